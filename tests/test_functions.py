"""Figures, identifiers, calculation, sources and streaming on small inputs."""

from __future__ import annotations

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import calc, figures, identifiers
from tallyforge.functions import text as tx
from tallyforge.operators import relational, sheet
from tallyforge.sources import csv_text, events, sinks, xlsx
from tallyforge.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("revenue of ₹1,250.50 crore", [("number", "INR", 12505000000.0)]),
    ("grew 12.5% and 40 bps", [("number", "PCT", 12.5), ("number", "BPS", 40.0)]),
    ("(1,234) loss", [("number", "PLAIN", -1234.0)]),
    ("on 2024-03-31", [("date", "DATE", 20240331.0)]),
    ("31 March 2024", [("date", "DATE", 20240331.0)]),
    ("31/03/2024", [("date", "DATE", 20240331.0)]),
    ("12/31/2024", [("date", "DATE", 20241231.0)]),
    ("Mar 2024", [("date", "DATE", 20240300.0)]),
    ("FY24", [("period", "DATE", 20240000.0)]),
    ("in 2023", [("year", "DATE", 20230000.0)]),
    ("3 deals", [("number", "COUNT", 3.0)]),
    ("see page 12", [("locator", "PLAIN", 12.0)]),
    ("5.2x leverage", [("number", "MULTIPLE", 5.2)]),
    ("2011-12", [("period", "DATE", 20120000.0)]),
    ("USD 5-7 million", [("number", "USD", 5e6), ("number", "USD", 7e6)]),
    ("https://a.b/2024 x", []),
    (None, None),
    ("", []),
])
def test_figures(spark, text, want):
    got = one(spark, figures.figures(F.lit(text).cast("string")))
    assert want == (None if got is None else [(f["kind"], f["unit"], None if f["value"] is None else float(f["value"])) for f in got])


@pytest.mark.parametrize("text,types", [
    ("PAN ABCDE1234F", ["PAN"]), ("card 4111 1111 1111 1111", ["CARD"]), ("4111 1111 1111 1112 card", []), ("a/c 123456789012", ["BANK_ACCOUNT"]),
    ("pay x.y@ybl now", ["UPI_ID"]), ("mail x.y@example.com", []), ("passport A1234567", ["PASSPORT"]), ("A1234567", []), ("voter id ABC1234567", ["VOTER_ID"]),
    ("IN30012345678901", ["DEMAT_ID"]), ("on 31/03/2025", []), ("", []), ("ＡＢＣＤＥ１２３４Ｆ", ["PAN"]),
])
def test_identifiers(spark, text, types):
    assert [f["type"] for f in one(spark, identifiers.detect(F.lit(text)))] == types
    masked = one(spark, identifiers.mask(F.lit(text)))
    assert masked.count("[") == len(types)
    assert one(spark, identifiers.mask(F.lit(masked))) == masked


def test_calc(spark):
    assert one(spark, calc.growth(F.lit(-200.0), F.lit(100.0)))["value"] == 150.0
    assert one(spark, calc.growth(F.lit(0.0), F.lit(1.0)))["error_code"] == calc.ZERO_DENOMINATOR
    assert one(spark, calc.cagr(F.lit(100.0), F.lit(0.0), F.lit(3.0)))["value"] == -100.0
    assert one(spark, calc.cagr(F.lit(-1.0), F.lit(5.0), F.lit(3.0)))["error_code"] == calc.NEGATIVE_BASE
    exact = one(spark, calc.exact(F.lit("ratio"), F.array(F.lit("1"), F.lit("3")), F.lit(None).cast("string")))
    assert exact["value"] == "0." + "3" * 34
    assert one(spark, calc.display(F.lit(-1234.565), "PCT")) == "−1,234.57%"
    assert one(spark, calc.label_year(F.lit("FY22"))) == 2022 and one(spark, calc.label_year(F.lit("Q1"))) is None
    assert one(spark, calc.scale_factor(F.lit("Lakh  Crore"))) == 1e12
    assert one(spark, calc.same_unit(F.lit("INR"), F.lit("USD"))) == calc.INCOMPATIBLE_UNITS
    assert one(spark, calc.same_unit(F.lit("PLAIN"), F.lit("COUNT"))) is None


def test_text(spark):
    assert one(spark, tx.luhn_valid(F.lit("4111111111111111"))) and not one(spark, tx.luhn_valid(F.lit("4111111111111112")))
    assert one(spark, tx.indian_grouping(F.lit(123456789))) == "12,34,56,789" and one(spark, tx.indian_grouping(F.lit(-999))) == "-999"
    a = one(spark, tx.a1_range(F.lit("'My sheet'!B2:AA10")))
    assert (a["sheet"], a["c0"], a["r0"], a["c1"], a["r1"]) == ("My sheet", 2, 2, 27, 10)
    assert one(spark, tx.parse_numeral(F.lit("1,00,000.50")))["decimals"] == 2


def test_sheet_metamorphic(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 5.0)], "k int, c string, v double")
    wide = sheet.pivot(rows, ["k"], "c", ["a", "b"], F.sum("v"))
    back = sheet.unpivot(wide, ["k"], ["a", "b"], "c", "v").where("v <> 0")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert sheet.deduplicate(sheet.deduplicate(rows)).count() == 3
    assert sheet.group_aggregate(rows, ["k"], {"s": ("sum", "v")}).agg(F.sum("s")).first()[0] == 10.0


def test_security_admits_nothing_without_membership(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8)], "space int, owner int")
    members = spark.createDataFrame([(1, 7), (2, 7)], "space_id int, user_id int")
    assert relational.secured(rows, members, 9, "space").count() == 0
    assert relational.secured(rows, members, 7, "space").count() == 2
    assert relational.secured(rows, members, 7, "space", "owner").count() == 1


def test_fair_claims_alternate(spark):
    at = datetime.datetime(2024, 1, 1)
    jobs = [(i, u, 1, at) for i, u in enumerate("AAAAAB")]
    order, served = [], []
    for n in range(6):
        left = spark.createDataFrame([j for j in jobs if j[0] not in [o[0] for o in order]], "id int, user_id string, priority int, run_after timestamp")
        done = spark.createDataFrame(served, "user_id string, started_at timestamp")
        job = relational.claim_fair(left, done, F.lit(at)).first()
        order.append((job["id"], job["user_id"]))
        served.append((job["user_id"], at + datetime.timedelta(minutes=n)))
    assert "".join(u for _, u in order) == "ABAAAA"


def test_range_join_over_zero_and_magnitudes(spark):
    values = spark.createDataFrame([("N", float(v)) for v in (-1000, -5, -0.5, 0, 0.25, 3, 999, 1e9, 1e14)], "dim string, key double")
    spans = spark.createDataFrame([(1, "N", -6.0, 4.0), (2, "N", 0.0, 0.3), (3, "N", 9e8, 2e9), (4, "N", -2000.0, -1.0), (5, "M", 0.0, 9.0)], "id int, dim string, lo double, hi double")
    got = sorted((r["id"], r["key"]) for r in relational.range_join(values, spans).collect())
    want = sorted((s["id"], v["key"]) for s in spans.collect() for v in values.collect() if s["dim"] == v["dim"] and s["lo"] <= v["key"] < s["hi"])
    assert got == want


def test_csv_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,Zoë\n2\n".encode())
    (tmp_path / "b.csv").write_bytes("id,name\n3,Zoë\n".encode("cp1252"))
    df = csv_text.read_csv_text(spark, str(tmp_path / "a.csv"), ["id", "name"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "Zoë"), ("2", None)]
    got = {r["path"][-5:]: r["encoding"] for r in csv_text.sniff_encodings(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "UTF-8", "b.csv": "windows-1252"}
    out = spark.createDataFrame([(2, "=1+1", 1.5), (1, "x", 2.0)], "k int, t string, v double")
    assert [r["t"] for r in sinks.guarded(out).orderBy("k").collect()] == ["x", "'=1+1"]
    assert [r[0] for r in sinks.csv_lines(out, ["k"], "CONFIDENTIAL").collect()] == ["k,t,v", "1,x,2.00", "2,=1+1,1.50", "# CONFIDENTIAL"]
    made = sinks.write_output(out, str(tmp_path / "out")).collect()
    assert made and all(len(r["sha256"]) == 64 and r["length"] > 0 for r in made)


def test_xlsx(spark, tmp_path):
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="P&amp;L" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si><si><r><t>A</t></r><r><t>B</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2"><f>A2*2</f></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    df = xlsx.read_xlsx(spark, str(tmp_path))
    assert df.where("error IS NOT NULL").count() == 1
    assert {r["row"]: r["values"] for r in xlsx.sheet_rows(df).collect()} == {1: ["Name", None, "AB"], 2: ["1.5", "2024-01-01"]}
    assert xlsx.uncached_formulas(df).first()["uncached"] == 1


def test_sse(spark):
    raw = spark.createDataFrame([(1, "﻿event: delta\r\ndata: a\r\ndata: b\r\n\r\n: note\n\ndata: c\n\n")], "id int, raw string")
    assert [(r["name"], r["data"]) for r in events.parse_sse(raw, "id", "raw").orderBy("seq").collect()] == [("delta", "a\nb"), ("message", "c")]


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(u, at + datetime.timedelta(minutes=m)) for u in "ab" for m in (0, 1, 2, 200)]
    spark.createDataFrame(rows, "user string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    windows.write_once(windows.rate_limit(stream, "user", "1 hour", 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["user"], r["n"], r["allowed"]) for r in got.where("n = 3").collect()) == [("a", 3, False), ("b", 3, False)]
    turns = [(1, 1, "delta", "x"), (1, 2, "delta", "y"), (1, 3, "replace", "z"), (1, 4, "delta", "!"), (1, 5, "done", None), (2, 1, "delta", "q")]
    spark.createDataFrame(turns, "conv int, seq int, action string, text string").coalesce(1).write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema("conv int, seq int, action string, text string").parquet(str(tmp_path / "turns"))
    q = windows.fold_turns(stream, "conv", "seq", "action", "text").writeStream.outputMode("update").format("memory").queryName("turns").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["conv"], r["body"], r["done"]) for r in spark.table("turns").collect()) == [(1, "z!", True), (2, "q", False)]


def test_keyed_hash_and_cursors(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        assert one(spark, tx.keyed_hash(F.lit("é value"), key)) == hmac.new(key, "é value".encode(), hashlib.sha256).hexdigest()
    assert one(spark, tx.decode_cursor(tx.encode_cursor(F.lit("2024-01-02"), F.lit(7)), "date", "int")) == (datetime.date(2024, 1, 2), 7)
    for bad in ("", "a", "!!!!", "MTIz", None):
        assert one(spark, tx.decode_cursor(F.lit(bad).cast("string"), "date", "int")) is None


def test_calc_words(spark):
    assert one(spark, calc.inferred_years(F.lit("FY20"), F.lit("FY24")))["value"] == 4 and one(spark, calc.inferred_years(F.lit("a"), F.lit("b")))["error_code"] == calc.INVALID_YEARS
    assert one(spark, calc.formula("growth", [calc.operand(F.lit(-80.0), 1), calc.operand(F.lit(1250.0), 1)], F.lit("x"))) == "(1,250.0 − (−80.0)) ÷ |(−80.0)| × 100 = x"
    assert one(spark, calc.formula("cagr", [F.lit("a"), F.lit("b")], F.lit("x"), F.lit(3))) == "((b ÷ a)^(1 ÷ 3) − 1) × 100 = x"
    assert one(spark, calc.formula("mean", [F.lit("a"), F.lit("b")], F.lit("x"))) == "(a + b) ÷ 2 = x" and one(spark, calc.as_source(F.lit(1.5), "PCT"))["text"] == "1.5000000000"
