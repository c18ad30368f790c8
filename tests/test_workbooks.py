"""Workbooks read whole, in part and with comments, result workbooks written by several tasks, grids with headers, encrypted columns."""

from __future__ import annotations

import datetime
import decimal
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import crypto
from tallyforge.sources import workbook, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def relations(*rows):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{t}" Target="{x}"/>' for i, t, x in rows) + "</Relationships>"


@pytest.fixture
def book(tmp_path):
    """Two sheets, one hidden; durations, dates, comments of two authors and one without."""
    path = tmp_path / "book.xlsx"
    rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}"><v>{r * 10 + k}</v></c>' for k, c in enumerate("ABCDE", 1)) + "</row>" for r in range(2, 60))
    sheet = f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" s="1"><v>1.5</v></c><c r="B1" s="2"><v>45292.25</v></c><c r="C1" s="3"><v>0.25</v></c><c r="D1"><f>A1</f></c><c><v>5</v></c></row>{rows}</sheetData></worksheet>'
    comments = f'<comments {MAIN}><authors><author>Ann</author><author/></authors><commentList><comment ref="B2" authorId="0"><text><r><t>two </t></r><r><t>runs</t></r></text></comment><comment ref="C40" authorId="1"><text><t>x</t></text></comment><comment ref="D3" authorId="9"><text><t>y</t></text></comment></commentList></comments>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{OFFICE}"><sheets><sheet name="P&amp;L" sheetId="1" r:id="r1"/><sheet name="It\'s" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", relations(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "/xl/worksheets/sheet2.xml")))
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="[h]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="22"/><xf numFmtId="46"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {MAIN}><sheetData><row><c><v>1</v></c><c/><c t="inlineStr"><is><t>no refs</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", relations(("c", "comments", "../comments1.xml")))
        z.writestr("xl/comments1.xml", comments)
    return str(path)


def test_cells_and_comments_in_one_pass(spark, book):
    whole = xlsx.read_workbooks(spark, book)
    assert sorted((r["sheet"], r["ref"], r["text"], r["author"]) for r in xlsx.comments_of(whole).collect()) == [("P&L", "B2", "two runs", "Ann"), ("P&L", "C40", "x", None), ("P&L", "D3", "y", None)]
    first = {r["ref"]: (r["kind"], r["text"], r["number"], r["formula"]) for r in xlsx.cells_of(whole).where("row = 1 and not hidden").collect()}
    assert first == {"A1": ("duration", None, 129_600.0, False), "B1": ("date", "2024-01-01T06:00:00", None, False), "C1": ("duration", None, 21_600.0, False), "D1": ("blank", None, None, True), "E1": ("number", None, 5.0, False)}
    assert {(r["ref"], r["text"], r["number"]) for r in xlsx.read_xlsx(spark, book).where("hidden").collect()} == {("A1", None, 1.0), ("C1", "no refs", None)}
    assert xlsx.read_xlsx(spark, book).columns == [c.split()[0] for c in xlsx.CELLS.split(", ")]


def test_a_range_is_read_without_the_rest(spark, book, monkeypatch):
    got = xlsx.read_range(spark, book, "'P&L'!$B$3:D2")
    assert {(r["ref"], r["number"]) for r in got.where("kind = 'number'").collect()} == {(f"{c}{r}", float(r * 10 + k)) for r in (2, 3) for k, c in enumerate("BCD", 2)}
    assert sorted(r["ref"] for r in xlsx.comments_of(got).collect()) == ["B2", "D3"]
    assert [r["text"] for r in xlsx.read_range(spark, book, "'It''s'!C1").collect()] == ["no refs"]
    assert [r["number"] for r in xlsx.read_range(spark, book, "A1").collect()] == [129_600.0] and xlsx.read_range(spark, book, "None!A1:Z99").count() == 0
    with pytest.raises(ValueError):
        xlsx.read_range(spark, book, "A:B")
    parsed, value = [], xlsx._value
    monkeypatch.setattr(xlsx, "_value", lambda *a: parsed.append(1) or value(*a))
    assert len([*xlsx.cells("x", open(book, "rb").read(), (None, 2, 2, 4, 3))]) == 8 and len(parsed) == 6  # six cells of 295


def test_a_broken_file_is_a_row(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    assert [(r["kind"], r["error"]) for r in xlsx.read_xlsx(spark, str(tmp_path / "bad.xlsx")).collect()] == [(None, "BadZipFile")]


OPERATIONS = json.dumps([{"operation": "filter", "parameters": {"b": 1, "a": "<x>"}, "at": "2024-01-01T00:00:00Z"}, {"operation": "sort"}])
NOTES = json.dumps([{"kind": "source", "text": "book.xlsx"}, {"kind": "confidential", "text": "user a & b"}])


def result(spark, n):
    rows = [(i, f'text {i} <&"> =1+1\nline', i / 4, i % 2 == 0, datetime.date(2024, 1, 1 + i % 28), decimal.Decimal(i) / 8, None if i % 3 else "x\0y") for i in range(n)]
    return spark.createDataFrame(rows, "id int, t string, d double, b boolean, day date, m decimal(10,3), z string").repartitionByRange(3, "id"), rows


def test_result_workbook_is_read_back(spark, tmp_path):
    workbook.register(spark)
    df, rows = result(spark, 100)
    path = f"{tmp_path}/out.xlsx"
    df.write.format("workbook").option("operations", OPERATIONS).option("notes", NOTES).mode("append").save(path)
    assert os.listdir(tmp_path) == ["out.xlsx"]
    cells = {(r["sheet"], r["row"], r["col"]): r["text"] if r["number"] is None else r["number"] for r in xlsx.read_xlsx(spark, path).collect()}
    want = {("Result", 1, k): c for k, c in enumerate(df.columns, 1)}
    for i, r in enumerate(rows, 2):
        values = [float(r[0]), r[1], r[2], str(r[3]).lower(), r[4].isoformat(), float(r[5]), r[6] and "xy"]
        want |= {("Result", i, k): v for k, v in enumerate(values, 1) if v is not None}
    want |= {("Operations", 1, k): c for k, c in enumerate(("step", "operation", "parameters", "at"), 1)}
    want |= {("Operations", 2, 1): 1.0, ("Operations", 2, 2): "filter", ("Operations", 2, 3): '{"a": "<x>", "b": 1}', ("Operations", 2, 4): "2024-01-01T00:00:00Z", ("Operations", 3, 1): 2.0, ("Operations", 3, 2): "sort", ("Operations", 3, 3): "{}"}
    want |= {("Notes", r, c): v for r, row in enumerate((("note", "text"), ("source", "book.xlsx"), ("confidential", "user a & b")), 1) for c, v in enumerate(row, 1)}
    assert cells == want


def test_full_sheets_go_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST", 41)
    writer = workbook.WorkbookWriter(spark.range(0).schema, {"path": f"{tmp_path}/x.xlsx"}, False)
    with zipfile.ZipFile(tmp_path / "z", "w") as z:
        assert writer._write_sheets(z, (workbook._row([k]) for k in range(100))) == ["Result", "Result (2)", "Result (3)", "Operations", "Notes"]
        assert [z.read(f"xl/worksheets/sheet{k}.xml").count(b"<row>") for k in range(1, 6)] == [41, 41, 21, 1, 1]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    workbook.register(spark)
    df, _ = result(spark, 50)
    broken = df.withColumn("z", F.when(F.col("id") == 49, F.raise_error(F.lit("boom"))).otherwise("fine"))
    with pytest.raises(Exception, match="boom"):
        broken.write.format("workbook").mode("append").save(f"{tmp_path}/out.xlsx")
    assert os.listdir(tmp_path) == []
    df.write.format("workbook").mode("append").save(f"{tmp_path}/out.xlsx")
    before = os.stat(f"{tmp_path}/out.xlsx").st_size
    with pytest.raises(Exception):  # it is there already
        df.limit(1).write.format("workbook").mode("append").save(f"{tmp_path}/out.xlsx")
    assert os.listdir(tmp_path) == ["out.xlsx"] and os.stat(f"{tmp_path}/out.xlsx").st_size == before
    df.limit(1).write.format("workbook").mode("overwrite").save(f"{tmp_path}/out.xlsx")
    assert xlsx.read_xlsx(spark, f"{tmp_path}/out.xlsx").where("sheet = 'Result' and col = 1").count() == 2


def test_grid_records(spark):
    """Two levels of headers above, two beside, with spans; a header below a cell isn't its own."""
    cells = [
        ("t", 0, 0, 2, 2, "corner", True), ("t", 0, 2, 1, 2, "2023", True), ("t", 0, 4, 1, 1, "2024", True), ("t", 1, 2, 1, 1, "H1", True), ("t", 1, 3, 1, 1, "H2", True), ("t", 1, 4, 1, 1, "H1", True),
        ("t", 2, 0, 2, 1, "Sales", True), ("t", 2, 1, 1, 1, "North", True), ("t", 3, 1, 1, 1, "South", True), ("t", 2, 2, 1, 1, "1", False), ("t", 2, 3, 1, 2, "2", False), ("t", 3, 2, 1, 1, "3", None), ("t", 4, 2, 1, 1, "foot", True), ("u", 0, 0, 1, 1, "only", False),
    ]
    df = spark.createDataFrame(cells, "table string, row int, col int, row_span int, col_span int, text string, header boolean")
    got = {(r["table"], r["row"], r["col"]): (r["text"], r["above"], r["beside"]) for r in xlsx.grid_records(df, "table").collect()}
    north, south = ["Sales", "North"], ["Sales", "South"]
    assert got == {("t", 2, 2): ("1", ["2023", "H1"], north), ("t", 2, 3): ("2", ["2023", "H2"], north), ("t", 2, 4): ("2", ["2024", "H1"], north), ("t", 3, 2): ("3", ["2023", "H1"], south), ("u", 0, 0): ("only", [], [])}


# -- encryption

OLD, NEW = bytes(range(32)), bytes(range(1, 33))


@pytest.fixture
def sealed(spark):
    rows = [("a", 1, "PAN ABCPK4321L", 1.5), ("a", 2, None, None), ("b", 3, "", -2.0), ("b", 4, "PAN ABCPK4321L", 1.5)]
    df = spark.createDataFrame(rows, "sheet string, id int, note string, amount double")
    keys = crypto.new_keys(df.select("sheet"), OLD)
    return df, keys, crypto.written(crypto.encrypted(df, "sheet", ["note", "amount"], keys, OLD), "sealed")


KINDS = {"note": "string", "amount": "double"}


def test_round_trip(spark, sealed):
    df, keys, hidden = sealed
    assert sorted(crypto.decrypted(hidden, "sheet", KINDS, keys, OLD).collect()) == sorted(df.collect())
    notes = [r["note"] for r in hidden.collect() if r["note"] is not None]
    assert len({bytes(x) for x in notes}) == 3 and not any(b"PAN" in bytes(x) for x in notes)  # equal values look different
    assert {len(bytes(r["wrapped"])) for r in keys.collect()} == {12 + 32 + 16} and len({bytes(r["wrapped"]) for r in keys.collect()}) == 2
    assert keys.collect() == keys.collect()


def test_what_is_moved_cannot_be_read(spark, sealed):
    df, keys, hidden = sealed
    for moved in (hidden.withColumn("sheet", F.lit("a")), hidden.withColumn("amount", F.col("note")), hidden.withColumn("note", F.concat("note", F.lit(b"x")))):
        with pytest.raises(Exception):
            crypto.decrypted(moved, "sheet", KINDS, keys, OLD).collect()
    swapped = keys.withColumn("sheet", F.translate("sheet", "ab", "ba"))
    for k, master in ((swapped, OLD), (keys, NEW)):
        with pytest.raises(Exception):
            crypto.decrypted(hidden, "sheet", KINDS, k, master).collect()
    with pytest.raises(Exception, match="no key for sheet c"):
        crypto.encrypted(df.withColumn("sheet", F.lit("c")), "sheet", ["note"], keys, OLD).collect()
    with pytest.raises(ValueError):
        crypto.new_keys(df, b"short")


def test_rotation_leaves_the_data(spark, sealed):
    df, keys, hidden = sealed
    fresh = crypto.written(crypto.rotated(keys, OLD, NEW), "keys")
    assert {r["version"] for r in fresh.collect()} == {2}
    assert sorted(crypto.decrypted(hidden, "sheet", KINDS, fresh, NEW).collect()) == sorted(df.collect())
    with pytest.raises(Exception):
        crypto.decrypted(hidden, "sheet", KINDS, fresh, OLD).collect()
