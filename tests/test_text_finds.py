"""Identifiers and figures over tables of short texts: what is found, what is not, and what masking leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import figures, identifiers

AADHAAR = next(f"4{n:010d}{c}" for n in range(1234567890, 1234567891) for c in "0123456789" if identifiers.verhoeff(f"4{n:010d}{c}"))
CARD = "5500005555555559"
FOUND = [
    ("holder ABCPK4321L signed", "PAN", "ABCPK4321L"), ("pan: abcpk4321l", "PAN", "abcpk4321l"), ("PAN no. ABCPK-4321-L", "PAN", "ABCPK-4321-L"), ("PAN ABCPK 4321 L", "PAN", "ABCPK 4321 L"),
    (f"no. {AADHAAR}", "AADHAAR", AADHAAR), (f"({AADHAAR[:4]}-{AADHAAR[4:8]}-{AADHAAR[8:]})", "AADHAAR", f"{AADHAAR[:4]}-{AADHAAR[4:8]}-{AADHAAR[8:]}"),
    ("Aadhaar XXXX XXXX 4321", "AADHAAR", "XXXX XXXX 4321"), ("UIDAI ********4321", "AADHAAR", "********4321"), ("xxxx-xxxx-4321 (aadhaar)", "AADHAAR", "xxxx-xxxx-4321"),
    ("a/c no. 00123456789", "BANK_ACCOUNT", "00123456789"), ("567890123456 is my account", "BANK_ACCOUNT", "567890123456"), ("ac. no. 98765432101", "BANK_ACCOUNT", "98765432101"),
    ("in30123456789012", "DEMAT_ID", "in30123456789012"), ("DP ID IN301234-56789012", "DEMAT_ID", "IN301234-56789012"), ("cdsl 12012345 67890123", "DEMAT_ID", "12012345 67890123"),
    (f"card {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]}", "CARD", f"{CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]}"), ("amex 3782 822463 10005", "CARD", "3782 822463 10005"),
    ("to a.b-c_d@okaxis now", "UPI_ID", "a.b-c_d@okaxis"), ("upi id ravi@oksbi.", "UPI_ID", "ravi@oksbi"), ("pay ravi＠ybl", "UPI_ID", "ravi＠ybl"),
    ("travel document P7654321", "PASSPORT", "P7654321"), ("passport no Z 1234567", "PASSPORT", "Z 1234567"), ("Voter-ID ABC/1234567", "VOTER_ID", "ABC/1234567"),
]
CLEAN = [
    "GSTIN 27ABCPK4321L1Z5", "ABCPK 4321 L", "XABCPK4321L", "CIN L17110MH1973PLC019786", "ISIN INE002A01018", "NSE: ABCPK4321L", "Rs 234567890124 deposited at the bank", "account of 1234567890 crore",
    "XXXX XXXX 4321", "aadhaar card XXXX XXXX XXXX 4321", f"aadhaar {AADHAAR}5", "account 12345678", "account 123456789.50", "account" + " filler" * 6 + " 123456789", "4111 1111-1111 1111", "0000 0000 0000 0000",
    "cfo@company.com", "ravi@ybl.in", "ravi@yblx", "passport AB1234567", "voter ABCD1234567", "Call the bank on +91 22 6000 0000", "Mobile +919876543210, account manager", "on 2025-03-31", "", None,
]


def test_identifiers_found(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(FOUND)], "id int, text string").select("id", identifiers.detect(F.col("text")).alias("f"))
    got = {r["id"]: [(f["type"], FOUND[r["id"]][0][f["start"] : f["end"]]) for f in r["f"]] for r in rows.collect()}
    assert got == {i: [(kind, said)] for i, (_, kind, said) in enumerate(FOUND)}


def test_identifiers_clean_and_masked(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN)], "id int, text string")
    for r in rows.select("text", identifiers.detect(F.col("text")).alias("f"), identifiers.mask(F.col("text")).alias("m")).collect():
        assert (r["f"] or []) == [] and r["m"] == r["text"] and (r["f"] is None) == (r["text"] is None)
    rows = spark.createDataFrame([(t, t.replace(said, f"[{kind}]")) for t, kind, said in FOUND] + [("é passport A1234567, a/c 123456789012 é", "é passport [PASSPORT], a/c [BANK_ACCOUNT] é")], "text string, want string")
    assert all(r["m"] == r["want"] for r in rows.select("want", identifiers.mask(F.col("text")).alias("m")).collect())
    mine = spark.createDataFrame([("pay x.y@mybank and z@ybl",)], "text string").select(identifiers.mask(F.col("text"), ["mybank"]).alias("m")).first()["m"]
    assert mine == "pay [UPI_ID] and z@ybl"


@pytest.mark.parametrize("text,want", [
    ("31/02/2025", [("amount", "31"), ("amount", "02"), ("amount", "2025")]), ("31 Feb 2025", [("amount", "31"), ("amount", "2025")]),
    ("2025-03", [("date", "2025-03")]), ("2011-12", [("period", "2011-12")]), ("pages 3-5 and sections 2 and 4", [("locator", "pages 3-5"), ("locator", "sections 2 and 4")]),
    ("as in [3, 4]", [("locator", "[3, 4]")]), ("४५", []), ("version 3.2.1", []), ("COVID-19", []), ("9MFY26 and H1FY26E", [("period", "9MFY26"), ("period", "H1FY26E")]),
    ("Sheet1!B2:F20", [("cell", "Sheet1!B2:F20")]), ("12 crores rupees", [("amount", "12 crores rupees")]), ("(₹5 cr) (5)", [("amount", "₹5 cr"), ("amount", "(5)")]),
    ("* 2) two\n3. three", [("list_marker", "2"), ("list_marker", "3")]), ("1,2,3 1,234,56", [("amount", "1"), ("amount", "2"), ("amount", "3"), ("amount", "1,234"), ("amount", "56")]),
])
def test_figures_as_written(text, want):
    found = [f for f in figures.scan(text)]
    assert [(f[0], f[3]) for f in found] == want and all(text[f[1] : f[2]] == f[3] for f in found)


GROUNDING = [
    ("₹3,120 cr", "₹3,120.37 cr", "matched"), ("₹3,100 cr", "₹3,120.37 cr", "not_found"), ("₹3,120.37 cr", "₹3,120 cr", "not_found"), ("₹3,120 cr", "₹3,119.5 cr", "matched"), ("₹3,120 cr", "₹3,120.5 cr", "not_found"),
    ("₹31,200 million", "₹3,120 crore", "matched"), ("31.2 bn", "₹3,120 crore", "matched"), ("₹1 lakh", "₹1,00,000", "matched"), ("$7m", "USD 7 million", "matched"), ("3,120", "₹3,120 cr", "matched"),
    ("$3,120 cr", "₹3,120 cr", "cross_currency"), ("₹3,120 cr", "3,120 cr", "not_found"), ("135 bps", "1.35%", "matched"), ("50 bps", "0.6%", "not_found"), ("13.5%", "13.5x", "not_found"), ("5.4x", "5.4 times", "matched"),
    ("-15%", "-15%", "matched"), ("-15%", "15%", "not_found"), ("(1,357)", "1,357", "matched"), ("(1,357)", "-1,357", "matched"), ("-1,357", "1,357", "not_found"),
    ("30 June 2024", "2024-06-30", "matched"), ("June 2024", "30/06/2024", "matched"), ("30 June 2024", "June 2024", "not_found"), ("2024", "FY2024", "matched"), ("2024", "2,024", "not_found"), ("2,024", "in 2024", "not_found"),
    ("5 deals", "", "exempt"), ("page 12", "", "exempt"), ("FY31", "", "exempt"),
]


def test_grounding(spark):
    from tallyforge.operators import grounding

    answers = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(GROUNDING)], "id int, text string")
    sources = spark.createDataFrame([(i, s) for i, (_, s, _) in enumerate(GROUNDING)], "id int, text string")
    got = {r["id"]: r["reason"] for r in grounding.verdicts(answers, sources).collect()}
    assert {i: (a, s, got.get(i)) for i, (a, s, w) in enumerate(GROUNDING) if got.get(i) != w} == {}
    cell = spark.createDataFrame([(0, "3,120", "INR", "crore"), (1, "3,120", "INR", "crore"), (2, "12.5", None, None), (3, "12.5", "PCT", None)], "id int, text string, unit string, scale string")
    asked = spark.createDataFrame([(0, "₹3,120 cr"), (1, "₹3,120"), (2, "12.5%"), (3, "12.5%")], "id int, text string")
    assert {r["id"]: r["reason"] for r in grounding.verdicts(asked, cell).collect()} == {0: "matched", 1: "not_found", 2: "not_found", 3: "matched"}


def test_range_join_by_widths(spark):
    from tallyforge.operators import relational

    values = spark.createDataFrame([(d, float(k)) for d in "ab" for k in (-1000, -50, -0.5, 0, 0.25, 49, 50, 1e12)], "dim string, key double")
    spans = spark.createDataFrame([(1, "a", -50.0, 50.0), (2, "a", 0.0, 1e-12), (3, "b", -1e13, 1e13), (4, "b", 50.0, 50.0), (5, "a", 49.0, 50.0)], "id int, dim string, lo double, hi double")
    got = sorted((r["id"], r["dim"], r["key"]) for r in relational.range_join(values, spans).collect())
    want = sorted((i, d, k) for i, d, lo, hi in map(tuple, spans.collect()) for e, k in map(tuple, values.collect()) if d == e and lo <= k < hi)
    assert got == want


def test_budget_choice(spark):
    from tallyforge.operators import ordered

    rows = [("x", i, s) for i, s in enumerate((50, 30, 40, 10, 60))] + [("y", 0, 200)]
    got = ordered.budget_choice(spark.createDataFrame(rows, "doc string, place int, size int"), "doc", ["size"], "place", "size", 85).collect()
    assert sorted((r["doc"], r["place"], r["turn"]) for r in got) == [("x", 1, 1), ("x", 2, 2), ("x", 3, 3)]


def test_versions_and_long_rows_of_numbers():
    import time

    raws = lambda text: [x[figures.FIELDS.index("raw")] for x in figures.scan(text)]
    assert raws("v1.2.3 and 1.2.3.4") == [] and raws("v1.25 of 3.5") == ["3.5"]
    assert raws("1,234,567 12,34,567 1,2,3 1234,567 12,34,567,890 12,34,56") == ["1,234,567", "12,34,567", "1", "2", "3", "12", "34", "56"]
    took = []
    for n in (2_000, 8_000):
        for row in ("1,", "1,11,", "111,", "1,111,111.1.", "1,11,11,11,111."):
            began = time.perf_counter()
            assert raws(row * n) is not None
            took.append(time.perf_counter() - began)
    assert max(took) < 3
    assert raws("," .join(["11"] * 400)) == [] and raws("9," + ",".join(["999"] * 8)) == ["9," + ",".join(["999"] * 8)]


def test_dates_have_days_and_parts_of_years():
    kinds = lambda text: [(x[0], x[3]) for x in figures.scan(text)]
    assert kinds("March 31, 2025") == [("date", "March 31, 2025")] and ("date", "March 45, 2025") not in kinds("March 45, 2025")
    assert kinds("Q4 FY26, 4Q FY26, H2 2025, 2H FY25") == [("period", x) for x in ("Q4 FY26", "4Q FY26", "H2 2025", "2H FY25")] and not [k for k, _ in kinds("Q5 H3") if k == "period"]
    assert kinds("31 - March. 2025") == [("date", "31 - March. 2025")] and kinds(f"'{'x' * 31}'!A1 'a[b'!C3:D4")[0] == ("cell", f"'{'x' * 31}'!A1")


def test_exempt_by_context(spark):
    rows = [("fiscal 2025", True), ("Financial Year: 2025", True), ("FY '2025", True), ("2025 fiscal", True), ("2025 calendar year", True), ("2025, calendar year", False), ("in 2025", False), ("fiscally 2025", False), ("2025 years", False), ("[up 2025](cite:a/b#2)", True), ("[x](cite:a) 2025", False), ("[2025](http://x)", False), ("a [1](cite:q) b [2025 z](cite:r)", True)]
    df = spark.createDataFrame(rows, "text string, want boolean").select("text", "want", F.explode(figures.figures(F.col("text"))).alias("f")).where("f.kind = 'year'")
    got = {r["text"]: r["e"] for r in df.select("text", figures.is_exempt(F.col("f"), F.col("text")).alias("e")).collect()}
    want = {t: w for t, w in rows if t in got}
    assert got == want and len(got) >= 8


def test_harmless_symbols_and_times(spark):
    rows = ["NSE - ABCDE1234F", "BSE: ABCDE1234F", "NSE-ABCDE1234F", "ABCDE1234F.NS", "at 2024-01-01T10:22:33.123456", "tel (022) 2345 6789 01", "+91 98765-43210 12", "phone: 080-23456789"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    found = df.select("i", F.size(identifiers.detect(F.col("text"))).alias("n")).where("n > 0").collect()
    assert found == []


def test_check_characters(spark):
    from tallyforge.functions import text as tx

    rows = [("27AAPFU0939F1ZV", "US0378331005"), ("27AAPFU0939F1ZW", "US0378331006"), ("27aapfu0939f1zv", "US037833100"), (None, None), ("", ""), ("29AAGCB7383J1Z4", "INE009A01021")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "g string, i string").select(tx.gstin_valid(F.col("g")), tx.isin_valid(F.col("i"))).collect()]
    assert got == [(True, True), (False, False), (False, False), (None, None), (False, False), (True, True)]


def test_superscripts_do_not_stop_the_scan():
    assert [f[3] for f in figures.scan("5² and 3² of 7")] == ["5", "3", "7"] and [f[3] for f in figures.scan("unimportant Sheet1!A1, x, page 3")] == ["Sheet1!A1", "page 3"]


def test_figures_one_by_one_are_those_of_the_list(spark):
    rows = [(1, "Up 12% to ₹1,200 crore in FY25, (3.5) at -2 bps"), (2, None), (3, "none"), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    listed = df.select("id", F.explode(figures.figures(F.col("text"))).alias("f")).select("id", "f.*")
    each = figures.each(df, "text", ["id"])
    assert each.columns == listed.columns and sorted(map(repr, each.collect())) == sorted(map(repr, listed.collect())) and each.count() > 4


def test_range_join_and_grounding_broadcast_no_bins(spark):
    from tallyforge.operators import relational

    values = spark.createDataFrame([("N", 1.0)], "dim string, key double")
    spans = spark.createDataFrame([(1, "N", 0.0, 4.0)], "id int, dim string, lo double, hi double")
    plan = relational.range_join(values, spans)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_equal_texts_are_read_once(monkeypatch):
    import pyarrow as pa

    read, scan = [], figures.scan
    monkeypatch.setattr(figures, "scan", lambda text: read.append(text) or scan(text))
    monkeypatch.setattr(figures, "REMEMBERED", 100)
    monkeypatch.setattr(figures, "_known", {})
    monkeypatch.setattr(figures, "_held", 0)
    find = getattr(figures.find_figures, "func", figures.find_figures)
    texts = ["up 5%", None, "", "up 7 bps", "up 5%", None, "₹3 cr and 4%"]
    got = find(pa.array(texts * 3, pa.string()))
    assert read == ["up 5%", "", "up 7 bps", "₹3 cr and 4%"] and got.to_pylist() == [None if t is None else [dict(zip(figures.FIELDS, x)) for x in scan(t)] for t in texts * 3]
    again = find(pa.array(["up 7 bps", "up 8 bps"] * 2, pa.string()))
    assert read[4:] in (["up 8 bps"], ["up 7 bps", "up 8 bps"]) and [len(x) for x in again.to_pylist()] == [1, 1, 1, 1]
    assert find(pa.array([None], pa.string())).to_pylist() == [None] and find(pa.array([], pa.string())).to_pylist() == []


def test_only_what_is_asked_is_listed(spark):
    """Entries of dimensions that no figure asks about are left out, and a value is listed for the widths of its own sort only."""
    from tallyforge.operators import grounding, relational

    sources = spark.createDataFrame([(1, "₹5 cr, 40% and 7 units"), (2, None)], "id int, text string")
    got = sorted((r["id"], r["dim"], r["key"]) for r in grounding.entries(sources, ["size:RATIO", "signed:MONEY:INR"]).collect())
    assert got == [(1, "signed:MONEY:INR", 5e7), (1, "size:RATIO", 40.0)] and grounding.entries(sources, []).count() == 0
    values = spark.createDataFrame([(f"{s}{i % 4}", i / 2) for i in range(60) for s in "ab"], "dim string, key double")
    spans = spark.createDataFrame([(i, f"{'ab'[i % 2]}{i % 4}", float(i), i + (0.5, 8.0)[i % 2]) for i in range(30)], "id int, dim string, lo double, hi double")
    rows = lambda df: sorted((r["id"], r["dim"], r["key"]) for r in df.collect())
    assert rows(relational.range_join(values, spans, lambda dim: F.substring(dim, 1, 1))) == rows(relational.range_join(values, spans)) != []
