"""The formula language against a small interpreter of its own, its rejections, and seeded random input."""

from __future__ import annotations

import datetime
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import types as T

from tallyforge.functions.formula import FormulaError, add_calculated_column, compile_formula, sheet_types

D = datetime.date
ROWS = [
    (100.0, 40.0, 7, 0, "North", True, 2.5, D(2024, 1, 1), D(2024, 1, 2), 1.5, 3.0, 1),
    (0.0, 0.0, 0, 0, "north", False, -2.5, D(2024, 1, 2), D(2024, 1, 2), -1.5, 0.0, 2),
    (None, 12.5, None, 0, "", None, 2.675, None, D(2024, 1, 1), 0.5, None, 3),
    (-50.0, 1e-9, -3, 0, None, True, 0.005, D(2024, 3, 1), D(2024, 1, 1), 99.995, -1.0, 4),
    (1.25e11, 98765432100.5, 1000000, 0, 'a "b" c', False, 15.0, D(2023, 12, 31), None, -0.5, 2.0, 5),
    (1.0, 3.0, 2, 0, "East", True, None, D(2024, 1, 1), D(2024, 1, 1), None, 9.0, 6),
]
NAMES = ["Revenue", "Cost", "Units", "Zero", "Region", "Active", "Margin %", "Day", "Day2", "Ünïcode name", "a]b", "*"]
KINDS = [T.DoubleType(), T.DoubleType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.DateType(), T.DateType(), T.DoubleType(), T.DoubleType(), T.LongType()]
SCHEMA = T.StructType([T.StructField(n, k) for n, k in zip(NAMES, KINDS)])
TYPES = sheet_types(SCHEMA)


def half_up(x, n):
    return None if x is None else float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


def lift(f):
    return lambda *a: None if None in a else f(*a)


add, mul, sub, less = lift(lambda a, b: a + b), lift(lambda a, b: a * b), lift(lambda a, b: a - b), lift(lambda a, b: a < b)
div = lift(lambda a, b: None if b == 0 else a / b)


def both(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


CASES = [
    ("[Revenue] - [Cost]", lambda r: sub(r["Revenue"], r["Cost"])),
    ("revenue+COST*2", lambda r: add(r["Revenue"], mul(r["Cost"], 2))),
    ("-[Units] + 1", lambda r: lift(lambda x: -x + 1)(r["Units"])),
    ("[Revenue] / [Zero]", lambda r: None),
    ("[Units] / 2", lambda r: div(r["Units"], 2)),
    ("7 / 2", lambda r: 3.5),
    ("2 - 3 - 4", lambda r: -5),
    ("[Revenue] < [Cost]", lambda r: less(r["Revenue"], r["Cost"])),
    ("[Day] < [Day2]", lambda r: less(r["Day"], r["Day2"])),
    ('[Region] = "north"', lambda r: lift(lambda x: x == "north")(r["Region"])),
    ('[Region] = "a ""b"" c"', lambda r: lift(lambda x: x == 'a "b" c')(r["Region"])),
    ("[Active] AND [Revenue] > 10", lambda r: both(r["Active"], lift(lambda x: x > 10)(r["Revenue"]))),
    ("NOT [Active]", lambda r: lift(lambda x: not x)(r["Active"])),
    ("[Active] OR TRUE", lambda r: True),
    ('IF([Active], "y", "n")', lambda r: lift(lambda x: "y" if x else "n")(r["Active"])),
    ("IF([Revenue] > 0, [Units], 1.5)", lambda r: lift(lambda x: (None if r["Units"] is None else float(r["Units"])) if x > 0 else 1.5)(r["Revenue"])),
    ("ROUND([Margin %])", lambda r: half_up(r["Margin %"], 0)),
    ("ROUND([Margin %], 2)", lambda r: half_up(r["Margin %"], 2)),
    ("ROUND([Units], 2)", lambda r: r["Units"]),
    ("ABS([Ünïcode name])", lambda r: lift(abs)(r["Ünïcode name"])),
    ("MIN([Revenue], [Cost], 5)", lambda r: min(x for x in (r["Revenue"], r["Cost"], 5.0) if x is not None)),
    ("MAX([Units])", lambda r: r["Units"]),
    ("[a]]b] + [*]", lambda r: add(r["a]b"], r["*"])),
    ("(1 + 2) * .5e1", lambda r: 15.0),
    ("9223372036854775808", lambda r: 9223372036854775808.0),
]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


@pytest.mark.parametrize("text,want", CASES, ids=[c[0] for c in CASES])
def test_value(sheet, text, want):
    got = [r["v"] for r in add_calculated_column(sheet, "v", text).select("v").collect()]
    for value, row in zip(got, (dict(zip(NAMES, r)) for r in ROWS)):
        expected = want(row)
        assert (value is None) == (expected is None), (row, value, expected)
        if isinstance(expected, float) and not isinstance(value, bool):
            assert math.isclose(value, expected, rel_tol=1e-12, abs_tol=1e-12)
        elif expected is not None:
            assert value == expected


@pytest.mark.parametrize("text,code", [
    ("", "syntax"), ("   ", "syntax"), ("1 +", "syntax"), ("1 < 2 < 3", "syntax"), ("[Revenue", "syntax"), ('"open', "syntax"), ("_x", "syntax"), ("a.b", "syntax"),
    ("1e999", "syntax"), ("ROUND(1, 2, 3)", "syntax"), ("IF(TRUE, 1)", "syntax"), ("MIN()", "syntax"), ("1 ; 2", "syntax"), ("lambda: 1", "syntax"),
    ("[Nope]", "unknown_column"), ("SUM(1)", "unknown_function"), ("EVAL([Revenue])", "unknown_function"), ("[Region] + 1", "type_mismatch"), ("[Day] + 1", "type_mismatch"),
    ("IF(1, 2, 3)", "type_mismatch"), ('IF(TRUE, 1, "x")', "type_mismatch"), ("NOT 1", "type_mismatch"), ('[Revenue] = "x"', "type_mismatch"), ("ROUND(1.5, [Units])", "type_mismatch"),
    ("ROUND(1.5, 16)", "type_mismatch"), ("1" * 1001, "too_long"), ("(" * 40 + "1" + ")" * 40, "too_deep"), ("1" + "+1" * 499 + "", "too_complex"),
])
def test_rejected(text, code):
    with pytest.raises(FormulaError) as e:
        compile_formula(text, TYPES)
    assert e.value.code == code and 0 <= e.value.position <= 1000


def test_columns_used(spark):
    assert compile_formula("[Revenue] + IF([Active], [Cost], [Revenue])", TYPES).columns_used == ("Revenue", "Active", "Cost")


def test_random_input_only_raises_formula_errors(spark):
    rng = random.Random(7)
    parts = ["[Revenue]", "Cost", "(", ")", "+", "-", "*", "/", "<", "AND", "NOT", "IF(", ",", '"x"', "1", "1e3", "[", "]", '"', "ROUND(", "TRUE", " ", "\\", "é"]
    for _ in range(400):
        try:
            compile_formula("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))), TYPES)
        except FormulaError:
            pass
