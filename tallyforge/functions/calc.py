"""Financial calculations as Columns: a value and, where it is undefined, an error code instead.

Doubles serve tables; `exact` computes in 34-digit decimals for single results that must be right to the last digit.
"""

from __future__ import annotations

import decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scale words, currency symbols, unit suffixes.
SCALES = {
    "k": 3, "thousand": 3, "thousands": 3, "lakh": 5, "lakhs": 5, "lac": 5, "lacs": 5, "m": 6, "mm": 6, "mn": 6, "million": 6, "millions": 6,
    "cr": 7, "crore": 7, "crores": 7, "b": 9, "bn": 9, "billion": 9, "billions": 9, "tn": 12, "trillion": 12, "trillions": 12,
    "lakh crore": 12, "lakh crores": 12,
}
SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€"}
SUFFIXES = {"PCT": "%", "BPS": " bps", "MULTIPLE": "x"}
MINUS = "−"
ZERO_DENOMINATOR, NEGATIVE_BASE, INVALID_YEARS, MISMATCHED_PERIODS = "zero_denominator", "negative_base", "invalid_years", "mismatched_periods"
# Why units don't go together, in words.
DATE_UNIT, OTHER_CURRENCY, OTHER_UNIT = "A date can't be used in a calculation.", "The values are in different currencies.", "The values are in different units."
INCOMPATIBLE_UNITS, TOO_FEW_INPUTS, WRONG_INPUT_COUNT = "incompatible_units", "too_few_inputs", "wrong_input_count"


def _either(error: Column, value: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error_code"))


def growth(start: Column, end: Column) -> Column:
    """(end - start) / |start| * 100."""
    return _either(F.when(start == 0, ZERO_DENOMINATOR), F.try_divide(end - start, F.abs(start)) * 100)


def cagr(start: Column, end: Column, years: Column) -> Column:
    error = F.when(years.isNull() | (years <= 0), INVALID_YEARS).when((start <= 0) | (end < 0), NEGATIVE_BASE)
    ratio = F.try_divide(end, start)
    return _either(error, F.when(ratio == 0, F.lit(-100.0)).otherwise((F.exp(F.try_divide(F.ln(ratio), years)) - 1) * 100))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Also the multiple; times 100 the margin."""
    return _either(F.when(denominator == 0, ZERO_DENOMINATOR), F.try_divide(numerator, denominator))


def margin(part: Column, whole: Column) -> Column:
    return _either(F.when(whole == 0, ZERO_DENOMINATOR), F.try_divide(part, whole) * 100)


def scale_factor(word: Column) -> Column:
    """Factor of a scale word; 1 for none, null for an unknown one."""
    scales = F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, 10.0**v)])
    clean = F.regexp_replace(F.trim(F.lower(F.rtrim(word, F.lit(".")))), r"\s+", " ")
    return F.when(F.coalesce(word, F.lit("")) == "", F.lit(1.0)).otherwise(scales[clean])


def same_unit(a: Column, b: Column) -> Column:
    """Null if two units go together, else the error code; plain numbers and counts do."""
    plain = lambda u: F.when(u == "COUNT", F.lit("PLAIN")).otherwise(u)
    return F.when((a == "DATE") | (b == "DATE") | (plain(a) != plain(b)), INCOMPATIBLE_UNITS)


def unit_message(a: Column, b: Column) -> Column:
    """Why two units don't go together, in words; null if they do."""
    money = lambda u: u.isin(*SYMBOLS)
    return F.when(same_unit(a, b).isNotNull(), F.when((a == "DATE") | (b == "DATE"), DATE_UNIT).when(money(a) & money(b), OTHER_CURRENCY).otherwise(OTHER_UNIT))


def canonical(value: Column, scale: Column) -> Column:
    """The value in base units; null for an unknown scale word."""
    return value * scale_factor(scale)


def of_figures(metric, a: Column, b: Column) -> Column:
    """A metric of two figures struct(value, unit, scale), with their scales applied and their units compared: struct(value, error_code, message)."""
    got, message = metric(canonical(a["value"], a["scale"]), canonical(b["value"], b["scale"])), unit_message(a["unit"], b["unit"])
    return F.struct(F.when(message.isNull(), got["value"]).alias("value"), F.coalesce(same_unit(a["unit"], b["unit"]), got["error_code"]).alias("error_code"), message.alias("message"))


def label_year(label: Column) -> Column:
    """FY22, CY2024, '25, 2023E -> the year; two digits are 20YY; null for anything else."""
    digits = F.regexp_extract(F.trim(label), r"(?i)^(?:FY|CY)?\s*['’]?((?:19|20)\d{2}|\d{2})[AEFP]?$", 1)
    year = F.when(digits != "", digits.try_cast("int"))
    return F.when(year < 100, year + 2000).otherwise(year)


def inferred_years(first: Column, last: Column, years: Column | None = None) -> Column:
    """struct(value, error_code): years between two period labels, which must agree with `years` where both are known."""
    years = F.lit(None).cast("int") if years is None else years
    between = label_year(last) - label_year(first)
    same = F.lower(F.trim(first)) == F.lower(F.trim(last))
    error = (
        F.when(same | (between <= 0) | (between != years), MISMATCHED_PERIODS)
        .when(F.coalesce(years, between).isNull() | (F.coalesce(years, between) <= 0), INVALID_YEARS)
    )
    return _either(error, F.coalesce(years, between))


# How each metric is written out; {0} and {1} are its operands.
FORMULAS = {"growth": "({1} {m} {0}) ÷ |{0}| × 100", "cagr": "(({1} ÷ {0})^(1 ÷ {y}) {m} 1) × 100", "margin": "{0} ÷ {1} × 100", "ratio": "{0} ÷ {1}", "multiple": "{0} ÷ {1}"}


def operand(value: Column, decimals: int, scale: Column | None = None) -> Column:
    """A number as it is written in a formula: separators, negatives in brackets with a typographic minus, its scale word if given."""
    digits = F.format_number(F.abs(value.cast(f"decimal(38,{decimals})")), decimals)
    shown = F.when(value < 0, F.concat(F.lit(f"({MINUS}"), digits, F.lit(")"))).otherwise(digits)
    return shown if scale is None else F.concat_ws(" ", shown, scale)


def formula(metric: str, operands: list[Column], shown: Column, years: Column | None = None) -> Column:
    """The calculation in words: operands in place, then what it comes to."""
    if metric in ("sum", "mean"):
        total = F.concat_ws(" + ", *operands)
        text = total if metric == "sum" else F.concat(F.lit("("), total, F.lit(f") ÷ {len(operands)}"))
    else:
        parts, rest = [], FORMULAS[metric].replace("{m}", MINUS)
        while rest:
            before, mark, after = rest.partition("{")
            parts.append(F.lit(before))
            name, _, rest = after.partition("}") if mark else ("", "", "")
            if mark:
                parts.append(years.cast("string") if name == "y" else operands[int(name)])
        text = F.concat(*parts)
    return F.concat(text, F.lit(" = "), shown)


def as_source(value: Column, unit: str) -> Column:
    """A result as text and unit of a source, so that figures may be grounded in it."""
    return F.struct(F.format_string("%.10f", value.cast("double")).alias("text"), F.lit(unit).alias("unit"), F.lit(None).cast("string").alias("scale"))


def display(value: Column, unit: str, scale: str | None = None) -> Column:
    """Half up to two places, thousands separators, a typographic minus, then the unit's sign or the scale word."""
    exact = value.cast("decimal(38,10)")
    digits = F.format_number(F.round(F.abs(exact), 2), 2)
    sign = F.when(F.round(exact, 2) < 0, F.lit(MINUS)).otherwise(F.lit(""))
    tail = F.lit(SUFFIXES.get(unit, f" {scale}" if scale else ""))
    return F.concat(sign, F.lit(SYMBOLS.get(unit, "")), digits, tail)


_CONTEXT = decimal.Context(prec=34, rounding=decimal.ROUND_HALF_EVEN)


def _exact(metric: str, values: list[decimal.Decimal], years: decimal.Decimal | None) -> tuple[decimal.Decimal | None, str | None]:
    c = _CONTEXT
    if metric in ("sum", "mean"):
        if not values:
            return None, TOO_FEW_INPUTS
        total = values[0]
        for v in values[1:]:
            total = c.add(total, v)
        return (total if metric == "sum" else c.divide(total, decimal.Decimal(len(values)))), None
    if len(values) != 2:
        return None, WRONG_INPUT_COUNT
    a, b = values
    if metric == "growth":
        return (None, ZERO_DENOMINATOR) if a == 0 else (c.multiply(c.divide(c.subtract(b, a), abs(a)), 100), None)
    if metric == "cagr":
        if years is None or years <= 0:
            return None, INVALID_YEARS
        if a <= 0 or b < 0:
            return None, NEGATIVE_BASE
        return (decimal.Decimal(-100) if b == 0 else c.multiply(c.subtract(c.exp(c.divide(c.ln(c.divide(b, a)), years)), 1), 100)), None
    if b == 0:
        return None, ZERO_DENOMINATOR
    value = c.divide(a, b)
    return (c.multiply(value, 100) if metric == "margin" else value), None


@F.arrow_udf(T.StructType().add("value", "string").add("error_code", "string"))
def exact(metric: pa.Array, values: pa.Array, years: pa.Array) -> pa.Array:
    """metric string, values array<string>, years string -> the decimal as text, or an error code."""
    out = []
    for m, vs, y in zip(metric.to_pylist(), values.to_pylist(), years.to_pylist()):
        value, error = _exact(m, [decimal.Decimal(v) for v in vs or ()], None if y is None else decimal.Decimal(y))
        out.append({"value": None if value is None else format(value, "f"), "error_code": error})
    return pa.array(out, pa.struct([("value", pa.string()), ("error_code", pa.string())]))
