"""Text, number, date and check-digit functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_numeral(text: Column) -> Column:
    """'1,00,000.50' -> struct(value decimal(38,10), decimals shown)."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    decimals = F.when(F.contains(plain, F.lit(".")), F.char_length(plain) - F.instr(plain, ".")).otherwise(0)
    return F.struct(plain.try_cast("decimal(38,10)").alias("value"), decimals.alias("decimals"))


def precision_match(a: Column, b: Column, decimals: Column) -> Column:
    """|a - b| within half a unit of the last decimal shown."""
    return F.abs(a - b) <= F.pow(F.lit(10.0), -decimals) / 2


def encode_date(d: Column) -> Column:
    """YYYYMMDD; parts that a text leaves out are 00."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def date_precision(code: Column) -> Column:
    return F.when(code % 100 != 0, "D").when((code / 100).cast("int") % 100 != 0, "M").otherwise("Y")


def truncate_date(code: Column, precision: str) -> Column:
    unit = {"Y": 10000, "M": 100, "D": 1}[precision]
    return code - code % unit


def date_iso(code: Column) -> Column:
    text = F.lpad(code.cast("string"), 8, "0")
    y, m, d = F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
    return F.when(d != "00", F.concat_ws("-", y, m, d)).when(m != "00", F.concat_ws("-", y, m)).otherwise(y)


def normalise_header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def values_only(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_filename(name: Column) -> Column:
    """Without control characters, separators and what file systems refuse; 120 characters at most."""
    return F.substring(F.trim(F.regexp_replace(name, r"[\x00-\x1f\x7f/\\:*?\"<>|]", "")), 1, 120)


def luhn_valid(digits: Column) -> Column:
    """Every second digit from the right doubled, digits of that summed, divisible by ten."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
    )
    return F.when(digits.rlike("^[0-9]+$"), F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def _worth(c: Column) -> Column:
    """0 to 9, then 10 for A to 35 for Z."""
    return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)


def gstin_valid(text: Column) -> Column:
    """Tax registration: state, PAN, entity, Z, and a check character: weights 1 and 2 by turns, digits in base 36 summed."""
    shape = text.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$")
    weighed = F.transform(F.split(F.substring(text, 1, 14), ""), lambda c, i: _worth(c) * (1 + i % 2))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + (x / 36).cast("int") + x % 36)
    return F.when(shape, F.pmod(-total, F.lit(36)) == _worth(F.substring(text, 15, 1))).otherwise(F.when(text.isNotNull(), F.lit(False)))


def isin_valid(text: Column) -> Column:
    """Securities number: a country, nine characters and a check digit: letters as two digits, then every second digit doubled."""
    digits = F.array_join(F.transform(F.split(text, ""), lambda c: _worth(c).cast("string")), "")
    return F.when(text.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$"), luhn_valid(digits)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def a1_range(text: Column) -> Column:
    """Sheet!A1:G5 -> struct(sheet, c0, r0, c1, r1); a single cell is a range of one."""
    shape = r"^(?:'?([^'!]+)'?!)?\$?([A-Za-z]{1,3})\$?([0-9]+)(?::\$?([A-Za-z]{1,3})\$?([0-9]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(text, shape, i), F.lit(""))
    c0, r0 = part(2), part(3)
    c1, r1 = F.coalesce(part(4), c0), F.coalesce(part(5), r0)
    return F.struct(part(1).alias("sheet"), column_number(c0).alias("c0"), r0.cast("int").alias("r0"), column_number(c1).alias("c1"), r1.cast("int").alias("r1"))


def covers(outer: Column, inner: Column) -> Column:
    """Whether one A1 range has another inside it, on the same sheet."""
    return outer["sheet"].eqNullSafe(inner["sheet"]) & (outer["c0"] <= inner["c0"]) & (outer["r0"] <= inner["r0"]) & (outer["c1"] >= inner["c1"]) & (outer["r1"] >= inner["r1"])


def indian_grouping(number: Column) -> Column:
    """Whole numbers with Indian separators: 1234567 -> 12,34,567."""
    digits = F.abs(number).cast("string")
    grouped = F.reverse(F.regexp_replace(F.substring(F.reverse(digits), 4, 40), r"(\d{2})(?=\d)", "$1,"))
    body = F.when(F.char_length(digits) <= 3, digits).otherwise(F.concat(grouped, F.lit(","), F.right(digits, F.lit(3))))
    return F.concat(F.when(number < 0, "-").otherwise(""), body)


def fiscal_month(d: Column) -> Column:
    """0 for April to 11 for March."""
    return F.pmod(F.month(d) - 4, F.lit(12))


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def mask(text: Column, pattern: str, label: str) -> Column:
    return F.regexp_replace(text, pattern, f"[{label}]")


def chain_hash(previous: Column, payload: Column) -> Column:
    """SHA-256 of the previous hash and the row's canonical JSON."""
    return F.sha2(F.concat(previous, payload), 256)


def keyed_hash(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in lower-case hex: equal values are recognised without the key's holder storing them."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def encode_cursor(*parts: Column) -> Column:
    """Place in a keyset page as URL-safe base64 without padding; parts must not hold a bar."""
    return F.rtrim(F.translate(F.base64(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column, *types: str) -> Column:
    """struct(_1, _2, ...) of the parts; null for a cursor that is none."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), F.lit("="))
    text = F.when(cursor.rlike("^[A-Za-z0-9_-]+$") & (F.char_length(cursor) % 4 != 1), F.unbase64(F.when(cursor.rlike("^[A-Za-z0-9_-]+$"), padded)).cast("string"))
    parts = F.split(text, r"\|")
    values = [F.get(parts, F.lit(i)).try_cast(t) for i, t in enumerate(types)]
    whole = F.size(parts) == len(types)
    for v in values:
        whole = whole & v.isNotNull()
    return F.when(whole, F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values, 1)]))
