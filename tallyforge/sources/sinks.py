"""Writing results: guarded values, CSV with a closing line, outputs with a manifest, audit rows in a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import values_only


def guarded(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would take for formulas get a quote in front."""
    return df.select(*[values_only(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def csv_lines(df: DataFrame, order: list[str], trailer: str) -> DataFrame:
    """A header line, the rows in order and a closing comment line, as text; doubles are printed with two decimals."""
    cell = lambda c, t: F.format_string("%.2f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string")
    body = df.select(F.lit(1).alias("part"), F.struct(*order).alias("key"), F.to_csv(F.struct(*[cell(c, t).alias(c) for c, t in df.dtypes])).alias("value"))
    spark, kind = df.sparkSession, body.schema["key"].dataType
    ends = spark.createDataFrame([(0, ",".join(df.columns)), (2, f"# {trailer}")], "part int, value string").select("part", F.lit(None).cast(kind).alias("key"), "value")
    return body.unionByName(ends).orderBy("part", "key").select("value")


def write_csv_with_trailer(df: DataFrame, path: str, order: list[str], trailer: str) -> None:
    csv_lines(df, order, trailer).write.mode("errorifexists").text(path)


def manifest(files: DataFrame) -> DataFrame:
    """Size and SHA-256 of written files: files as the binaryFile source reads them."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_output(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet by Spark's commit protocol, then describe what was written."""
    df.write.mode("errorifexists").parquet(path)
    return manifest(df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path))


def markdown_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("value"))


def _ascii(text: Column) -> Column:
    """JSON's escapes for what isn't ASCII, in UTF-16 halves beyond the basic plane."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    beyond = lambda n: n - 0x10000
    high, low = (lambda n: (beyond(n) / 1024).cast("int") + 0xD800), (lambda n: beyond(n) % 1024 + 0xDC00)
    each = lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 0x10000, unit(F.ascii(c))).otherwise(F.concat(unit(high(F.ascii(c))), unit(low(F.ascii(c)))))
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.array_join(F.transform(F.split(text, ""), each), "")).otherwise(text)


def canonical_row(df: DataFrame, *columns: str) -> Column:
    """A row as JSON that is the same wherever it is made: keys sorted, no spaces, ASCII only, nulls kept.

    Times are UTC with microseconds and Z, durations whole microseconds; all columns where none are named.
    """

    def value(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return F.expr(f"unix_micros(timestamp_micros(0) + `{name}`)") if kind.startswith("interval day") or kind.startswith("interval hour") else c

    kinds = dict(df.dtypes)
    fields = [value(c, kinds[c]).alias(c) for c in sorted(columns or df.columns)]
    return _ascii(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def canonical_json(columns: list[str]) -> Column:
    """Sorted keys, no spaces, nulls kept; for ASCII values."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
