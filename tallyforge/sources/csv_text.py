"""CSV as text: nothing is inferred, short lines are padded with nulls, long ones cut."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that tell its encoding.
HEAD = 1 << 20


def schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8", max_rows: int | None = None) -> DataFrame:
    """All columns as text. With max_rows one more row is read at most, so that an overflow can be told."""
    df = spark.read.schema(schema(columns)).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).option("encoding", encoding).csv(path)
    return df if max_rows is None else df.limit(max_rows + 1)


def parse_lines(df: DataFrame, line: str, columns: Sequence[str]) -> DataFrame:
    """Lines of a column, by the same rules."""
    return df.select(F.from_csv(line, F.lit(schema(columns).simpleString()[7:-1].replace(":", " ")), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def _sniff(head: bytes) -> str:
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    if b"\0" in head:
        return "corrupt"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        cut = len(head) == HEAD and e.start > HEAD - 4  # a character cut in two is no sign of another encoding
        return "UTF-8" if cut else "windows-1252"
    return "UTF-8"


def sniff_encodings(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding of each file: a UTF-16 mark, else UTF-8 if it decodes, else Windows-1252; corrupt with a zero byte."""

    @F.arrow_udf("string")
    def sniff(content: pa.Array) -> pa.Array:
        return pa.array([None if c is None else _sniff(c) for c in content.to_pylist()], pa.string())

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", sniff(F.substring("content", 1, HEAD)).alias("encoding"))
