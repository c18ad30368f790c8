"""Envelope encryption of columns: a data key for each sheet, wrapped by a master key.

AES-256-GCM with a fresh IV for each value. What a value belongs to (its sheet and column), and what a key belongs to (its sheet), is
authenticated with it, so a value or key that is moved elsewhere can't be read. To change the master key only the keys are written anew.

The master key is a literal of the plan: keep plans and event logs closed, or hide it by spark.sql.redaction.string.regex.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

_KEYS = "sheet string, version int, wrapped binary"


def _aad(*parts: Column) -> Column:
    """Parts with their lengths, so that none can pass into the next."""
    return F.concat(*[F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts]).cast("binary")


def _seal(value: Column, key: Column, aad: Column) -> Column:
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def _open(value: Column, key: Column, aad: Column) -> Column:
    return F.aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def _master(key: bytes) -> Column:
    if len(key) != 32:
        raise ValueError("a master key has 32 bytes")
    return F.lit(bytearray(key))


def new_keys(sheets: DataFrame, master: bytes, version: int = 1) -> DataFrame:
    """sheets(sheet) -> sheet, version, wrapped: a random data key for each sheet, written once, for every reading would draw others."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([secrets.token_bytes(32) for _ in range(batch.num_rows)], pa.binary())], ["sheet", "key"])

    drawn = sheets.where("sheet is not null").select("sheet").distinct().mapInArrow(draw, "sheet string, key binary")
    return written(drawn.select("sheet", F.lit(version).alias("version"), _seal(F.col("key"), _master(master), _aad(F.col("sheet"))).alias("wrapped")), "keys")


def rotated(keys: DataFrame, old: bytes, new: bytes) -> DataFrame:
    """The same data keys under another master key; what they have encrypted stays as it is."""
    plain = _open(F.col("wrapped"), _master(old), _aad(F.col("sheet")))
    return keys.select("sheet", (F.col("version") + 1).alias("version"), _seal(plain, _master(new), _aad(F.col("sheet"))).alias("wrapped"))


def _with_key(df: DataFrame, sheet: str, keys: DataFrame, master: bytes) -> DataFrame:
    plain = keys.select(F.col("sheet").alias("_sheet"), _open(F.col("wrapped"), _master(master), _aad(F.col("sheet"))).alias("_key"))
    return df.join(plain, df[sheet] == F.col("_sheet"), "left").drop("_sheet")


def encrypted(df: DataFrame, sheet: str, columns: Sequence[str], keys: DataFrame, master: bytes) -> DataFrame:
    """df with these columns as binary; nulls stay null. A row of a sheet without a key fails."""
    known = F.coalesce(F.col("_key"), F.raise_error(F.concat(F.lit("no key for sheet "), F.coalesce(sheet, F.lit("null")))).cast("binary"))
    seal = lambda c: F.when(F.col(c).isNotNull(), _seal(F.col(c).cast("string").cast("binary"), known, _aad(F.col(sheet), F.lit(c))))
    return _with_key(df, sheet, keys, master).withColumns({c: seal(c) for c in columns}).drop("_key")


def decrypted(df: DataFrame, sheet: str, columns: dict[str, str], keys: DataFrame, master: bytes) -> DataFrame:
    """df with these columns as values of these types again. A value under another key, sheet or column fails."""
    plain = lambda c, kind: _open(F.col(c), F.col("_key"), _aad(F.col(sheet), F.lit(c))).cast("string").cast(kind)
    return _with_key(df, sheet, keys, master).withColumns({c: plain(c, kind) for c, kind in columns.items()}).drop("_key")
