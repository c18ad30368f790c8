"""Sharding by bytes: global prefix sums from per-range totals, cut at equal targets into contiguous balanced shards.

Rows are ordered by id (then checksum, size and input position), range-partitioned once and stored. Each range's byte
total gives the offsets; a row whose middle byte falls in the k-th of n equal stretches goes to shard k, so a shard
strays from its target by less than one row.

Defined results. Null text: no bytes, checksum 0, size 8 still. Null ids come first. Repeated rows: each has its own
slot. Empty table: no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, ranged

ORDER = ["doc_id", "text_crc32", "size", "_row"]


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = 8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = positions(ranged(sized, ORDER, "shard"), ORDER, F.col("size")).withColumn(
        "shard", F.expr(f"cast(((2 * _before + size) * {shards}L) div (2 * _total) as int)")
    )
    starts = placed.groupBy("shard").agg(F.min("_pos").alias("_start"))  # a row per shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_pos") - F.col("_start")).alias("slot"))
