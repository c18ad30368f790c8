"""What the corpus operators share: shared storage, row keys, global positions, size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of UTF-8 that SQL's lower() would also change outside ASCII stay as they are: only these letters are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; one of our own only where that is unset on a single machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _local_dir()).rstrip("/")


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, path, True)
    return path


#: Spark deletes the shuffle files of a query as soon as it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whole texts are long: so many rows, and about so many bytes, at most go to Python at once.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BYTES, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


@contextlib.contextmanager
def _released(spark: SparkSession):
    before = {k: spark.conf.get(k, d) for k, d in ((CLEANUP, "false"), (BATCH, "10000"), (BYTES, str(2**31 - 1)))}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BYTES, str(min(MOST, int(before[BYTES]))))
    spark.conf.set(BATCH, str(min(ROWS, int(before[BATCH])) if int(before[BATCH]) > 0 else ROWS))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is read many times.

    Nothing executes this plan again, so its shuffle files go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Like stored(), in n buckets by key: tables with the same buckets are joined on the key where they lie."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    with _released(spark):
        df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete a table written by stored() or bucketed() that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        spark.sql(f"DROP TABLE IF EXISTS `{folder.rsplit('/', 1)[1]}`")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables written on the way. They are deleted when the scope ends, those that are dropped sooner at once."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def drop(self, table: DataFrame) -> None:
        """Delete one of the scope's tables that no later plan reads; others stay."""
        if any(t is table for t in self.tables):
            self.tables = [t for t in self.tables if t is not table]
            discard(table)

    def __exit__(self, *_) -> None:
        for table in self.tables:
            discard(table)
        self.tables = []


_libc = ctypes.CDLL(None)


def release() -> None:
    """What a worker has freed goes back to the system. Workers stay for later tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Broadcast df when its size was checked; else Spark picks a shuffle join, which splits skewed keys."""
    return F.broadcast(df) if small else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the short way; other letters keep their case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that tell rows apart even where an id repeats with another text; equal rows share a key."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["_h"] == b["_h"]) & a["_id"].eqNullSafe(b["_id"])


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df range-partitioned by order and stored, with its range as _part."""
    n = shuffle_partitions(df.sparkSession)
    return stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)


def positions(parts: DataFrame, order: list[str], weight: Column | None = None) -> DataFrame:
    """Global 0-based position (_pos) in the given order, and with a weight its exclusive prefix sum (_before) and total (_total).

    Per-range totals (one row per range) give each range its offset; only inside a range are rows counted one by one.
    """
    w = F.lit(0).cast("long") if weight is None else weight.cast("long")
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_w0"),
        F.sum("_w").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("_pos", F.row_number().over(inside) - 1)
        .withColumn("_before", F.coalesce(F.sum(w).over(earlier), F.lit(0)))
        .join(F.broadcast(offsets), "_part")  # a row per range: as many as there are shuffle partitions
        .withColumn("_pos", F.col("_pos") + F.col("_n0"))
        .withColumn("_before", F.col("_before") + F.col("_w0"))
        .drop("_n0", "_w0")
    )
