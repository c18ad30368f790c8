"""Tables written on the way: in the folder that all executors share, so that they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
