"""A training-corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last returns token ids. Nulls, empty texts, repeated rows and empty tables have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, jaccard_join, language_id, sentencepiece_codec
from tallyforge.llm.common import stored
from tallyforge.llm.queries import DROPOUT, MODEL_FILE, SEED

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null texts, and texts without any letter."""
    known = language_id.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), docs.select("text", "lang"))
    return stored(known.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*"), "known")  # written in small batches, texts being long


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents: the smallest doc_id, and of its rows the one whose text has the least hash.

    A row without an id is known by its text's hash, above all other ids, so it stays only where no linked row has one.
    """
    own = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    row = F.struct(*docs.columns)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("key"), F.col("text").alias("said"), row.alias("row"))
    leaders = jaccard_join.components(keyed.select(F.col("key").alias("doc_id"), F.col("said").alias("text"))).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    one = keyed.groupBy("key").agg(F.min_by("row", F.xxhash64("said")).alias("row"))
    return one.join(leaders, "key", "left_semi").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in windows of benchmark items."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = found.select("doc_id", "row_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("hash"))
    return rows.join(bad, (F.col("hash") == F.col("row_hash")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_anti").select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with seeded merge-dropout, and whether they decode to the text."""
    codec = sentencepiece_codec.SentencePiece(spark, MODEL_FILE, DROPOUT, SEED)
    out = sentencepiece_codec.encode_documents(docs.select("doc_id", "text", "lang", "source"), codec)
    return stored(out.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless")), "tokens")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", tokenise),
]

#: Stages that return what they have written themselves.
WRITTEN = ("language_id", "sentencepiece")
#: SQL can't express language ID and tokenisation; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name in WRITTEN else stored(made, name)
    return docs
