"""Retrieval over chunks: cosine search, rank fusion, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k vectors closest to one query vector: vectors(id, embedding), query of one row (embedding)."""
    asked = query.limit(1).select(F.col("embedding").alias("_q"))
    near = vectors.crossJoin(F.broadcast(asked)).withColumn("score", F.round(F.try_divide(dot("embedding", "_q"), F.sqrt(dot("embedding", "embedding") * dot("_q", "_q"))), 6))  # one row
    return near.select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def rank_fusion(rankings: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings(id, rank)."""
    return rankings.groupBy("id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 8).alias("score"))


def chunks(docs: DataFrame, ident: str, text: str, words: int) -> DataFrame:
    """Runs of whole words: ident, chunk (from 0), body."""
    all_words = F.filter(F.split(text, r"[ \n\t]+"), lambda w: w != "")
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / words).cast("int")), lambda i: F.array_join(F.slice(w, i * words + 1, words), " "))
    rows = docs.select(ident, F.posexplode(F.transform(F.array(all_words), cut)[0]))  # the text is split once, not for each chunk
    return rows.select(ident, F.col("pos").alias("chunk"), F.col("col").alias("body"))


def ranked(df: DataFrame, ident: str, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), ident).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), ident)))  # k rows
