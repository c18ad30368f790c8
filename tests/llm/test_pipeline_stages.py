"""Each stage of the pipeline on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"x{i % 977}y{i}" for i in range(8_000))
ROWS = [
    (3, WORDS, "en"), (2, WORDS, "en"), (2, WORDS, "en"), (None, WORDS, "en"), (4, WORDS + " and", None), (5, "Something else altogether, of its own", "en"),
    (None, "only here, without an id", "en"), (None, "only here, without an id", "en"), (6, LONG, "en"), (7, "12 34 !!", "en"), (8, "", "en"), (9, None, "en"), (5, "another text of the same id, five", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")})
    return rows.select("*", *[F.lit("clash").alias(c) for c in ("_n", "_h", "_b", "key", "row", "said", "id", "hash", "row_hash", "score", "lang_pred", "doc", "n", "label", "_id")])


def kept(df, docs):
    assert df.columns == docs.columns
    rows = df.collect()
    assert all(r["_h"] == r["score"] == r["row"] == "clash" for r in rows)
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def test_language(spark, docs, data):
    want = sorted(((i, t) for i, t, _ in ROWS if any(c.isalpha() for c in t or "")), key=repr)
    assert kept(corpus_pipeline.language(spark, docs, data), docs) == want
    assert corpus_pipeline.language(spark, docs.limit(0), data).count() == 0


def test_deduplicate(spark, docs, data):
    got = kept(corpus_pipeline.deduplicate(spark, docs, data), docs)
    assert [i for i, t in got if t in (WORDS, WORDS + " and")] == [2]
    assert got.count((None, "only here, without an id")) == 1 and sum(i == 5 for i, _ in got) == 1
    assert {(6, LONG), (7, "12 34 !!"), (8, ""), (9, None)} <= set(got) and len(got) == 7
    assert corpus_pipeline.deduplicate(spark, docs.limit(0), data).count() == 0


def test_decontaminate(spark, docs, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("size(split(text, ' ')) > 20").first()["text"]
    bad = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(item)}))
    assert kept(corpus_pipeline.decontaminate(spark, bad, data), docs) == sorted(((i, t) for i, t, _ in ROWS), key=repr)
    assert corpus_pipeline.decontaminate(spark, docs.limit(0), data).count() == 0


def test_tokenise(spark, docs, data):
    rows = corpus_pipeline.tokenise(spark, docs, data).collect()
    assert len(rows) == len(ROWS) and all(r["lossless"] for r in rows)
    assert {r["doc_id"]: r["ids"] for r in rows}[9] is None and {r["doc_id"]: r["ids"] for r in rows}[8] == []
    assert corpus_pipeline.tokenise(spark, docs.limit(0), data).count() == 0
