"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, jaccard_join, language_id, license_scan, lm_scoring, near_dedup, sentencepiece_codec, sharding, token_alignment, topk_search, url_filter, whitening
from .common import stored

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: benchmark decontamination -------------------------------------------------------------------------------


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def _words_sql(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({lowered}, '{decontamination.BREAKS}'), lambda x: x <> '')"


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_words_sql('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1:s + 13], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, s, n, array_to_string(w[s + 1:s + n], ' ') AS t
        FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT occ.r, occ.s, occ.n, win.item_id FROM occ JOIN win USING (n, t)),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

# --- 2: SentencePiece encoding and decoding ----------------------------------------------------------------------

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20240


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    codec = sentencepiece_codec.SentencePiece(spark, model_file, DROPOUT, SEED)
    out = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), codec)
    digests = out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
    return stored(digests, "encoded")  # written in small batches, texts being long


# --- 3: language identification ---------------------------------------------------------------------------------


def remainder(n: int) -> Column:
    """crc32 of the id as text, mod n: what splits rows into learned and held out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), docs.where(remainder(4) != 2).select("text", "lang"))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


# --- 4: URL filters ---------------------------------------------------------------------------------------------

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM p
"""

# --- 5: sharding ------------------------------------------------------------------------------------------------


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# --- 6: n-gram Jaccard join -------------------------------------------------------------------------------------


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 7: HTML extraction -----------------------------------------------------------------------------------------


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extraction.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# --- 8: language-model scoring ----------------------------------------------------------------------------------


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scoring.score_rows(docs, remainder(7) != 2, F.lit(True))
    return out.withColumn("held_out", F.coalesce(remainder(7) == 2, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


# --- 9: exact top-k search --------------------------------------------------------------------------------------


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10
"""

# --- 10: licence scans ------------------------------------------------------------------------------------------


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text_sha256", "license", "n_notices", F.array_join("notices", ",").alias("notices"))


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), '{license_scan.COPYRIGHT_LINE}', '\\1', 'g'), '{license_scan.NOT_WORD}', ' ', 'g')"
    for spelling, one in license_scan.SPELLINGS:
        out = f"regexp_replace({out}, '{spelling}', '{one}', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _known_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in license_scan.known_licenses())
    return f"""k AS (SELECT min(license) AS found, sha256(array_to_string({_canonical_sql('text')}, ' ')) AS digest FROM (VALUES {rows}) v(license, text) GROUP BY 2)"""


OP10_SQL = f"""
WITH {_known_sql()},
d AS (SELECT row_number() OVER () AS n, doc_id, {_canonical_sql('text')} AS lines FROM documents),
u AS (SELECT n, unnest(lines) AS line FROM d),
hits AS (SELECT u.n, count(*) AS n_notices, string_agg(DISTINCT k.found, ',' ORDER BY k.found) AS notices
         FROM u JOIN k ON k.digest = sha256(u.line) GROUP BY 1)
SELECT d.doc_id, sha256(array_to_string(d.lines, ' ')) AS text_sha256, k.found AS license,
       coalesce(h.n_notices, 0) AS n_notices, coalesce(h.notices, '') AS notices
FROM d LEFT JOIN k ON k.digest = sha256(array_to_string(d.lines, ' ')) LEFT JOIN hits h ON h.n = d.n
"""

# --- 11: embedding whitening ------------------------------------------------------------------------------------


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 32)


# --- 12: MinHash near-dedup --------------------------------------------------------------------------------------


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 13: cross-tokenizer alignment ------------------------------------------------------------------------------

BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def op13_token_alignment(spark: SparkSession, sf_dir: str, byte_file: str = BYTE_FILE, model_file: str = MODEL_FILE) -> DataFrame:
    tokenizers = token_alignment.Tokenizers(spark, byte_file, model_file)
    return token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizers)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_language_id, op4_url_filter, op5_sharding, op6_jaccard_join, op7_html_extraction, op8_lm_scoring, op9_topk_search, op10_license_scan, op11_whitening, op12_near_dedup, op13_token_alignment, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op4_url_filter": OP4_SQL, "op9_topk_search": OP9_SQL, "op10_license_scan": OP10_SQL}
