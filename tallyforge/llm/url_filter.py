"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes, then confirmed by digest.

Each URL becomes a few expressions ``host suffix + path prefix``; only suffix depths and prefix lengths that some rule
has are made, which loses nothing. The first 32 bits of each expression's SHA-256 meet the rules' prefixes in an
equi-join, the full digest confirms, and the longest rule decides.

Defined results. Null url or no ``://``: empty host and path, no rule, default verdict. Empty host: no rule fits.
Ties in length: longer host first, then block before allow. Repeated rows: one result each. Null page_id: kept.
Empty pages or rules: no rows, or all rows with the default. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if

#: Up to this many rules are broadcast (under 200 bytes each); more are joined by shuffle.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_digests(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) -> digest rows; of equal rules a blocking one stays."""
    name = F.concat("host", "path")
    return (
        rules.where(F.col("host") != "")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
        .select(
            F.sha2(name, 256).alias("r_digest"),
            F.substring(F.sha2(name, 256), 1, 8).alias("prefix"),
            name.alias("r_rule"),
            F.col("verdict").alias("r_verdict"),
            F.struct(F.char_length(name).alias("a"), F.char_length("host").alias("b"), (F.col("verdict") == "block").cast("int").alias("c")).alias("r_rank"),
            F.size(F.split("host", r"\.")).alias("depth"),
            F.char_length("path").alias("length"),
        )
    )


def url_filter(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """pages(page_id, url) and rules(host, path, verdict) -> page_id, host, path, rule, verdict."""
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame([*rules], "host string, path string, verdict string")
    digests = rule_digests(rules)
    shape = digests.agg(F.count(F.lit(1)), F.collect_set("depth"), F.collect_set("length")).first()
    n_rules, depths, lengths = shape[0], sorted(shape[1]), sorted(shape[2])  # at most as many as labels and characters a rule has
    labels = F.split("host", r"\.")
    each = [
        F.when((F.lit(d) <= F.size(labels)) & (F.lit(n) <= F.char_length("path")) & (F.col("host") != ""),
               F.concat(F.array_join(F.slice(labels, -d, d), "."), F.substring("path", 1, n)))
        for d in depths for n in lengths
    ] or [F.lit(None).cast("string")]
    spread = (
        pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_e", F.explode_outer(F.array_compact(F.array(*each))))
        .withColumn("digest", F.sha2("_e", 256))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    met = spread.join(broadcast_if(n_rules <= BROADCAST_RULES, digests.drop("depth", "length")), "prefix", "left")
    hit = F.when(F.col("r_digest") == F.col("digest"), F.struct("r_rank", "r_rule", "r_verdict"))
    best = met.groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(hit).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.r_rule").alias("rule"), F.coalesce("_best.r_verdict", F.lit(default)).alias("verdict"))
