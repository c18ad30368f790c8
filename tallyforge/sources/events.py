"""Text scans: server-sent events, metric lines, Markdown tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_sse(df: DataFrame, ident: str, text: str) -> DataFrame:
    """A row per event: ident, seq, name ('message' by default), data (lines joined). Comments are skipped; CR LF counts as LF."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    blocks = df.select(ident, F.posexplode(F.split(plain, r"\n\n+")).alias("seq", "block")).where(F.col("block").rlike("(?m)^(data|event):"))
    lines = F.split("block", "\n")
    values = lambda field: F.transform(F.filter(lines, lambda x: x.startswith(f"{field}:")), lambda x: F.regexp_replace(x, f"^{field}: ?", ""))
    name = F.coalesce(F.get(values("event"), F.lit(0)), F.lit("message"))
    return blocks.select(ident, "seq", name.alias("name"), F.array_join(values("data"), "\n").alias("data"))


def parse_metrics(df: DataFrame, line: str) -> DataFrame:
    """name, labels (map), value of each metric line; comments and other lines are dropped."""
    c = F.col(line)
    labels = F.regexp_extract_all(F.regexp_extract(c, r"\{([^}]*)\}", 1), F.lit(r'(\w+)="[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(F.regexp_extract(c, r"\{([^}]*)\}", 1), F.lit(r'\w+="([^"]*)"'), F.lit(1))
    shape = r"^([A-Za-z_:][\w:]*)(?:\{[^}]*\})?\s+(\S+)"
    rows = df.where(c.rlike(shape)).select(F.regexp_extract(c, shape, 1).alias("name"), F.map_from_arrays(labels, values).alias("labels"), F.regexp_extract(c, shape, 2).try_cast("double").alias("value"))
    return rows.where("value IS NOT NULL")


def metric_sum(metrics: DataFrame, name: str, labels: Mapping[str, str]) -> DataFrame:
    match: Column = F.col("name") == name
    for k, v in labels.items():
        match = match & (F.element_at("labels", F.lit(k)) == v)
    return metrics.where(match).groupBy("name").agg(F.sum("value").alias("value"))


def parse_markdown_rows(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Body rows of the tables in a text: ident, line, cells."""
    lines = df.select(ident, F.posexplode(F.split(text, "\n")).alias("line", "raw")).where(F.col("raw").rlike(r"^\s*\|.*\|\s*$"))
    rule = F.col("raw").rlike(r"^[\s|:-]+$")
    from pyspark.sql.window import Window

    before = F.max(F.when(rule, 1).otherwise(0)).over(Window.partitionBy(ident).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    cells = F.transform(F.split(F.regexp_replace("raw", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return lines.withColumn("_body", before == 1).where(~rule & F.col("_body")).select(ident, "line", cells.alias("cells"))
