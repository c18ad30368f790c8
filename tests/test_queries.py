"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import random

import duckdb
import pytest
from conftest import rows_of

import __spark_entry__ as entry
from tallyforge.operators import best_match
from tallyforge.plans import ORACLE, QUERIES

WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, data, same_as_duckdb):
    same_as_duckdb(QUERIES[name](spark, data), ORACLE[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.schema == QUERIES[name](spark, data).schema
    df.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def odd_rows(spark, tmp_path, name, rows, schema):
    """A query's rows on a table of a few odd rows, and those of its SQL."""
    table = spark.createDataFrame(rows, schema)
    folder, view = tmp_path / "odd", {"merge_intervals": "lineitem", "align_best_match": "embeddings"}[name]
    table.coalesce(1).write.parquet(f"{folder}/{view}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{folder}/{view}.parquet/*.parquet'")
    df, got = QUERIES[name](spark, str(folder)), con.execute(ORACLE[name])
    return rows_of(df.columns, df.collect()), rows_of([d[0] for d in got.description], got.fetchall())


def test_intervals_of_fractions_and_nulls(spark, tmp_path):
    rows = [(1, 0, 2.5), (1, 3, 0.5), (1, 4, 2.7), (1, 8, 1.5), (1, 10, -0.5), (2, None, 3.0), (2, None, 1.0), (2, 5, 2.0), (2, 5, None), (2, 20, 1.0), (None, 1, 1.0), (None, None, None)]
    got, want = odd_rows(spark, tmp_path, "merge_intervals", rows, "l_suppkey long, l_partkey long, l_quantity double")
    assert got == want


def test_best_match_of_copies_and_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(best_match, "BLOCK", 7)
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    vectors = [[rng.choice((-1.5, 0.25, 0.5, 1.0000005, 2.0)) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.choice(vectors) if i % 3 else [v + rng.choice((0, 1e-7)) for v in rng.choice(vectors)], i % 2) for i in range(60)]
    odd = [None, [], [None], [None, 1.0], [1.0, None, 2.0], [1.0], [1.0, 2.0, 3.0, 4.0, 5.0], [nan, 1.0], [inf, -1.0], [inf, inf], [0.0, 0.0], [-1.0, 0.0]]
    rows += [(100 + i, v, 2) for i, v in enumerate(odd)] + [(200 + i, v, 3) for i, v in enumerate(odd[:3])] + [(300, [1.0], 4), (301, [1.0], None), (None, [9.0], 3)]
    rows += [(400, [1.0], 5), (400, [2.0], 5), (401, [1.5], 5), (402, [1.0], 5), (402, [3.0], 6), (403, [2.0], 6)]  # ids of several rows
    got, want = odd_rows(spark, tmp_path, "align_best_match", rows, "vec_id long, embedding array<float>, label int")
    assert len(want) > 70 and got == want
