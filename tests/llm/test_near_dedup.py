"""Near-duplicates against all pairs, signatures against a plain SuperMinHash and the true similarity, and edge cases."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import linking
from tallyforge.llm import near_dedup as n
from tallyforge.llm import queries as q
from tallyforge.llm.common import Scratch
from tallyforge.llm.jaccard_join import shingle_set


def brute(docs, width=3, top=85):
    """doc_id -> set size, least linked id; rows with one id are one document."""
    sets, parent = [], {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].add(k)
    for k, (i, s) in enumerate(sets):
        for m in {m for x in s for m in where[x] if m > k}:
            j, u = sets[m]
            both = len(s & u)
            if 100 * both >= top * (len(s) + len(u) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def got(df):
    return sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect())


def test_op12_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(q.op12_near_dedup(spark, data)) == brute(docs)


def plain_signature(hasher, s):
    """One shingle after the other, one rank after the other, without stopping."""
    out = [2**64 - 1] * hasher.size
    for e in s.tolist():
        order = list(range(hasher.size))
        for j in range(hasher.size):
            h = int(n._mix(np.array([(e + ((hasher.seed * 256 + j) * 0x9E3779B97F4A7C15)) % 2**64], np.uint64))[0])
            k = j + ((h % 2**32) * (hasher.size - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], (j << 56) | h >> 8)
    return out


@pytest.mark.parametrize("size", [1, 16, 128, 256])
def test_signatures_stop_early_without_a_difference(size):
    rng = np.random.default_rng(4)
    hasher = n.SuperMinHash(size, 3)
    sets = [np.unique(rng.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64)) for k in (1, 2, 7, 0, 40, 130)]
    signatures = hasher.signatures(sets)
    for s, row in zip(sets, signatures):
        assert row.tolist() == plain_signature(hasher, s)
    assert hasher.signatures([]).shape == (0, size)


def test_signatures_estimate_similarity_with_less_variance():
    """The mean error vanishes; for sets of few elements the variance is below that of independent hashes."""
    rng = np.random.default_rng(9)
    for union, shared in ((40, 20), (200, 170), (2000, 600)):
        errors = []
        for seed in range(200):
            e = rng.integers(0, 2**63, union, dtype=np.int64).astype(np.uint64)
            own = (union - shared) // 2
            x, y = n.SuperMinHash(128, seed).signatures([e[: shared + own], np.append(e[:shared], e[shared + own :])])
            errors.append(n.similarity(x, y) - shared / union)
        true = shared / union
        independent = true * (1 - true) / 128
        assert abs(np.mean(errors)) < 4 * (independent / 200) ** 0.5
        assert np.var(errors) < (0.7 if union <= 128 else 1.3) * independent


def test_edge_cases(spark):
    words = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i % 977}y{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, words), (4, words), (5, words), (None, words), (6, long), (7, "Two words"), (8, "two WORDS"), (4, "another text of the same id"), (9, "another text of the same id"), (None, "alone and without an id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit("clash").alias(c) for c in ("n", "rep", "key", "kept", "label", "least", "text_hash")])
    want = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 38, 4, True), (4, 38, 4, True), (4, 4, 4, True), (5, 38, 4, False), (6, 29_998, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 4, 4, False),
        (None, 0, None, True), (None, 3, None, True), (None, 38, 4, False),
    ]
    assert sorted(map(repr, map(tuple, n.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()))) == sorted(map(repr, want))
    assert n.near_duplicates(df.limit(0)).count() == 0
    assert n.near_duplicates(df.where("doc_id = 1")).count() == 1


def near_copies(rng, base, ids, changes):
    out = []
    for i in ids:
        w = list(base)
        for k in rng.sample(range(len(w)), changes):
            w[k] = f"e{i}x{k}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("many", [1, 0])
def test_groups_chains_passages(spark, monkeypatch, many):
    """Groups of near copies, a chain whose ends don't link, one long passage in unlike documents, and the very threshold; once with all rests by the prefix join."""
    monkeypatch.setattr(n, "MANY", many)
    rng = random.Random(2)
    docs = near_copies(rng, [f"b{i}" for i in range(200)], range(100, 160), 3) + near_copies(rng, [f"g{i}" for i in range(30)], range(160, 190), 1)
    docs += [(i, " ".join(f"c{k}" for k in range(i * 6, i * 6 + 100))) for i in range(200, 212)]
    passage = " ".join(f"p{k}" for k in range(300))
    docs += [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(60 + i % 40))) for i in range(300, 360)]
    docs += [(400, " ".join(f"t{k}" for k in range(19))), (401, " ".join(f"t{k}" for k in range(22))), (402, " ".join(f"t{k}" for k in range(24)))]  # 17 of 20, and just below
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got(n.near_duplicates(df)) == brute(docs)


def test_alike_but_not_linked(spark, monkeypatch):
    """Copies that are somewhat too far from each other: the sets that are brought together grow with the copies, not with their pairs."""
    met, verified = [], linking._verified
    monkeypatch.setattr(linking, "_verified", lambda pairs, nodes, similarity: met.append(pairs.count()) or verified(pairs, nodes, similarity))
    docs = near_copies(random.Random(4), [f"b{i}" for i in range(150)], range(500), 4)
    assert got(n.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)
    assert sum(met) < 10 * len(docs), met


def test_parities_lose_no_pair(spark):
    """The filter passes all linked pairs, also where sets hold more shingles than there are bits, and sets without parities."""
    rng, similarity = random.Random(6), linking.Similarity(17, 20)
    rows = []
    for k in range(300):
        size = rng.choice((1, 3, 20, 150, 2000))
        base = [rng.randrange(2**64) for _ in range(size)]
        for i in range(2):
            cut = rng.randrange(size // 5 + 1)
            rows.append((2 * k + i, size, np.array(sorted(base[cut:] + [rng.randrange(2**64) for _ in range(rng.randrange(cut + 1))]), np.uint64)))
    sets = {i: s for i, _, s in rows}
    df = spark.createDataFrame([(i, len(s) + i % 3, bytearray(s.tobytes())) for i, _, s in rows], "id bigint, n int, keys binary")
    entries = df.select("id", "n")
    signed = linking._with_parities(entries, df.where("id % 10 > 0"))
    pairs = signed.alias("x").join(signed.alias("y"), F.expr("x.id = y.id - 1 and x.id % 2 = 0")).select("x.id", similarity.near("x", "y").alias("near")).collect()
    assert len(pairs) == 300
    linked = lambda i: 37 * len(np.intersect1d(sets[i], sets[i + 1])) >= 17 * (len(sets[i]) + i % 3 + len(sets[i + 1]) + (i + 1) % 3)
    assert all(r["near"] for r in pairs if linked(r["id"]) or r["id"] % 10 == 0)
    assert sum(linked(r["id"]) for r in pairs) > 50 and sum(not r["near"] for r in pairs) > 50


def test_bands_lose_no_link(spark):
    """Pairs at the threshold, of short and of long sets."""
    rng = random.Random(8)
    docs = []
    for k in range(400):
        base = [f"k{k}w{i}" for i in range(rng.choice((22, 42, 62, 102, 182)))]
        size = len(base) - 2
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"k{k}z{i}" for i in range(size * 3 // 17)]))]
    want = brute(docs)
    assert sum(not kept for *_, kept in want) == 400
    assert got(n.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))) == want


@pytest.mark.parametrize("most", [linking.EDGES, 0])
def test_union_find(spark, monkeypatch, most):
    """Chains, stars and a large ring over several tasks; once by contraction to the end."""
    monkeypatch.setattr(linking, "EDGES", most)
    edges = [(i, i + 1) for i in range(0, 500)] + [(1000, i) for i in range(1001, 1400)] + [(2000 + i, 2000 + (i + 1) % 300) for i in range(300)] + [(5000, 5001)]
    random.Random(1).shuffle(edges)
    with Scratch() as scratch:
        ends = {r["label"]: r["to"] for r in linking.connected(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), scratch).collect()}
    for part in (range(0, 501), range(1000, 1400), range(2000, 2300), range(5000, 5002)):
        assert len({ends.get(i, i) for i in part}) == 1
    assert len({*ends.values()}) <= 4


def test_scratch_deletes_its_tables(spark):
    import os

    with Scratch() as scratch:
        a, b = scratch(spark.range(3), "a"), scratch(spark.range(4), "b")
        folders = [f.rsplit("/", 1)[0].removeprefix("file://") for t in (a, b) for f in t.inputFiles()]
        scratch.drop(a)
        scratch.drop(spark.range(1))
        assert b.count() == 4
    assert folders and not any(map(os.path.exists, folders))


def test_shingles_of_three():
    assert len(shingle_set("a b c d", 3)) == 2 and len(shingle_set("A b", 3)) == 1 and (shingle_set("A b", 3) == shingle_set("a  B", 3)).all()
