"""The corpus queries against SQL where there is some, and against brute force on whole small tables otherwise."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries as q
from tallyforge.llm import sentencepiece_codec

ORACLE = q.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, data, same_as_duckdb):
    same_as_duckdb(q.queries()[name](spark, data), ORACLE[name])


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op2_round_trip(spark, data, docs):
    rows = q.op2_sentencepiece(spark, data).collect()
    assert len(rows) == len(docs) and all(r["lossless"] for r in rows)
    assert sum(r["decoded_bytes"] for r in rows) == sum(len(t.encode()) for _, t, _ in docs)


def test_op2_without_dropout_is_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=q.MODEL_FILE)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(q.MODEL_FILE), 0.0, 0, 1)
    for text in [t for _, t, _ in docs[:80]] + [" x", "a  b\n c", "é 字𠀀", "x" * 200, "\tt\r\n\n z", "Hello, World! don't", "    four"]:
        assert codec.encode_batch([text]).to_pylist()[0] == model.encode(text)


def test_op2_brute_force(spark, data, docs):
    """All texts by a plain agenda: the best pair left comes up, and is merged or skipped as its hash says."""
    m = sentencepiece_codec
    v = m.Vocabulary.load(q.MODEL_FILE)
    codec, below = m.Codec(v, q.DROPOUT, q.SEED), int(q.DROPOUT * 2**64)
    id_of = {v.pieces[i]: i for i in range(v.first_piece, len(v.pieces))}

    def plain(text):
        ids, units = [], codec.units.findall(" " + text)
        for unit, key in zip(units, codec.keys(text, len(units))):
            part = [("▁" if c == " " else c, i, i + 1) for i, c in enumerate(unit)]
            skipped = set()
            while True:
                pairs = [(v.ranks[id_of[a[0] + b[0]]], k) for k, (a, b) in enumerate(zip(part, part[1:])) if a[0] + b[0] in id_of and (a[1], b[1], b[2]) not in skipped]
                if not pairs:
                    break
                k = min(pairs)[1]
                (x, i, j), (y, _, end) = part[k], part[k + 1]
                if (key ^ m.LEFT[i & m.PLACES] ^ m.MIDDLE[j & m.PLACES] ^ m.RIGHT[end & m.PLACES]) * m.SPREAD % 2**64 < below:
                    skipped.add((i, j, end))
                else:
                    part[k : k + 2] = [(x + y, i, end)]
            for s, _, _ in part:
                ids += [id_of[s]] if s in id_of else [v.first_byte + b for b in s.encode()]
        return ids

    sp = m.SentencePiece(spark, q.MODEL_FILE, q.DROPOUT, q.SEED)
    got = {r["doc_id"]: list(r["ids"]) for r in m.encode_documents(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), sp).collect()}
    short = [(i, t) for i, t, _ in docs if len(t) < 20_000]
    assert len(short) > 0.9 * len(docs) and all(got[i] == plain(t) for i, t in short)


def test_op3_held_out_accuracy(spark, data, docs):
    rows = {r["doc_id"]: r for r in q.op3_language_id(spark, data).collect()}
    assert len(rows) == len(docs)
    held = [(rows[i], lang) for i, _, lang in docs if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (remainder(i, 4) == 2) for i, _, _ in docs)
    assert sum(r["lang_pred"] == lang for r, lang in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_op5_law(spark, data, docs):
    rows = q.op5_sharding(spark, data).collect()
    texts = {i: (t or "").encode() for i, t, _ in docs}
    assert len(rows) == len(docs)
    shards = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["grown_shard"] is None
        shards[r["shard"]].append(r)
    order = sorted(rows, key=lambda r: r["doc_id"])
    total, before = sum(r["size"] for r in rows), 0
    for r in order:  # contiguous, and cut at equal targets
        assert r["shard"] == (2 * before + r["size"]) * 24 // (2 * total)
        before += r["size"]
    for rs in shards.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))


def brute_components(docs):
    sets, parent = {}, {}
    for i, t, _ in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    where = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            where[s].add(i)
    for i in ids:
        for j in {j for s in sets[i] for j in where[s] if j > i}:
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op6_brute_force(spark, data, docs):
    want = brute_components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op6_jaccard_join(spark, data).collect()} == want


def test_op7_whole_articles(spark, data):
    import html
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in q.op7_html_extraction(spark, data).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", article)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_op8_brute_force(spark, data, docs):
    def tokens(t):
        return (t or "").encode().lower().split() + [b" "]

    c, grams = Counter(), [Counter(), Counter()]
    for i, t, _ in docs:
        if remainder(i, 7) != 2:
            k = tokens(t)
            c.update(k), grams[0].update(zip(k, k[1:])), grams[1].update(zip(k, k[1:], k[2:]))
    n, v = sum(c.values()), len(c)
    two = {g: k for g, k in grams[0].items() if k >= 2 and min(c[w] for w in g) >= 2}
    three = {g: k for g, k in grams[1].items() if k >= 2 and g[:2] in two and g[1:] in two}
    after = defaultdict(dict)
    for g, k in [*two.items(), *three.items()]:
        after[g[:-1]][g[-1]] = k
    count, alphas = {**{(w,): k for w, k in c.items()}, **two}, {}

    def p(h, w):
        if not h:
            return (c[w] + 1) / (n + v + 1)
        if h not in after:
            return p(h[1:], w)
        if w in after[h]:
            return (after[h][w] - 0.6) / count[h]
        if h not in alphas:
            alphas[h] = (1 - sum(k - 0.6 for k in after[h].values()) / count[h]) / (1 - sum(p(h[1:], x) for x in after[h]))
        return alphas[h] * p(h[1:], w)

    texts = {i: t for i, t, _ in docs}
    rows = q.op8_lm_scoring(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        k = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(k), sum(c[w] > 0 for w in k), n, remainder(r["doc_id"], 7) == 2)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in k), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(tuple(k[max(0, j - 2) : j]), w)) for j, w in enumerate(k)), rel_tol=1e-9)
    h = next(h for h in after if len(h) == 2)
    assert math.isclose(sum(p(h, w) for w in c) + p(h, b"no such word"), 1.0, rel_tol=1e-9)


def test_pipeline_brute_force(spark, data, docs):
    """Every stage's decisions, recomputed from the operators' own definitions."""
    import re

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    out = {r["doc_id"]: r for r in q.pipeline(spark, data).collect()}
    kept = [d for d in docs if any(ch.isalpha() for ch in d[1] or "")]
    groups = brute_components(kept)
    kept = [d for d in kept if groups[d[0]][1] == d[0]]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    want = set()
    for i, t, _ in kept:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(i)
    assert set(out) == want and all(r["lossless"] for r in out.values())
