"""Alignment against token ends compared offset by offset, the transducer by itself, and edge cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries as q
from tallyforge.llm import token_alignment as t

ODD = ["<|endoftext|> a <s> </s> <unk>", "a\0b", "é́ ﬁ Å ①  x", "  lead\t\ttab\r\n", "﻿x", "𠀀字 한국", " ", "\n", "a" * 3000, " " * 9000 + "x", "!?" * 500, "don't we'll 12 345", "​"]


@pytest.fixture(scope="module")
def aligner():
    return t.Aligner(t.ByteLevel(Path(q.BYTE_FILE).read_bytes()), t.Pieces(Path(q.MODEL_FILE).read_bytes()))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(q.BYTE_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=q.MODEL_FILE)


def brute(text, a, b):
    """[(A ids, B ids)] by the offsets at which tokens end, with each library's own tokens; None if bytes differ."""
    if not text:
        return None
    code = {0x100 + k: c for k, c in enumerate(c for c in range(256) if not (0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or 0xAE <= c))}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(code.get(ord(c), ord(c)) for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
        return None

    def ends(parts):
        out, n = {}, 0
        for k, p in enumerate(parts):
            n += len(p)
            out[n] = k + 1
        return out

    ea, eb = ends(bytes_a), ends(bytes_b)
    cut, groups = [(0, 0), *((ea[e], eb[e]) for e in sorted(ea.keys() & eb.keys()))], []
    for (i, j), (k, m) in zip(cut, cut[1:]):
        groups.append((ids_a[i:k], ids_b[j:m]))
    return groups


def expected(texts, a, b):
    each = [brute(x, a, b) for x in texts]
    count = Counter((x[-1], y[-1]) for groups in each for x, y in groups or [])
    highest = defaultdict(int)
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    out = []
    for groups in each:
        groups = groups or []
        links = [(x[-1], y[-1]) for x, y in groups]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op13_brute_force(spark, data, libraries):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = dict(zip((d["doc_id"] for d in docs), expected([d["text"] for d in docs], *libraries)))
    rows = q.op13_token_alignment(spark, data).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == want


def test_fast_tokens_are_the_library_s(aligner, libraries, spark, data):
    assert aligner.a.fast is not None
    texts = [" " + (r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + ODD
    assert all(aligner.a.encode(x) == libraries[0].encode(x, add_special_tokens=False).ids for x in texts)
    assert aligner.a.encode(" " * 100_000) == libraries[0].encode(" " * 100_000, add_special_tokens=False).ids  # too long for the fast way


def test_edge_cases(spark, libraries):
    texts = [None, "", "a ▁ b", *ODD, "same text", "same text", "word " * 30_000]
    df = spark.createDataFrame([(None if k == 5 else min(k, 9), x) for k, x in enumerate(texts)], "doc_id int, text string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("row", "a", "b", "links", "count", "best", "n_a")])
    files = t.Tokenizers(spark, q.BYTE_FILE, q.MODEL_FILE)
    want = expected(texts, *libraries)
    assert want[:3] == [(0, 0, 0, 0, 0, 0, "")] * 3
    ids = [r["doc_id"] for r in df.collect()]
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in t.align(df, files).collect()), key=repr)
    assert got == sorted(((i, *w) for i, w in zip(ids, want)), key=repr)
    assert t.align(df.limit(0), files).count() == 0
    assert t.align(df.where("text is null"), files).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]
    groups = {r["doc_id"]: (r["a"], r["b"]) for r in t.alignments(df.where("doc_id in (0, 3)"), files).collect()}
    assert groups[0] == (None, None) and [*zip(*groups[3])] == brute(texts[3], *libraries)


def test_cuts_change_nothing(aligner, libraries, spark, data, monkeypatch):
    """Results remembered by cut, with a memory that is emptied now and then, and whole texts, against the offsets."""
    assert aligner.cuts
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()][:60] + ODD
    texts += ["a ▁ b", "x  y", " x y ", "a\u00a0 b", "a \u0300b", "a 's b", "( ( 1 ² ½", "a\x1c b", "a  b c  d  e", "  ", " a", "a "]
    monkeypatch.setattr(t, "CUTS", 3000)
    for x in texts:
        groups = brute(x, *libraries)
        for cuts in (True, False):
            aligner.cuts = cuts
            got = aligner.summary(x)
            if groups is None:
                assert got[:4] == (0, 0, 0, "")
                continue
            line = ";".join(",".join(map(str, y)) + "|" + ",".join(map(str, z)) for y, z in groups)
            assert got[:4] == (sum(len(y) for y, _ in groups), sum(len(z) for _, z in groups), len(groups), hashlib.sha256(line.encode()).hexdigest())
            assert {(y, z): n for y, z, n in zip(*(v.tolist() for v in got[4:]))} == Counter((y[-1], z[-1]) for y, z in groups)


def test_counts_beyond_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"w{k % 7} and some text {k % 3}") for k in range(60)], "doc_id int, text string")
    files = t.Tokenizers(spark, q.BYTE_FILE, q.MODEL_FILE)
    broadcast = sorted(t.align(df, files).collect())
    monkeypatch.setattr(t, "PAIRS", 0)
    assert sorted(t.align(df, files).collect()) == broadcast


def cuts(rng, data, size):
    at = sorted(rng.sample(range(1, len(data)), min(len(data) - 1, size)))
    return [data[i:j] for i, j in zip([0, *at], [*at, len(data)])]


def test_transducer(monkeypatch):
    """Random cuts of random bytes; memo emptied now and then; bytes that differ."""
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"ab") for _ in range(n)) for n in range(1, 8) for _ in range(200)]
    vocabulary = [*dict.fromkeys(pieces)]
    number = {p: k for k, p in enumerate(vocabulary)}
    monkeypatch.setattr(t, "MEMO", 50)
    machine = t.Transducer(vocabulary, vocabulary)
    for _ in range(300):
        whole = bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 60)))
        a, b = (cuts(rng, whole, rng.randrange(0, 30)) for _ in range(2))
        if not all(p in number for p in a + b):
            continue
        ends = [[len(b"".join(x[: k + 1])) for k in range(len(x))] for x in (a, b)]
        both = sorted({*ends[0]} & {*ends[1]})
        assert machine.groups([number[p] for p in a], [number[p] for p in b]) == ([ends[0].index(e) + 1 for e in both], [ends[1].index(e) + 1 for e in both])
    assert machine.groups([number[b"a"]], [number[b"b"]]) is None
    assert machine.groups([number[b"a"], number[b"a"]], [number[b"a"]]) is None
    assert machine.groups([number[b"a"]], [number[b"a"], number[b"a"]]) is None
    assert machine.groups([], []) == ([], [])
    twice = t.Transducer([b"ab", b"c"], [b"a", b"b", b"bc"])
    assert twice.groups([0, 1], [0, 2]) == ([2], [2])
    steps = twice.steps
    assert twice.groups([0, 1], [0, 2]) == ([2], [2]) and twice.steps == steps  # nothing is compared again
