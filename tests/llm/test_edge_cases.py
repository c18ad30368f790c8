"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import (
    decontamination, html_extraction, jaccard_join, language_id, license_scan, lm_scoring, queries, sentencepiece_codec, sharding, topk_search, url_filter,
)

WORDS = " ".join(f"w{i}" for i in range(40))
LONG = " ".join(f"x{i % 977}y{i}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, WORDS), (4, WORDS), (5, WORDS), (None, WORDS), (6, LONG), (7, "12 34 !!"), (4, "another text of the same id")]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    rows = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return rows.select("*", *[F.lit("clash").alias(c) for c in ("_id", "_h", "_row", "lang", "key", "n", "label", "score", "lang_pred", "shard", "size", "ids", "decoded")])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(10, WORDS), (9, WORDS), (8, "same id"), (7, None), (6, "..."), (None, "another text")], "item_id bigint, text string")
    rows = decontamination.contamination(docs, items).collect()
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert len(rows) == len(TEXTS)
    assert (by[4, 40]["n_hit"], by[4, 40]["items"], by[4, 40]["contaminated"]) == (40, ["10", "9"], True)
    assert by[None, 40]["n_hit"] == 40
    assert (by[4, 6]["n_hit"], by[4, 6]["items"]) == (4, ["8"])  # the null item hits words but isn't counted
    assert by[1, 0]["n_words"] == by[2, 0]["n_hit"] == 0 and not by[1, 0]["contaminated"]
    assert by[6, 30_000]["n_hit"] == 0 and by[7, 2]["n_words"] == 2
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_index_searches(spark, docs):
    index = decontamination.build_index(docs.where("doc_id in (4, 7)"))
    asked = spark.createDataFrame([(1, "W3 w4 w5"), (2, "w5 w4"), (3, "nope")], "query_id int, phrase string")
    assert got(decontamination.phrase_search(index, asked).distinct(), "query_id", "doc_id", "pos") == [(1, 4, 3)]
    near = decontamination.proximity_search(index, asked, 2)
    assert {(r["query_id"], r["doc_id"]) for r in near.collect()} == {(1, 4), (2, 4)}


def test_sentencepiece(spark, docs, none):
    codec = sentencepiece_codec.SentencePiece(spark, queries.MODEL_FILE, 0.3, 5)
    odd = spark.createDataFrame([("▁a ▁",), ("a▁b",), ("\0",), ("\u200b𠀀é",), ("  x  ",)], "text string")
    for df in (docs.drop("_row"), odd):
        for r in sentencepiece_codec.encode_documents(df, codec).collect():
            assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
    other = sentencepiece_codec.SentencePiece(spark, queries.MODEL_FILE, 0.3, 6)
    a, b = (sentencepiece_codec.encode_documents(docs.where("doc_id = 6"), c).first() for c in (codec, other))
    assert a["ids"] != b["ids"] and a["decoded"] == b["decoded"]
    assert sentencepiece_codec.encode_documents(none, codec).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_codec.SentencePiece(spark, queries.MODEL_FILE, 2.0)


def test_agenda_and_scan_agree():
    v = sentencepiece_codec.Vocabulary.load(queries.MODEL_FILE)
    codec = sentencepiece_codec.Codec(v, 0.3, 1, 1)
    for text in ("▁thetheandheretion", "▁abababab", "▁nnnnnnnnnnn"):
        assert codec._scan(list(text), 99) == codec._agenda(list(text), 99, 0)


def test_language_id(spark, docs, none):
    labelled = spark.createDataFrame([("the cat and the dog in the house", "en"), ("el perro y la casa de la abuela", "es"), ("nobody", None), (None, "fr"), ("", "de")], "text string, lang string")
    tests = spark.createDataFrame([(1, "the dog and the cat"), (2, "la casa del perro"), (3, None), (4, ""), (5, "12 !?"), (6, "字")], "doc_id int, text string")
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(tests, labelled).collect()}
    assert rows[1][0] == "en" and rows[2][0] == "es" and rows[6][0] in ("en", "es")
    assert rows[3] == rows[4] == rows[5] == ("und", 0.0)
    assert language_id.identify(docs, labelled).count() == len(TEXTS) and language_id.identify(none, labelled).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(tests, labelled.limit(0)).collect()} == {"und"}


def test_cross_parse_is_greedy():
    import numpy as np

    train = "abracadabra and the cat"
    parser = language_id.CrossParser({"x": [train]})
    for text in ("cad abra", "zzz", "the the cat", "b", "and the catx"):
        n = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in train:
                j += 1
            n, i = n + 1, max(j, i + 1)
        symbols = language_id._classes(parser.letters, parser.width)[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        assert round(parser._bits(symbols, np.array([len(symbols)]))[0, 0] / np.log2(parser.sizes[0])) == n


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/7x?q"), (3, "http://A.Example.COM/en/7x?q"), (4, "https://example.com/en/8#t"), (5, "http://com/en/"), (6, "http:///en/"), (7, "http://xexample.com"), (None, "http://b.org/es/a://c/"), (8, "https://q.net?x=://com/en/")], "page_id bigint, url string")
    pages = pages.select("*", F.lit(1).alias("host"), F.lit(2).alias("rule"), F.lit(3).alias("prefix"))
    rows = got(url_filter.url_filter(pages, queries.URL_RULES), "page_id", "host", "path", "rule", "verdict")
    assert rows == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (3, "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (4, "example.com", "/en/8", "com/en/", "block"), (5, "com", "/en/", "com/en/", "block"), (6, "", "/en/", None, "allow"), (7, "xexample.com", "", None, "allow"),
        (None, "b.org", "/es/a://c/", "org/es/", "block"), (8, "q.net", "", None, "allow"),
    ], key=repr)
    assert url_filter.url_filter(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, []).collect()} == {"allow"}
    both = url_filter.url_filter(spark.createDataFrame([(1, "http://a.com/x")], "page_id int, url string"), [("com", "/x", "allow"), ("com", "/x", "block")])
    assert both.first()["verdict"] == "block"


def test_sharding(docs, none):
    rows = sharding.shard_by_bytes(docs, 3).collect()
    assert len(rows) == len(TEXTS) and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8} and {r["text_crc32"] for r in rows if r["doc_id"] == 1} == {0}
    for s in {r["shard"] for r in rows}:
        mine = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))
    assert sharding.shard_by_bytes(none, 3).count() == 0


def test_jaccard(spark, docs, none):
    assert got(jaccard_join.components(docs), "doc_id", "n_shingles", "component_id") == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 36, 4), (4, 36, 4), (4, 2, 4), (5, 36, 4), (None, 36, 4), (6, 29_996, 6), (7, 1, 7)], key=repr
    )
    assert jaccard_join.components(none).count() == 0


def test_jaccard_groups_and_chains(spark):
    """Groups of near copies, a chain whose ends don't link, one common passage in unlike documents, and the very threshold."""
    base = [f"b{i}" for i in range(200)]
    near = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1 :])) for i, k in zip(range(100, 160), range(3, 200, 3))]
    chain = [(i, " ".join(f"c{k}" for k in range(i * 8, i * 8 + 100))) for i in range(200, 212)]
    passage = " ".join(f"p{k}" for k in range(60))
    common = [(i, " ".join(f"u{i}x{k}" for k in range(80)) + " " + passage) for i in range(300, 360)]
    edge = [(400, " ".join(f"t{k}" for k in range(11))), (401, " ".join([f"t{k}" for k in range(10)] + ["end"])), (402, " ".join(f"t{k}" for k in range(12)))]
    rows = near + chain + common + edge
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_corpus_queries import brute_components

    want = brute_components([(i, t, None) for i, t in rows])
    assert len({c for i, (_, c) in want.items() if i < 200}) == 1 and len({c for i, (_, c) in want.items() if 200 <= i < 300}) == 1
    assert len({c for i, (_, c) in want.items() if 300 <= i < 400}) == 60
    out = jaccard_join.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want


def test_html(spark):
    menu, foot = "<div>Home</div><div>About us</div>", "<div>All rights</div>"
    page = lambda body: f"<html><head><title>T</title></head><body>{menu}{body}{foot}</body></html>"
    rows = [
        (1, "http://a.com/x/1", page("<p>First &amp; own</p><p>Shared <b>quote</b></p>")), (2, "http://a.com/x/2", page("<p>Second own</p>")), (3, "http://a.com/y", page("<p>Third</p>")),
        (4, "http://solo.com/", "<nav>m</nav><article><header><h1>H</h1></header><p>One<br>two  three<p class='ad'>buy</p><div id=comments>me too</div><aside>x</aside></article>after"),
        (5, None, None), (6, "http://b.com/", ""), (7, "http://c.com/", "<script>var a = '<p>no</p>'</script><p>1 &lt; 2 <!-- c --></p><form><p>f</p></form><p"), (1, "http://a.com/x/1", page("<p>First &amp; own</p><p>Shared <b>quote</b></p>")),
        (8, "http://d.com/1", "<article><p>Copied text</p></article>"), (9, "http://d.com/2", "<article><p>Copied text</p></article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit("clash").alias("host"), F.lit("x").alias("_pos"), F.lit("x").alias("blocks"), F.lit("x").alias("lines"))
    text = {r["page_id"]: r["text"] for r in html_extraction.extract(pages.where("page_id <> 1").unionAll(pages.where("page_id = 1").limit(1))).collect()}
    assert text[1] == "First & own\nShared quote" and text[2] == "Second own" and text[3] == "Third"
    assert text[4] == "H\nOne two three\nafter" and text[5] == "" and text[6] == "" and text[7] == "1 < 2"
    assert text[8] == text[9] == "Copied text"
    assert html_extraction.extract(pages).count() == len(rows) and html_extraction.extract(pages.limit(0)).count() == 0


def test_common_lines():
    assert html_extraction.common_lines([1, 2, 3, 4, 2], [2, 9, 3, 2]) == ([1, 2, 4], [0, 2, 3])
    assert html_extraction.common_lines([], [1]) == ([], [])
    assert len(html_extraction.common_lines([7] * 50, [7] * 30)[0]) == 30


def test_lm(docs, none):
    out = lm_scoring.score(docs, docs)
    by = {r["doc_id"]: r for r in out.collect() if r["doc_id"] not in (4, None)}
    assert out.count() == len(TEXTS) and by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[6]["n_tokens"] == 30_001
    assert all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in by.values())
    alone = lm_scoring.score(docs, none).where("doc_id = 7").first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and alone["score"] == 0.0 == alone["base_score"]
    assert lm_scoring.score(none, docs).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [0.5, 0.1]), (2, [0.5, 0.1]), (3, [0.5, 0.1]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 0.0]), (8, [0.1]), (200, [-1.0, 2.5]), (None, [9.0, 9.0]), (9, [-3.0, -3.0])]
    rows += [(i, [0.25, 0.25]) for i in range(1000, 1060)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", F.lit(1).alias("score"), F.lit(2).alias("b"))
    ask = vectors.where("vec_id in (100, 200)").withColumnRenamed("vec_id", "query_id")
    out = topk_search.top_k(vectors, ask, 4)
    q = lambda v: [int(1024 * x // 1) for x in v]
    clean = sorted({(i, tuple(q(v))) for i, v in rows if i is not None and v and len(v) == 2 and None not in v and nan not in v and inf not in v and v[0] == v[0]})
    want = []
    for qi, qv in clean:
        if qi in (100, 200):
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in clean if i != qi)[:4]
            want += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got(out, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    few = vectors.where("vec_id in (1, 100)")
    assert topk_search.top_k(few, few.where("vec_id = 100").withColumnRenamed("vec_id", "query_id"), 10).count() == 1
    assert topk_search.top_k(vectors.limit(0), ask.limit(0), 10).count() == 0

def test_topk_in_cells(spark, monkeypatch):
    """Small cells and blocks, copies, ids of several vectors, ties, numbers of every width, vectors of several lengths."""
    for name, n in {"GROUP": 40, "SHARE": 3, "PAIRS": 50, "BLOCK": 16, "NUMBERS": 30, "AT_ONCE": 2}.items():
        monkeypatch.setattr(topk_search, name, n)
    rng = random.Random(11)
    for size in (1.0, 40.0, 3e5):
        some = [[rng.choice((-1, 1)) * rng.randrange(5) * size / 4 for _ in range(rng.choice((1, 3, 3, 3, 6)))] for _ in range(60)]
        rows = [(rng.randrange(150) if i % 4 else 7 + i % 3, rng.choice(some)) for i in range(250)]
        vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
        out = topk_search.top_k(vectors, vectors.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), 4)
        clean, want = sorted({(i, tuple(int(1024 * x // 1) for x in v)) for i, v in rows}), []
        for qi, qv in clean:
            if qi < 20:
                best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in clean if i != qi and len(v) == len(qv))[:4]
                want += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        assert len(want) > 100 and got(out, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_topk_asks_equal_queries_once_and_deals_them_once_a_group(spark, monkeypatch):
    """What is shuffled and compared doesn't grow with copies, nor with the product of queries and blocks."""
    packs, stored = [], topk_search.stored
    monkeypatch.setattr(topk_search, "stored", lambda df, name: packs.append((name, stored(df, name))) or packs[-1][1])
    rows = [(i, [float(i % 30), 1.0]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = topk_search.top_k(vectors, vectors.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id"), 2)
    assert out.count() == 3000
    sizes = {name: df.count() for name, df in packs}
    assert sizes["classes"] == 15 and sizes["found"] <= 15 * 3



def test_license(spark, docs, none):
    mit = "Copyright (c) 2020 Someone\n\n" + license_scan.MIT.upper().replace('"', "“").replace("\n", "\n\n  * ")
    texts = spark.createDataFrame([(1, mit), (2, "intro\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, license_scan.MIT + " and more"), (1, mit)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in license_scan.license_scan(texts).collect()}
    assert rows[1]["license"] == "MIT" and rows[1]["n_notices"] == 0
    assert rows[2]["license"] is None and rows[2]["notices"] == ["CC-BY-NC-4.0", "MIT"] and rows[2]["n_notices"] == 2
    assert rows[3]["text_sha256"] is None and rows[4]["license"] is None and rows[5]["license"] is None
    assert license_scan.license_scan(texts).count() == 6 and license_scan.license_scan(none).count() == 0
    assert license_scan.license_scan(docs).count() == len(TEXTS)


def test_lm_grows_with_the_corpus(spark):
    """A bigram seen twice stays in the model when a million other tokens are learned from as well."""
    few = [(i, "rare pair stands here") for i in (1, 2)] + [(3, "rare other"), (4, "some pair")]
    many = few + [(i, "filler " * 1800) for i in range(10, 610)]
    held = spark.createDataFrame([(0, "rare pair")], "doc_id bigint, text string")
    for rows in (few, many):
        r = lm_scoring.score(held, spark.createDataFrame(rows, "doc_id bigint, text string")).first()
        n = sum(len(t.split()) + 1 for _, t in rows)
        v = len({w for _, t in rows for w in t.split()}) + 1
        # rare: unigram 3 of n; rare -> pair 2 of 3; (rare, pair) -> end unseen, as is pair -> end twice or more
        p1 = lambda c: (c + 1) / (n + v + 1)
        after_pair = (1 - (2 - 0.6) / 3) / (1 - p1(2))  # pair -> stands
        after_rare_pair = (1 - (2 - 0.6) / 2) / (1 - (2 - 0.6) / 3)
        want = [p1(3), (2 - 0.6) / 3, after_rare_pair * after_pair * p1(len(rows))]
        assert abs(r["score"] - sum(map(__import__("math").log10, want))) < 1e-9


def test_dropout_varies_by_occurrence():
    """A word has its own skips at every place of a text and in every text, and what is remembered changes nothing."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(queries.MODEL_FILE), 0.1, 1)
    texts = [" ".join(["international"] * 40) + f" {i}" for i in range(50)]
    words = {}
    for t in texts:
        got = codec.units.findall(" " + t)
        words[t] = [codec.unit(u, k) for u, k in zip(got, codec.keys(t, len(got)))]
        assert codec.encode(t) == b"".join(words[t]) == codec.encode(t)
        assert len(set(words[t][1:40])) > 2
    assert len({w for t in texts for w in words[t][1:40]}) > 5
    assert len({tuple(w[1:40]) for w in words.values()}) == len(texts)
    n = sum(len(w[1:40]) for w in words.values())
    plain = sentencepiece_codec.Codec(codec.vocabulary, 0.0, 1).unit(" international", 0)
    kept = sum(w == plain for t in texts for w in words[t][1:40]) / n
    assert 0.9 ** len("▁international") < kept < 1


def test_many_texts_are_cut_by_the_pattern():
    """Runs of spaces, stops, white space and letters that pieces have before stops, in texts beside each other."""
    import random

    codec, draw = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(queries.MODEL_FILE), 0.1, 1), random.Random(5)
    texts = ["".join(draw.choice("  aZs9é_.,;:'-!)(\"\n\t\r▁東\u00a0\u2028😀t") for _ in range(draw.randrange(12))) for _ in range(20_000)]
    texts += ["", " ", "word", "word.", ".", "\n", *("x" * k + ". y" for k in range(60))]
    joined, begin = "", []
    want = []
    for t in filter(None, texts):
        begin.append(len(joined))
        joined += " " + t
        want += codec.units.findall(" " + t)
    starts = codec._cut(__import__("numpy").frombuffer(joined.encode("utf-32-le"), "uint32"), __import__("numpy").array(begin)).tolist()
    assert [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)])] == want
    plain = [b"".join(codec.unit(u, k) for u, k in zip(us, codec.keys(t, len(us)))) for t in texts for us in [codec.units.findall(" " + t) if t else []]]
    assert [x.values.to_numpy().tobytes() for x in codec.encode_batch(texts)] == plain
    assert len(codec.courses.of) == codec.courses.first.n  # what was drawn for one occurrence is not remembered


def test_a_worker_drops_its_codec(spark, tmp_path):
    """A codec with what it has met doesn't stay in a worker that goes on to other work (checked in the tasks that follow)."""
    import gc

    from pyspark.sql import functions as F

    codec = sentencepiece_codec.SentencePiece(spark, queries.MODEL_FILE, 0.1, 1)
    texts = spark.range(0, 64, 1, 8).select(F.col("id").cast("string").alias("text"))

    def held(batches):
        for batch in batches:
            gc.collect()
            n = sum(type(x).__name__ == "Codec" for x in gc.get_objects())
            yield batch.from_pydict({"n": [n]})

    assert texts.select(codec.encode(F.col("text")).alias("ids")).where("size(ids) > 0").count() == 64
    assert {r["n"] for r in texts.mapInArrow(held, "n long").collect()} == {0}


def test_language_sample(spark):
    """Shared openings, many copies and many languages don't take the sample."""
    import random

    header = "this header opens all documents of the collection and has nothing to say of their language " * 4
    draw = random.Random(1)
    words = {k: ["".join(draw.choice(letters) for _ in range(5)) for _ in range(200)] for k, letters in (("a", "abcdefgh"), ("b", "mnopqrst"))}
    body = lambda k: " ".join(draw.choice(words[k]) for _ in range(400))
    labelled = spark.createDataFrame([(header + body(k), k) for k in words for _ in range(20)], "text string, lang string")
    asked = spark.createDataFrame([(i, body("ab"[i % 2])) for i in range(20)], "doc_id int, text string")
    assert all(r["lang_pred"] == "ab"[r["doc_id"] % 2] and r["score"] > 0.9 for r in language_id.identify(asked, labelled).collect())
    sample = language_id.Sample(4, 40)
    copied = [(f"copy {k} " * 20, "x") for k in range(3) for _ in range(200)]
    others = [(" ".join(f"{w}{chr(97 + k)}" for w in words["a"][:20]), "x") for k in range(9)]
    rows = spark.createDataFrame(copied + others, "text string, lang string")
    once = spark.createDataFrame([*dict.fromkeys(copied + others)], "text string, lang string")
    assert language_id.fit(rows, sample).sizes == language_id.fit(once, sample).sizes
    alone = language_id.fit(spark.createDataFrame([("only text " * 11, "x"), ("y" * 7, "y")], "text string, lang string"), sample)
    assert alone.sizes == [109, 7]
    many = spark.createDataFrame([(f"word {k}", f"l{k}") for k in range(130)], "text string, lang string")
    assert len(language_id.fit(many, sample).languages) == 130


def test_html_names_rule_out_no_articles(spark):
    """Layout classes around an article, and weak names in one, lose no text; declared boilerplate goes all the same."""
    text = lambda page: [b for b, _ in html_extraction.blocks_of(page)]
    for says in ('class="layout has-sidebar"', "class=no-header", "class='with-nav'", 'class="comment-status-open"', 'id="social-policy"', 'class="sidebar widget"', 'role="search"'):
        assert text(f"<div {says}><p>Before</p><article><p>Text</p></article></div>") == ["Before", "Text"]
    assert text("<form><div class=ad>buy</div><main><p>Text</p></main></form>") == ["Text"]
    assert text("<article><p>Text</p><div class=comments><article>me too</article></div></article>") == ["Text"]
    assert text("<div class='sidebar'>x</div><form>y</form><nav><article>z</article></nav><main><div class=ads>buy</div>Text</main>") == ["Text"]
    page = lambda own: f"<article><p>{own}</p><p class=related>About {own}</p><div class='share'>Tell others</div><p class='notice'>Of {own}</p></article>"
    rows = spark.createDataFrame([(i, f"http://a.com/{i}", page(f"text{i}")) for i in (1, 2)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extraction.extract(rows).collect()} == {i: f"text{i}\nAbout text{i}\nOf text{i}" for i in (1, 2)}


def test_license_whole_texts(spark):
    """The complete texts, with and without the appendix, are known."""
    bsd = license_scan.BSD_2.replace("\nTHIS", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS")
    rows = [("BSD-3-Clause", "Copyright (c) 2020 Someone\n\n" + bsd), ("BSD-2-Clause", license_scan.BSD_2)]
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"):
        whole = (license_scan.WHOLE / f"{name}.txt").read_text()
        assert len(whole) > 10_000
        rows += [(name, whole), (name, whole.upper().replace("\n", "\n   "))]
        if "END OF TERMS AND CONDITIONS" in whole:
            rows.append((name, whole.split("END OF TERMS AND CONDITIONS")[0]))
    docs = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(rows)], "doc_id int, name string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(docs).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_html_markup_as_found():
    """Unquoted values, self-closed elements, references across tags, comments that are articles."""
    text = lambda page: [b for b, _ in html_extraction.blocks_of(page)]
    assert text("<p title=it's>Hello world. Don't stop</p><p>second</p>") == ["Hello world. Don't stop", "second"]
    assert text('<p title=\'a > b\' data-x="1 > 2">one</p><p a="unclosed>two</p>') == ["one", "two"]
    for raw in ("<svg width=1 />", "<iframe src=x />", "<iframe src=x>", "<svg><path d='M0'/></svg>", "<script>if (a < b) '<p>x</p>'</script>", "<title>T</title>"):
        assert text(f"<p>a</p>{raw}<p>b</p>") == ["a", "b"]
    assert text("<p>&am<b>p; b</b> &lt;i&gt; &amp;lt;</p>") == ["&amp; b <i> &lt;"]
    assert text("<article><p>Text</p><section id='search'><p>Of search</p></section><p class='related work'>Also</p></article><article class='comment'><p>me too</p></article>") == ["Text", "Of search", "Also"]
    long = "<div>" * 20_000 + "<p>deep</p>" + "<p a='" * 2_000
    assert text(long)[0] == "deep"


def test_cross_parse_of_long_texts():
    """One parse from beginning to end, however long the text and its phrases are, and languages with letters of their own."""
    import random

    import numpy as np

    draw = random.Random(7)
    train = {"a": "".join(draw.choice("ab ") for _ in range(3000)).replace("  ", " "), "b": "xyz " * 300 + "ab", "c": "字語文 " * 40}
    parser = language_id.CrossParser({k: [v] for k, v in train.items()})
    texts = ["".join(draw.choice("ab ") for _ in range(10_000)), "xyz " * 2_000, "xyz " * 64 + "q" + train["a"] * 3, "b" * 700, "字語文 字 ab" * 100, "", "ab"]
    folded = [" ".join("".join(c if c.isalpha() else " " for c in t).split(" ")) for t in texts]
    symbols, sizes = [], []
    for t in folded:
        while "  " in t:
            t = t.replace("  ", " ")
        symbols.append(language_id._classes(parser.letters, parser.width)[0][np.frombuffer(t.encode("utf-32-le"), np.uint32)])
        sizes.append(t)
    got = parser._bits(np.concatenate(symbols), np.array([len(t) for t in sizes]))
    for k, lang in enumerate(parser.languages):
        known = " ".join(train[lang].split())
        for i, t in enumerate(sizes):
            n = at = 0
            while at < len(t):
                end = at
                while end < len(t) and t[at : end + 1] in known:
                    end += 1
                n, at = n + 1, max(end, at + 1)
            assert round(got[k, i] / np.log2(parser.sizes[k])) == n, (lang, i)


def test_automaton_follows_failure_arcs():
    """Words a=0, b=1, c=2. States: 0, a=1, b=2, c=3, ab=4. Arcs: root's, b after a, c after ab; ab fails to b, b to the root."""
    import numpy as np

    keys = np.array([1 * 3 + 1, 4 * 3 + 2])
    machine = lm_scoring.Automaton(3, np.array([-1.0, -2.0, -3.0]), np.array([1, 2, 3]), keys, np.array([-0.5, -0.25]), np.array([4, 3]), np.array([0, 0, 0, 0, 2]), np.array([0.0, -0.1, -0.2, -0.4, -0.8]))
    after, cost = machine.step(np.array([0, 1, 4, 4, 2]), np.array([0, 1, 2, 0, 2]))
    assert after.tolist() == [1, 4, 3, 1, 3]
    assert np.allclose(cost, [-1.0, -0.5, -0.25, -0.8 - 0.2 - 1.0, -0.2 - 3.0])  # ab fails to b, b to the root
    code = np.array([0, 1, 2, 0, 1, 0, 2, 2, 0, 1])
    whole = machine.read(code, np.array([0]), np.array([0]), np.array([len(code)]))
    state, each = np.array([0]), []
    for w in code:
        state, c = machine.step(state, np.array([w]))
        each.append(c[0])
    assert np.allclose(whole, each)
    lanes = np.arange(0, len(code), 3)  # lanes inside a text, entered two words earlier
    assert np.allclose(machine.read(code, lanes, np.maximum(lanes - 2, 0), np.minimum(lanes + 3, len(code))), whole)
    none = lm_scoring.Automaton(3, machine.base, machine.target, keys[:0], keys[:0], keys[:0], machine.fail, machine.weight)
    assert np.allclose(none.step(np.array([0, 4]), np.array([2, 1]))[1], [-3.0, -0.8 - 0.2 - 2.0])


def plain(page):
    return [t for t, _ in html_extraction.blocks_of(page)]


def test_html_comments_and_inline_elements():
    page = "<body><article><div id='comments-1' class='user-comments'><p>reader</p></div><p>z</p><ul class='comment-list'><li>one</li></ul></article></body>"
    assert plain(page) == ["z"]
    assert plain("<body class='comment-status-open'><article><p>See <span class='notice'>this</span> now, <a class='link' href='x'>there</a>.</p></article>") == ["See this now, there."]
    assert html_extraction.blocks_of("<article><p>See <span class='notice'>this</span> now</p></article>") == [("See this now", True)]
    assert plain("<article><p>a <span class='ad'>buy <b>me</b></span>b <button>x</button>c<br>d</p></article>") == ["a b c d"]
    assert plain("<div class='user-comments'><p>only this</p></div>") == ["only this"]  # a page has nothing else
    assert plain("<div class='user-comments'><article><p>text</p></article><p>more</p></div>") == ["text", "more"]
    assert plain("<div class='user-comments'><p>gone</p></div><p>kept</p>") == ["kept"]
    assert plain("<p>a</p><svg><path>b</path></svg><p>c<svg>d") == ["a", "cd"] and plain("<p>a</p><script>x") == ["a"]
    assert plain("a < b <c") == ["a < b"] and plain("x <a b=1") == ["x"]


def test_html_is_linear():
    import time

    for piece in ("<svg>", "<div></span>", "<a b=", "<p><b>", "</div>", "<a b='", "<!--", "<div class='comments'>"):
        took = []
        for n in (10_000, 40_000):
            began = time.perf_counter()
            html_extraction.blocks_of(piece * n)
            took.append(time.perf_counter() - began)
        assert took[1] < max(10 * took[0], 1.0), (piece, took)


def test_html_differencing_by_brute_force(spark):
    """Random pages without articles: each loses the lines of a longest common subsequence with its nearest neighbour by path."""
    import random

    rng = random.Random(3)
    pages = []
    for k in range(40):
        path = "/" + "/".join(rng.choice("ab") for _ in range(3)) + f"/{k:02}"
        pages.append((k, f"http://{rng.choice('xy')}.org{path}", "".join(f"<p>{rng.choice('mnopqr')}</p>" for _ in range(rng.randrange(0, 9)))))
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    for host in "xy":
        mine = sorted((u.split("/", 3)[3], k, plain(h)) for k, u, h in pages if f"//{host}." in u)
        for i, (path, k, lines) in enumerate(mine):
            near = [(next((n for n, (c, d) in enumerate(zip(path, mine[j][0])) if c != d), min(len(path), len(mine[j][0]))), j < i, mine[j][2]) for j in (i - 1, i + 1) if 0 <= j < len(mine)]
            other = max(near, key=lambda x: x[:2])[2] if near else []
            best = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
            for x, a in enumerate(lines):
                for y, b in enumerate(other):
                    best[x + 1][y + 1] = best[x][y] + 1 if a == b else max(best[x][y + 1], best[x + 1][y])
            left = got[k].split("\n") if got[k] else []
            assert len(left) == len(lines) - best[-1][-1]
            rest = iter(lines)
            assert all(x in rest for x in left)  # in order
