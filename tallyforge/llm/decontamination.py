"""Benchmark decontamination over a distributed positional inverted index.

Test items are cut into windows of consecutive words. The corpus is scanned once for the frequency of the test terms; a
window with a term the corpus lacks can't occur. Postings (term, document, position) are then stored for the rarest
terms of each other window, their lists are moved by each term's place in the window and intersected, and what is left
is confirmed word by word. The same index answers phrase and proximity searches.

Words: A-Z lower-cased, then runs of digits, a-z and everything beyond ASCII.

Defined results. Null or wordless text: no words, nothing hit, not contaminated. An item with fewer words than a window,
but some, is one window; one without words has none. Null item_id: its windows hit words, but no item is counted. Equal
rows get equal results; an id that repeats with another text is another document. Empty tables: no rows, or no hits.
Items with no hit: the digest of the empty string. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, broadcast_if, row_key, stored

# What separates words, before and after A-Z are lower-cased.
BREAKS = r"[\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
#: Windows, terms or candidates of up to so many bytes, counted with room for what a hash table adds, are broadcast; more are joined
#: by shuffle, where Spark splits skewed terms.
BROADCAST = 32 << 20
#: The second-rarest list is intersected if it is at most so many times as long; else the words confirm at once.
WORTH = 64


def fits(df: DataFrame, size: Column) -> bool:
    """Whether rows of this size are few enough to broadcast."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST


def pieces(text: Column) -> Column:
    """Words in their own case; an empty string may stand first and last, so places in the array are word positions plus 0 or 1."""
    return F.split(text, BREAKS)


def count_words(text: Column) -> Column:
    p = pieces(text)
    n = F.size(p) - (p[0] == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
    return F.coalesce(n, F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.filter(pieces(ascii_lower(text)), lambda w: w != "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """items(item_id, text) -> stored distinct windows: wid, n (words), window (joined by spaces), items."""
    w = F.col("w")
    cut = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = cut.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size, F.lit(0)) + 1), lambda i: F.slice(w, i, size))).alias("w"))
    named = each.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("n")).agg(F.collect_set("item_id").alias("items"))
    return stored(named.withColumn("wid", F.monotonically_increasing_id()), "windows")


def tokens(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> term, _id, _h, pos."""
    spread = docs.select(*row_key("doc_id", "text"), F.posexplode(pieces(F.col("text"))).alias("pos", "w")).where(F.col("w") != "")
    return spread.select(ascii_lower(F.col("w")).alias("term"), "_id", "_h", "pos")


def postings(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """The index: positions of the given terms in every document."""
    return tokens(docs).join(broadcast_if(small, terms.select("term").distinct()), "term", "left_semi")


def rarest_terms(docs: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """Per window that can occur, its one or two rarest terms: wid, n, term, off (place), bit, need (bits that make a hit)."""
    places = wins.select("wid", "n", F.posexplode(F.split("window", " ")).alias("off", "term")).groupBy("wid", "n", "term").agg(F.min("off").alias("off"))
    seen = postings(docs, places, small).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    w = Window.partitionBy("wid")
    ranked = (
        places.join(seen, "term", "left")
        .withColumn("all_seen", F.count("cf").over(w) == F.count(F.lit(1)).over(w))
        .withColumn("k", F.row_number().over(w.orderBy("cf", "term")))
        .withColumn("least", F.min("cf").over(w))
        .where("all_seen and (k = 1 or k = 2 and cf <= least * {})".format(WORTH))
    )
    return ranked.select("wid", "n", "term", "off", F.expr("shiftleft(1, k - 1)").alias("bit"), F.sum(F.expr("shiftleft(1, k - 1)")).over(w).cast("int").alias("need"))


def intersect(index: DataFrame, probes: DataFrame, small: bool) -> DataFrame:
    """Offset-adjusted intersection of the lists of each window's probes: _id, _h, wid, n, start (place of the first word)."""
    moved = index.join(broadcast_if(small, probes), "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    met = moved.groupBy("_id", "_h", "wid", "n", "start").agg(F.bit_or("bit").alias("bits"), F.first("need").alias("need"))
    return met.where("bits = need").drop("bits", "need")


def confirm(docs: DataFrame, found: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """The candidates whose words all agree: _id, _h, wid, start, n, items."""
    per_doc = stored(found.groupBy("_id", "_h").agg(F.collect_list(F.struct("wid", "start", "n")).alias("found")), "candidates")
    few = fits(per_doc, 64 + 32 * F.size("found"))
    k = per_doc.select(F.col("_id").alias("k_id"), F.col("_h").alias("k_h"), "found")
    text = docs.select(*row_key("doc_id", "text"), "text")
    met = text.join(broadcast_if(few, k), (F.col("_h") == F.col("k_h")) & F.col("_id").eqNullSafe(F.col("k_id")))
    got = F.transform(  # the outer transform binds the text's words once
        F.array(pieces(F.col("text"))),
        lambda p: F.transform(F.col("found"), lambda c: F.struct(c["wid"].alias("wid"), c["start"].alias("start"), c["n"].alias("n"), ascii_lower(F.array_join(F.slice(p, c["start"] + 1, c["n"]), " ")).alias("got"))),
    )[0]
    return (
        met.select("_id", "_h", F.inline(got))
        .join(broadcast_if(small, wins.select("wid", "window", "items")), "wid")
        .where(F.col("got") == F.col("window"))
        .drop("got", "window")
    )


def occurrences(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Every place where a window's words stand in a document."""
    small = fits(wins, 2 * F.octet_length("window") + 64 * (F.col("n") + 1) + 16 * F.size("items"))  # as windows, or as terms
    probes = stored(rarest_terms(docs, wins, small), "probes")
    index = stored(postings(docs, probes, small), "postings")
    return confirm(docs, intersect(index, probes, small), wins, small)


def covered(spans: Column) -> Column:
    """Number of places that spans (struct(start, stop), sorted) cover."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans, zero,
        lambda a, s: F.struct(F.greatest(a["upto"], s["stop"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, n_words, n_hit, items (sorted as strings), contaminated, row_hash (of id and text).

    Contaminated: some word is hit and share * n_hit >= n_words.
    """
    hits = (
        occurrences(docs, windows(items, size))
        .groupBy("_id", "_h")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        .select(F.col("_id").alias("h_id"), F.col("_h").alias("h_h"), covered(F.col("spans")).alias("n_hit"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    )
    every = docs.select("doc_id", *row_key("doc_id", "text"), count_words(F.col("text")).alias("n_words"))
    both = every.join(hits, (F.col("_h") == F.col("h_h")) & F.col("_id").eqNullSafe(F.col("h_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.col("_h").alias("row_hash"),
    )


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings of all terms, or of terms(term)."""
    return stored(tokens(docs) if terms is None else postings(docs, terms, fits(terms, 2 * F.octet_length("term") + 64)), "postings")


def phrase_search(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases(query_id, phrase) -> query_id, doc_id, pos of the first word, by intersecting the moved lists of all words."""
    asked = phrases.select("query_id", words(F.col("phrase")).alias("w")).select("query_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))
    moved = index.join(asked, "term").withColumn("start", F.col("pos") - F.col("off"))
    met = moved.groupBy("query_id", "_id", "_h", "start", "n").agg(F.count_distinct("off").alias("k")).where("k = n")
    return met.select("query_id", F.col("_id").alias("doc_id"), F.col("start").alias("pos"))


def proximity_search(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """queries(query_id, phrase) -> query_id, doc_id, pos: places of the query's rarest word with all its others at most `within` words off."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("phrase")))).alias("term"))
    w = Window.partitionBy("query_id")
    ranked = (
        asked.join(index.groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "term", "left")
        .withColumn("k", F.row_number().over(w.orderBy(F.coalesce("cf", F.lit(0)), "term")))
        .withColumn("m", F.count(F.lit(1)).over(w))
    )
    lists = index.join(ranked, "term").withColumn("bin", F.floor(F.col("pos") / (within + 1)))
    near = lists.where("k = 1").select("query_id", "_id", "_h", "m", F.col("pos").alias("at"), F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"))
    met = near.join(lists.select("query_id", "_id", "_h", "bin", "term", "pos"), ["query_id", "_id", "_h", "bin"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    return met.groupBy("query_id", "_id", "_h", "at", "m").agg(F.count_distinct("term").alias("c")).where("c = m").select("query_id", F.col("_id").alias("doc_id"), F.col("at").alias("pos"))
