"""Near-duplicate detection by SuperMinHash signatures, banding, verification on full sets, and union-find.

A document is the set of its distinct word shingles; equal sets are one class. Each shingle has a random order of the signature's
places and, for the place that is j-th in its order, a rank in [j, j + 1); a place takes the least rank of all shingles. So the
ranks of a shingle are correlated, as it has one place for each integer, and the share of places where two signatures agree varies
less about the similarity than with independent hashes. All shingles of many documents advance a rank together, and a
document stops once all its places are taken, since later ranks are higher: a long one after a single rank.

Signatures are cut into bands; classes with an equal band are candidates. At a similarity of 0.85 two signatures of 128 places lack a
common band of 4 with a chance of (1 - 0.85**4)**32 < 6e-11 a pair, which is what a link may be lost by. Candidates are verified on
their full sets, read from the texts of these classes only. Lists of a band that still hold many pairs of
different components after rounds of pivots (texts that share a long passage do) go through the exact prefix join instead, so no
list is cut and none is gone through pair by pair while it is long.

Defined results. Null or wordless text: no shingles, linked with nothing, a component of its own. Fewer words than a shingle: the
whole sequence is the one shingle. Rows with one doc_id are one node, even if their texts differ. Null doc_id: linked like others;
component_id is the smallest id that is reachable, null where there is none. kept: whether doc_id is component_id, two nulls being
equal. Repeated rows: each is returned. doc_id must be an integer. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join, linking
from .common import Scratch, broadcast_if, stored
from .jaccard_join import component, shingle_set
from .linking import Similarity

#: Shingles that advance together, unless one document has more, and texts that a worker holds at once.
AT_ONCE, TEXTS = 100_000, 256
#: Pairs for each listed row (a class has as many as bands) from which another way than going through them is taken.
MANY = 1
#: Pivots that a class meets in a round.
PIVOTS = 3
#: Candidate classes that are broadcast at most (40 bytes each).
CHOSEN = 500_000
_FREE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class SuperMinHash:
    """size: places of a signature, at most 256. A rank is its integer part in the upper 8 bits and 56 random ones."""

    size: int = 128
    seed: int = 1

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of ranks for each set; an empty set's are all free."""
        m = self.size
        out = np.full(len(sets) * m, _FREE)
        elements = np.concatenate([*sets, np.empty(0, np.uint64)])
        base = np.repeat(np.arange(len(sets)) * m, [len(s) for s in sets])
        order = None  # by shingle, its places as far as they are dealt
        for j in range(m):
            if not len(elements):
                break
            h = _mix(elements + np.uint64((self.seed * 256 + j) * 0x9E3779B97F4A7C15 & 2**64 - 1))
            other = (j + ((h & np.uint64(2**32 - 1)) * np.uint64(m - j) >> np.uint64(32))).astype(np.int64)
            if order is None:
                place = other
            else:  # a step of Fisher and Yates's shuffle
                at = np.arange(len(elements))
                place = order[at, other].astype(np.int64)
                order[at, other] = order[:, j]
            np.minimum.at(out, base + place, np.uint64(j << 56) | (h >> np.uint64(8)))
            open_ = (out.reshape(-1, m) == _FREE).any(axis=1)[base // m]
            if order is None:
                elements, base, other = elements[open_], base[open_], other[open_]
                order = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
                order[np.arange(len(elements)), other] = 0
            elif not open_.all():
                elements, base, order = elements[open_], base[open_], order[open_]
        return out.reshape(-1, m)

    def bands(self, signatures: np.ndarray, rows: int) -> np.ndarray:
        """A hash of each band of so many places."""
        parts = signatures.reshape(len(signatures), -1, rows)
        out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
        for k in range(rows):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
        return out.view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """The estimate of two sets' similarity by their signatures."""
    return float((x == y).mean())


_SIGNED = "doc_id bigint, text_hash bigint, n int, d1 bigint, d2 bigint, bands array<bigint>"


def _signed(width: int, hasher: SuperMinHash, rows: int):
    """(doc_id, text, text_hash) -> size and digest of the set, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                texts = part.column(1).dictionary_encode()  # copies are hashed once
                sets = [shingle_set(t.as_py(), width) for t in texts.dictionary]
                sizes = np.array([len(s) for s in sets], np.int64)
                lanes, signatures = np.cumsum(sizes) // AT_ONCE, []
                for k in np.unique(lanes):
                    signatures.append(hasher.signatures([sets[i] for i in np.flatnonzero(lanes == k)]))
                bands = hasher.bands(np.concatenate(signatures), rows) if signatures else np.empty((0, 0), np.int64)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                at = texts.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                n = np.where(at < 0, 0, np.append(sizes, 0)[at]).astype(np.int32)
                some = n > 0
                d = np.zeros((len(at), 2), np.int64)
                d[some] = digests[at[some]]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * bands.shape[1])), pa.int32()), pa.array(bands[at[some]].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["doc_id", "text_hash", "n", "d1", "d2", "bands"])

    return run


_NODES = "rep bigint, least bigint, gid bigint, n int, keys binary"


def _with_sets(width: int):
    """(rep, least, gid, n, text) -> the text's set in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                keys = pa.array([shingle_set(t.as_py(), width).tobytes() for t in part.column(4)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], keys], ["rep", "least", "gid", "n", "keys"])

    return run


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs(text, text_hash), classes(rep, least, gid, n, text_hash) -> each class with one of its texts."""
    few = broadcast_if(classes.count() <= CHOSEN, classes)
    met = docs.join(few, "text_hash").groupBy("rep").agg(*(F.first(c).alias(c) for c in ("least", "gid", "n", "text")))
    return met.select("rep", "least", "gid", "n", "text")


def near_duplicates(docs: DataFrame, width: int = 3, similarity: Similarity = Similarity(17, 20), hasher: SuperMinHash = SuperMinHash(), rows: int = 4) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept. rows: places of a band."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    with Scratch() as scratch:
        scan = scratch(texts.mapInArrow(_signed(width, hasher, rows), _SIGNED), "signatures")
        same = ["n", "d1", "d2"]
        by_set = scan.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"))
        sets = scratch(by_set.withColumn("rep", F.coalesce("least", "d1")).withColumn("whole", F.xxhash64("bands")), "sets")
        classed = scratch(scan.select("doc_id", *same).join(sets.select(*same, "rep", "least"), same, "left").select("doc_id", "n", "rep", "least"), "classed")
        scratch.drop(scan)
        groups = sets.groupBy("n", "whole").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"))
        classes = scratch(sets.drop("bands", "d1", "d2").join(groups, ["n", "whole"]).drop("whole"), "classes")
        bands = sets.join(classes.where("rep = gid").select("rep"), "rep").select(F.explode("bands").alias("key"), F.col("rep").alias("id"), "n", F.lit(0).alias("i"))
        lists = scratch(bands.join(bands.groupBy("key").count().where("count > 1").select("key"), "key"), "lists")
        scratch.drop(sets)
        met = classes.join(lists.select(F.col("id").alias("gid")).distinct().withColumn("met", F.lit(True)), "gid", "left").where("met or members > 1")
        chosen = scratch(met.select("rep", "least", "gid", "n", "text_hash"), "chosen")
        picked = _texts(texts.select("text", "text_hash"), chosen)
        nodes = scratch(picked.mapInArrow(_with_sets(width), _NODES), "nodes")

        def exactly(ids: DataFrame) -> DataFrame:
            """Edges among classes, by the exact prefix join of their texts."""
            rest = _texts(texts.select("text", "text_hash"), chosen.join(ids.withColumnRenamed("id", "rep"), "rep").select("rep", "least", "gid", "n", "text_hash"))
            joined = jaccard_join.components(rest.select(F.col("rep").alias("doc_id"), "text"), width, similarity)
            named = joined.join(ids.withColumnRenamed("id", "doc_id"), "doc_id").join(ids.select(F.col("id").alias("component_id"), F.col("label").alias("b")), "component_id")
            return named.where("label <> b").select(F.col("label").alias("a"), "b").distinct()

        found = linking.components(classed, nodes, lists, similarity, scratch, exactly, MANY, PIVOTS)
        out = classed.join(found, "rep", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component())
        return stored(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
