"""N-gram Jaccard self-join by grouped prefixes, as connected components of all links.

A document is the set of its distinct word shingles. Equal sets are one class. Shingles have one global order, by the number
of documents that have them: two sets at the threshold share a shingle of their prefixes, and this shingle is met twice or
more. So a document with enough shingles of its own has no partner, and of the others only the shingles that are met
elsewhere are listed. Classes with the same size and prefix are one group; prefixes are listed once a group, pairs of groups
are filtered by size and place, and only what they leave is expanded to members and verified. No link between different
texts is lost, and pairs are not enumerated inside what is already known to be connected (see ``linking``).

Counting. Stretches of whole documents deal their shingles out to buckets, each bucket counts, and what is met twice goes back
to its stretch, packed in arrays: a shingle that a stretch has often is asked for once. Shingles are told apart by bucket and
48 bits, sets by 128.

Defined results. Null or wordless text: no shingles, linked with nothing, a component of its own. Fewer words than a shingle:
the whole sequence is the one shingle. Rows with one doc_id are one node, even if their texts differ. Null doc_id: linked like
others; component_id is the smallest id that is reachable, null where there is none. Repeated rows: each is returned. doc_id
must be an integer. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import Scratch, release, shuffle_partitions, stored
from .linking import Similarity
from .packed import DEALT, LOW, bucket_of, grouped, joined48, low48, rows, together, unpacked

#: Shingles and sets that a stretch holds at most, unless one document has more; sets are numbered by 16 bits.
STRETCH, SETS = 1_000_000, 60_000
#: Occurrences from which a stretch asks for a shingle once, not for each document.
OFTEN = 8
#: Bytes of text for which there is a bucket.
BUCKET = 6 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; bytes.lower and bytes.split know ASCII only, as defined."""
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(words) - n + 1
    out = h[:m] * _ODD[0]
    for k in range(1, n):
        out += (h[k : k + m] ^ (h[k : k + m] >> np.uint64(31))) * _ODD[k % len(_ODD)] + _ODD[-1] * np.uint64(k // len(_ODD))
    out ^= out >> np.uint64(32)
    out *= _ODD[1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _name(low: np.ndarray, bucket) -> np.ndarray:
    """What a shingle is called after counting."""
    return low & LOW | (np.asarray(bucket).astype(np.uint64) << np.uint64(48))


# -- counting


def _dealt(width: int, buckets: int):
    """(doc_id, text) -> a head for each stretch (its documents, sets and frequent shingles) and its other shingles by bucket."""

    def stretch(number: int, ids: list, which: list[int], sets: dict[bytes, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for _, s in sets.values()], np.int32)
        keys = np.concatenate([s for _, s in sets.values()])
        owner = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        order, first, times = grouped(keys)
        often, times = keys[order[first[times >= OFTEN]]], times[times >= OFTEN]
        place = np.minimum(np.searchsorted(often, keys), max(0, len(often) - 1))
        hot = often[place] == keys if len(often) else np.zeros(len(keys), bool)
        head = (ids, np.array(which, np.int32), n, b"".join(sets), owner[hot], keys[hot])
        yield rows([((number + (number >> 32)) % buckets, number, True, head)])
        keys, owner = keys[~hot], owner[~hot]
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, owner = keys[order], owner[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ends_often = np.searchsorted(bucket_of(often, buckets), np.arange(buckets + 1))
        made = []
        for b in np.flatnonzero((np.diff(ends) > 0) | (np.diff(ends_often) > 0)).tolist():
            k, o = keys[ends[b] : ends[b + 1]], owner[ends[b] : ends[b + 1]]
            mine = slice(ends_often[b], ends_often[b + 1])
            made.append((b, number, False, (*low48(k), o, often[mine] & LOW, times[mine])))
        if made:
            yield rows(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, which, sets, size = [], [], {}, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                for i, t in zip(batch.column(0).slice(a, 512).to_pylist(), batch.column(1).slice(a, 512).to_pylist()):
                    s = shingle_set(t, width)
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if digest not in sets:
                        sets[digest] = len(sets), s
                        size += len(s)
                    ids.append(i)
                    which.append(sets[digest][0])
                    if size > STRETCH or len(sets) > SETS or len(ids) > 20 * SETS:
                        yield from stretch(number, ids, which, sets)
                        number, ids, which, sets, size = number + 1, [], [], {}, 0
                        release()
        if ids:
            yield from stretch(number, ids, which, sets)
        ids, which, sets = [], [], {}
        release()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket: each part gets back those of its shingles that are met twice or more, with their numbers."""
    for bucket, met_rows in together(batches, "bucket"):
        for row in met_rows:
            if row[2]:
                yield rows([(*row[:3], unpacked(row[3]))])
        parts = [(row[1], unpacked(row[3])) for row in met_rows if not row[2]]
        if not parts:
            continue
        keys = np.concatenate([x for _, (low, high, _, often, _) in parts for x in (joined48(low, high), often)])
        weight = np.concatenate([x for _, (low, _, _, _, times) in parts for x in (np.ones(len(low), np.int64), times)])
        order, first, times = grouped(keys)
        met = np.empty(len(keys), np.int64)
        met[order] = np.repeat(np.add.reduceat(weight[order], first), times)
        out, at = [], 0
        for number, (low, _, owner, often, _) in parts:
            k, m = _name(keys[at : at + len(low)], bucket), met[at : at + len(low)]
            at += len(low)
            of = _name(often, bucket), met[at : at + len(often)]
            at += len(often)
            out.append((bucket, number, False, (k[m > 1], m[m > 1].astype(np.uint32), owner[m > 1], *of)))
        yield rows(out)
    release()


#: Of a document: doc_id, n and its set's digest. Of a set that may have partners besides: u shingles met nowhere else, place of
#: the group (p1), the other shingles of its prefix in order, all of them as sorted bytes.
SCAN = "doc_id bigint, n int, d1 bigint, d2 bigint, u int, p1 bigint, prefix array<bigint>, keys binary"


def _scanned(buckets: int, similarity: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine in together(batches, "batch"):
            head = next(unpacked(r[3]) for r in mine if r[2])
            parts = [unpacked(r[3]) for r in mine if not r[2]]
            yield from scanned(head, parts)
        release()

    def scanned(head: tuple, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, which, n, digests, hot_owner, hot_keys = head
        d = np.frombuffer(digests, np.int64).reshape(-1, 2)
        size = len(which)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(n[which]), pa.array(d[which, 0]), pa.array(d[which, 1]),
            *(pa.nulls(size, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())),
        ], ["doc_id", "n", "d1", "d2", "u", "p1", "prefix", "keys"])
        if not parts:
            return
        keys, met, owner, often, often_met = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(often)
        hot = _name(hot_keys, bucket_of(hot_keys, buckets) & 0xFFFF)
        place = order[np.searchsorted(often[order], hot)] if len(hot) else np.empty(0, np.int64)
        keys, met, owner = np.concatenate([keys, hot]), np.concatenate([met, often_met[place]]), np.concatenate([owner, hot_owner])
        order = np.lexsort((keys, met, owner))
        keys, ends = keys[order], np.searchsorted(owner[order], np.arange(len(n) + 1))
        u = n - np.diff(ends)
        long = similarity.prefix(n)
        some = np.flatnonzero((n > 0) & (u < long))
        for a in range(0, len(some), 2048):
            c = some[a : a + 2048]
            mine = [keys[ends[i] : ends[i + 1]] for i in c]
            prefix = [k[: long[i] - u[i]] for i, k in zip(c, mine)]
            own = [digests[16 * i : 16 * i + 16] if u[i] else b"" for i in c]
            p1 = np.array([xxhash.xxh3_64_intdigest(k.tobytes() + x) for k, x in zip(prefix, own)], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(c), pa.int64()), pa.array(n[c]), pa.array(d[c, 0]), pa.array(d[c, 1]), pa.array(u[c].astype(np.int32)), pa.array(p1), lists,
                pa.array([np.sort(k).tobytes() for k in mine], pa.binary()),
            ], ["doc_id", "n", "d1", "d2", "u", "p1", "prefix", "keys"])

    return run


# -- joining


def _nodes(scan: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored: sets that may have partners, by class: rep, least, gid (its group's representative), n, u, prefix, keys."""
    same = ["n", "d1", "d2"]
    once = scan.where(F.col("keys").isNotNull()).groupBy(*same).agg(*(F.first(c).alias(c) for c in ("u", "p1", "prefix", "keys")))
    sets = scratch(once.join(classes, same).drop("d1", "d2"), "sets")
    groups = sets.groupBy("n", "p1").agg(F.min("rep").alias("gid"))
    nodes = scratch(sets.join(groups, ["n", "p1"]).drop("p1"), "nodes")
    scratch.drop(sets)
    return nodes


def components(docs: DataFrame, width: int = 5, similarity: Similarity = Similarity(3, 4)) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id for links of the similarity between sets of `width`-word shingles."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(docs.sparkSession)
    buckets = max(parts, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    dealt = texts.mapInArrow(_dealt(width, buckets), DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(_counted, DEALT).repartition(parts, "batch").sortWithinPartitions("batch")
    with Scratch() as scratch:
        scan = scratch(counted.mapInArrow(_scanned(buckets, similarity), SCAN), "scan")
        # a class is named by its least id; one without ids by its digest
        plain = scan.where(F.col("keys").isNull()).select("doc_id", "n", "d1", "d2")
        least = plain.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("least"))
        classes = scratch(least.withColumn("rep", F.coalesce("least", "d1")), "classes")
        classed = scratch(plain.join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", "rep", "least"), "classed")
        nodes = _nodes(scan, classes, scratch)
        for table in (scan, classes):
            scratch.drop(table)
        lists = scratch(
            nodes.where("rep = gid").select(F.col("rep").alias("id"), "n", "u", F.posexplode("prefix").alias("at", "key")).select("key", "id", "n", (F.col("u") + F.col("at")).alias("i")),
            "lists",
        )
        named = linking.components(classed, nodes, lists, similarity, scratch)
        return stored(classed.join(named, "rep", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component()), "joined")


def component() -> Column:
    """A document's component_id: its class's, else its own id where it has no shingles, else its class's least id."""
    return F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "least")).alias("component_id")
