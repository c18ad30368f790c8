"""Masking of known values: a table of values is searched in all texts at once.

A value is found whatever its case and whatever white space stands between its characters. Texts and values are compared without
white space, in lower case. Of each value one anchor is kept: the least, by hash, of the first few short pieces of it (or all of a
short value). Of each stretch of a text the least piece is an anchor too, so a text that has a value has its anchor where the
value begins; there a hash of as many characters as the value has tells whether it is the value, so values that begin alike aren't
confused. What a text has of them is then replaced, the longest values first. Values that fit a broadcast go to the texts, which
are read once and never shuffled; else an equi-join finds the few values that a text may have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Characters of a piece, and pieces of which one is an anchor.
PIECE, WINDOW = 7, 4
SPAN = PIECE + WINDOW - 1
#: Values up to which texts are searched for their anchors where they lie (some 30 bytes each), and bytes of values up to which
#: they are replaced there too.
FEW, BYTES = 2_000_000, 32 << 20
#: Anchors, or texts, that are handed on together.
MANY, FLUSH = 500_000, 500


def _low(c: str) -> str:
    """Lower case, if that is one character."""
    low = c.lower()
    return low if len(low) == 1 else c


def squeezed(text: str) -> str:
    """A text without white space in lower case."""
    plain = "".join(text.split())
    low = plain.lower()
    return low if plain.isascii() or len(low) == len(plain) else "".join(map(_low, plain))


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each piece of n characters."""
    m = max(len(points) - n + 1, 0)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[k : k + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


#: Odd, so it has an inverse among the numbers of 64 bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(min(n, 1), np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))


def _mixed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = sums + sizes.astype(np.uint64)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def value_hash(value: str) -> int:
    """Of all characters of a value without white space."""
    points = _points(value)
    return int(_mixed((points * _powers(BASE, len(points))).sum(keepdims=True), np.array([len(points)]))[0])


def stretch_hashes(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """value_hash of stretches of a text."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * _powers(BASE, len(points)))])
    return _mixed((sums[start + size] - sums[start]) * _powers(INVERSE, len(points))[start], size)


class Known:
    """Anchors of values, the sizes of the values with each, and hashes of whole values; of values with a hash, where they stand."""

    def __init__(self, anchor: np.ndarray, size: np.ndarray, full: np.ndarray):
        self.order = np.argsort(full, kind="stable")
        self.full = full[self.order]
        shapes = np.unique(np.stack([anchor, size.astype(np.int64)], axis=1), axis=0) if len(anchor) else np.empty((0, 2), np.int64)
        self.anchor, self.begin = np.unique(shapes[:, 0], return_index=True)
        self.begin, self.size = np.append(self.begin, len(shapes)), shapes[:, 1].copy()
        self.short = np.unique(size[size < SPAN]).tolist()
        self.mask = np.int64((1 << min(24, 12 + len(self.anchor).bit_length())) - 1)
        self.some = np.zeros(int(self.mask) + 1, bool)
        self.some[self.anchor & self.mask] = True

    def within(self, text: str) -> np.ndarray:
        """Hashes of the values that a text without white space has."""
        points = _points(text)
        starts, which = [], []
        for hashes in _leasts(points, self.short):
            at = np.flatnonzero(self.some[hashes & self.mask])
            at = at[among(hashes[at], self.anchor)]
            starts.append(at)
            which.append(np.searchsorted(self.anchor, hashes[at]))
        start, which = np.concatenate(starts), np.concatenate(which)
        if not len(start):
            return np.empty(0, np.int64)
        many = self.begin[which + 1] - self.begin[which]
        size = self.size[np.repeat(self.begin[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        start = np.repeat(start, many)
        fits = start + size <= len(points)
        found = np.unique(stretch_hashes(points, start[fits], size[fits]))
        return found[among(found, self.full)]

    def places(self, found: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.full, found), np.searchsorted(self.full, found, "right")
        return np.concatenate([self.order[a:b] for a, b in zip(low, high)])


def value_anchor(value: str) -> int:
    """Of a value without white space."""
    points = _points(value)
    if len(points) < SPAN:
        return int(_grams(points, len(points))[0])
    return int(_grams(points[:SPAN], PIECE).min())


def _leasts(points: np.ndarray, short: list[int]) -> Iterator[np.ndarray]:
    """At each place the anchor of a value that begins there: of a value of SPAN or more, and of one of each short length."""
    pieces = _grams(points, PIECE)
    least = pieces[: max(len(pieces) - WINDOW + 1, 0)]
    for k in range(1, WINDOW):
        least = np.minimum(least, pieces[k : k + len(least)])
    yield least.view(np.int64)
    for n in short:
        yield _grams(points, n).view(np.int64)


def text_anchors(text: str, short: list[int]) -> np.ndarray:
    """All that a value in a text can have as its anchor; short: lengths of values below SPAN."""
    return np.unique(np.concatenate(list(_leasts(_points(text), short))))


def among(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of these are known; known is sorted, and is looked up in, not gone through."""
    return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found if len(known) else np.zeros(len(found), bool)


def _masked(text: str, values: list[tuple[str, str]]) -> str:
    """values: (value without white space, label), in the order in which they are replaced."""
    body, places = squeezed(text), [i for i, c in enumerate(text) if not c.isspace()]
    taken, spans = np.zeros(len(body), bool), []
    for value, label in values:
        at = body.find(value)
        while at >= 0:
            if taken[at : at + len(value)].any():
                at = body.find(value, at + 1)
                continue
            taken[at : at + len(value)] = True
            spans.append((places[at], places[at + len(value) - 1] + 1, label))
            at = body.find(value, at + len(value))
    out, done = [], 0
    for start, end, label in sorted(spans):
        out += text[done:start], f"[{label.upper()}]"
        done = end
    return "".join(out) + text[done:]


def mask_known(texts: DataFrame, text: str, values: DataFrame) -> DataFrame:
    """texts with every known value in the column `text` as [LABEL]; values(value, label).

    Longest first, equally long ones by value and label, each from the left; nothing is masked twice, and labels aren't searched. Null
    texts stay, null or blank values are none, a value without a label is a VALUE. Repeated values count once.
    """
    spark = texts.sparkSession

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(squeezed(v), w) for v, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(v, w, value_anchor(v), value_hash(v)) for v, w in rows if v]
            anchor, full = np.array([r[2] for r in rows], np.uint64).view(np.int64), np.array([r[3] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(anchor), pa.array(full)], ["value", "label", "anchor", "full"])

    given = values.where("value is not null").select(F.col("value").cast("string").alias("value"), F.coalesce("label", F.lit("value")).alias("label"))
    known = written(given.distinct().mapInArrow(anchored, "value string, label string, anchor bigint, full bigint").distinct(), "values")  # read several times
    n, n_bytes = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value") + F.octet_length("label")), F.lit(0))).first()
    few = n <= FEW
    if few and n_bytes <= BYTES:
        return _masked_in_place(texts, text, known)
    size = F.char_length("value").alias("size")
    if few:
        rows = known.select("anchor", size, "full").distinct().toArrow()  # checked: 40 MB at most
        only, short = spark.sparkContext.broadcast(Known(*(rows.column(c).to_numpy() for c in range(3)))), []
    else:
        only, short = None, [r[0] for r in known.select(size).where(F.col("size") < SPAN).distinct().collect()]  # at most SPAN numbers
    by = "full" if few else "anchor"

    def pairs(keys: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(found))], ["key", by])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, all_found = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = squeezed(body)
                found = only.value.within(body) if only is not None else text_anchors(body, short)
                keys.append(np.full(len(found), key, np.int64))
                all_found.append(found)
                if sum(map(len, all_found)) >= MANY or len(keys) == FLUSH:
                    yield pairs(keys, all_found)
                    keys, all_found = [], []
            if keys:
                yield pairs(keys, all_found)

    @F.arrow_udf("string")
    def masked(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for body, mine in zip(bodies.to_pylist(), lists.to_pylist()):
            out.append(_masked(body, [(v["value"], v["label"]) for v in mine]) if body is not None and mine else body)
        return pa.array(out, pa.string())

    keyed = texts.withColumn("_key", F.xxhash64(text))
    there = keyed.where(F.col(text).isNotNull()).select(F.col("_key").alias("key"), F.col(text).alias("body"))
    met = there.mapInArrow(anchors, f"key bigint, {by} bigint").join(known, by)
    ranked = F.array_sort(F.collect_set(F.struct((-F.char_length("value")).alias("longest"), "value", "label")))
    candidates = met.groupBy(F.col("key").alias("_key")).agg(ranked.alias("_values"))
    both = keyed.join(candidates, "_key", "left")
    return both.withColumn(text, F.when(F.col("_values").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("_values")))).select(*texts.columns)


def _masked_in_place(texts: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """With values that fit a broadcast: each text is searched and masked where it lies, so none is shuffled."""
    rows = known.select("anchor", F.char_length("value").alias("size"), "full", "value", "label").toArrow().combine_chunks()
    found_by = Known(*(rows.column(c).to_numpy() for c in range(3)))
    strings = [rows.column(c).combine_chunks() for c in (3, 4)]
    held = texts.sparkSession.sparkContext.broadcast((found_by, *strings))  # checked by mask_known

    @F.arrow_udf("string")
    def masked(bodies: pa.Array) -> pa.Array:
        known, value, label = held.value
        out = []
        for body in bodies.to_pylist():
            found = known.within(squeezed(body)) if body else ()
            if len(found):
                at = pa.array(known.places(found))
                mine = sorted(zip(value.take(at).to_pylist(), label.take(at).to_pylist()), key=lambda v: (-len(v[0]), v))
                body = _masked(body, mine)
            out.append(body)
        return pa.array(out, pa.string())

    return texts.withColumn(text, masked(F.col(text)))
