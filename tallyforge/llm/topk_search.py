"""Exact top-k inner-product search by a three-phase uniform threshold.

Each vector is cut into slices; a slice of a block of vectors is a node that knows only its part of each score. For every
query: (1) the nodes of a block hand in their best parts; the exact scores of these few give a cutoff that the k-th best
score can't fall below. (2) A score at or above the cutoff has a part of at least cutoff / slices in some node, so each node
hands in its entries from there on, which is sufficient. (3) The parts still missing of these entries are added from the other
nodes, and the k best are kept exactly. Nodes are dealt into cells, a cell being some blocks and a share of the queries; in it
the cutoff goes from block to block and only rises. What the cells found best is merged: a few rows a query and cell.

Vectors travel as whole numbers of the least width, in blocks: candidates once for each share of queries, queries once for
each group of blocks, so what is shuffled doesn't grow with the pairs. Equal vectors are one candidate that carries its
k + 1 smallest ids, and queries with equal vectors are asked once, so thousands of copies cost one and ties are still
decided by id.

Defined results. Vectors null or with null or non-finite components take no part, nor does a null id. Vectors of
different lengths don't meet. Rows equal in id and vector count once; rows with the query's id are its own. Fewer than k
others: all of them. Ties: smaller id. Empty table: no rows. Scores beyond a long fail. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, stored

#: Slices of a vector; numbers in a packed block and vectors at most; queries that meet a block at once.
SLICES, NUMBERS, BLOCK, AT_ONCE = 2, 1 << 17, 2048, 512
#: Candidates and queries that a cell has at most, about; pairs below which no further cells are made.
GROUP, SHARE, PAIRS = 1 << 17, 1 << 14, 1 << 27
NONE = np.iinfo(np.int64).min
PACKED = "dim int, width int, a binary, b binary, c binary, body binary"


def finite(embedding: Column) -> Column:
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _whole(x: np.ndarray) -> np.ndarray:
    """Floors as longs; what is beyond them is the nearest long."""
    low = np.floor(x)
    out = np.where(np.abs(low) < 2.0**63, low, 0).astype(np.int64)
    return np.where(low >= 2.0**63, np.iinfo(np.int64).max, np.where(low <= -(2.0**63), NONE, out))


def _quantised(scale: int):
    """(key, embedding) -> key and vector as bytes: the width of a number, then all numbers. Equal vectors have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # nulls are NaN here
            good = bad[ends] == bad[ends - sizes]
            with np.errstate(over="ignore"):
                v = _whole(float(scale) * np.where(np.isfinite(x), x, 0.0))
            wide = np.concatenate([[0], np.cumsum((v > 32767) | (v < -32768))])
            narrow = wide[ends] == wide[ends - sizes]
            small = np.where((v <= 32767) & (v >= -32768), v, 0).astype("<i2").tobytes()
            large = v.astype("<i8").tobytes()
            out = [
                b"\x02" + small[2 * (e - n) : 2 * e] if short else b"\x08" + large[8 * (e - n) : 8 * e]
                for e, n, short in zip(ends[good].tolist(), sizes[good].tolist(), narrow[good].tolist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(keys[good], pa.int64()), pa.array(out, pa.binary())], ["key", "v"])

    return run


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, c, v) -> blocks of vectors of one length and width."""
    kept: dict[tuple[int, int], list[tuple]] = {}
    held = 0

    def pack(key: tuple[int, int]) -> pa.RecordBatch:
        rows = kept.pop(key)
        ids = [np.array([r[i] for r in rows], np.int64).tobytes() for i in range(3)]
        return pa.RecordBatch.from_pylist([{"dim": key[0], "width": key[1], "a": ids[0], "b": ids[1], "c": ids[2], "body": b"".join(r[3][1:] for r in rows)}], _schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            width = row[3][0]
            key = ((len(row[3]) - 1) // width, width)
            kept.setdefault(key, []).append(row)
            held += len(row[3]) + 24
            if len(kept[key]) >= min(BLOCK, max(16, NUMBERS // max(key[0], 1))):
                held -= sum(len(r[3]) + 24 for r in kept[key])
                yield pack(key)
            elif held > 64 * NUMBERS:  # vectors of very many lengths
                yield from [pack(k) for k in list(kept)]
                held = 0
    yield from [pack(k) for k in list(kept)]


_schema = pa.schema([("dim", pa.int32()), ("width", pa.int32()), *[(n, pa.binary()) for n in ("a", "b", "c", "body")]])


def _length(x: np.ndarray) -> float:
    """The greatest length of a row's vector, rounded up."""
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) * 1.001


class Cell:
    """A share of the queries, the blocks that pass by, and for each query the k best so far: scores, candidates, their first ids."""

    def __init__(self, key: tuple, k: int):
        self.key, self.k, self.parts, self.q = key, k, [], None

    def _matrix(self, row: dict) -> np.ndarray:
        n = len(row["a"]) // 8
        return np.frombuffer(row["body"], f"<i{row['width']}").reshape(n, row["dim"]).astype(np.int64)

    def ask(self, row: dict) -> None:
        self.parts.append((*(np.frombuffer(row[n], np.int64) for n in "abc"), self._matrix(row)))

    def _begin(self) -> None:
        self.qid, self.own, self.has_own, self.q = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        self.longest, n = _length(self.q), len(self.q)
        self.score = np.full((n, self.k), NONE, np.int64)
        self.cand, self.first = np.full((n, self.k), -1, np.int64), np.full((n, self.k), np.iinfo(np.int64).max, np.int64)
        self.some_own = bool(self.has_own.any())
        self.as_type: dict = {}

    def meet(self, row: dict) -> None:
        if self.q is None:
            if not self.parts:
                return
            self._begin()
        cid, one, two = (np.frombuffer(row[n], np.int64) for n in "abc")
        c = self._matrix(row)
        bound = self.longest * _length(c)  # of all parts, and of whatever is summed on the way
        kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else object
        if kind not in self.as_type:
            self.as_type = {kind: self.q.astype(kind)}
        q, c = self.as_type[kind], c.astype(kind)
        cuts = [c.shape[1] * s // SLICES for s in range(SLICES + 1)]
        for at in range(0, len(q), AT_ONCE):
            mine = q[at : at + AT_ONCE]
            self._phases(at, [mine[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:])], kind, cid, one, two)

    def _exact(self, parts: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(p[i, j] for p in parts).astype(np.int64)

    def _id(self, i: np.ndarray, j: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least id of a candidate that isn't the query's own, and whether there is one."""
        if not self.some_own:
            return one[j], np.ones(len(j), bool)
        mine = (self.has_own[i] == 1) & (self.own[i] == one[j])
        return np.where(mine, two[j], one[j]), ~(mine & (one[j] == two[j]))

    def _phases(self, at: int, parts: list[np.ndarray], kind, cid: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        n, m = parts[0].shape
        cutoff = self.score[at : at + n, -1].copy()
        # 1: the best parts of each slice, their exact scores, the cutoff
        new = np.flatnonzero(cutoff == NONE)
        if len(new):
            most = min(self.k + self.some_own, m)
            j = np.concatenate([np.argpartition(-p[new], most - 1, axis=1)[:, :most] for p in parts], axis=1)
            pairs = np.unique(np.repeat(new, j.shape[1]) * m + j.ravel())
            i, j = pairs // m, pairs % m
            ok = self._id(at + i, j, one, two)[1]
            i, j = i[ok], j[ok]
            total = self._exact(parts, i, j)
            order = np.lexsort((~total, i))  # ~x falls as x rises, for every long
            i, total = i[order], total[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            cutoff[i[rank == self.k - 1]] = total[rank == self.k - 1]
        # 2: every entry that a score at the cutoff needs
        least = cutoff // SLICES + (cutoff % SLICES > 0)  # part * slices >= cutoff, in integers
        if kind is object:
            mask = np.logical_or.reduce([(p >= least[:, None].astype(object)).astype(bool) for p in parts])
        else:
            most = 2**24 if kind is np.float32 else 2**53  # parts are smaller, so beyond it all or none are meant
            floor = np.clip(least, -most, most).astype(kind)[:, None]
            mask = parts[0] >= floor
            for p in parts[1:]:
                mask |= p >= floor
        flat = np.flatnonzero(mask)
        i, j = flat // m, flat % m
        # 3: the missing parts, the exact scores, the k best
        total = self._exact(parts, i, j)
        enough = total >= cutoff[i]
        i, j, total = i[enough], j[enough], total[enough]
        first, ok = self._id(at + i, j, one, two)
        last, there = self.first[at + i, -1], self.score[at + i, -1]
        ok &= (total > there) | ((total == there) & (first < last)) | (self.cand[at + i, -1] < 0)
        self._keep(at + i[ok], total[ok], cid[j[ok]], first[ok])

    def _keep(self, i: np.ndarray, total: np.ndarray, cid: np.ndarray, first: np.ndarray) -> None:
        if not len(i):
            return
        rows = np.unique(i)
        old_i = np.repeat(rows, self.k)
        old = [x[rows].ravel() for x in (self.score, self.cand, self.first)]
        there = old[1] >= 0
        i, total, cid, first = (np.concatenate([a, b[there]]) for a, b in zip((i, total, cid, first), (old_i, *old)))
        order = np.lexsort((first, ~total, i))
        i, total, cid, first = i[order], total[order], cid[order], first[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < self.k
        at = (i[top], rank[top])
        self.score[at], self.cand[at], self.first[at] = total[top], cid[top], first[top]

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.q is None:
            return
        i, r = np.nonzero(self.cand >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.qid[i], self.cand[i, r], self.first[i, r], self.score[i, r])], ["qid", "cid", "first", "score"])


def _met(k: int):
    """Rows of cells, the queries of each before its blocks -> the k best candidates of each query in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["dim"], row["g"], row["qb"])
                if cell is None or cell.key != key:
                    if cell:
                        yield from cell.found()
                    cell = Cell(key, k)
                cell.meet(row) if row["block"] else cell.ask(row)
        if cell:
            yield from cell.found()

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int, scale: int = 1024) -> DataFrame:
    """candidates(vec_id, embedding), queries(query_id, embedding) -> query_id, rank (from 1), vec_id, score."""

    def clean(df: DataFrame, key: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(F.col(key).cast("long"), F.col("embedding").cast("array<double>"))
        return rows.mapInArrow(_quantised(scale), "key bigint, v binary").withColumnRenamed("key", key)

    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = clean(candidates, "vec_id").withColumn("r", F.dense_rank().over(by_id)).where(F.col("r") <= k + 1)  # limited before the shuffle too
    cands = stored(few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    asked = stored(clean(queries, "query_id").distinct(), "queries")
    # Equal vectors are asked once: an id is at most one row of the k + 1 best. Ids with several vectors are told apart.
    several = cands.select(F.explode("ids").alias("query_id")).groupBy("query_id").count().where("count > 1").select("query_id", F.col("query_id").alias("own"))
    members = asked.join(several, "query_id", "left")
    classes = stored(members.select("v", "own").distinct().withColumn("qid", F.monotonically_increasing_id()), "classes")
    nc, nq = cands.count(), classes.count()
    shares = -(-nq // SHARE) or 1
    wanted = min(shuffle_partitions(cands.sparkSession), -(-nc * nq // PAIRS))
    groups = max(-(-nc // GROUP), -(-wanted // shares), 1)
    two = F.coalesce(F.try_element_at("ids", F.lit(2)), F.get("ids", F.lit(0)))
    blocks = cands.select("cid", F.get("ids", F.lit(0)).alias("one"), two.alias("two"), "v").mapInArrow(_packs, PACKED)
    asking = classes.select("qid", F.coalesce("own", F.lit(0)), F.col("own").isNotNull().cast("long"), "v").mapInArrow(_packs, PACKED)
    place = lambda n: F.pmod(F.xxhash64("a"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asking.select("*", F.lit(False).alias("block"), place(shares).alias("qb"), each(groups).alias("g")).unionByName(
        blocks.select("*", F.lit(True).alias("block"), place(groups).alias("g"), each(shares).alias("qb"))
    )
    cells = dealt.repartition(2 * shares * groups, "dim", "g", "qb").sortWithinPartitions("dim", "g", "qb", "block")
    found = stored(cells.mapInArrow(_met(k + 1), "qid bigint, cid bigint, first bigint, score bigint"), "found")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    few = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).join(cands.select("cid", "ids"), "cid")
    owners = members.join(classes.select("v", F.col("own").alias("_own"), "qid"), ["v"]).where(F.col("own").eqNullSafe(F.col("_own"))).select("qid", "query_id", "own")
    rows = few.select("qid", "score", F.explode("ids").alias("vec_id")).join(classes.select("qid", "own"), "qid").where("own is null or vec_id <> own")
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("qid", "score", "vec_id")
    final = Window.partitionBy("qid", "query_id").orderBy(F.desc("score"), "vec_id")
    mine = rows.join(owners.select("qid", "query_id"), "qid").where("vec_id <> query_id")
    return mine.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
