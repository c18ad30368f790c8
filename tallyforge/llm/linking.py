"""What joins on set similarity share: links between pairs of sets, and the components of all links.

Candidates come as lists: sets that have a key in common may be linked. Groups of sets are listed once. Pairs are not enumerated
inside what is already known to be connected:

1. Every group's representative is compared with the pivot that most of its lists agree upon, members with their group's.
2. While lists with several labels have many pairs left, and each round halves them, what is outside a list's commonest label meets
   pivots of it.
3. The rest: in lists and groups that still hold several labels, all pairs of different labels that pass the filters; or, if they
   are still many, whatever other exact way the caller has for the sets in these lists. Here sets also carry the parities of their
   hashes in so many bits: each shingle that only one of two sets has changes one bit at most, so sets whose bits differ in more
   places than linked sets differ in shingles are no pair. That rules out nearly all sets that are much alike but not linked
   (texts around one passage) inside the join of the lists; their full sets are never brought together.

Labels are joined by union-find: each task makes a forest of the edges it has, and what the forests leave is contracted step by step
across tasks until one task can take in the rest, so neither a task nor the driver ever holds all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release

#: Rounds of pivots in lists with several labels, and pairs for each listed row from which another round is made.
ROUNDS, MANY = 3, 4
#: Edges that a forest takes in at once (about 100 MB).
EDGES = 1 << 19
#: Words of 64 parity bits of a set.
WORDS = 8


@dataclass(frozen=True)
class Similarity:
    """Sets are linked if low * shared >= top * union."""

    top: int
    low: int

    @property
    def both(self) -> int:
        """Sets of sizes a and b are linked if both * shared >= top * (a + b)."""
        return self.top + self.low

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Of n shingles in a global order, how many can't all be lacking in a linked set."""
        return n - (self.top * n + self.low - 1) // self.low + 1

    def possible(self, x: str, y: str) -> Column:
        """Size and place filters of a pair that meets in a list: the shingles from there on must suffice."""
        rest = f"least({x}.n - {x}.i, {y}.n - {y}.i)"
        return F.expr(f"{self.low} * least({x}.n, {y}.n) >= {self.top} * greatest({x}.n, {y}.n) and {self.both} * {rest} >= {self.top} * ({x}.n + {y}.n)")

    def near(self, x: str, y: str) -> Column:
        """Parity filter of a pair; sets without parities pass. alone: shingles of a set that no other has."""
        apart = " + ".join([f"{x}.alone + {y}.alone", *(f"bit_count({x}.w{k} ^ {y}.w{k})" for k in range(WORDS))])
        return F.expr(f"coalesce({self.both} * ({apart}) <= {self.low - self.top} * ({x}.n + {y}.n), true)")


# -- links


def _compare(similarity: Similarity):
    """(la, lb, na, nb, keys_a, keys_b) -> the linked (a, b) by label. Keys: sorted hashes, of all shingles or at least of those that sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            for x, y, n in zip(batch.column("keys_a"), batch.column("keys_b"), both.tolist()):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                ok.append(similarity.both * int(np.count_nonzero(t[at] == s)) >= similarity.top * n)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("la", "lb")], ["a", "b"])
        release()

    return run


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, keys) -> id, alone, and the parities of the keys by their last bits."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("keys")]
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate([*sets, np.empty(0, np.uint64)])
        words = np.zeros(len(sets) * WORDS, np.uint64)
        np.bitwise_xor.at(words, np.repeat(np.arange(len(sets)) * WORDS, sizes) + (keys >> np.uint64(6) & np.uint64(WORDS - 1)).astype(np.int64), np.uint64(1) << (keys & np.uint64(63)))
        columns = words.view(np.int64).reshape(-1, WORDS).T
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(batch.column("n").to_numpy() - sizes), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["id", "alone", *(f"w{k}" for k in range(WORDS))])


def _with_parities(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """entries(id, ...) with the parities of those ids' sets that nodes(id, n, keys) has."""
    here = nodes.join(entries.select("id").distinct(), "id").select("id", F.col("n").cast("long").alias("n"), "keys")
    return entries.join(here.mapInArrow(_parities, f"id bigint, alone bigint, {', '.join(f'w{k} bigint' for k in range(WORDS))}"), "id", "left")


def _verified(pairs: DataFrame, nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """pairs(a, b, la, lb) -> edges (a, b) between the labels of the linked ones.

    The pivot b comes first: there many narrow rows meet one set. Then each document meets its own, evenly.
    """
    side = lambda c: nodes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"keys_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("la", "lb", "na", "nb", "keys_a", "keys_b").mapInArrow(_compare(similarity), "a bigint, b bigint").distinct()


# -- union-find


class Forest:
    """Labels that are connected have one root, the least of them."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def add(self, edges: pa.RecordBatch) -> None:
        for a, b in zip(edges.column(0).to_pylist(), edges.column(1).to_pylist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def rows(self, a: str, b: str) -> pa.RecordBatch:
        """Each label but the roots, with its root."""
        labels = [*self.parent]
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array([self.find(x) for x in labels], pa.int64())], [a, b])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> fewer edges that connect what these did: each label of a task's edges with its root."""
    forest = Forest()
    for batch in batches:
        forest.add(batch)
        if len(forest.parent) > EDGES:
            yield forest.rows("a", "b")
            forest = Forest()
    yield forest.rows("a", "b")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) that are left, at most EDGES -> label, to."""
    forest = Forest()
    for batch in batches:
        forest.add(batch)
    yield forest.rows("label", "to")


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) -> label, to: one name for all labels of a component; a label that isn't there is its own.

    Tasks' forests first. While they leave more edges than a task takes in, every label is moved to one of its neighbours or left: by
    turns to the neighbour with most neighbours, which ends stars at once, and to the least by a hash of the step's number, which
    halves chains. What is left then goes into one forest, and the moves are followed backwards.
    """
    moves: list[DataFrame] = []
    edges = scratch(edges.mapInArrow(_forests, "a bigint, b bigint"), "edges")
    while edges.count() > EDGES:
        step = len(moves)
        near = edges.select(F.col("a").alias("label"), F.col("b").alias("to")).unionAll(edges.select(F.col("b").alias("label"), F.col("a").alias("to")))
        known = near.groupBy("label").agg(F.count(F.lit(1) if step % 2 == 0 else F.lit(None)).alias("c"))
        order = lambda c, v: F.struct((-F.col(c)).alias("c"), F.xxhash64(v, F.lit(step)).alias("h"), F.col(v).alias("v"))
        best = near.join(known.select(F.col("label").alias("to"), F.col("c").alias("to_c")), "to").groupBy("label").agg(F.min(order("to_c", "to")).alias("m"))
        moved = scratch(best.join(known, "label").select("label", F.least("m", order("c", "label"))["v"].alias("to")), "moved")
        moves.append(moved)
        side = lambda c: moved.select(F.col("label").alias(c), F.col("to").alias(f"t{c}"))
        before, edges = edges, scratch(edges.join(side("a"), "a").join(side("b"), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        scratch.drop(before)
    end = scratch(edges.coalesce(1).mapInArrow(_roots, "label bigint, to bigint"), "moved")
    scratch.drop(edges)
    while moves:
        moved, last = moves.pop(), end
        end = scratch(moved.join(end.select(F.col("label").alias("to"), F.col("to").alias("end")), "to", "left").select("label", F.coalesce("end", "to").alias("to")), "moved")
        for table in (moved, last):
            scratch.drop(table)
    return end


# -- candidates


def _pivot_order(seed: int) -> Column:
    return F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id", "n", "i")


def _first_pairs(lists: DataFrame, members: DataFrame, similarity: Similarity) -> DataFrame:
    """Each group's representative with the pivot that most of its lists have, and members with their representatives."""
    pivots = lists.groupBy("key").agg(F.min(_pivot_order(0)).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "p.*")
    met = lists.alias("x").join(pivots.alias("y"), "key").where((F.col("x.id") != F.col("y.id")) & similarity.possible("x", "y"))
    times = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("y.h").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    best = times.groupBy("a").agg(F.min(F.struct(-F.col("c"), "h", "b"))["b"].alias("b"))
    pairs = best.unionAll(members.where("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b")))
    return pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))


def _mixed(entries: DataFrame) -> DataFrame:
    """Of entries(key, id, n, i, label, lo, hi) the keys with several labels, with the commonest one. lo, hi: of the id's members."""
    major = (
        entries.groupBy("key", "lo").agg(F.count(F.lit(1)).alias("c"), F.max("hi").alias("hi"))
        .groupBy("key").agg(F.max(F.struct("c", "lo")).alias("most"), F.min("lo").alias("least"), F.max("hi").alias("greatest"))
        .where("least <> greatest").select("key", F.col("most.lo").alias("major"))
    )
    return entries.join(major, "key")


MINOR = "(lo <> major or hi <> major)"


def _more_pairs(mixed: DataFrame, seed: int, similarity: Similarity, few: int | None) -> DataFrame:
    """What is outside a list's commonest label with a pivot inside it, or with so few of the pivots, those that most of its lists have."""
    pivots = mixed.where(f"not {MINOR}").groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key", F.lit(seed)).alias("h"), "id", "n", "i")).alias("p")).select("key", "p.*")
    met = mixed.where(MINOR).alias("x").join(pivots.alias("y"), "key").where((F.col("x.label") != F.col("x.major")) & similarity.possible("x", "y"))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("la"), F.col("x.major").alias("lb"))
    if few is None:
        return pairs.distinct()
    ranked = F.struct((-F.col("count")).alias("c"), F.xxhash64("b", F.lit(seed)).alias("h"), "b", "la", "lb")
    best = pairs.groupBy("a", "b", "la", "lb").count().groupBy("a").agg(F.array_sort(F.collect_list(ranked)).alias("m"))  # at most one for each of its lists
    return best.select("a", F.explode(F.slice("m", 1, few)).alias("m")).select("a", "m.b", "m.la", "m.lb")


def _rest_pairs(mixed: DataFrame, similarity: Similarity) -> DataFrame:
    """ids (a, b) of all pairs with different labels that pass the filters. mixed: with parities, null where an id stands for several sets."""
    met = mixed.where(MINOR).alias("x").join(mixed.alias("y"), "key").where(
        F.expr("x.id <> y.id and not (x.lo = y.hi and x.hi = y.lo) and (y.lo = y.major and y.hi = y.major or x.id < y.id)") & similarity.possible("x", "y") & similarity.near("x", "y")
    )
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _rest(lists: DataFrame, inside: DataFrame, here: DataFrame, nodes: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame:
    """Edges among all that is left: pairs of groups in mixed lists, expanded to members, and pairs inside mixed groups."""
    sets = nodes.select(F.col("rep").alias("id"), "n", "keys")
    single = here.groupBy("gid").count().where("count = 1").select(F.col("gid").alias("id"))
    lists = scratch(_with_parities(lists, sets.join(single, "id")), "parities")
    inside = scratch(_with_parities(inside, sets), "parities")
    of = lambda key, c: here.select(F.col(key).alias(f"g{c}"), F.col("rep").alias(c), F.col("label").alias(f"l{c}"))
    named = lambda pairs, key: pairs.select(F.col("a").alias("ga"), F.col("b").alias("gb")).join(of(key, "a"), "ga").join(of(key, "b"), "gb")
    pairs = named(_rest_pairs(lists, similarity), "gid").unionAll(named(_rest_pairs(inside, similarity), "rep")).where("la <> lb").select("a", "b", "la", "lb")
    return _verified(pairs, nodes, similarity)


def ties(classed: DataFrame) -> DataFrame:
    """classed(doc_id, rep) -> edges (a, b) between the classes that one doc_id stands for."""
    tied = classed.where("doc_id is not null and rep is not null")
    first = tied.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    return tied.join(first, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def components(classed: DataFrame, nodes: DataFrame, lists: DataFrame, similarity: Similarity, scratch: Scratch, other: Callable[[DataFrame], DataFrame] | None = None, many: float = MANY, few: int | None = None) -> DataFrame:
    """rep, component: of all classes that may be linked, the least doc_id of their component.

    classed(doc_id, rep): documents with the names of their classes. nodes(rep, least, gid, n, keys): classes that may have links, their
    least doc_id, their group and their set. lists(key, id, n, i): candidates, by group. other(ids): edges (a, b) between
    the labelled ids(id, label), by another way than pairs. many: see MANY. few: pivots that a set meets in a round, by default one for each list.
    """
    members = nodes.select("rep", "gid", "n")
    tied = scratch(ties(classed), "ties")
    known = nodes.select("rep", "least").unionAll(tied.select("a", "a")).unionAll(tied.select("b", "b")).groupBy("rep").agg(F.min("least").alias("least"))

    def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
        ends = connected(edges, scratch)
        out = scratch(labels.join(ends, "label", "left").select("rep", "least", F.coalesce("to", "label").alias("label")), "labels")
        for table in (labels, edges, ends):
            scratch.drop(table)
        return out

    labels = merged(known.select("rep", "least", F.col("rep").alias("label")), scratch(_verified(_first_pairs(lists, members, similarity), nodes, similarity).unionAll(tied), "found"))
    listed, source, before = lists.count(), lists, float("inf")
    for seed in range(1, ROUNDS + 2):
        here = members.join(labels, "rep")
        groups = here.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.when(F.col("rep") == F.col("gid"), F.col("label"))).alias("label"))
        mixed = scratch(_mixed(lists.join(groups.withColumnRenamed("gid", "id"), "id")), "mixed")
        scratch.drop(source)
        by_key = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.expr(MINOR)).alias("minor"))
        left = by_key.agg(F.sum(F.col("all") * F.col("minor"))).first()[0] or 0
        if left <= many * listed or 2 * left > before or seed > ROUNDS:  # few are left, or pivots don't make them fewer
            break
        before = left
        edges = scratch(_verified(_more_pairs(mixed, seed, similarity, few), nodes, similarity), "found")
        source, lists = mixed, mixed.select("key", "id", "n", "i")  # lists with one label stay so
        if edges.isEmpty():
            break
        labels = merged(labels, edges)
    inside = scratch(_mixed(here.select(F.col("gid").alias("key"), F.col("rep").alias("id"), "n", F.lit(0).alias("i"), "label", F.col("label").alias("lo"), F.col("label").alias("hi"))), "mixed")
    if other and left > many * listed:
        mine = mixed.select(F.col("id").alias("gid")).distinct().join(here, "gid").select(F.col("rep").alias("id"), "label")
        labels = merged(labels, scratch(other(mine.unionAll(inside.select("id", "label")).distinct()), "found"))
    elif left or not inside.isEmpty():
        labels = merged(labels, scratch(_rest(mixed, inside, here, nodes, similarity, scratch), "found"))
    component = labels.groupBy("label").agg(F.min("least").alias("component"))
    return scratch(labels.join(component, "label").select("rep", "component"), "components")
