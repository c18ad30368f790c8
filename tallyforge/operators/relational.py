"""Reading patterns over relational tables: secured views, pages, queues, chains, intervals, diffs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import discard, written


def secured(df: DataFrame, memberships: DataFrame, user, space: str, owner: str | None = None) -> DataFrame:
    """Rows of the spaces that the user is a member of, and with an owner column only their own; no membership, no rows.

    memberships(space_id, user_id) is reduced to one user's spaces first; a left semi join follows.
    """
    mine = memberships.where(F.col("user_id") == user).select(F.col("space_id").alias("_space")).distinct()
    seen = df.join(mine, df[space] == F.col("_space"), "left_semi")
    return seen.where(F.col(owner) == user) if owner else seen


def owned(df: DataFrame, ident: str, wanted, owner: str, user) -> DataFrame:
    """The row of an id, if it is the user's: no row tells another's apart from one that isn't there, and rows without an owner are nobody's."""
    return df.where((F.col(ident) == wanted) & (F.col(owner) == user))


def keyset_page(df: DataFrame, order: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """The rows that follow a cursor in descending order, one more than the limit to tell whether there are others."""
    key = F.struct(*order)
    rows = df if after is None else df.where(key < F.struct(*[v if isinstance(v, Column) else F.lit(v) for v in after]))
    return rows.orderBy(*[F.desc(c) for c in order]).limit(limit + 1)


def claim_fair(jobs: DataFrame, started: DataFrame, now: Column) -> DataFrame:
    """The next due job: best priority, then the user served longest ago (never served first), then age.

    jobs(id, user_id, priority, run_after), started(user_id, started_at); users join null-safely.
    """
    served = started.groupBy("user_id").agg(F.max("started_at").alias("last_started")).withColumnRenamed("user_id", "_user")
    due = jobs.where(F.col("run_after") <= now).join(served, F.col("user_id").eqNullSafe(F.col("_user")), "left").drop("_user")
    return due.orderBy("priority", F.asc_nulls_first("last_started"), "run_after", "id").limit(1)


def round_robin(jobs: DataFrame, user: str, order: Sequence[str]) -> DataFrame:
    """Turn of each job if users are served in rotation."""
    return jobs.withColumn("turn", F.row_number().over(Window.partitionBy(user).orderBy(*order)))


def chain_failures(rows: DataFrame, expected_hash: Column) -> DataFrame:
    """Rows of a hash chain that break it: GAP, then PREV_HASH, then HASH.

    rows(seq, prev_hash, hash). Each row meets its predecessor by seq = seq - 1, so no window over the whole chain is needed.
    """
    previous = rows.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    first = rows.agg(F.min("seq").alias("_first"))
    both = rows.withColumn("_expected", expected_hash).join(previous, "seq", "left").crossJoin(F.broadcast(first))  # one row
    reason = (
        F.when((F.col("seq") > F.col("_first")) & F.col("_before").isNull(), "GAP")
        .when((F.col("seq") > F.col("_first")) & (F.col("_before") != F.col("prev_hash")), "PREV_HASH")
        .when(F.col("_expected") != F.col("hash"), "HASH")
    )
    return both.select("seq", reason.alias("reason")).where("reason IS NOT NULL")


def first_failure(rows: DataFrame, chain: str, body: Column) -> DataFrame:
    """The first broken row of each chain that has one: rows(chain, seq, prev_hash, hash) -> chain, seq, reason.

    GAP: no predecessor; PREV_HASH: not the predecessor's hash; HASH: not the hash of what stands before it and the body.
    """
    before = rows.select(F.col(chain).alias("_chain"), (F.col("seq") + 1).alias("_seq"), F.col("hash").alias("_before"))
    both = rows.join(before, (F.col(chain) == F.col("_chain")) & (F.col("seq") == F.col("_seq")), "left")
    reason = (
        F.when((F.col("seq") > 1) & F.col("_before").isNull(), "GAP")
        .when(F.coalesce("_before", F.lit("")) != F.col("prev_hash"), "PREV_HASH")
        .when(F.sha2(F.concat("prev_hash", body), 256) != F.col("hash"), "HASH")
    )
    return both.withColumn("reason", reason).where("reason is not null").groupBy(chain).agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one; ones without a start come last and begin none of their own."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    island = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_fresh", fresh).withColumn("_island", island).groupBy(key, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    )


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed values by key."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change IS NOT NULL")


def budget_prefix(df: DataFrame, key: str, order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """The rows of each key that fit a running budget, in order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def failure_runs(df: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """Length of the run of failures up to each row; a success starts anew."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = df.withColumn("_ok", F.when(failed, 0).otherwise(1)).withColumn("_run", F.sum("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("failures", F.sum(1 - F.col("_ok")).over(inside)).drop("_ok", "_run")


def range_join(values: DataFrame, intervals: DataFrame, sort: Callable[[Column], Column] = lambda dim: F.lit("")) -> DataFrame:
    """values(dim, key, ...) inside intervals(dim, lo, hi, ...): lo <= key < hi.

    An interval falls into bins as wide as the next power of two, so it covers two or three of them, wherever it lies. A value
    is listed once for each width that occurs (at most one for each binary exponent) among intervals of its sort of dimension, of
    which there are few: an equi-join on dimension, width and bin, then the exact test.
    """
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("hi").cast("double") - F.col("lo").cast("double"), F.lit(1e-9)))))
    place = lambda c: F.floor(F.col(c).cast("double") / F.col("_width"))
    sized = intervals.where("lo < hi").withColumn("_width", width)
    binned = sized.withColumn("_bin", F.explode(F.sequence(place("lo"), place("hi"))))
    widths = sized.agg(F.collect_set(F.struct(sort(F.col("dim")).alias("sort"), "_width")).alias("_widths"))  # one row of at most two thousand numbers a sort
    own = F.transform(F.filter("_widths", lambda w: w["sort"] == sort(F.col("dim"))), lambda w: w["_width"])
    listed = values.crossJoin(F.broadcast(widths)).withColumn("_width", F.explode(own)).drop("_widths").withColumn("_bin", place("key"))
    return listed.join(binned.hint("merge"), ["dim", "_width", "_bin"]).where("key >= lo AND key < hi").drop("_bin", "_width")


def chain_roots(df: DataFrame, ident: str, parent: str) -> DataFrame:
    """ident, root and depth of each row: parents are followed to rows whose parent is null or not there.

    Every pass doubles the distance and is written, so the plan doesn't grow; as many are needed as the longest chain has binary
    digits. Rows of a cycle, or above which there is one, are left out: where a pass ends no chain, all that are left are such rows.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(parent).alias("up"))
    there = rows.select(F.col("id").alias("up"), F.lit(True).alias("_there"))
    mine = F.when(F.col("_there"), F.col("up"))
    known = written(rows.join(there, "up", "left").select("id", mine.alias("up"), F.coalesce(mine, "id").alias("top"), mine.isNotNull().cast("long").alias("depth")), "chains")
    left = known.where("up is not null").count()
    while left:
        above = known.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"))
        further = written(known.join(above, "up", "left").select("id", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "chains")
        discard(known)
        known, before = further, left
        left = known.where("up is not null").count()
        if left == before:
            break
    return known.where("up is null").select("id", F.col("top").alias("root"), "depth")
