"""The best match of each row among the rows of its label, by inner product.

Equal vectors of a label are one class that carries its two smallest ids, so copies cost one, and a row can tell its own id apart. Classes
are dealt into blocks; each pair of blocks is one group, whose products are taken by NumPy a few hundred rows at a time. For a class
the two best ids of each block are kept, of all blocks the two best again, of which a row takes the first that isn't its own.

Products are taken as doubles; what comes near the best is summed again from the left, so that rounding is that of a plain sum. Missing
components, also those behind a shorter vector's end, add nothing; without any common component a product is null, which comes last.
Ties go to the smaller id. Rows without id or label take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written

#: Classes in a block, rows whose products are taken at once, and products summed again at once.
BLOCK, ROWS, AGAIN = 8192, 256, 1 << 16
DIGITS = 6


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components with zeros for missing ones, and where there are some."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, width = vectors.flatten(), int(sizes.max(initial=0))
    there = np.arange(width) < sizes[:, None]
    out = np.zeros(there.shape)
    out[there] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return out, there


def _rounded(x: np.ndarray) -> np.ndarray:
    """Halves away from zero, on the scaled double; what is no number afterwards stays as it was."""
    scaled = x * 10.0**DIGITS
    whole = np.trunc(scaled)
    out = (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**DIGITS
    return np.where(np.isfinite(out), out, x) + 0.0


def _summed(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Products of rows by rows, each summed from the left over the components that both have."""
    return _rounded(np.add.accumulate(np.where(common, a * b, 0.0), axis=1)[:, -1]) if a.shape[1] else np.zeros(len(a))


def _near_best(p: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Whether a product may be one of its row's two best."""
    best = p.argmax(axis=1)
    rest = p.copy()
    rest[np.arange(len(p)), best] = -np.inf
    return p >= (rest.max(axis=1) - slack)[:, None]


def _two_best(row: np.ndarray, ids: np.ndarray, s: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Of each row the places of its two best products with different ids."""
    nan = np.isnan(s)
    order = np.lexsort((ids, np.where(nan | null, 0.0, -s), ~nan, null, row))
    row, ids = row[order], ids[order]
    first = np.r_[True, row[1:] != row[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    other = np.flatnonzero(ids != ids[start])
    other = other[np.unique(row[other], return_index=True)[1]]
    return order[np.r_[np.flatnonzero(first), other]]


def _pair(table: pa.Table) -> pa.Table:
    """The two best ids for each class of one block among those of another."""
    mine = table.filter(table["asks"])
    theirs = table.filter(pa.compute.invert(table["asks"]))
    cid = mine["cid"].to_numpy()
    firsts, seconds = theirs["first"].to_numpy(), theirs["second"]
    has, seconds = seconds.is_valid().to_numpy(), seconds.fill_null(0).to_numpy()
    (a, a_there), (b, b_there) = (_matrix(t["v"].combine_chunks()) for t in (mine, theirs))
    width = max(a.shape[1], b.shape[1])
    a, a_there, b, b_there = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, a_there, b, b_there))
    whole = a_there.all() and b_there.all() and width > 0
    again = len(np.unique(firsts)) < len(firsts)  # ids of several vectors: then two best products may be one id's
    found = []
    with np.errstate(all="ignore"):
        longest = np.sqrt((b * b).sum(axis=1)).max(initial=0.0)
        for k in range(0, len(a), ROWS):
            x = a[k : k + ROWS]
            p = x @ b.T
            slack = 2 * 10.0**-DIGITS + 8 * (width + 1) * np.finfo(float).eps * np.sqrt((x * x).sum(axis=1)) * longest
            near = _near_best(p, slack)
            odd = ~np.isfinite(p).all(axis=1) | ~np.isfinite(slack)
            if not whole:
                common = (a_there[k : k + ROWS].astype(np.float32) @ b_there.T.astype(np.float32)) > 0
                odd |= ~common.all(axis=1)
            near[odd | again] = True
            i, j = np.nonzero(near)
            both = ((i[n : n + AGAIN], j[n : n + AGAIN]) for n in range(0, len(i), AGAIN))
            s = np.concatenate([_summed(x[r], b[c], a_there[k + r] & b_there[c]) for r, c in both])
            null = np.zeros(len(i), bool) if whole else ~common[i, j]
            two = np.flatnonzero(has[j])
            i, s, null, ids = np.r_[i, i[two]], np.r_[s, s[two]], np.r_[null, null[two]], np.r_[firsts[j], seconds[j[two]]]
            best = _two_best(i, ids, s, null)
            found.append((cid[k + i[best]], s[best], null[best], ids[best]))
    cids, s, null, ids = map(np.concatenate, zip(*found))
    return pa.table({"cid": pa.array(cids, pa.int64()), "s": pa.array(s, pa.float64(), mask=null), "other": pa.array(ids, pa.int64())})


def best_match(df: DataFrame, ident: str, label: Column, vector: Column) -> DataFrame:
    """ident, best: for each id that isn't alone in its label the other id with the greatest product, rounded to six digits."""
    rows = df.select(F.col(ident).cast("long").alias("id"), label.alias("label"), vector.alias("v")).where("id is not null and label is not null").distinct()
    two = rows.withColumn("r", F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))).where("r <= 2")  # limited before the shuffle too
    classes = written(two.groupBy("label", "v").agg(F.min("id").alias("first"), F.max(F.when(F.col("r") == 2, F.col("id"))).alias("second")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    placed = classes.join(classes.groupBy("label").agg(blocks.alias("n")), "label").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    side = lambda asks: placed.select("label", "cid", "first", "second", "v", F.lit(asks).alias("asks"), F.col("mine").alias("a" if asks else "b"), every.alias("b" if asks else "a"))
    met = side(True).unionByName(side(False)).groupBy("label", "a", "b").applyInArrow(_pair, "cid bigint, s double, other bigint")
    by_score = Window.partitionBy("cid").orderBy(F.desc_nulls_last("s"), "other")
    best = met.groupBy("cid", "other").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(by_score)).where("r <= 2").select("cid", "s", "other")
    members = rows.alias("m").join(classes.alias("c"), (F.col("m.label") == F.col("c.label")) & F.col("m.v").eqNullSafe(F.col("c.v"))).select("id", "cid")
    first = F.max(F.struct(F.col("s"), (-F.col("other")).alias("minus")))
    return members.join(best, "cid").where("id <> other").groupBy("id").agg(first.alias("x")).select(F.col("id").alias(ident), (-F.col("x.minus")).alias("best"))
