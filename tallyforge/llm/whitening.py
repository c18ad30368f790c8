"""Embedding whitening by matrix-free block Lanczos over distributed passes.

Entries become integers, so sums, counts and deviations are exact. The covariance is never formed: a pass gives it times a block of
vectors, as every partition centres its rows, multiplies them by the block and back, and adds up a matrix of dimensions by
block; Spark sums these by entry. On the driver are only matrices of dimensions by basis vectors.

Each new block is orthogonalised against the whole basis, twice. Where it breaks down, that is, where columns have nothing new,
random ones take their place, so that the basis starts afresh outside the subspace that is exhausted. Ritz pairs come from the
whole projected matrix. It ends when the residuals of all wanted pairs are small, or when the basis is the whole space.

Defined results. Rows with a null vector, or with null or non-finite entries, are left out; all others are learned from and are
returned, repeated ones each time, those with a null id too. Vectors of different lengths: the longest counts, shorter ones (empty
ones too) go on with zeros. Components whose variance is nothing but rounding (a RANK part of the largest) don't exist, so
equal rows, or a single one, have none, and there are fewer components than asked for where rank or length is less. Ties of
eigenvalues: any orthonormal choice, one for all rows. Empty table: no rows. Integers beyond a long fail. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk_search import finite

#: Rows that are matrices at once.
ROWS = 2048
#: Residuals at which Ritz pairs are taken, and the least eigenvalue, as parts of the largest eigenvalue.
TOLERANCE, RANK = 1e-13, 1e-13


@dataclass(frozen=True)
class Quantiser:
    """An entry c becomes floor(scale * c) + offset."""

    scale: int = 64
    offset: int = 1_000_000

    def rows(self, vectors: DataFrame, key: str, column: str) -> DataFrame:
        """key, x: the vectors that take part, as integers."""
        whole = F.transform(F.col(column), lambda c: F.floor(F.lit(float(self.scale)) * c.cast("double")).cast("long") + F.lit(self.offset).cast("long"))
        return vectors.where(finite(F.col(column))).select(F.col(key).alias("key"), whole.alias("x"))


@dataclass(frozen=True)
class Whitening:
    """A fitted model: how many vectors, sums by dimension, falling eigenvalues with unit eigenvectors in columns, and the trace."""

    quantiser: Quantiser
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return _deviations(x, self.n, self.sums)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return _projected(deviations, self.n, self.vectors, self.values)


# -- rows as matrices


def _matrices(batches: Iterator[pa.RecordBatch], dims: int, fill: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(key, x) in pieces of at most ROWS rows; short vectors are filled up."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            lists = part.column(1)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            if dims and (sizes == dims).all():
                x = flat.reshape(-1, dims)
            else:
                x = np.full((len(sizes), dims), fill, np.int64)
                x[np.arange(dims) < sizes[:, None]] = flat
            yield part.column(0), x


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if x.size and n * int(np.abs(x).max()) + int(np.abs(sums).max()) >= 2**63:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums


def _squared(deviations: np.ndarray) -> np.ndarray:
    """Sums of squares by row, exactly; beyond a long they fail when they are returned."""
    if deviations.size and int(np.abs(deviations).max()) ** 2 * deviations.shape[1] >= 2**63:
        deviations = deviations.astype(object)
    return (deviations * deviations).sum(axis=1)


def _projected(deviations: np.ndarray, n: int, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (deviations.astype(np.float64) / n) @ vectors / np.sqrt(values)


def _added(rows: DataFrame, shape: tuple[int, int], dims: int, fill: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(x) over all rows: each task adds up a matrix of the shape, Spark the tasks' entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _matrices(batches, dims, fill):
            total += part(x)
        i, j = np.indices(shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row for each entry of the shape
        out[r["i"], r["j"]] = r["v"]
    return out


def _sums(rows: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """How many vectors, and by dimension the sum and the number of those that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, had = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            n += len(sizes)
            longest = int(sizes.max(initial=0))
            if longest > len(total):
                total, had = (np.append(v, np.zeros(longest - len(v), np.int64)) for v in (total, had))
            for _, x in _matrices([batch], longest, 0):
                total[:longest] += x.sum(axis=0)
            had[:longest] += (np.arange(longest) < sizes[:, None]).sum(axis=0)
        at = np.arange(-1, len(total), dtype=np.int32)  # under -1 the number of vectors
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(0, total)), pa.array(np.append(n, had))], ["at", "s", "had"])

    got = {r["at"]: (r["s"], r["had"]) for r in rows.mapInArrow(run, "at int, s bigint, had bigint").groupBy("at").agg(F.sum("s").alias("s"), F.sum("had").alias("had")).collect()}
    return got.pop(-1, (0, 0))[1], [got[k] for k in sorted(got)]


# -- Lanczos


def new_block(w: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns for w, orthogonal to the basis; a column with nothing new is replaced by a random one. At most what is left of the space."""
    dims = len(w)
    out = np.empty((dims, 0))
    for k in range(min(w.shape[1], dims - basis.shape[1])):
        v = w[:, k]
        while True:
            before = np.linalg.norm(v)
            for q in (basis, out, basis, out):  # twice, against everything
                v = v - q @ (q.T @ v)
            after = np.linalg.norm(v)
            if before and after > 1e-10 * before:
                break
            v = rng.standard_normal(dims)  # breakdown
        v = v / after
        for q in (basis, out):
            v = v - q @ (q.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], dims: int, want: int, block: int, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The `want` largest eigenvalues, falling, with unit eigenvectors, of the symmetric matrix that times() multiplies by; passes made."""
    rng = np.random.default_rng(seed)
    basis, images, passes = np.empty((dims, 0)), np.empty((dims, 0)), 0
    following = rng.standard_normal((dims, min(block, dims)))
    while True:
        v = new_block(following, basis, rng)
        image = times(v)
        passes += 1
        basis, images = np.column_stack([basis, v]), np.column_stack([images, image])
        projected = basis.T @ images
        values, inside = np.linalg.eigh((projected + projected.T) / 2)
        values, inside = values[::-1][:want], inside[:, ::-1][:, :want]
        ritz = basis @ inside
        residuals = np.linalg.norm(images @ inside - ritz * values, axis=0)
        if basis.shape[1] == dims or (len(values) == want and (residuals <= tolerance * max(values[0], 0)).all()):
            return values, ritz / np.linalg.norm(ritz, axis=0), passes
        following = image


def fit(vectors: DataFrame, components: int = 32, key: str = "vec_id", column: str = "embedding", quantiser: Quantiser = Quantiser(), block: int | None = None) -> Whitening:
    """The whitening of all vectors that take part. block: columns of a pass, by default as many as components."""
    rows = quantiser.rows(vectors, key, column)
    n, by_dimension = _sums(rows)
    fill, dims = quantiser.offset, len(by_dimension)
    sums = [s + (n - had) * fill for s, had in by_dimension]
    totals = np.array(sums, object if any(abs(s) >= 2**63 for s in sums) else np.int64)
    empty = Whitening(quantiser, n, totals, np.empty(0), np.empty((dims, 0)), 0.0, 0, 0.0)
    if not n or not dims:
        return empty
    trace = 0.0

    def times(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            d = _deviations(x, n, totals)
            centred = d.astype(np.float64) / n
            squares = np.zeros((1, v.shape[1]))
            squares[0, 0] = _squared(d).astype(np.float64).sum()
            return np.vstack([centred.T @ (centred @ v), squares])

        nonlocal trace
        got = _added(rows, (dims + 1, v.shape[1]), dims, fill, part)
        trace = got[-1, 0] / n / n / n
        return got[:-1] / n

    values, ritz, passes = block_lanczos(times, dims, min(components, dims), block or components)
    there = values > RANK * max(values[0], 0)
    values, ritz = values[there], ritz[:, there]
    if not len(values):
        return empty

    def products(x: np.ndarray) -> np.ndarray:
        w = _projected(_deviations(x, n, totals), n, ritz, values)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _added(rows, (len(values) + 1, len(values)), dims, fill, products) / n
    covariance = got[:-1] - np.outer(got[-1], got[-1])
    return Whitening(quantiser, n, totals, values, ritz, trace, passes, float(np.abs(covariance - np.eye(len(values))).max()))


def transform(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = model.quantiser.rows(vectors, key, column)
    k, dims, fill = len(model.values), len(model.sums), model.quantiser.offset
    component = np.arange(1, k + 1, dtype=np.int32)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not k:
            return
        for keys, x in _matrices(batches, dims, fill):
            d, m = model.deviations(x), len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(component, m)), pa.array(np.full(m * k, model.n)), pa.array(np.repeat(_squared(d), k), pa.int64()),
                    pa.array(model.project(d).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)


def whiten(vectors: DataFrame, components: int = 32, key: str = "vec_id", column: str = "embedding", quantiser: Quantiser = Quantiser()) -> DataFrame:
    """All vectors, whitened by what is learned from all of them."""
    return transform(vectors, fit(vectors, components, key, column, quantiser), key, column)
