"""Counting by packed exchanges: stretches of whole documents ask buckets about their keys, and get the answers back in order.

A stretch sends its sorted 64-bit keys, split by bucket, as arrays in one binary value for each bucket; a bucket's parts meet
in one task, and each part's answers go back to its stretch. So a hot key is one entry for each stretch, rows are few, and what
is shuffled is little more than the keys. Keys are told apart by bucket and 48 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: head: what belongs to the stretch and not to a bucket. data: pickled arrays.
DEALT = "bucket int, batch bigint, head boolean, data binary"
LOW = np.uint64((1 << 48) - 1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def low48(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower 48 bits in six bytes a key."""
    return keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)


def joined48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low | high.astype(np.uint64) << np.uint64(32)


def rows(made: list[tuple]) -> pa.RecordBatch:
    """(bucket, batch, head, data) -> rows of DEALT."""
    bucket, batch, head, data = zip(*made)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(batch, pa.int64()), pa.array(head), pa.array([pickle.dumps(x, 5) for x in data], pa.binary())], ["bucket", "batch", "head", "data"])


def together(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list]]:
    """Rows (bucket, batch, head, data) of DEALT that follow each other with the same value; data is still packed."""
    value, met = None, []
    for batch in batches:
        for v, row in zip(batch.column(by).to_pylist(), zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "head")), batch.column("data"))):
            if v != value and met:
                yield value, met
                met = []
            value = v
            met.append(row)
    if met:
        yield value, met


def unpacked(data: pa.Scalar):
    return pickle.loads(data.as_py())


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where in it each distinct key begins, and how often it is there."""
    order = np.argsort(keys)
    inside = keys[order]
    first = np.flatnonzero(np.append(True, inside[1:] != inside[:-1])) if len(keys) else np.empty(0, np.int64)
    return order, first, np.diff(np.append(first, len(keys)))
