"""Requests from chunks of text to buckets of keys, and the answers back.

A chunk holds some megabytes of text. What it wants to know about its distinct
keys (word or passage hashes) goes out as one packed array per bucket of the
hash range, so a key costs 8 bytes and a hot one appears once a chunk, whatever
its count. A bucket's task sees all chunks' entries for its keys and answers
each chunk in the order of its request; the chunk knows that order, so answers
carry no keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each uint64 key: n even ranges of hashes, in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted ``buckets`` and the offsets between them: what
    a chunk sends depends on its own entries only, however many buckets there are."""
    head = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    return buckets[head], np.append(head, len(buckets))


def requests(chunk: int, full: np.ndarray, off: np.ndarray | dict, **arrays: np.ndarray) -> pa.Table:
    """A row (bucket, chunk, one binary column per array) for every bucket in
    ``full``; ``off`` are their offsets in every array, or a dict has each array's
    own."""
    cols = {"bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int64())}
    for name, a in arrays.items():
        at = (off[name] if isinstance(off, dict) else off).tolist()
        cols[name] = pa.array([a[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())
    return pa.table(cols)


def joined(t: pa.Table, column: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all rows of a binary column as one array, and n+1 offsets."""
    parts = [np.frombuffer(b, dtype) for b in t.column(column).to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), off


def answers(df: DataFrame, *columns: str) -> DataFrame:
    """Per chunk, the answers of its buckets in bucket order: arrays of binary."""
    packed = df.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", *columns))).alias("got"))
    return packed.select("chunk", *[F.col(f"got.{c}").alias(c) for c in columns])


def with_answers(chunked: DataFrame, got: DataFrame) -> DataFrame:
    """Join answers to a table bucketed by chunk; only the answers move."""
    return chunked.join(got.hint("shuffle_hash"), "chunk", "left")


def whole(parts, dtype) -> np.ndarray:
    """One array of a list of binary values (None: empty)."""
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(p, dtype) for p in parts or ())])
