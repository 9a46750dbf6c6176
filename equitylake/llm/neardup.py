"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines.

Vectors of the same label and dimension are compared. Equal vectors form a
class, and classes are compared once. In each of several tables, the signs of a
class against ``bits`` random hyperplanes are its bucket; ``bits`` grows with
the log of the number of classes, so that chance meetings stay rare, and the
number of tables follows from the target recall at the threshold. Buckets with
more than one class are dealt to units, small ones together, large ones as pairs
of blocks; a unit computes the cosines of its buckets in double precision. A
pair counts in the first table that its classes share, so nothing is sent per
pair and nothing counted twice. Components come from a spanning forest of the
links.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors without a label, link with nothing and are kept; rows
that repeat an id are copies like any equal vectors; null ids name a component
only if it has no other; an empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components, forest, id_of, node_of
from .words import mix

BLOCK = 1024  # classes of a block of a large bucket
BIN = 4096  # rows that small buckets share


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables that find a pair at the threshold with ``recall``."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, or None if it takes no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            norm = np.sqrt(x @ x) if np.isfinite(x).all() else 0.0
            if not norm or not np.isfinite(norm):
                x = None
        out.append(x)
    return out


def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((n, dim))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, label, vec) of every row; key is null if it takes no part."""
    def run(batches):
        for b in batches:
            keys, vecs = [], []
            for x, label in zip(usable(b.column("vec")), b.column("label").to_pylist()):
                ok = x is not None and label is not None
                vecs.append(x.tobytes() if ok else None)
                keys.append(hashlib.blake2b(f"{label}\0".encode() + vecs[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), b.column("label"),
                                              pa.array(vecs, pa.binary())], names=["vec_id", "key", "label", "vec"])
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"),
                          vectors["embedding"].alias("vec")).mapInArrow(
        run, "vec_id long, key binary, label string, vec binary")


def signs(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(key, buckets): a bucket number per table, of label, dimension and signs."""
    def run(batches):
        for b in batches:
            labels = b.column("label").to_pylist()
            vecs = [np.frombuffer(v, np.float64) for v in b.column("vec").to_pylist()]
            out = np.zeros((len(vecs), tables), np.uint64)
            for dim in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                side = np.stack([vecs[i] for i in at]) @ _planes(dim, tables * bits, seed).T > 0
                weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                out[at] = (side.reshape(len(at), tables, bits) * weight).sum(axis=2, dtype=np.uint64)
            tag = np.array([int.from_bytes(hashlib.blake2b(f"{x}\0{len(v)}".encode(), digest_size=8).digest(), "little")
                            for x, v in zip(labels, vecs)], np.uint64)
            if len(vecs):
                out = mix(out + mix(tag[:, None] + np.arange(tables, dtype=np.uint64)[None, :]))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.ListArray.from_arrays(np.arange(len(vecs) + 1, dtype=np.int32) * tables,
                                                           pa.array(out.view(np.int64).ravel()))], names=["key", "buckets"])
    return classes.select("key", "label", "vec").mapInArrow(run, "key binary, buckets array<long>")


def compare(t: pa.Table, threshold: float) -> pa.Table:
    """Links of a unit's buckets: rows (key, other, docs); with ``other`` an edge
    of a spanning forest, without it the vectors that a class links with."""
    t = t.sort_by([("bucket", "ascending"), ("side", "ascending"), ("key", "ascending")])
    bucket, side = t.column("bucket").to_numpy(), t.column("side").to_numpy()
    nth, copies = t.column("nth").to_numpy(), t.column("copies").to_numpy()
    key = t.column("key").to_pylist()
    buckets = np.array(t.column("buckets").combine_chunks().values).reshape(t.num_rows, -1)
    vec = [np.frombuffer(v, np.float64) for v in t.column("vec").to_pylist()]
    docs = np.zeros(t.num_rows, np.int64)
    edges: list[tuple[int, int]] = []
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = np.arange(a, b)
        x = np.stack(vec[a:b])
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        cross = bool(side[b - 1])
        left = np.flatnonzero(side[a:b] == 0)
        right = np.flatnonzero(side[a:b] == 1) if cross else left
        link = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :]) >= threshold
        if not cross:
            np.fill_diagonal(link, False)
        for earlier in range(int(nth[a])):  # pairs that an earlier table holds count there
            if not link.any():
                break
            link &= buckets[rows[left], earlier][:, None] != buckets[rows[right], earlier][None, :]
        if link.any():
            docs[rows[left]] += link @ copies[rows[right]]
            if cross:
                docs[rows[right]] += copies[rows[left]] @ link
            label = forest(link, left, right, len(rows))
            edges += [(int(rows[i]), int(rows[label[i]])) for i in np.flatnonzero(label != np.arange(len(rows)))]
    count = np.flatnonzero(docs)
    return pa.table({"key": pa.array([key[i] for i in count] + [key[i] for i, _ in edges], pa.binary()),
                     "other": pa.array([None] * len(count) + [key[i] for _, i in edges], pa.binary()),
                     "docs": np.concatenate([docs[count], np.zeros(len(edges), np.int64)])})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999,
                    seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per vector."""
    found = staged(classes_of(vectors), "neardup")
    classes = found.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.min(F.struct("label", "vec")).alias("of"))
    # from here on a class goes by its node, which sorts by its smallest id
    classes = staged(classes.select(F.col("key").alias("class"), node_of(F.col("first_id"), F.col("key")).alias("key"),
                                    "copies", "of.*"), "neardup_class")
    bits = max(8, math.ceil(math.log2(max(classes.count(), 2))))
    signed = staged(signs(classes, bits, tables_for(threshold, bits, recall), seed), "neardup_sign")
    placed = signed.select("key", F.posexplode("buckets").alias("nth", "bucket"))
    # only the buckets that several classes share, with their size
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("nth").alias("nth")).where("n > 1")
    rows = placed.select("key", "bucket").join(shared, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    bins = max(1, math.ceil((rows.where("blocks = 1").count()) / BIN))
    small = rows.where("blocks = 1").select("*", F.pmod(F.xxhash64("bucket"), F.lit(bins)).alias("unit"),
                                            F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    large = (rows.where("blocks > 1").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("unit", F.col("bucket")).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
             .withColumn("side", F.when(F.col("b") <= F.col("o"), 0).otherwise(1)).drop("b", "o"))
    units = small.unionByName(large).drop("n", "blocks").join(signed, "key").join(
        classes.select("key", "copies", "vec"), "key")

    def unit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return compare(t, threshold)

    links = staged(units.groupBy("unit", "i", "j").applyInArrow(unit, "key binary, other binary, docs long"), "neardup_link")
    counts = links.where("other is null").groupBy("key").agg(F.sum("docs").alias("linked"))
    roots = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "class", "copies").join(roots, F.col("key") == F.col("node"), "left").join(
        counts, "key", "left").select(
        F.col("class").alias("key"), id_of(F.coalesce("root", "key")).alias("component_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return found.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))
