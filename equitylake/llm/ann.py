"""Approximate nearest neighbours by inner product, over one-bit codes.

Vectors are assigned to the nearest of some centroids (fitted on a bounded
sample, their number grows with the root of the table). A vector's residual to
its centroid is rotated at random and keeps one sign bit a dimension, packed,
with two correction scalars: its length, and the inner product of the unit
residual with its code. From these a query estimates its inner product with the
vector, with an error bound that holds with high probability. In every list that
a query probes, the estimates' lower bounds set the bar that the n-th best
passes for sure; only vectors whose upper bound reaches it are reranked, by the
exact inner product in double precision.

A query first probes the nearest lists that hold n other vectors; the n-th best
of these is its bar. Then it probes every other list that can hold a vector above
the bar: its inner product with the centroid and the greatest residual of the
list bound those of the list's vectors. So no list is left out that matters,
whatever the size of the table, and only the codes' error bounds are approximate.

A list is cut into blocks of bounded size and the queries that probe it into
batches; a task compares a batch with a block and keeps the n best of each
query, so one list may hold any share of the rows. All rows are indexed.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and null ids, take no part; rows that repeat an id count once, by
the smallest vector; vectors are compared within their dimension; fewer
candidates than asked for are all returned; ties go to the smaller id; an empty
table gives no rows; other columns are read by the query condition alone. Texts,
long or not, play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_texts_ok, staged
from .neardup import usable

SAMPLE = 8192  # vectors that the centroids are fitted on, at most (a dimension)
BLOCK = 4096  # vectors of a block, about
BATCH = 1024  # queries of a batch, about


@dataclass
class Index:
    """Centroids and rotation of one dimension."""
    centroids: np.ndarray
    rotation: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        d = (self.centroids ** 2).sum(axis=1)[None, :] - 2 * x @ self.centroids.T
        return d.argmin(axis=1)

    def first(self, q: np.ndarray, size: np.ndarray, top: int) -> list[np.ndarray]:
        """Lists of each query: by the inner product with their centroids, until
        they hold ``top`` vectors besides the query."""
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        need = (np.cumsum(size[order], axis=1) < top + 1).sum(axis=1) + 1
        return [o[:n][size[o[:n]] > 0] for o, n in zip(order, need)]

    def rest(self, q: np.ndarray, bar: np.ndarray, size: np.ndarray, radius: np.ndarray, top: int) -> list[np.ndarray]:
        """The other lists of each query that may hold a score of at least its bar."""
        norm = np.sqrt((q ** 2).sum(axis=1))[:, None]
        most = q @ self.centroids.T + norm * radius[None, :]
        slack = 1e-9 * norm * (radius + np.sqrt((self.centroids ** 2).sum(axis=1)))[None, :]  # rounding
        may = (most + slack >= bar[:, None]) & (size > 0)[None, :]
        for i, done in enumerate(self.first(q, size, top)):
            may[i, done] = False
        return [np.flatnonzero(m) for m in may]


def fit(sample: np.ndarray, n: int, seed: int = 3, steps: int = 10) -> Index:
    """k-means centroids, as many as a quarter of the root of n, and a random
    rotation."""
    rng = np.random.default_rng(seed)
    lists = min(max(1, int(math.sqrt(n) / 4)), len(sample))
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(steps):
        own = ((c ** 2).sum(axis=1)[None, :] - 2 * sample @ c.T).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=lists)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    rotation, _ = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))
    return Index(c, rotation)


def encode(x: np.ndarray, centroid: np.ndarray, rotation: np.ndarray):
    """(packed sign bits, length of the residual, its unit's product with its code)."""
    residual = (x - centroid) @ rotation.T
    length = np.sqrt((residual ** 2).sum(axis=1))
    bits = residual > 0
    dot = np.abs(residual).sum(axis=1) / math.sqrt(x.shape[1]) / np.where(length > 0, length, 1.0)
    return np.packbits(bits, axis=1), length, dot


def estimate(codes: np.ndarray, length: np.ndarray, dot: np.ndarray, centroid: np.ndarray,
             rotation: np.ndarray, q: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and their error bounds."""
    dim = q.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (q @ rotation.T).astype(np.float32)
    safe = np.where(dot > 0, dot, 1.0)
    raw = turned @ signs.T / math.sqrt(dim)
    about = (q @ centroid)[:, None] + raw * (length / safe)[None, :]
    spread = length / safe * np.sqrt(np.maximum(0.0, 1 - dot ** 2)) * eps / math.sqrt(max(dim - 1, 1))
    norm = np.sqrt((q ** 2).sum(axis=1))
    return about, norm[:, None] * spread[None, :] + 1e-5 * norm[:, None] * (1 + length)[None, :]


def best(q_ids, q, bars, ids, vecs, codes, length, dot, centroid, rotation, top: int, eps: float):
    """(query, id, score) of the ``top`` best of a block for each query, of those
    that reach its bar. All queries share the block's codes; reranking is exact."""
    about, error = estimate(codes, length, dot, centroid, rotation, q, eps)
    own = q_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, about - error)
    k = min(top, len(ids))
    bar = np.maximum(np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k], bars)
    out = []
    for i in range(len(q_ids)):
        at = np.flatnonzero((about[i] + error[i] >= bar[i]) & ~own[i])
        score = np.add.accumulate(vecs[at] * q[i], axis=1)[:, -1]  # summed in order, so that reruns agree bit by bit
        order = np.lexsort((ids[at], -score))[:top]
        out.append((np.full(len(order), q_ids[i]), ids[at][order], score[order]))
    return [np.concatenate(x) for x in zip(*out)]


def search(vectors: DataFrame, is_query: Column, top: int = 20, eps: float = 2.5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of every row for
    which ``is_query`` (of the column vec_id) holds."""
    def clean(batches):
        for b in batches:
            xs = usable(b.column("vec"))
            at = [i for i, x in enumerate(xs) if x is not None]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at, pa.int64())),
                                              pa.array([xs[i].tobytes() for i in at], pa.binary()),
                                              pa.array([len(xs[i]) for i in at], pa.int32())], names=["vec_id", "vec", "dim"])
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("vec")).where(
        "vec_id is not null").mapInArrow(clean, "vec_id long, vec binary, dim int")
    rows = staged(rows.groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("v")).select("vec_id", "v.*"), "ann")
    index: dict[int, Index] = {}
    for r in rows.groupBy("dim").count().collect():
        # bounded: at most SAMPLE vectors of each dimension reach the driver
        got = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
        index[r["dim"]] = fit(np.stack([np.frombuffer(v, np.float64) for v in got.column(0).to_pylist()]), r["count"])

    def assign(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            vecs = b.column("vec").to_pylist()
            own, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([np.frombuffer(vecs[i], np.float64) for i in at])
                own[at] = index[int(dim)].nearest(x)
                far[at] = np.sqrt(((x - index[int(dim)].centroids[own[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), b.column("dim"), pa.array(own, pa.int32()),
                                              pa.array(far), b.column("query")],
                                             names=["vec_id", "vec", "dim", "list", "far", "query"])
    placed = staged(rows.select("*", F.coalesce(is_query, F.lit(False)).alias("query")).mapInArrow(
        assign, "vec_id long, vec binary, dim int, list int, far double, query boolean"), "ann_list")
    cut = lambda n, size: F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(n / size))).cast("int")
    sizes = placed.groupBy("dim", "list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    held = {dim: (np.zeros(len(i.centroids), np.int64), np.zeros(len(i.centroids))) for dim, i in index.items()}
    for r in sizes.collect():  # bounded: a row for each list
        held[r["dim"]][0][r["list"]], held[r["dim"]][1][r["list"]] = r["n"], r["radius"]
    sizes = sizes.drop("radius")

    def probes(batches):
        for b in batches:
            dims, vecs = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            bar, lists = b.column("bar").to_numpy(zero_copy_only=False), [[]] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                q = np.stack([np.frombuffer(vecs[i], np.float64) for i in at])
                size, radius = held[int(dim)]
                # without a bar yet: the first lists; then all others that may reach it
                begin = np.isnan(bar[at])
                for new, found in ((True, index[int(dim)].first(q[begin], size, top)),
                                   (False, index[int(dim)].rest(q[~begin], bar[at][~begin], size, radius, top))):
                    for i, p in zip(at[begin == new], found):
                        lists[i] = p.tolist()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), b.column("dim"), b.column("bar"),
                                              pa.array(lists, pa.list_(pa.int32()))],
                                             names=["vec_id", "vec", "dim", "bar", "lists"])

    def block(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        dim, which = key[0].as_py(), key[1].as_py()
        x = np.stack([np.frombuffer(v, np.float64) for v in t.column("vec").to_pylist()])
        codes, length, dot = encode(x, index[dim].centroids[which], index[dim].rotation)
        one = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.table({"dim": pa.array([dim], pa.int32()), "list": pa.array([which], pa.int32()),
                         "ids": one(t.column("vec_id").to_numpy()), "vecs": one(x), "codes": one(codes),
                         "length": one(length), "dot": one(dot)})

    def batch(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "list": pa.array([key[1].as_py()], pa.int32()),
                         "q_ids": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()),
                         "q": pa.array([b"".join(t.column("vec").to_pylist())], pa.binary()),
                         "bars": pa.array([np.nan_to_num(t.column("bar").to_numpy(), nan=-np.inf, neginf=-np.inf).tobytes()],
                                          pa.binary())})

    blocks = (placed.select("vec_id", "vec", "dim", "list").join(sizes, ["dim", "list"])
              .withColumn("block", cut(F.col("n"), BLOCK)).drop("n").groupBy("dim", "list", "block")
              .applyInArrow(block, "dim int, list int, ids binary, vecs binary, codes binary, length binary, dot binary"))

    def compare(batches):
        for b in batches:
            for r in b.to_pylist():
                at = index[r["dim"]]
                get = lambda c, d=np.float64: np.frombuffer(r[c], d)  # noqa: B023, E731
                ids = get("ids", np.int64)
                q, d, s = best(get("q_ids", np.int64), get("q").reshape(-1, r["dim"]), get("bars"), ids, get("vecs").reshape(-1, r["dim"]),
                               get("codes", np.uint8).reshape(len(ids), -1), get("length"), get("dot"),
                               at.centroids[r["list"]], at.rotation, top, eps)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(s)], names=["query_id", "vec_id", "score"])

    def near(queries: DataFrame) -> DataFrame:
        """query_id, vec_id, score from the lists that (vec_id, vec, dim, bar) probe."""
        asked = queries.mapInArrow(probes, "vec_id long, vec binary, dim int, bar double, lists array<int>").select(
            "vec_id", "vec", "dim", "bar", F.explode("lists").alias("list"))
        asked = staged(asked, "ann_ask")
        asks = asked.groupBy("dim", "list").agg(F.count("*").alias("m"))
        batches_ = (asked.join(asks, ["dim", "list"]).withColumn("batch", cut(F.col("m"), BATCH)).drop("m")
                    .groupBy("dim", "list", "batch")
                    .applyInArrow(batch, "dim int, list int, q_ids binary, q binary, bars binary"))
        # the batches of a list meet its blocks; both sides are bounded packed rows
        return batches_.join(blocks, ["dim", "list"]).mapInArrow(compare, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        packed = found.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")).alias("all"))
        return packed.select("query_id", F.slice(F.array_sort("all"), 1, top).alias("all"))

    long_texts_ok(vectors)
    queries = placed.where("query").select("vec_id", "vec", "dim")
    begun = staged(ranked(near(queries.withColumn("bar", F.lit(float("nan"))))), "ann_near")
    # a query that found fewer than asked for has nothing to pass
    bars = begun.select(F.col("query_id").alias("vec_id"), F.when(
        F.size("all") >= top, -F.element_at("all", -1).getField("far")).otherwise(F.lit(float("-inf"))).alias("bar"))
    others = near(queries.join(bars, "vec_id"))
    found = begun.select("query_id", F.explode("all").alias("r")).select(
        "query_id", "r.vec_id", (-F.col("r.far")).alias("score")).unionByName(others)
    return ranked(found).select("query_id", F.posexplode("all").alias("place", "r")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"),
        (-F.col("r.far")).alias("score"))
