"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

The set of a document are the hashes of its runs of ``n`` words (all its words,
if fewer). Documents with the same word sequence form a class, and classes are
compared once. Per class, ``rows`` minima of hash functions make a band; the
number of bands follows from the target recall at the threshold. Classes that
share a band are candidates; a star of edges to the smallest class of every
band value joins them to clusters without listing pairs.

Each cluster is then verified on whole sets. Clusters are dealt to units of
bounded size, small ones together, a large one as pairs of its blocks, and a
unit counts the common n-grams of all its pairs at once: exactly for each pair,
with nothing sent per pair. Out come the number of links of every class and a
spanning forest of the links, from which the components follow.

Edge cases: null text, or text without words, links with nothing and is a class
of its own; repeated rows are copies of each other like any equal texts; null
ids are ignored when a class or component is named, unless it has no other; an
empty table gives no rows. A very long text is a chunk of its own, compared whole;
only id and text are read, and ``keep_one`` carries other columns in a struct, so
no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_texts_ok, staged
from .components import components, forest, id_of, node_of
from .exchange import with_answers
from .substring import chunked, each_chunk, spread
from .words import Words, mix, run_hash, run_starts, span_hash

N = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, compared without rounding
UNIT_DOCS, UNIT_GRAMS = 1024, 1 << 20
SENT = 512  # sets that a chunk sends at once


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` minima that find a pair at the threshold with ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)))


class Grams:
    """The n-gram hashes of a batch of texts: ``hash`` and the n+1 ``offsets`` of
    the texts; a text of fewer than n words has one, one without words none."""

    def __init__(self, words: Words, n: int = N):
        count = np.diff(words.first)
        per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        self.offsets = np.concatenate([[0], np.cumsum(per)])
        self.hash = np.zeros(int(per.sum()), np.uint64)
        long = np.flatnonzero(count >= n)
        if len(long):
            ok = run_starts(words.first, len(words.hash), n)
            self.hash[spread(self.offsets[long], per[long])] = run_hash(words.hash, n)[ok]
        short = np.flatnonzero((count > 0) & (count < n))
        self.hash[self.offsets[short]] = span_hash(words.hash, words.first[short], words.first[short + 1])

    def of(self, i: int) -> np.ndarray:
        return np.unique(self.hash[self.offsets[i]:self.offsets[i + 1]])


def signatures(g: Grams, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """Band values (texts with n-grams x bands)."""
    full = np.flatnonzero(np.diff(g.offsets) > 0)
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    rng = np.random.default_rng(seed)
    start = g.offsets[full]
    for b in range(bands):
        value = np.full(len(full), b, np.uint64)
        for _ in range(rows):
            odd, add = (np.uint64(rng.integers(0, 1 << 63, dtype=np.uint64)) for _ in range(2))
            value = mix(value + np.minimum.reduceat(g.hash * (odd * np.uint64(2) + np.uint64(1)) + add, start))
        out[:, b] = value
    return out


def sketches(held: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(chunk, row, doc_id, key, grams, bands) of every document; ``key`` is a
    128-bit hash of its words, null without words."""
    def run(r: dict) -> pa.Table:
        words, ids = Words(r["texts"].values), r["ids"].values
        g = Grams(words, n)
        full = np.diff(g.offsets) > 0
        one = span_hash(words.hash, words.first[:-1], words.first[1:])
        two = span_hash(mix(words.hash + np.uint64(1)), words.first[:-1], words.first[1:])
        key = np.stack([one, two], axis=1)
        sig = signatures(g, bands, rows).view(np.int64)
        at = np.cumsum(full) - 1
        size = len(full)
        off = np.concatenate([[0], np.cumsum(full)]) * bands
        return pa.table({
            "chunk": np.full(size, r["chunk"].as_py()), "row": np.arange(size, dtype=np.int32), "doc_id": ids,
            "key": pa.array([key[i].tobytes() if full[i] else None for i in range(size)], pa.binary()),
            "grams": np.diff(g.offsets).astype(np.int64),
            "bands": pa.ListArray.from_arrays(off.astype(np.int32), pa.array(sig[:int(at[-1]) + 1 if size else 0].ravel()))})
    return held.mapInArrow(each_chunk(run), "chunk long, row int, doc_id long, key binary, grams long, bands array<long>")


def overlaps(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, tile: int = 2048) -> np.ndarray:
    """Common entries of every left set with every right set (index arrays)."""
    m = len(grams)
    owner = np.repeat(np.arange(m), [len(g) for g in grams])
    flat = np.concatenate(grams) if m else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    head = np.flatnonzero(new)
    df = np.diff(np.append(head, len(flat)))
    to_left, to_right = np.full(m, -1), np.full(m, -1)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    # sets that share a rare entry: pair them by their distance in the entry's list
    rare = np.repeat((df > 1) & (df <= 16), df)
    o, which = owner[rare], np.repeat(np.arange(len(df)), df)[rare]
    for step in range(1, 16):
        same = np.flatnonzero(which[step:] == which[:-step])
        if not len(same):
            break
        for a, b in ((o[same], o[same + step]), (o[same + step], o[same])):
            ok = (to_left[a] >= 0) & (to_right[b] >= 0)
            cell = to_left[a[ok]] * len(right) + to_right[b[ok]]
            out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.float32)
    # frequent entries: columns of 0/1 matrices, multiplied tile by tile
    common = np.flatnonzero(df > 16)
    column = np.full(len(df), -1)
    for at in range(0, len(common), tile):
        part = common[at:at + tile]
        column[part] = np.arange(len(part))
        rows, cols = owner[spread(head[part], df[part])], np.repeat(column[part], df[part])
        x = np.zeros((len(left), len(part)), np.float32)
        y = np.zeros((len(right), len(part)), np.float32)
        for matrix, to in ((x, to_left), (y, to_right)):
            ok = to[rows] >= 0
            matrix[to[rows[ok]], cols[ok]] = 1.0
        out += x @ y.T
    return out


def verify(key: list[bytes], copies: np.ndarray, side: np.ndarray, grams: list[np.ndarray], cross: bool,
           threshold: tuple[int, int] = THRESHOLD) -> pa.Table:
    """Links of a unit: (key, other, classes, docs). Rows without ``other`` count
    the classes and documents that a class links with; rows with it are edges of
    a spanning forest. If ``cross`` holds, sides 0 and 1 are compared with each
    other (either may be empty: a block without classes), else side 0 with itself."""
    size = np.array([len(g) for g in grams], np.int64)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if cross else left
    if not len(left) or not len(right):
        return pa.table({"key": pa.array([], pa.binary()), "other": pa.array([], pa.binary()),
                         "classes": np.zeros(0, np.int64), "docs": np.zeros(0, np.int64)})
    common = overlaps(grams, left, right)
    top, bottom = threshold
    union = size[left][:, None] + size[right][None, :] - common
    link = common * bottom >= union * top
    if not cross:
        np.fill_diagonal(link, False)
    classes, docs = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    classes[left] = link.sum(axis=1)
    docs[left] = link @ copies[right]
    if cross:
        classes[right] = link.sum(axis=0)
        docs[right] = copies[left] @ link
    label = forest(link, left, right, len(key))
    count, tree = np.flatnonzero(classes), np.flatnonzero(label != np.arange(len(key)))
    take = lambda at: [key[i] for i in at]
    return pa.table({"key": pa.array(take(count) + take(tree), pa.binary()),
                     "other": pa.array([None] * len(count) + take(label[tree]), pa.binary()),
                     "classes": np.concatenate([classes[count], np.zeros(len(tree), np.int64)]),
                     "docs": np.concatenate([docs[count], np.zeros(len(tree), np.int64)])})


def _placed(members: DataFrame) -> DataFrame:
    """Members (key, cluster, grams, ...) with ``unit``, ``b`` and ``blocks``: a cluster
    that fits goes whole to a bin of such (block -1 of 1); a larger one is cut into
    blocks by a hash of the key, to be compared pair by pair."""
    sizes = (members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("grams").alias("g"))
             .withColumn("blocks", F.greatest(F.ceil(F.col("n") / UNIT_DOCS), F.ceil(F.col("g") / UNIT_GRAMS)).cast("int")))
    total = sizes.where("blocks <= 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).first()
    bins = max(1, math.ceil(2 * total[0] / UNIT_DOCS), math.ceil(2 * total[1] / UNIT_GRAMS))
    small = F.col("blocks") <= 1
    return members.join(sizes.select("cluster", F.greatest("blocks", F.lit(1)).alias("blocks")), "cluster").select(
        "*", F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster")).alias("unit"),
        F.when(small, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).alias("b"))


def expanded(b: np.ndarray, blocks: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(member, i, j, side) of the units that members of block ``b`` go to, ``step``
    at a time: (b, o) for every block o of their cluster, the lower one first."""
    ends = np.cumsum(blocks.astype(np.int64))
    for at in range(0, int(ends[-1]) if len(ends) else 0, step):
        k = np.arange(at, min(at + step, int(ends[-1])))
        member = np.searchsorted(ends, k, side="right")
        own, other = b[member], k - (ends - blocks)[member]
        whole = own < 0
        yield (member, np.where(whole, -1, np.minimum(own, other)).astype(np.int32),
               np.where(whole, -1, np.maximum(own, other)).astype(np.int32), (~whole & (own > other)).astype(np.int32))


def join(docs: DataFrame, n: int = N, recall: float = 0.9999, rows: int = 4,
         held: DataFrame | None = None) -> DataFrame:
    """Per document: chunk, row (its place), doc_id, class_id (smallest id with
    the same words), n_links (documents linked directly, copies included),
    n_class_links (classes linked), component (node), component_id (smallest id
    reachable over links)."""
    spark = docs.sparkSession
    long_texts_ok(docs)
    held = chunked(docs, "jaccard") if held is None else held
    found = staged(sketches(held, bands_for(THRESHOLD[0] / THRESHOLD[1], rows, recall), rows, n), "jaccard_sketch")
    classes = found.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies"),
        F.min(F.struct("chunk", "row", "grams", "bands")).alias("at"))
    classes = staged(classes.withColumn("node", node_of(F.col("class_id"), F.col("key"))), "jaccard_class")
    banded = classes.select("node", F.explode("at.bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = banded.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(stars)
    clusters = clusters.select("node", F.col("root").alias("cluster")).unionByName(
        clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    members = clusters.join(classes, "node").select(
        F.col("node").alias("key"), "cluster", "copies", F.col("at.chunk").alias("chunk"), F.col("at.row").alias("row"),
        F.col("at.grams").alias("grams"))
    # the chunks send the sets of the texts that units want; each learns of a text once
    wanted = _placed(staged(members, "jaccard_member")).groupBy("chunk").agg(
        F.collect_list(F.struct("row", "key", "copies", "unit", "b", "blocks")).alias("want"))

    def send(r: dict) -> Iterator[pa.Table]:
        want = r["want"].values if r["want"].is_valid else None
        if want is None:
            return
        want = pa.table({f: want.field(f) for f in ("row", "key", "copies", "unit", "b", "blocks")})
        texts, at = np.unique(want.column("row").to_numpy(), return_inverse=True)
        g = Grams(Words(r["texts"].values.take(pa.array(texts))), n)
        sets = pa.array([g.of(i).tobytes() for i in range(len(texts))], pa.binary())
        # a text of a large cluster goes to many units
        for member, i, j, side in expanded(want.column("b").to_numpy(), want.column("blocks").to_numpy(), SENT):
            out = want.select(["key", "copies", "unit"]).take(pa.array(member))
            yield pa.table({"key": out.column(0), "copies": out.column(1), "unit": out.column(2),
                            "i": i, "j": j, "side": side, "grams": sets.take(pa.array(at[member]))})

    def unit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("key", "ascending")])
        return verify(t.column("key").to_pylist(), t.column("copies").to_numpy(), t.column("side").to_numpy(),
                      [np.frombuffer(b, np.uint64) for b in t.column("grams").to_pylist()],
                      key[1].as_py() != key[2].as_py())

    long_texts_ok(docs)
    sent = with_answers(held, wanted).mapInArrow(
        each_chunk(send), "key binary, copies long, unit long, i int, j int, side int, grams binary")
    links = staged(sent.groupBy("unit", "i", "j").applyInArrow(
        unit, "key binary, other binary, classes long, docs long"), "jaccard_link")
    counts = links.where("other is null").groupBy("key").agg(
        F.sum("classes").alias("n_class_links"), F.sum("docs").alias("linked"))
    roots = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "node", "class_id", "copies").join(roots, "node", "left").join(
        counts.withColumnRenamed("key", "node"), "node", "left").select(
        "key", "class_id", "copies", F.coalesce("root", "node").alias("component"),
        F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"), F.coalesce("linked", F.lit(0)).alias("linked"))
    named = named.withColumn("component_id", id_of(F.col("component")))
    return found.select("chunk", "row", "doc_id", "key").join(named, "key", "left").select(
        "chunk", "row", "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("n_class_links", F.lit(0).cast("long")).alias("n_class_links"), "component",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its
    columns. Documents without words stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = chunked(docs, "jaccard_docs", rest)
    rows = join(docs, held=held, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "row")).alias("first")
    kept = rows.where("component is null").select("chunk", "row").unionByName(
        rows.where("component is not null").groupBy("component").agg(first).select("first.chunk", "first.row"))

    def pick(r: dict) -> pa.Table | None:
        if not r["rows"].is_valid:
            return None
        at = pa.array(sorted(r["rows"].as_py()))
        cols = {"id": r["ids"], "text": r["texts"]} | ({"rest": r["rest"]} if rest else {})
        return pa.table({c: v.values.take(at) for c, v in cols.items()})

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "id long, text string" + (
        ", rest struct<" + ", ".join(f"`c{k}`:{fields[c]}" for k, c in enumerate(rest)) + ">" if rest else "")
    out = with_answers(held, kept.groupBy("chunk").agg(F.collect_list("row").alias("rows"))).mapInArrow(each_chunk(pick), schema)
    back = {"doc_id": F.col("id").cast(fields["doc_id"]), "text": F.col("text")} | {
        c: F.col("rest").getField(f"c{k}") for k, c in enumerate(rest)}
    return out.select(*[back[c].alias(c) for c in docs.columns])
