"""Ranked lexical search by dense blocked matrix products.

The query items' distinct terms are the vocabulary, numbered compactly. One
pass over the documents keeps, per document, its number of terms and the (term,
count) pairs of that vocabulary, packed, and per task the counts of documents;
texts are not read again. A term's weight and a document's length factor follow
from the totals. Then tiles of ``TILE_DOCS`` documents become dense float64
matrices of impacts, are multiplied by tiles of the items' weights, and the
products are summed over the vocabulary tiles in int64.

All factors are whole numbers. A vocabulary tile is cut so that no item's
weights in it, times the largest possible impact (10**6), sum to 2**53; so every
partial sum of the product is exact in float64, in whatever order the BLAS adds.
A single weight beyond that is spread over several columns.

Top k, tie-safe: a tile's scores at or above an item's k-th best so far are all
candidates, and the best k by (score, smallest doc_id) are kept, per task. What
tasks found is merged in two steps, first in groups of tasks, then per item.

Items come to the driver in blocks bounded by ``BLOCK_BYTES`` of text and
``BLOCK_ITEMS`` items (a larger item is a block of its own), and every block is a
pass over all documents.

Edge cases: null text has no terms, and an item or document without terms takes
part in nothing; a null doc_id is larger than every id in ties; repeated rows are
documents (and items) of their own; no items or no documents give an empty
result; a very long text costs in proportion to its length; extra columns don't
matter, as only id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import BATCH_BYTES, chunks, long_texts_ok, staged

#: characters that belong to no term, as in the contract: ASCII but for letters and digits
TERM = np.zeros(256, dtype=bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
EXACT = 1 << 53
MOST_IMPACT = 1_000_000  # (10**9 * tf) div (1000 * tf + 8 * m) stays below 10**6
TILE_DOCS = 512
TILE_TERMS = 4096
BLOCK_ITEMS = 1024
BLOCK_BYTES = 4 << 20
GROUPS = 1009  # of tasks, whose results are merged first
KEY = np.uint64(0xA24BAED4963EE407)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term in order, n+1 offsets): A-Z hashed as a-z."""
    raw, off = words.utf8(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = TERM[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[off] = True
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]  # texts may meet inside a run
    cut = cut[inside[cut] & inside[cut - 1]]
    start = np.union1d(edge[inside[edge]], cut)
    end = np.union1d(edge[~inside[edge]], cut)
    if inside[0]:
        start = np.concatenate([[0], start])
    if inside[-1]:
        end = np.concatenate([end, [len(raw)]])
    out = np.empty(len(start), np.uint64)
    block = start // words.BLOCK  # the sums need 24 bytes a byte
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(start) else []
    for a, b in zip(edges[:-1], edges[1:]):
        low, high = start[a], end[b - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(words._BYTE_LOWER[raw[low:high]] * words._power("up", high - low), out=sums[1:])
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = words.mix((sums[e] - sums[s]) * words._power("down", high - low)[s] ^ (e - s).astype(np.uint64) ^ KEY)
    return out, np.searchsorted(start, off)


def item_blocks(items: DataFrame, block_items: int = BLOCK_ITEMS,
                block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The items with a text, in blocks that fit in the driver. Rows arrive one
    partition at a time."""
    block: list = []
    size = 0
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).where(
        F.col("text").isNotNull())
    for r in rows.toLocalIterator():
        n = len(r.text.encode())
        if block and (len(block) >= block_items or size + n > block_bytes):
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


class Vocabulary:
    """The distinct terms of a block of items: sorted hashes, and each item's
    counts as (term number, count)."""

    def __init__(self, texts: list[str]):
        hashes, first = terms_of(pa.array(texts, pa.string()))
        self.hash, number = np.unique(hashes, return_inverse=True)
        self.items = [np.unique(number[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]

    def __len__(self) -> int:
        return len(self.hash)


POSTINGS = "doc_id long, n long, terms binary, counts binary, docs long, total long, df binary"


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per document with terms: ``n`` of them, and of the vocabulary the term
    numbers and counts, packed (uint32, uint64). Per task one more row with its
    ``docs``, ``total`` terms and documents per vocabulary term (``df``)."""
    v = len(vocabulary)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = known.value
        df = np.zeros(v, np.int64)
        n_docs = total = 0
        for _, t in chunks(batches, limit=BATCH_BYTES):
            hashes, first = terms_of(t.column("text").combine_chunks())
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            at = np.searchsorted(vocab, hashes)
            at[at == v] = 0
            hit = vocab[at] == hashes if v else np.zeros(len(hashes), bool)
            pair, count = np.unique(doc[hit] * np.int64(max(v, 1)) + at[hit], return_counts=True)
            of, term = np.divmod(pair, max(v, 1))
            df += np.bincount(term, minlength=v)
            n_docs += int((n > 0).sum())
            total += int(n.sum())
            cut = np.searchsorted(of, np.arange(len(n) + 1))
            term, count = term.astype("<u4"), count.astype("<u8")
            # documents without a known term count above and match nothing
            rows = np.flatnonzero(np.diff(cut))
            ids = t.column("doc_id").combine_chunks().take(pa.array(rows))
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n[rows], pa.int64()),
                 pa.array([term[cut[i]:cut[i + 1]].tobytes() for i in rows], pa.binary()),
                 pa.array([count[cut[i]:cut[i + 1]].tobytes() for i in rows], pa.binary()),
                 pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())],
                names=["doc_id", "n", "terms", "counts", "docs", "total", "df"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
             pa.array([n_docs]), pa.array([total]), pa.array([df.tobytes()], pa.binary())],
            names=["doc_id", "n", "terms", "counts", "docs", "total", "df"])
    long_texts_ok(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, POSTINGS)


def totals(posted: DataFrame, v: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document count of each term. A task's counts are unpacked and
    summed per term by Spark; the driver gets one row a term."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v, np.int64)
        for b in batches:
            for x in b.column("df"):
                df += np.frombuffer(x.as_py(), np.int64)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term], pa.int64())],
                                         names=["term", "df"])
    stats = posted.where("df is not null")
    n, length = stats.agg(F.sum("docs"), F.sum("total")).first()
    found = stats.select("df").mapInArrow(unpack, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(v, np.int64)
    for r in found.collect():
        df[r.term] = r.df
    return n or 0, length or 0, df


class Tiles:
    """The items' weights as tiles: (terms of the tile; item, column and weight of
    every entry). A task makes them dense one at a time."""

    def __init__(self, vocabulary: Vocabulary, n: int, df: np.ndarray, most_terms: int = TILE_TERMS):
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]
        columns: list[list[tuple[int, int]]] = [[] for _ in range(len(df))]  # term -> (item, weight)
        for i, (terms, counts) in enumerate(vocabulary.items):
            for t, c in zip(terms.tolist(), counts.tolist()):
                if weight[t]:
                    columns[t].append((i, weight[t] * c))
        room = (EXACT - 1) // MOST_IMPACT
        self.tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        terms: list[int] = []
        entries: list[tuple[int, int, int]] = []
        used: Counter = Counter()

        def close() -> None:
            if terms:
                item, column, weight = (np.array(x, np.int64) for x in zip(*entries))
                self.tiles.append((np.array(terms, np.int64), item, column, weight.astype(np.float64)))
            terms.clear()
            entries.clear()
            used.clear()
        for t, column in enumerate(columns):
            while column:
                if len(terms) == most_terms or any(used[i] + min(x, room) > room for i, x in column):
                    close()
                for i, x in column:
                    used[i] += min(x, room)
                    entries.append((i, len(terms), min(x, room)))
                terms.append(t)
                column = [(i, x - room) for i, x in column if x > room]
        close()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Impact of a term with count ``tf`` in a document of ``n`` terms (int64)."""
    m = 25 + (75 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The k best (score, doc_id) of every item so far. ``low`` is each item's
    k-th score: no lower one can matter, an equal one may."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.low = np.ones(items, np.int64)
        self.item = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.score = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores``: items x documents of a tile."""
        item, at = np.nonzero(scores >= self.low[:, None])
        self.item = np.concatenate([self.item, item])
        self.doc = np.concatenate([self.doc, doc[at]])
        self.null = np.concatenate([self.null, null[at]])
        self.score = np.concatenate([self.score, scores[item, at]])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        first = np.searchsorted(self.item[order], np.arange(len(self.low)))
        rank = np.arange(len(order)) - first[self.item[order]]
        order = order[rank < self.k]
        self.item, self.doc, self.null, self.score = (x[order] for x in (self.item, self.doc, self.null, self.score))
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.low)) == self.k)
        last = np.searchsorted(self.item, full, side="right") - 1
        self.low[full] = self.score[last]


def scored(posted: DataFrame, tiles: list, items: int, docs: int, length: int, k: int,
           tile_docs: int = TILE_DOCS) -> DataFrame:
    """(item, doc_id, score, part): every task's best k documents of every item."""
    held = posted.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        best = Best(items, k)
        for b in batches:
            for a in range(0, b.num_rows, tile_docs):
                tile = b.slice(a, tile_docs)
                packed = [np.frombuffer(x.as_py(), "<u4") for x in tile.column("terms")]
                d = len(packed)
                row = np.repeat(np.arange(d), [len(x) for x in packed])
                term = np.concatenate(packed).astype(np.int64)
                tf = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in tile.column("counts")]).astype(np.int64)
                n = tile.column("n").to_numpy(zero_copy_only=False)
                value = impacts(tf, n[row], docs, length).astype(np.float64)
                order = np.argsort(term, kind="stable")
                by_term = term[order]
                scores = np.zeros((items, d), np.int64)
                for terms, at_item, at_column, weight in held.value:
                    low, high = np.searchsorted(by_term, terms), np.searchsorted(by_term, terms, side="right")
                    size = high - low
                    if not size.any():
                        continue
                    q = np.zeros((items, len(terms)))
                    q[at_item, at_column] = weight
                    dense = np.zeros((len(terms), d))
                    column = np.repeat(np.arange(len(terms)), size)
                    pick = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
                    dense[column, row[pick]] = value[pick]
                    scores += (q @ dense).astype(np.int64)
                ids = tile.column("doc_id")
                best.add(scores, ids.fill_null(0).to_numpy(zero_copy_only=False),
                         ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null),
             pa.array(best.score, pa.int64()), pa.array(np.full(len(best.item), part), pa.int64())],
            names=["item", "doc_id", "score", "part"])
    return (posted.where("df is null").select("doc_id", "n", "terms", "counts")
            .mapInArrow(run, "item long, doc_id long, score long, part long"))


def _ranked(df: DataFrame, by: list, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank: Column = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's ``k`` best documents with a
    score above 0, best first, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items):
        vocabulary = Vocabulary([text for _, text in block])
        if not len(vocabulary):
            continue
        posted = staged(postings(docs, vocabulary.hash), "ranked")
        n, length, df = totals(posted, len(vocabulary))
        if not n:
            continue
        tiles = Tiles(vocabulary, n, df).tiles
        found = scored(posted, tiles, len(block), n, length, k)
        found = _ranked(found.withColumn("part", F.col("part") % GROUPS), ["item", "part"], k)
        found = _ranked(found.select("item", "doc_id", "score"), ["item"], k)
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        found = found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"),
                                                            "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
