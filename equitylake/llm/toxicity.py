"""Toxicity: a logistic classifier regularised by counterfactuals.

Features are the presence of lower-cased words (letter runs). The model is
fitted on a bounded sample of labelled texts (``SAMPLE`` rows, the smallest
hashes of the ids), on the whole of each. Words are counted by label in Spark;
the vocabulary are all words of the sample that tell the labels apart better
than chance words would, and the identity terms, and only their occurrences
reach the driver. In every sampled text that mentions
an identity term, the term is swapped for each other one of its set; the
squared change of the logit under these swaps is a penalty on the fit, so that
a mention of a group by itself does not move a score. Every text of the table
is then scored with the whole of its words.

Edge cases: null or empty text has no words and gets the intercept's score; a
null label teaches nothing; with no labelled row every score is 0.5; several
labels of an id count as one, the largest; rows that repeat an id teach with one
text only, and each is scored; an empty table gives no rows; source, lang and ids
are not features, and other columns, whatever their names, are not read. Whole
texts count, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, long_texts_ok, per_chunk, staged
from .words import Words

SAMPLE = 12_000  # labelled texts that the fit sees, at most

#: identity terms in sets whose members can stand for each other
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees"), ("young", "old"), ("deaf", "blind", "disabled"),
)


def word_hashes(terms: Iterable[str]) -> np.ndarray:
    terms = list(terms)
    return Words(pa.array(terms), lower=True, letters=True).hash if terms else np.zeros(0, np.uint64)


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes text by text, and the n+1 offsets of the texts."""
    w = Words(texts, lower=True, letters=True)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(w.first)))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts, lower=True, letters=True)
        out = np.full(len(w.first) - 1, self.bias)
        if len(self.words) and len(w.hash):
            at = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
            hit = self.words[at] == w.hash
            pairs = np.unique(w.doc[hit] * len(self.words) + at[hit])  # a word counts once a text
            np.add.at(out, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return out


def sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, words): all distinct word hashes (binary) of the texts of a
    bounded, seeded sample of labelled ids."""
    marked = (labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull())
              .groupBy(labels["doc_id"].alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    marked = marked.where(learn(F.col("label_id")))
    # at most ``rows`` ids with a label: the bound that lets them be broadcast
    picked = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)

    def hashes(_: int, t: pa.Table) -> pa.Table:
        h, first = presence(t.column("text"))
        return pa.table({"doc_id": t.column("doc_id"), "toxic": t.column("toxic"),
                         "words": pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())})
    long_texts_ok(docs)
    joined = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(
        F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")
    found = joined.mapInArrow(per_chunk(hashes), "doc_id long, toxic int, words binary")
    # rows that repeat an id: one each, so that the bound on ids bounds rows
    return found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words"))


def _read(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all rows, and the row of each."""
    texts = [np.frombuffer(b, np.uint64) for b in t.column("words").to_pylist()]
    return (np.concatenate([np.zeros(0, np.uint64), *texts]),
            np.repeat(np.arange(len(texts)), np.array([len(x) for x in texts], np.int64)))


def vocabulary(sampled: DataFrame, terms: np.ndarray, rate: float, least: int = 3) -> np.ndarray:
    """Hashes of the words of the sample that tell the labels apart, and of the
    identity terms. A word counts by the log-likelihood gain of its own share of
    toxic texts over the share in all; it must gain more than the best of as many
    chance words would."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = _read(b)
            known, own = np.unique(words, return_inverse=True)
            toxic = b.column("toxic").to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.view(np.int64)), pa.array(np.bincount(own, minlength=len(known)).astype(np.int64)),
                 pa.array(np.bincount(own, weights=toxic[row], minlength=len(known)).astype(np.int64))],
                names=["word", "df", "pos"])

    counts = staged(sampled.select("toxic", "words").mapInArrow(count, "word long, df long, pos long")
                    .groupBy("word").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos")), "toxicity_words")
    bar = float(np.log(counts.count() + 1.0))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df, pos = b.column("df").to_numpy(), b.column("pos").to_numpy()
            own = np.clip(pos / df, 1e-9, 1 - 1e-9)
            z = pos * np.log(own / rate) + (df - pos) * np.log((1 - own) / (1 - rate))
            yield pa.RecordBatch.from_arrays([b.column("word").filter(pa.array((df >= least) & (z > bar)))], names=["word"])

    chosen = counts.mapInArrow(choose, "word long").toArrow().column("word").to_numpy().view(np.uint64)
    return np.unique(np.concatenate([chosen, terms]))


def occurrences(sampled: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, row, column): the labels in order of the ids, and the places of the
    features that are present, by row."""
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row = _read(b)
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            hit = words[at] == flat if len(words) else np.zeros(0, bool)
            cut = np.searchsorted(row[hit], np.arange(b.num_rows + 1))
            at = at[hit].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"),
                 pa.array([at[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["doc_id", "toxic", "at"])

    got = sampled.mapInArrow(hits, "doc_id long, toxic int, at binary").orderBy("doc_id").toArrow()
    at = [np.frombuffer(b, np.int32) for b in got.column("at").to_pylist()]
    row = np.repeat(np.arange(len(at)), np.array([len(x) for x in at], np.int64))
    return got.column("toxic").to_numpy().astype(np.float64), row, np.concatenate([np.zeros(0, np.int32), *at]).astype(np.int64)


def fit(words: np.ndarray, y: np.ndarray, row: np.ndarray, column: np.ndarray,
        identity: Sequence[Sequence[str]] = IDENTITY, l2: float = 1e-4, swap: float = 1.0, steps: int = 30) -> Model:
    """Fit on the features ``words`` (sorted hashes) that are present in the texts.
    ``swap`` weighs the squared change of the logit when an identity term is
    swapped for another of its set. Newton steps by conjugate gradients, so that
    memory follows the occurrences, not texts times words."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    size = len(words) + 1
    # counterfactuals: a pull between the weights of two terms by how often the one
    # is mentioned
    first, second, share = [], [], []
    mentions = np.bincount(column, minlength=size)
    for g in identity:
        cols = np.searchsorted(words, word_hashes(g))
        for a in cols:
            for b in cols:
                if a != b and mentions[a]:
                    first.append(a), second.append(b), share.append(2 * swap * mentions[a] / len(y))
    first, second, share = np.array(first, np.int64), np.array(second, np.int64), np.array(share)

    def product(w):  # logits
        return np.bincount(row, weights=w[column], minlength=len(y)) + w[-1]

    def back(v):
        out = np.bincount(column, weights=v[row], minlength=size)
        out[-1] = v.sum()
        return out

    def penalised(w):
        out = l2 * w
        out[-1] = 0.0
        change = share * (w[first] - w[second])
        return out + np.bincount(first, weights=change, minlength=size) - np.bincount(second, weights=change, minlength=size)

    def loss(w):
        z = product(w)
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * w @ penalised(w))

    w = np.zeros(size)
    w[-1] = np.log(rate / (1 - rate))
    pulled = np.bincount(first, weights=share, minlength=size) + np.bincount(second, weights=share, minlength=size)
    for _ in range(steps):  # Newton steps, halved while they don't lower the loss
        p = 1.0 / (1.0 + np.exp(-np.clip(product(w), -30, 30)))
        gradient = back(p - y) / len(y) + penalised(w)
        curve = p * (1 - p) / len(y)
        step = _solve(lambda v: back(curve * product(v)) + penalised(v) + 1e-9 * v, gradient,  # noqa: B023
                      back(curve) + l2 + pulled + 1e-9)
        size_, now = 1.0, loss(w)
        while size_ > 1e-6 and loss(w - size_ * step) > now:
            size_ /= 2
        w = w - size_ * step
        if np.abs(step).max() < 1e-6:
            break
    return Model(words, w[:-1], float(w[-1]))


def _solve(apply, right: np.ndarray, diagonal: np.ndarray, most: int = 2000, small: float = 1e-10) -> np.ndarray:
    """Conjugate gradients, scaled by the diagonal."""
    x, r = np.zeros_like(right), right.copy()
    z = r / diagonal
    d, rz, end = z.copy(), r @ z, small ** 2 * (right @ right)
    for _ in range(most):
        if r @ r <= end:
            break
        ad = apply(d)
        a = rz / (d @ ad)
        x, r = x + a * d, r - a * ad
        z = r / diagonal
        rz, before = r @ z, rz
        d = z + rz / before * d
    return x


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, **options) -> Model:
    """Fit on the bounded sample of the labelled rows that ``learn`` (a function
    of the id column; default crc32 modulo 5 not 0) lets in."""
    learn = (lambda c: fold(c, 5) != 0) if learn is None else learn
    identity = options.get("identity", IDENTITY)
    terms = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(g) for g in identity)])
    sampled = staged(sample(docs, labels, learn), "toxicity_sample")
    n, toxic = sampled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    words = vocabulary(sampled, terms, (toxic + 0.5) / (n + 1.0))
    return fit(words, *occurrences(sampled, words), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row."""
    def run(_: int, t: pa.Table) -> pa.Table:
        p = 1.0 / (1.0 + np.exp(-np.clip(model.logits(t.column("text")), -500, 500)))
        return pa.table({"doc_id": t.column("doc_id"), "score": p, "predicted": (p >= 0.5).astype(np.int32)})
    long_texts_ok(docs)
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
            .mapInArrow(per_chunk(run), "doc_id long, score double, predicted int"))
