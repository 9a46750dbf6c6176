"""Language-model scores from a weighted backoff automaton of word bigrams.

Unigrams are smoothed additively, p(w) = (c(w) + a) / (N + a (V + 1)). Bigrams
are smoothed towards them, p(w | h) = (c(h w) + m p(w)) / (c(h) + m), which sums
to one for every context. As an automaton: the root has an arc for every word;
every word is a state; a seen bigram is an arc from its first word's state; and
a failure arc with weight m / (c(h) + m) leads from a state to the root. A text
is read left to right from the start state; each word takes its arc, or the
failure arc and then the root's, and the log-probabilities add up.

Counts are of the whole training fold and never meet in one place. Documents
are written once as chunks; a chunk asks the buckets of the hash range for the
counts of its distinct words, then for those of its bigrams, and compiles the
part of the automaton that its texts can reach. A bigram with a word that only
one chunk holds is counted there and not sent. Words are known by 64-bit hashes.

Edge cases: null or empty text is the end token alone; null ids fold like ''
(held out); with no training document every probability is the smoothed one of
an unseen word; repeated rows count and are scored like others; an empty table
gives no rows. A very long text is a chunk of its own, read whole; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, long_texts_ok, n_partitions, staged_by
from .exchange import answers, bucket_of, cuts, joined, requests, whole, with_answers
from .substring import chunked, each_chunk
from .words import Words, mix

START, END = np.uint64(0x5A5A5A5A5A5A5A01), np.uint64(0x5A5A5A5A5A5A5A02)
FOLDS = 10


class Tokens:
    """The tokens of a chunk: ``token`` (its word hashes, each text's followed by
    END), ``context`` (the token before, START at a text's beginning), ``train``
    (whether the text is of the training fold) and ``first`` (n+1 offsets)."""

    def __init__(self, row: dict):
        ids = row["ids"].values
        words = Words(row["texts"].values, lower=True)
        n = len(words.first) - 1
        self.ids = ids
        self.held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0
                              for i in ids.to_pylist()], bool)
        self.first = words.first + np.arange(n + 1)
        self.token = np.insert(words.hash, words.first[1:], END)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first[:-1]] = START
        self.train = np.repeat(~self.held, np.diff(self.first))
        self.size = np.diff(self.first)


class Bigrams:
    """The bigrams of a chunk: its distinct words' counts and, of its distinct
    bigrams, which are counted here (``here``) and which must be asked for."""

    def __init__(self, t: Tokens, counts: np.ndarray, alone: np.ndarray):
        self.words, self.token = np.unique(t.token, return_inverse=True)
        self.counts = counts
        before = np.concatenate([[0], self.token[:-1] + 1])
        before[t.first[:-1]] = 0  # state 0: START; state i + 1: word i
        self.state = before
        own = np.concatenate([[False], alone])
        pair = before.astype(np.uint64) << np.uint64(32) | self.token.astype(np.uint64)
        self.pairs, index = np.unique(pair, return_inverse=True)
        self.index = index
        self.local = np.bincount(index[t.train], minlength=len(self.pairs))
        state = (self.pairs >> np.uint64(32)).astype(np.int64)
        word = (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.here = own[state] | alone[word]
        far = ~self.here
        h = np.concatenate([[START], self.words])
        keys = mix(h[state[far]] * np.uint64(0x9E3779B97F4A7C15) + self.words[word[far]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.far = keys[order], np.flatnonzero(far)[order]


class Automaton:
    """``arcs``: sorted state << 32 | word of the seen bigrams with their log10
    weights; ``fail``: of each state's failure arc; ``root``: of the root's arcs.
    After a word the automaton is in that word's state."""

    def __init__(self, arcs: np.ndarray, weights: np.ndarray, fail: np.ndarray, root: np.ndarray):
        self.arcs, self.weights, self.fail, self.root = arcs, weights, fail, root

    def traverse(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log10 weight of reading ``word`` in ``state``."""
        out = self.fail[state] + self.root[word]
        if len(self.arcs):
            key = state.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            out[hit] = self.weights[at[hit]]
        return out


def compiled(b: Bigrams, pair_counts: np.ndarray, docs: int, total: int, kinds: int,
             add: float, prior: float) -> tuple[Automaton, np.ndarray]:
    """The automaton of a chunk, and the root's log10 weights."""
    p = (b.counts + add) / (total + add * (kinds + 1))
    context = np.concatenate([[docs], b.counts]).astype(np.float64)
    root = np.log10(p)
    fail = np.log10(prior / (context + prior))
    seen = pair_counts > 0
    arcs = b.pairs[seen]
    state = (arcs >> np.uint64(32)).astype(np.int64)
    word = (arcs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    weights = np.log10((pair_counts[seen] + prior * p[word]) / (context[state] + prior))
    return Automaton(arcs, weights, fail, root), root


def score(docs: DataFrame, add: float = 0.1, prior: float = 20.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``prior`` (m) is how many observations the unigrams are worth in a context."""
    spark = docs.sparkSession
    train_docs = docs.where(fold(docs["doc_id"], FOLDS) != 0).count()
    held = chunked(docs, "lm")
    n = max(n_partitions(spark), 16, held.count() // 2)

    def ask_words(row: dict) -> pa.Table:
        t = Tokens(row)
        keys, index = np.unique(t.token, return_inverse=True)
        counts = np.bincount(index[t.train], minlength=len(keys)).astype(np.uint32)
        return requests(row["chunk"].as_py(), *cuts(bucket_of(keys, n)), keys=keys, counts=counts)

    def total(t: pa.Table):
        """Summed counts in request order, requesting chunks, offsets, and of
        the distinct keys their totals."""
        keys, off = joined(t, "keys", np.uint64)
        counts, _ = joined(t, "counts", np.uint32)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        head = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order].astype(np.int64), head)
        asked = np.diff(np.append(head, len(order)))
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(new) - 1
        return sums[own], asked[own], off, sums

    def answer_words(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        got, asked, off, sums = total(t)
        rest = np.zeros(t.num_rows - 1, np.int64)
        return pa.table({
            "chunk": t.column("chunk"), "bucket": t.column("bucket"),
            "counts": pa.array([got[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary()),
            "alone": pa.array([(asked[a:b] == 1).tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary()),
            "tokens": np.append(sums.sum(), rest), "kinds": np.append((sums > 0).sum(), rest)})

    def bigrams(row: dict) -> tuple[Tokens, Bigrams]:
        t = Tokens(row)
        return t, Bigrams(t, whole(row["counts"].as_py(), np.int64), whole(row["alone"].as_py(), np.bool_))

    def ask_bigrams(row: dict) -> pa.Table:
        b = bigrams(row)[1]
        return requests(row["chunk"].as_py(), *cuts(bucket_of(b.keys, n)), keys=b.keys,
                        counts=b.local[b.far].astype(np.uint32))

    def answer_bigrams(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        got, _, off, _ = total(t)
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"),
                         "pairs": pa.array([got[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())})

    def read(row: dict) -> pa.Table:
        t, b = bigrams(row)
        counts = b.local.copy()
        counts[b.far] = whole(row["pairs"].as_py(), np.int64)
        automaton, root = compiled(b, counts, train_docs, tokens, kinds, add, prior)
        summed = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every text has its END
        return pa.table({
            "doc_id": t.ids, "held_out": t.held, "n_tokens": t.size.astype(np.int64),
            "n_known": summed((b.counts > 0)[b.token].astype(np.int64)),
            "train_tokens": np.full(len(t.size), tokens, np.int64),
            "base_score": summed(root[b.token]), "score": summed(automaton.traverse(b.state, b.token))})

    long_texts_ok(docs)
    asked = held.mapInArrow(each_chunk(ask_words), "bucket int, chunk long, keys binary, counts binary")
    words = staged_by(asked.groupBy("bucket").applyInArrow(
        answer_words, "chunk long, bucket int, counts binary, alone binary, tokens long, kinds long"),
        "lm_words", "chunk")
    tokens, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    held = with_answers(held, answers(words, "counts", "alone"))
    pairs = (held.mapInArrow(each_chunk(ask_bigrams), "bucket int, chunk long, keys binary, counts binary")
             .groupBy("bucket").applyInArrow(answer_bigrams, "chunk long, bucket int, pairs binary"))
    return with_answers(held, answers(pairs, "pairs")).mapInArrow(
        each_chunk(read), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                          "base_score double, score double")
