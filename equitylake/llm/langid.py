"""Language identification by multilingual mixture inference.

Training counts byte trigrams of the words of each labelled language over the
whole training fold, in a table of fixed size. A document is a mixture: each of
its words comes from one of the languages, with the likelihood of its trigrams.
Expectation-maximisation estimates the proportions; the set of languages is the
one whose likelihood, less a penalty per language that grows with the log of
the number of words, is highest among the nested sets of the largest
proportions, from one language to all that were learned. The prediction is the largest proportion of that set.

Edge cases: null text, or text without a letter, is ``und`` with score 0; ties
go to the smaller language name; a null language teaches nothing, and if
nothing is learned all is ``und``; an empty table gives no rows. Counts cover
whole texts, however long; model size is ``TABLE`` counts a language. Other columns
are not read, or carried by position, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, long_texts_ok, per_chunk
from .words import utf8

TABLE = 1 << 16  # hashed trigrams a language
UNKNOWN = "und"
# bytes that make words: ASCII letters, and all bytes of other characters
_FOLD = np.zeros(256, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, word): the trigram code at every word byte (what lies before a
    word counts as its edge) and the number of that byte's word."""
    letters = _FOLD[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[off] = True
    one = np.zeros(len(raw), np.uint32)
    one[1:] = letters[:-1]
    one[head[:-1]] = 0
    two = np.zeros(len(raw), np.uint32)
    two[1:] = one[:-1]
    two[head[:-1] | (one == 0)] = 0
    inside = letters > 0
    start = inside & (one == 0)
    at = np.flatnonzero(inside)
    codes = (letters[at] << np.uint32(16)) | (one[at] << np.uint32(8)) | two[at]
    codes = (codes * np.uint32(2654435761)) >> np.uint32(16)
    return codes, np.cumsum(start)[at] - 1


def trigram_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """(lang, code, n) over the texts of the rows where ``learn`` holds."""
    def count(_: int, t: pa.Table) -> pa.Table:
        langs = t.column("lang").combine_chunks().dictionary_encode()
        names = langs.dictionary.to_pylist()
        which = langs.indices.to_numpy()
        raw, off = utf8(t.column("text"))
        codes, _ = trigrams(raw, off)
        per_doc = np.add.reduceat(np.concatenate([(_FOLD[raw] > 0).astype(np.int64), [0]]), off[:-1])
        per_doc[off[1:] == off[:-1]] = 0
        lang = np.repeat(which, per_doc)
        n = np.bincount(lang.astype(np.int64) * TABLE + codes, minlength=len(names) * TABLE)
        at = np.flatnonzero(n)
        return pa.table({"lang": pa.array(names, pa.string()).take(pa.array(at // TABLE)),
                         "code": (at % TABLE).astype(np.int32), "n": n[at].astype(np.int64)})

    long_texts_ok(docs)
    rows = docs.select(docs["text"].alias("text"), docs["lang"].alias("lang")).where(
        learn & docs["lang"].isNotNull() & docs["text"].isNotNull())
    return (rows.mapInArrow(per_chunk(count), "lang string, code int, n long")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, learn: Column, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-likelihood table (TABLE x languages). The
    driver gets one array of TABLE counts a language."""
    packed = (trigram_counts(docs, learn).groupBy("lang")
              .agg(F.collect_list("code").alias("code"), F.collect_list("n").alias("n"))
              .orderBy("lang").toArrow())
    langs, columns = packed.column("lang").to_pylist(), []
    for i in range(len(langs)):
        c = np.full(TABLE, float(smooth))
        c[packed.column("code")[i].values.to_numpy()] += packed.column("n")[i].values.to_numpy()
        columns.append(np.log(c / c.sum()))
    table = np.stack(columns, axis=1) if columns else np.zeros((TABLE, 0))
    return langs, table.astype(np.float32)


def mixtures(word_ll: np.ndarray, first: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM proportions and log-likelihood of each text; ``first`` are the offsets
    of its words, at least one each."""
    k = word_ll.shape[1]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    top = word_ll.max(axis=1, keepdims=True)
    rel = np.exp(word_ll - top)
    n = np.diff(first)[:, None]
    theta = np.full((len(first) - 1, k), 1.0 / k, np.float32)
    for _ in range(steps):
        joint = rel * np.maximum(theta, 1e-20)[doc]
        joint /= joint.sum(axis=1, keepdims=True)
        theta = (np.add.reduceat(joint, first[:-1], axis=0, dtype=np.float64) / n).astype(np.float32)
    ll = np.log((rel * np.maximum(theta, 1e-20)[doc]).sum(axis=1)) + top[:, 0]
    return theta, np.add.reduceat(ll, first[:-1], dtype=np.float64)


def ceiling(word_ll: np.ndarray, first: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Per text, a log-likelihood that no mixture of any set of languages exceeds:
    the words' own maxima, or the likelihood of ``theta`` with what its gradient
    can add at most (the likelihood is concave in the proportions)."""
    top = word_ll.max(axis=1, keepdims=True)
    rel = np.exp(word_ll - top)
    mixed = (rel * np.maximum(theta, 1e-20)[np.repeat(np.arange(len(theta)), np.diff(first))]).sum(axis=1)
    most = np.add.reduceat(top[:, 0], first[:-1], dtype=np.float64)
    slope = np.add.reduceat(rel / mixed[:, None], first[:-1], axis=0, dtype=np.float64).max(axis=1)
    by_slope = np.add.reduceat(np.log(mixed), first[:-1], dtype=np.float64) + most + slope - np.diff(first)
    return np.minimum(most, by_slope + 1e-3 + 1e-5 * np.diff(first))  # what single precision may lose


def select(word_ll: np.ndarray, first: np.ndarray, theta: np.ndarray, steps: int,
           penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the predicted language, its proportion and the size of the set
    that penalised likelihood selects among all nested sets. A text is left alone
    once no larger set can be worth its penalty."""
    docs, k = theta.shape
    order = np.argsort(-theta, axis=1, kind="stable")
    words = np.diff(first)
    cost = penalty * np.log(words + 1.0)
    best = np.full(docs, -np.inf)
    pred, share, size = order[:, 0].copy(), np.ones(docs), np.ones(docs, np.int64)
    bound = ceiling(word_ll, first, theta) if k > 1 else best
    left = np.arange(docs)  # texts that a set of s languages may still suit best
    for s in range(1, k + 1):
        if s > 1:
            left = left[bound[left] - s * cost[left] > best[left]]
        if not len(left):
            break
        count = words[left]
        off = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(first[left] - off[:-1], count) + np.arange(off[-1])
        sub = word_ll[at[:, None], order[np.repeat(left, count), :s]]
        if s == 1:
            part, ll = np.ones((len(left), 1)), np.add.reduceat(sub[:, 0], off[:-1], dtype=np.float64)
        else:
            part, ll = mixtures(sub, off, steps)
        value = ll - s * cost[left]
        better = value > best[left]
        won = left[better]
        best[won] = value[better]
        pred[won] = order[won, part.argmax(axis=1)[better]]
        share[won] = part.max(axis=1)[better]
        size[won] = s
    return pred, share, size


def infer(ids: pa.Array, texts: pa.Array, langs: Sequence[str], table: np.ndarray, steps: int = 6,
          penalty: float = 2.0) -> pa.Table:
    """doc_id, lang_pred, score, n_langs (size of the selected set) of a batch."""
    raw, off = utf8(texts)
    n = len(off) - 1
    pred = np.full(n, -1)
    score, size = np.zeros(n), np.zeros(n, np.int64)
    lettered = has_letter(raw, off)
    if len(raw) and len(langs):
        codes, word = trigrams(raw, off)
        inside = np.flatnonzero(_FOLD[raw])
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
        if len(begin):
            word_ll = np.add.reduceat(table[codes], begin, axis=0)
            owner = np.searchsorted(off, inside[begin], side="right") - 1
            own, first = np.unique(owner, return_index=True)
            first = np.append(first, len(begin))
            theta, _ = mixtures(word_ll, first, steps)
            pred[own], score[own], size[own] = select(word_ll, first, theta, steps, penalty)
    pred[~lettered], score[~lettered], size[~lettered] = -1, 0.0, 0
    return pa.table({"doc_id": ids, "lang_pred": pa.array([langs[p] if p >= 0 else UNKNOWN for p in pred], pa.string()),
                     "score": pa.array(np.clip(score, 0.0, 1.0)), "n_langs": pa.array(size)})


def predict(docs: DataFrame, langs: Sequence[str], table: np.ndarray, **options) -> DataFrame:
    """doc_id, lang_pred, score, n_langs for every row."""
    langs = list(langs)

    def run(_: int, t: pa.Table) -> pa.Table:
        return infer(t.column("doc_id"), t.column("text"), langs, table, **options)

    long_texts_ok(docs)
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
            .mapInArrow(per_chunk(run), "doc_id long, lang_pred string, score double, n_langs long"))


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text, whether it has a letter. Texts without an ASCII letter that have
    other characters are looked at one by one."""
    n = len(off) - 1
    if not len(raw):
        return np.zeros(n, bool)
    kinds = _FOLD[raw]
    ascii_ = np.concatenate([[0], np.cumsum((kinds > 0) & (kinds < 0x80))])
    other = np.concatenate([[0], np.cumsum(kinds >= 0x80)])
    yes = ascii_[off[1:]] > ascii_[off[:-1]]
    for i in np.flatnonzero(~yes & (other[off[1:]] > other[off[:-1]])):
        yes[i] = any(c.isalpha() for c in raw[off[i]:off[i + 1]].tobytes().decode())
    return yes


def identify(docs: DataFrame, learn: Column | None = None, **options) -> DataFrame:
    """Train on the rows of ``learn`` (default: ids whose crc32 modulo 5 is not 0)
    and predict every row."""
    learn = fold(docs["doc_id"], 5) != 0 if learn is None else learn
    return predict(docs, *train(docs, learn), **options)


def keep_identified(docs: DataFrame, learn: Column | None = None, **options) -> DataFrame:
    """The documents that are in some language, with all their columns; those
    predicted ``und`` go, which are the ones without a letter. If no language is
    learned, the documents with a letter stay too. Rows stay where they are:
    nothing is joined."""
    learn = fold(docs["doc_id"], 5) != 0 if learn is None else learn
    langs, table = train(docs, learn)
    columns = docs.columns
    inner = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(columns)])
    text, doc_id = (f"c{columns.index(c)}" for c in ("text", "doc_id"))

    def keep(_: int, t: pa.Table) -> pa.Table:
        if not langs:
            return t.filter(pa.array(has_letter(*utf8(t.column(text)))))
        got = infer(t.column(doc_id), t.column(text), langs, table, **options)
        return t.filter(pc.not_equal(got.column("lang_pred"), UNKNOWN))

    long_texts_ok(docs)
    kept = inner.mapInArrow(per_chunk(keep, text), inner.schema)
    return kept.select(*[kept[f"c{k}"].alias(c) for k, c in enumerate(columns)])
