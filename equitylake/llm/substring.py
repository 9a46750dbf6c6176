"""Substring dedup: removal of passages that a document with a smaller id has.

A window is ``width`` consecutive words of one document. Every word that lies in
a window whose word sequence also starts in a document with a smaller id goes.

1. Documents are written once as chunks of text, in a table bucketed by chunk.
2. Each window has a minimiser: its run of ``k`` words with the least hash.
   Equal windows have equal minimisers, and neighbouring windows mostly share
   theirs, so a quarter as many keys tell which places may recur.
3. Segments (the consecutive windows of one minimiser) whose minimiser occurs in
   several documents are dealt to shards by that minimiser, distinct ones once a
   chunk. A minimiser with more than ``HOT`` distinct segments a chunk is a phrase
   among ever different words: its windows are dealt one by one, by their own
   hashes, so that no shard grows with one phrase. A shard confirms the
   recurring windows, compiles them into an Aho-Corasick automaton, one symbol a
   word, and streams all its segments through it. Every occurrence found carries
   the smallest id of its window.
4. The answers return to the chunks, which mark the covered words.

Words are compared by 64-bit hashes, 13 of them in a row for a match.

Edge cases: null or empty text has no words; a document shorter than a window
keeps all its words; a null id counts as larger than all others, and equal ids
(repeated rows) are not smaller than each other; an empty table gives no rows.
A very long text is a chunk of its own, searched whole; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, long_texts_ok, n_partitions, staged_by
from .exchange import answers, bucket_of, cuts, joined, requests, whole, with_answers
from .words import Words, mix, run_hash, run_starts, span_hash

WIDTH = 13
HOT = 2  # distinct segments of a minimiser, a chunk, above which its windows are dealt singly
HOT_LEAST = 64  # and in all
NO_ID = np.iinfo(np.int64).max
CHUNK = "chunk long, ids array<long>, texts array<string>"


def chunked(docs: DataFrame, name: str, rest: Sequence[str] = ()) -> DataFrame:
    """(chunk, ids, texts), bucketed by chunk; with ``rest``, these columns too,
    as an array of structs with the fields c0, c1, ..."""
    columns = ["id", "text"] + ["rest"] * bool(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, t in chunks(batches):
            one = np.array([0, t.num_rows], np.int32)
            lists = [pa.ListArray.from_arrays(one, t.column(c).combine_chunks()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists],
                                             names=["chunk", "ids", "texts", "rest"][:len(lists) + 1])
    long_texts_ok(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"), *(
        [F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(rest)]).alias("rest")] if rest else []))
    kind = rows.schema["rest"].dataType.simpleString() if rest else ""
    return staged_by(rows.mapInArrow(run, CHUNK + (f", rest array<{kind}>" if rest else "")), name, "chunk")


def each_chunk(fn):
    """A function for ``mapInArrow`` over chunk rows: fn(row) gives a table, an
    iterator of tables, or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = fn({c: b.column(c)[i] for c in b.schema.names})
                for t in () if out is None else (out,) if isinstance(out, pa.Table) else out:
                    yield from t.to_batches()
    return run


class Segments:
    """The segments of a chunk's texts: ``start`` (first word), ``windows``
    (their number) and ``key`` (minimiser), in order of start."""

    def __init__(self, words: Words, ids: pa.Array, width: int = WIDTH, k: int = 6):
        self.words, self.width = words, width
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(words.hash) - width + 1
        valid = np.flatnonzero(run_starts(words.first, len(words.hash), width)) if n > 0 else np.zeros(0, np.int64)
        if not len(valid):
            self.start = self.windows = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = run_hash(words.hash, k)
        least, at = grams[:n].copy(), np.arange(n)
        for o in range(1, width - k + 1):
            lower = grams[o:o + n] < least
            least[lower] = grams[o:o + n][lower]
            at[lower] = np.flatnonzero(lower) + o
        a = at[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (valid[1:] != valid[:-1] + 1) | (a[1:] != a[:-1])
        first = np.flatnonzero(new)
        self.start = valid[first]
        self.windows = np.diff(np.append(first, len(valid)))
        self.key = mix(least[self.start])  # least hashes are small ones: mixed, keys spread evenly
        self.doc = words.doc[self.start]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimisers, and the index of every segment's own."""
        return np.unique(self.key, return_inverse=True)

    def held(self, n_keys: int, own: np.ndarray) -> np.ndarray:
        """Per minimiser, the number of its distinct segments in the chunk (127: or
        more), plus 128 if several ids of the chunk hold it."""
        owner = self.ids[self.doc]
        low, high = np.full(n_keys, NO_ID), np.full(n_keys, -NO_ID)
        np.minimum.at(low, own, owner)
        np.maximum.at(high, own, owner)
        end = self.start + self.windows + self.width - 1
        pair = np.unique(span_hash(self.words.hash, self.start, end) ^ mix(self.key), return_index=True)[1]
        count = np.minimum(np.bincount(own[pair], minlength=n_keys), 127)
        return (count + 128 * (low != high)).astype(np.uint8)

    def distinct(self, which: np.ndarray, shards: int) -> "Distinct":
        """The segments dealt: ``which`` is 0 for those of minimisers that don't
        recur, 2 for those whose windows are dealt singly."""
        return Distinct(self, which, shards)


class Distinct:
    """The distinct segments among those picked, by shard and then by hash. ``at``,
    ``windows`` and ``doc``: first word, windows and document of every one picked."""

    def __init__(self, s: Segments, which: np.ndarray, shards: int):
        plain, hot = np.flatnonzero(which == 1), np.flatnonzero(which == 2)
        single = spread(s.start[hot], s.windows[hot])
        self.at = start = np.concatenate([s.start[plain], single])
        self.windows = np.concatenate([s.windows[plain], np.ones(len(single), np.int64)])
        self.doc = np.concatenate([s.doc[plain], np.repeat(s.doc[hot], s.windows[hot])])
        size = self.windows + s.width - 1
        h = span_hash(s.words.hash, start, start + size)
        shard = bucket_of(np.concatenate([s.key[plain], mix(h[len(plain):])]), shards)
        order = np.lexsort((h, shard))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        self.own = np.empty(len(order), np.int64)  # picked -> distinct
        self.own[order] = np.cumsum(new) - 1
        first = order[new]
        self.start, self.size = start[first], size[first]
        self.shards, self.cuts = cuts(shard[first])
        ids = s.ids[self.doc][order]
        at = np.flatnonzero(new)
        self.low = np.minimum.reduceat(ids, at) if len(at) else ids
        self.high = np.maximum.reduceat(ids, at) if len(at) else ids


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every span, one after the other."""
    off = np.cumsum(size) - size
    return np.repeat(start - off, size) + np.arange(int(size.sum()))


def _read(row: dict) -> tuple[Words, pa.Array]:
    return Words(row["texts"].values), row["ids"].values


SYMBOLS = 1 << 20  # words that one symbol tells apart; a shard with more takes two a word


PASSAGES = 64  # of an automaton, about


def _symbols(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Word hashes as code points (surrogates skipped), one or two a word. The
    two come from disjoint ranges, so a match can't start between them."""
    known, codes = np.unique(words, return_inverse=True)
    codes = codes.astype(np.uint32)
    if len(known) > SYMBOLS:
        codes = np.stack([codes >> np.uint32(16), (codes & np.uint32(0xFFFF)) + np.uint32(1 << 17)], axis=1).ravel()
    codes += 1
    codes[codes >= 0xD800] += np.uint32(0x800)
    return codes, 2 if len(known) > SYMBOLS else 1


def locate(words: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray,
           width: int = WIDTH, k: int = 6) -> np.ndarray:
    """For every window of the segments (``size`` words each, one after the
    other), the smallest id of a document that holds its word sequence, or NO_ID
    if only one does. ``low`` and ``high`` are the least and greatest id that a
    segment occurs with.

    Equal segments are looked at once. The passages, runs of windows that recur
    with the same smallest id, are compiled into automata, and the segments that
    hold any are streamed through them to locate every occurrence. Segments that
    may share a passage have the same minimiser, so a shard is split further by
    minimiser into automata of about ``PASSAGES`` passages: small ones have few
    branches at the root, where an automaton is slowest."""
    if not len(size):
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    _, one, same = np.unique(span_hash(words, first, first + size), return_index=True, return_inverse=True)
    grams = run_hash(words, k)
    key = np.min([grams[first[one] + o] for o in range(width - k + 1)], axis=0)
    order = np.argsort(key, kind="stable")
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    one, same, key = one[order], place[same], key[order]
    least, most = np.full(len(one), NO_ID), np.full(len(one), -NO_ID)
    np.minimum.at(least, same, low)
    np.maximum.at(most, same, high)
    found = _located(words[spread(first[one], size[one])], size[one], least, most, key, width)
    windows = size[one] - width + 1
    return found[spread((np.cumsum(windows) - windows)[same], windows[same])]


def _located(words: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray,
             key: np.ndarray, width: int) -> np.ndarray:
    import ahocorasick
    windows = size - width + 1
    first = np.cumsum(size) - size
    at = spread(first, windows)  # word where each window starts
    owner = np.repeat(np.arange(len(size)), windows)
    found = np.full(len(at), NO_ID)
    # confirm: the least id of each distinct window, and whether another has it too
    _, own = np.unique(run_hash(words, width)[at], return_inverse=True)
    least, most = np.full(own.max() + 1, NO_ID), np.full(own.max() + 1, -NO_ID)
    np.minimum.at(least, own, low[owner])
    np.maximum.at(most, own, high[owner])
    recurs = (least < most)[own]
    if not recurs.any():
        return found
    # passages: consecutive recurring windows of a segment with the same least id
    value = least[own]
    r = np.flatnonzero(recurs)
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1] + 1) | (owner[r][1:] != owner[r][:-1]) | (value[r][1:] != value[r][:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(r))) + width - 1
    start = at[r[head]]
    _, distinct = np.unique(span_hash(words, start, start + length), return_index=True)
    distinct.sort()
    start, length, holder, value = (x[distinct] for x in (start, length, owner[r[head]], value[r[head]]))
    # the segments that hold a passage, with a character between them that none has
    streamed = np.unique(owner[r])
    codes, per = _symbols(words)
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    part = size[streamed] * per
    gap = np.zeros(int(part.sum()) + len(part), "<u4")
    begin = np.cumsum(part + 1) - part - 1
    gap[spread(begin, part)] = codes[spread(first[streamed] * per, part)]
    window = np.full(len(gap), -1)
    mine = windows[streamed]
    window[spread(begin, mine * per)[::per] if per > 1 else spread(begin, mine)] = spread(
        (np.cumsum(windows) - windows)[streamed], mine)
    stream = gap.tobytes().decode("utf-32-le")
    # batches: whole minimisers, about PASSAGES passages each
    edges = np.flatnonzero(np.concatenate([[True], key[holder][1:] != key[holder][:-1]]))
    edges = edges[np.concatenate([[True], np.diff(edges // PASSAGES) > 0])]
    to = np.append(np.searchsorted(key[streamed], key[holder[edges]]), len(streamed))
    borders = np.append(begin, len(gap))[to].tolist()
    edges = np.append(edges, len(start)).tolist()
    froms, ends = (start * per).tolist(), ((start + length) * per).tolist()
    for a, b, x, y in zip(edges[:-1], edges[1:], borders[:-1], borders[1:]):
        automaton = ahocorasick.Automaton()
        for i in range(a, b):
            automaton.add_word(text[froms[i]:ends[i]], i)
        automaton.make_automaton()
        hits = list(automaton.iter(stream[x:y]))
        which = np.array([i for _, i in hits], np.int64)
        end = np.array([e for e, _ in hits], np.int64) + x
        covered = length[which] - width + 1
        found[spread(window[end - length[which] * per + 1], covered)] = np.repeat(value[which], covered)
    return found


def dedup(docs: DataFrame, width: int = WIDTH, k: int = 6, shards: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (the removed runs of words
    as start:end, comma-joined), one row per document."""
    spark = docs.sparkSession
    held = chunked(docs, "substring")
    n_chunks = held.count()
    n = max(n_partitions(spark), 16, n_chunks // 4)
    shards = shards or max(4 * n, n_chunks)
    hot = max(HOT * n_chunks, HOT_LEAST)

    def ask(row: dict) -> pa.Table:
        words, ids = _read(row)
        s = Segments(words, ids, width, k)
        keys, own = s.keys()
        return requests(row["chunk"].as_py(), *cuts(bucket_of(keys, n)), keys=keys, held=s.held(len(keys), own))

    def recur(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        keys, off = joined(t, "keys", np.uint64)
        held, _ = joined(t, "held", np.uint8)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        head = np.flatnonzero(new)
        many = np.logical_or.reduceat(held[order] >= 128, head) | (np.diff(np.append(head, len(order))) > 1)
        segments = np.add.reduceat(held[order].astype(np.int64) & 127, head)
        bits = np.empty(len(order), np.uint8)
        bits[order] = (many * np.where(segments > hot, 2, 1))[np.cumsum(new) - 1]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"),
                         "bits": pa.array([bits[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())})

    def deal(row: dict) -> pa.Table:
        words, ids = _read(row)
        s = Segments(words, ids, width, k)
        d = s.distinct(whole(row["bits"].as_py(), np.uint8)[s.keys()[1]], shards)
        ends = np.concatenate([[0], np.cumsum(d.size)])
        off = {c: d.cuts for c in ("size", "low", "high")} | {"words": ends[d.cuts]}
        return requests(row["chunk"].as_py(), d.shards, off, size=d.size.astype(np.uint32), low=d.low, high=d.high,
                        words=words.hash[spread(d.start, d.size)])

    def confirm(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        size, off = joined(t, "size", np.uint32)
        size = size.astype(np.int64)
        found = locate(joined(t, "words", np.uint64)[0], size, joined(t, "low", np.int64)[0],
                       joined(t, "high", np.int64)[0], width, k)
        ends = np.concatenate([[0], np.cumsum(size - width + 1)])[off]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"),
                         "least": pa.array([found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    def cut(row: dict) -> pa.Table:
        words, ids = _read(row)
        s = Segments(words, ids, width, k)
        d = s.distinct(whole(row["bits"].as_py(), np.uint8)[s.keys()[1]], shards)
        least = whole(row["least"].as_py(), np.int64)
        per = d.size - width + 1
        value = least[spread((np.cumsum(per) - per)[d.own], d.windows)]
        start = spread(d.at, d.windows)
        start = start[value < np.repeat(s.ids[d.doc], d.windows)]
        cover = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        return _result(words, ids, gone)

    ask_schema = "bucket int, chunk long, keys binary, held binary"
    long_texts_ok(docs)
    bits = (held.mapInArrow(each_chunk(ask), ask_schema)
            .groupBy("bucket").applyInArrow(recur, "chunk long, bucket int, bits binary"))
    held = staged_bits(held, bits)
    least = (held.mapInArrow(each_chunk(deal), "bucket int, chunk long, size binary, low binary, high binary, words binary")
             .groupBy("bucket").applyInArrow(confirm, "chunk long, bucket int, least binary"))
    return with_answers(held, answers(least, "least")).mapInArrow(
        each_chunk(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string")


def staged_bits(held: DataFrame, bits: DataFrame) -> DataFrame:
    """Chunks with the answers on their minimisers, which are written as they
    are read twice."""
    got = staged_by(answers(bits, "bits"), "substring_bits", "chunk")
    return with_answers(held, got)


def _result(words: Words, ids: pa.Array, gone: np.ndarray) -> pa.Table:
    n = len(words.first) - 1
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[words.first[1:]] - before[words.first[:-1]]
    raw, off = words.raw, words.offsets
    sha, spans = [], []
    for i in range(n):
        kept = raw[off[i]:off[i + 1]].tobytes().split()
        span = ""
        if removed[i]:
            mask = gone[words.first[i]:words.first[i + 1]]
            kept = compress(kept, (~mask).tolist())
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            span = ",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2]))
        sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        spans.append(span)
    return pa.table({"doc_id": ids, "n_words": np.diff(words.first).astype(np.int64),
                     "n_removed": removed.astype(np.int64), "kept_sha256": sha, "spans": spans})
