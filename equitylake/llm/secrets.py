"""Secret scan: fixed patterns, and character Markov models on top.

Patterns find assigned credentials, access keys and long hex runs. The labelled
samples of the models come from them: the values the patterns found are random
strings, every other run of word characters is ordinary text. Both give counts
of character pairs over the whole corpus, two smoothed transition tables, and a
log-likelihood ratio for any stretch of characters. In a long run of word
characters that no pattern touches, the stretch with the highest ratio (a maximum
subarray over its transitions) is a secret if that is high enough in total and a
character; it is reported up to the separators or edges around it.

Spans are ``kind:start:end`` in code points, end exclusive. Overlaps of
different kinds stay, as the patterns are applied one by one.

Edge cases: null or empty text has no spans; without any labelled value the
random model is the smoothed uniform one; an empty table gives no rows; other
columns are not read. The tables have a fixed size, whatever the input. A text costs in
proportion to its length, however many spans it has; ``redacted`` carries other
columns by position, so no name can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_texts_ok, per_chunk
from .words import utf8

# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: characters of a run that the models see; class 0 is anything else, the run's edge
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N_CLASS = len(RUN) + 1
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(RUN)] = np.arange(1, N_CLASS)
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_JOINS = np.zeros(256, bool)  # characters of a run that join words
_JOINS[list(b"+/_=-")] = True


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind number, end) of the base spans, and the spans of the values."""
    found, values = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_ASSIGN:
            found.append((m.start(), 0, m.end()))
            values.append(m.span(2))
    for k, pattern, least in ((1, ACCESS, MIN_ACCESS), (2, HEX, MIN_HEX)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                found.append((m.start(), k, m.end()))
                values.append(m.span())
    return sorted(found), values


def runs_of(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes in one text each."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros(len(mask) + 1, bool)
    head[off] = True
    start = mask & head[:-1]
    start[1:] |= mask[1:] & ~mask[:-1]
    end = mask & head[1:]
    end[:-1] |= mask[:-1] & ~mask[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = e - s >= least
    return s[long], e[long]


class Scan:
    """Base spans of a batch of texts. Whole-batch byte tests pick the texts on
    which a pattern can match at all; only those are searched with it."""

    def __init__(self, texts: pa.Array):
        self.raw, self.off = utf8(texts)
        raw, off = self.raw, self.off
        self.n = len(off) - 1
        hit = set()
        hex_starts, _ = runs_of(_HEX[raw], off, MIN_HEX)
        hit.update(np.unique(np.searchsorted(off, hex_starts, side="right") - 1).tolist())
        whole, lower = raw.tobytes(), raw.tobytes().lower()
        for data, words in ((lower, _ASSIGN_WORDS), (whole, (b"AKIA",))):
            for w in words:
                at = data.find(w)
                while at >= 0:
                    hit.add(int(np.searchsorted(off, at, side="right")) - 1)
                    at = data.find(w, at + 1)
        self.base: dict[int, list[tuple[int, int, int]]] = {}
        self.values: list[tuple[int, int]] = []  # in bytes of the batch
        self.taken: list[tuple[int, int]] = []
        for i in sorted(hit):
            data = whole[off[i]:off[i + 1]]
            text = data.decode()
            spans, values = base_spans(text)
            if spans:
                self.base[i] = spans
                at = self.bytes_of(i, len(text))
                self.values += [(at(a), at(b)) for a, b in values]
                self.taken += [(at(a), at(b)) for a, _, b in spans]

    def bytes_of(self, i: int, length: int):
        """From code points of text i (``length`` of them) to bytes of the batch."""
        low, high = int(self.off[i]), int(self.off[i + 1])
        if length == high - low:
            return lambda p: low + p
        place = np.append(np.flatnonzero((self.raw[low:high] & 0xC0) != 0x80), high - low) + low
        return lambda p: int(place[p])

    def code_points(self) -> np.ndarray:
        """Code points of the batch before each byte."""
        return np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])

    def classes(self) -> np.ndarray:
        return _CLASS[self.raw]


def _pairs(classes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code of the class pair (before, at) for every byte and one past the end;
    a text's edge counts as class 0. Length len(classes) + 1."""
    before = np.zeros(len(classes) + 1, np.int32)
    before[1:] = classes
    before[off] = 0
    at = np.zeros(len(classes) + 1, np.int32)
    at[:-1] = classes
    return before * N_CLASS + at


def pair_counts(docs: DataFrame) -> DataFrame:
    """(model, pair, n): counts of class pairs over all texts; model 1 is of the
    labelled random strings, model 0 of everything else."""
    def count(_: int, t: pa.Table) -> pa.Table:
        s = Scan(t.column("text"))
        codes = _pairs(s.classes(), s.off)
        secret = np.zeros(len(codes), bool)
        other = np.zeros(len(codes), bool)
        for a, b in s.values:
            secret[a:b] = True
        for a, b in s.taken:
            other[a:b + 1] = True
        tables = (np.bincount(codes[~secret & ~other], minlength=N_CLASS ** 2),
                  np.bincount(codes[secret], minlength=N_CLASS ** 2))
        rows = [(m, np.flatnonzero(c), c) for m, c in enumerate(tables)]
        return pa.table({"model": np.concatenate([np.full(len(i), m, np.int32) for m, i, _ in rows]),
                         "pair": np.concatenate([i for _, i, _ in rows]).astype(np.int32),
                         "n": np.concatenate([c[i] for _, i, c in rows]).astype(np.int64)})

    long_texts_ok(docs)
    return (docs.select(docs["text"].alias("text")).mapInArrow(per_chunk(count), "model int, pair int, n long")
            .groupBy("model", "pair").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, prior: float = 500.0) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of every class pair; at most
    2 * 68**2 counts reach the driver. A transition is smoothed towards the
    character's own frequency, worth ``prior`` observations. Pairs with the edge
    class are neutral."""
    counts = np.zeros((2, N_CLASS ** 2))
    for r in pair_counts(docs).collect():
        counts[r["model"], r["pair"]] += r["n"]
    counts = counts.reshape(2, N_CLASS, N_CLASS)[:, 1:, 1:]
    single = counts.sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    log = np.log((counts + prior * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + prior))
    ratio = np.zeros((N_CLASS, N_CLASS))
    ratio[1:, 1:] = log[1] - log[0]
    return ratio.ravel()


def scan(docs: DataFrame, ratio: np.ndarray | None = None, **limits) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    ratio = train(docs) if ratio is None else ratio
    names = ["n_assign", "n_access", "n_hex", "n_markov"]

    def find(_: int, t: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in [*names, "base_sha256", "spans"]}
        for base, spans in spans_of(t.column("text"), ratio, **limits):
            for kind, c in enumerate(names):
                out[c].append(sum(k == kind for _, k, _ in spans))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(spans))
        return pa.table({"doc_id": t.column("doc_id")} | {
            c: pa.array(v, pa.int64() if c in names else pa.string()) for c, v in out.items()})

    long_texts_ok(docs)
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
            .mapInArrow(per_chunk(find), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, "
                                         "base_sha256 string, spans string"))


def redacted(docs: DataFrame, ratio: np.ndarray | None = None, mark: str = "[REDACTED]", **limits) -> DataFrame:
    """All documents with all columns, every span in ``text`` replaced by
    ``mark``; a column ``n_chars`` follows where the text changes."""
    ratio = train(docs) if ratio is None else ratio
    columns = docs.columns
    inner = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(columns)])
    at = columns.index("text")
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def clean(_: int, t: pa.Table) -> pa.Table:
        whole, changed = t.column(at).to_pylist(), {}
        for i, (_, spans) in enumerate(spans_of(t.column(at), ratio, **limits)):
            if spans:
                changed[i] = whole[i] = redact(whole[i], spans, mark)
        t = t.set_column(at, t.schema.field(at), pa.array(whole, t.schema.field(at).type))
        if chars is not None and changed:
            n = t.column(chars).to_pylist()
            for i, text in changed.items():
                n[i] = len(text)
            t = t.set_column(chars, t.schema.field(chars), pa.array(n, t.schema.field(chars).type))
        return t

    long_texts_ok(docs)
    out = inner.mapInArrow(per_chunk(clean, f"c{at}"), inner.schema)
    return out.select(*[out[f"c{k}"].alias(c) for k, c in enumerate(columns)])


def spans_of(texts: pa.Array, ratio: np.ndarray, min_length: int = 16, per_char: float = 0.5,
             total: float = 16.0) -> Iterator[tuple[list, list]]:
    """The base spans and all spans of each text, in order."""
    s = Scan(texts)
    added = _markov(s, ratio, min_length, per_char, total)
    for i in range(s.n):
        base = s.base.get(i, [])
        yield base, sorted(base + added.get(i, []))


def _markov(s: Scan, ratio: np.ndarray, min_length: int, per_char: float,
            total: float) -> dict[int, list[tuple[int, int, int]]]:
    """Spans by text that the models add: of each run clear of every base span, the
    best-scoring stretch of at least ``min_length`` characters."""
    raw, off = s.raw, s.off
    classes = s.classes()
    a, b = runs_of(classes > 0, off, min_length)
    taken = np.zeros(len(raw) + 1, np.int64)
    for x, y in s.taken:
        taken[x] += 1
        taken[y] -= 1
    busy = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
    clear = busy[b] == busy[a]
    a, b = a[clear], b[clear]
    if not len(a):
        return {}
    # a stretch x..y scores llr[y] - llr[x + 1]: the pair that enters it doesn't count
    llr = np.concatenate([[0.0], np.cumsum(ratio[_pairs(classes, off)[:-1]])])
    n = b - a - min_length + 1  # places where a stretch may start
    first = np.cumsum(n) - n
    x = np.repeat(a - first, n) + np.arange(int(n.sum()))
    origin = np.repeat(llr[a + 1], n)
    low = llr[x + 1] - origin
    # the least start up to each place: one running minimum, each run far below the last
    level = np.repeat(np.arange(len(a)), n) * (2 * np.abs(low).max() + 1)
    least = np.minimum.accumulate(low - level) + level
    gain = llr[x + min_length] - origin - least
    best = np.maximum.reduceat(gain, first)
    found: dict[int, list[tuple[int, int, int]]] = {}
    chosen = np.flatnonzero(best >= total)
    points = s.code_points() if len(chosen) else None
    for r in chosen.tolist():
        mine = slice(first[r], first[r] + n[r])
        k = int(gain[mine].argmax())
        start, end = int(a[r] + low[mine][:k + 1].argmin()), int(a[r] + k + min_length)
        if best[r] < per_char * (end - start):
            continue
        while start < end and _JOINS[raw[start]]:  # a join at its edge is not part of it
            start += 1
        while end > start and _JOINS[raw[end - 1]]:
            end -= 1
        joins = np.flatnonzero(_JOINS[raw[a[r]:b[r]]]) + a[r]
        before, after = joins[joins < start], joins[joins >= end]
        if start == end:
            continue
        start, end = int(before[-1]) + 1 if len(before) else int(a[r]), int(after[0]) if len(after) else int(b[r])
        i = int(np.searchsorted(off, start, side="right")) - 1
        found.setdefault(i, []).append((int(points[start] - points[off[i]]), 3, int(points[end] - points[off[i]])))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
