"""Vectorised word tables: every word of a batch of texts as a 64-bit hash.

Words are the maximal runs of characters other than space and U+0009 to
U+000D. Those are ASCII, so words can be cut in the UTF-8 bytes, and an Arrow
string column already holds the bytes of a whole batch side by side. Hashes
come from prefix sums of a polynomial over the bytes, so no Python runs per
word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)  # letter runs: ASCII letters and all bytes beyond ASCII
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


BLOCK = 1 << 19  # bytes


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier (``up``) or its inverse (``down``)."""
    have = _powers[which]
    if len(have) < n:
        base = _ODD if which == "up" else _ODD_INV
        size = -(-n // BLOCK) * BLOCK
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (nulls as empty) and its n+1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch of texts.

    ``hash``: 64-bit hash of each word, in order; ``doc``: index of its text;
    ``start``/``end``: its bytes in ``raw``; ``first``: n+1 word offsets, so
    text i has the words ``first[i]:first[i + 1]``. ``lower`` hashes A-Z as a-z;
    ``letters`` takes runs of letters for words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, letters: bool = False):
        self.raw, self.offsets = utf8(texts)
        raw, off = self.raw, self.offsets
        n = len(off) - 1
        if not len(raw):
            self.hash = np.zeros(0, np.uint64)
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(n + 1, np.int64)
            self.doc = np.zeros(0, np.int64)
            return
        inside = _LETTER[raw] if letters else ~_SPACE[raw]
        head = np.zeros(len(raw) + 1, bool)  # a text begins here
        head[off] = True
        before = np.empty(len(raw), bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | head[:-1]))
        after = np.empty(len(raw), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | head[1:])) + 1
        self.hash = np.empty(len(start), np.uint64)
        table = _BYTE_LOWER if lower else _BYTE
        # words of about BLOCK bytes at a time: the sums need 24 bytes a byte
        block = start // BLOCK
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(start) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, high = start[a], end[b - 1]
            sums = np.empty(high - low + 1, np.uint64)
            sums[0] = 0
            part = table[raw[low:high]]
            part *= _power("up", len(part))
            np.cumsum(part, out=sums[1:])
            s, e = start[a:b] - low, end[a:b] - low
            self.hash[a:b] = mix((sums[e] - sums[s]) * _power("down", len(part))[s] ^ (e - s).astype(np.uint64))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (one per start; needs len >= k)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power("up", len(words)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power("down", n))


def run_starts(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Mask over the starts of ``run_hash``: the k words lie in one text."""
    ok = np.ones(max(n_words - k + 1, 0), bool)
    for back in range(1, k):  # a text that begins inside the run breaks it
        cut = first[1:-1] - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def span_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the entries ``start:end`` of each span."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power("up", len(words)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power("down", len(words) + 1)[start]
    return mix(h ^ (end - start).astype(np.uint64))
