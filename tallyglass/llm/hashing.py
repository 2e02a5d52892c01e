"""Vectorised hashing of byte spans and sliding minima, on numpy arrays of uint64."""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
_TABLE = np.random.Generator(np.random.Philox(20_240_229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE2 = np.random.Generator(np.random.Philox(7_919)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class Spans:
    """Fingerprints of any spans of one byte array; equal bytes give equal values."""

    def __init__(self, data: np.ndarray, second: bool = False):
        base, table = (_BASE2, _TABLE2) if second else (_BASE, _TABLE)
        n = len(data)
        self.inverse = _power(pow(base, -1, 1 << 64), n + 1)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(table[data] * _power(base, n), out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U) * U(0x2545F4914F6CDD1D))

    def grams(self, k: int) -> np.ndarray:
        """Of all spans of k bytes, by start."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for every i with a whole window."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, size = x, 1
    while size * 2 <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[:n], have[w - size : w - size + n])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, and where each begins (one more entry: the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word (run without white space)."""
    ink = ~_SPACE[data]
    first, last = ink.copy(), ink.copy()
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] |= ink[inner]  # a text's end parts words
    last[inner - 1] |= ink[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(starts, a, side="right") - 1


#: Words are hashed in parts of about so many bytes, whatever a text's length.
PART = 1 << 20


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every lower-cased word. Long texts are cut at white space."""
    hashes, owners, some, whose, size = [], [], [], [], 0

    def flush() -> None:
        data, starts = joined(some)
        a, b, part = word_spans(data, starts)
        if len(a):
            hashes.append(Spans(data)(a, b))
            owners.append(np.array(whose, np.int64)[part])

    for i, text in enumerate(texts):
        raw, at = (text or "").lower().encode("utf-8", "replace"), 0
        while at < len(raw):
            end = len(raw)
            if end - at > PART:
                gap = re.compile(rb"[ \t-\r]").search(raw, at + PART)
                end = gap.start() if gap else end
            some.append(raw[at:end])
            whose.append(i)
            size, at = size + end - at, end
            if size >= PART:
                flush()
                some.clear()
                whose.clear()
                size = 0
    flush()
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def word_grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(word) - k + 1
    if n <= 0:
        return word[:0]
    out = np.zeros(n, U)
    for i in range(k):
        out = out * U(0x9FB21C651E98DF25) + word[i : i + n]
    return mix(out)
