"""Words of UTF-8 texts and hashes of word windows, vectorized over many texts at once.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return, which in UTF-8
is the same as a run of such characters. Hashes are 64-bit polynomial hashes of random byte values, mixed; equality of
windows is equality of these hashes (two different windows agree with a chance of about 2**-64).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 1 << 20
_RNG = np.random.default_rng(971)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0xD6E8FEB86659FD93  # odd
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k up to n, at least; made once a worker, and again only if more are needed."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(21, int(n).bit_length())
        p, q = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _powers[:] = [np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """hash: of each word; first: the number of words before each text (one more entry than texts)."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray  # byte places in the joined texts (a newline after each)
    end: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) for the window of k words at each word; valid: it lies within one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=total[1:])
        h = np.zeros(n, np.uint64)
        h[: n - k + 1] = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        return mix(h + np.uint64(k)), left >= k


def split_words(texts: list[bytes], lower: bool = False) -> Words:
    data = b"\n".join(texts) + b"\n" if texts else b""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(raw):
        to = min(len(raw), at + PIECE)
        while to < len(raw) and not _SPACE[raw[to - 1]]:  # a piece ends behind a space
            nxt = np.flatnonzero(_SPACE[raw[to : to + PIECE]])
            to = to + int(nxt[0]) + 1 if len(nxt) else min(len(raw), to + PIECE)
        part = raw[at:to]
        if lower:
            part = _LOWER[part]
        space = _SPACE[part]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(start, offsets), start, end)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [t.encode() if t else b"" for t in texts]
