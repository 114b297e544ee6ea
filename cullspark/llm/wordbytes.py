"""Words of UTF-8 text as arrays: digits, letters (A-Z lower-cased) and all that isn't ASCII are a word's, the rest divides words."""

from __future__ import annotations

import numpy as np

#: Bytes that are worked on together; a longer word is taken whole.
STEP = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x)


_UP, _DOWN = _powers(_BASE, STEP), _powers(_INVERSE, STEP)


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words low[start:end]: polynomials of their bytes, all from one running sum."""
    n = len(low)
    up, down = (_UP[:n], _DOWN[:n]) if n <= STEP else (_powers(_BASE, n), _powers(_INVERSE, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(low * up, out=sums[1:], dtype=np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(buffer: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased buffer, and its words' starts, ends and hashes."""
    low = _LOWER[np.frombuffer(buffer, np.uint8)]
    found, at, n = [], 0, len(low)
    while at < n:
        to = min(n, at + STEP)
        while to < n and _IN_WORD[low[to - 1]] and _IN_WORD[low[to]]:  # a step ends at a word's end
            to += 1
        part = low[at:to]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], _IN_WORD[part], [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        found.append((starts + at, ends + at, _hashes(part, starts, ends)))
        at = to
    if not found:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return low.tobytes(), *(np.concatenate(x) for x in zip(*found))


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """Texts as one buffer with a zero byte behind each, and where each begins; nulls are empty."""
    parts = [("" if t is None else t).encode("utf-8", "replace") for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))[:-1].astype(np.int64)
    return b"\0".join([*parts, b""]), begins


def batches(texts: list[str | None], size: int = STEP):
    """Ranges of texts with about size characters, at least one text each."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        n += 0 if t is None else len(t)
        if n >= size:
            yield at, k + 1
            at, n = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
