"""Array helpers for many texts at once: they work on one concatenated array, not text by text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # characters joined into one array; a longer text is a chunk of its own
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunked(texts: list[str], size: int = CHUNK) -> Iterator[slice]:
    """Slices of ``texts`` with about ``size`` characters each; every text is in exactly one."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield slice(start, i)
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offset where each text starts (one more for the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without white space, lower-cased) of all texts: a 64-bit hash each, its length, and offsets per text."""
    c, offsets = code_points([t + " " for t in map(str.lower, texts)])
    blank = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0x85) | (c == 0xA0) | (c == 0x3000) | ((c >= 0x2000) & (c <= 0x200A))
    edge = np.diff(blank.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(c) + 1)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), end - start, np.searchsorted(start, offsets)


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the index of the text of each. A text of fewer words has one shingle of all its words, an empty text none."""
    w, _, offsets = words(texts)
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), n)
    if len(w) >= k:
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(BASE) + w[j : len(w) - k + 1 + j]
        whole = owner[: len(h)] == owner[k - 1 :]
        h, at = mix(h[whole]), owner[: len(h)][whole]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        rest = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            on = n[short] > j
            rest[on] = rest[on] * np.uint64(BASE) + w[offsets[short[on]] + j]
        h, at = np.concatenate([h, mix(rest + np.uint64(k))]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Rolling hash of all q consecutive elements of ``c``, put together from hashes of 1, 2, 4, ... elements."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    part, size, out, done = c.astype(np.uint64), 1, None, 0
    while True:
        factor = np.uint64(pow(BASE, size, 1 << 64))
        if q & size:
            out = part.copy() if out is None else out[: len(part) - done] * factor + part[done:]
            done += size
            if done == q:
                return mix(out[: len(c) - q + 1])
        part = part[:-size] * factor + part[size:]
        size *= 2
