"""Hashes of words and word shingles with numpy, over many texts at once.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text. Equal words have equal hashes wherever they
stand, in any process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which span_hash() takes the hash of any span of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes at any place."""
    inverse = powers(INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of lower-cased UTF-8 bytes, in pieces of bounded size."""
    is_word = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(data) <= 1 << 23:
        return start, end, span_hash(prefix_hash(data), start, end)
    hashes, first = np.empty(len(start), np.uint64), 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + (1 << 22))))
        a, b = start[first], end[last - 1]
        hashes[first:last] = span_hash(prefix_hash(data[a:b]), start[first:last] - a, end[first:last] - a)
        first = last
    return start, end, hashes


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts as bytes with a zero byte after each, and where each text starts (one more entry at the end)."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\0".join([*parts, b""]), np.uint8), starts


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + hashes[k : k + len(out)]
    return mix(out)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; of all its words where it has fewer, none where it has none."""
    data, bounds = join(texts)
    start, _, hashes = words(data)
    first = np.searchsorted(start, bounds)
    runs = combine(hashes, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(combine(hashes[a:b], int(b - a)) ^ U(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
