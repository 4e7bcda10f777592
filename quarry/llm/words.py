"""Texts as hashed words: A-Z lower-cased, separated by ASCII white space."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_SPAN = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def encoded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower()


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(h: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of all runs of ``size`` words; none if there are fewer words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    up, down = (p[: len(h)] for p in _powers(base, 1 << max(16, len(h).bit_length())))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mixed((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def hashes(body: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word of an encoded text: a polynomial in its bytes and its length, mixed."""
    b, out, at = np.frombuffer(body, np.uint8), np.empty(len(first), np.uint64), 0
    up, down = _powers(BASES[1], _SPAN)
    while at < len(first):
        end = int(np.searchsorted(last, first[at] + _SPAN, "right"))
        if end == at:  # a word longer than the span
            out[at], at = xxhash.xxh64_intdigest(body[first[at] : last[at]]), at + 1
            continue
        start, lo = first[at:end] - first[at], first[at]
        part = b[lo : last[end - 1]]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)])])
        size = (last[at:end] - first[at:end]).astype(np.uint64)
        out[at:end] = mixed((total[last[at:end] - lo] - total[start]) * down[start] + size * np.uint64(BASES[0]))
        at = end
    return out


def of(body: bytes) -> np.ndarray:
    """Hashes of the words of an encoded text."""
    return hashes(body, *bounds(body))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The different shingles of a text of word hashes; fewer words than a shingle, also none, make one."""
    if len(h) >= size:
        g = np.sort(runs(h, size))
        return g[np.concatenate([[True], g[1:] != g[:-1]])]
    return runs(h, len(h)) if len(h) else np.zeros(1, np.uint64)


def least(g: np.ndarray, size: int) -> np.ndarray:
    """Places of the leftmost minimum of each run of ``size`` values, by doubling."""
    value, place, have = g, np.arange(len(g)), 1
    while have < size:
        step = min(have, size - have)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[:-step], value[step:])
        have += step
    return place


def bounds(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text begin and end."""
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(b, np.uint8)], [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def code_points(b: bytes, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Byte offsets as offsets of code points."""
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80)])
    return list(zip(chars[first].tolist(), chars[last].tolist()))
