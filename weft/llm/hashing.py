"""Karp-Rabin hashes of all grams of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, "uint64"), np.full(n, inverse, "uint64")
        up[0] = down[0] = 1
        return np.cumprod(up, dtype="uint64"), np.cumprod(down, dtype="uint64")


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads hashes evenly over 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """A hash for each of the len(codes) - length + 1 grams; equal grams have equal hashes wherever they are."""
    n = len(codes)
    if n < length:
        return np.zeros(0, "uint64")
    up, down = _powers(1 << max(12, n.bit_length()), base)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, "uint64")
        np.cumsum((codes.astype("uint64") + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[length:] - sums[: n - length + 1]) * down[: n - length + 1])


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values, by doubling."""
    span, m = 1, h
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def batches_by_chars(texts: list[str], most: int = 1_000_000):
    """Index ranges of ``texts`` with about ``most`` characters each, at least one text."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)
