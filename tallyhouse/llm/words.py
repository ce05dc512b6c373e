"""Hashes of words and word sequences, computed on whole arrays."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes from which a word counts as long.
LONG = 64
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k below n; the longest table asked for so far is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024, 2 * len(have) if have is not None else 0), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], alike wherever the values are alike."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(MULTIPLIER, len(values)), out=sums[1:])
    back = powers(INVERSE, len(values) + 1)[starts]
    return mixed((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes that aren't ASCII white space."""
    space = np.ones(len(text) + 2, np.int8)
    space[1:-1] = SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(space))
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words; long ones by XXH3, as polynomials modulo 2 ** 64 collide on some strings of 1,024 bytes and more."""
    found = span_hashes(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends)
    for k in np.flatnonzero(ends - starts >= LONG):
        found[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]])
    return found


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words."""
    starts = np.arange(max(0, len(words) - n + 1))
    return span_hashes(words, starts, starts + n)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    reach, least = 1, values
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
