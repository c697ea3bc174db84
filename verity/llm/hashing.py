"""Vectorised hashing of words and windows in many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: A random value for each byte, made by a rule: splitmix64 of its number.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 0 to n."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, modulo 2**64, with a leading 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def ranges(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each pair, wherever they stand."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start])


class Words:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of many texts: 64-bit hashes, and where each text's begin."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        joined = b"\n".join([b"", *texts, b""])
        self.raw = joined.lower() if fold else joined
        self.buf = np.frombuffer(self.raw, np.uint8)
        space = SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        lengths = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(lengths + 1) - lengths  # in buf
        self.text_end = self.text_start + lengths
        #: words first[i]:first[i + 1] belong to text i
        self.first = np.append(np.searchsorted(self.start, self.text_start), len(self.start))
        self.hash = ranges(prefix(BYTE[self.buf]), self.start, self.end)


def segment_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last]; empty where last is not after first or first is behind the end."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    first = np.minimum(first, len(values))
    return total[np.clip(last, first, len(values))] - total[first]
