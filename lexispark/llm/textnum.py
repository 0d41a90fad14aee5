"""Words of a text as numbers: hashes computed over the whole byte array at once."""

from __future__ import annotations

import numpy as np

#: A word is a run of bytes other than space and \t \n \v \f \r, so [^\x20\x09-\x0D]+ in UTF-8.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixSums:
    """A polynomial prefix sum of an array, from which any span's hash follows."""

    def __init__(self, values: np.ndarray) -> None:
        _grow(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of values[s:e] for each span."""
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * _inverse[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, n: int) -> np.ndarray:
        """For each window of n values a hash of which only the high bits are well mixed."""
        m = max(0, len(self.sums) - n)
        with np.errstate(over="ignore"):
            return (self.sums[n:] - self.sums[:m]) * _inverse[:m] * np.uint64(0x9FB21C651E98DF25)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span."""
    return PrefixSums(values).spans(starts, ends)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (starts, ends) of the words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[0::2], turns[1::2]


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the whole text; none for null."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(data, *word_spans(data))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n consecutive words; none if there are fewer."""
    m = len(words) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(m, np.uint64)
        for j in range(n):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + m]
    return mix(total)
