"""Hashes of many substrings at once, in numpy: polynomial prefix sums modulo 2^64, with mixed results."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
#: Two independent random values for every byte, and two odd bases with their inverses.
BYTES = _rng.integers(0, 1 << 64, (2, 256), np.uint64)
BASES = [int(x) | 5 for x in _rng.integers(1 << 60, 1 << 63, 4, np.int64) // 8 * 8]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if size <= 1 << 20:  # longer ones are for a very long text alone
            _powers[base] = (both[0], both[1])
        have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Hashes of values[start:end], for arrays of starts and ends."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.base, (up, self.down) = base, powers(base, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    def windows(self, length: int) -> np.ndarray:
        """Of every window of that length, by its start."""
        return mix((self.sums[length:] - self.sums[: len(self.sums) - length]) * self.down[: len(self.sums) - length])


class Text:
    """The UTF-8 bytes of some texts, one space after each; `begin[i]:end[i]` are text i's."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.data = b" ".join(raw) + b" "
        self.buf = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        self.end = self.begin + lengths

    def words(self, fold: bool = False) -> Words:
        return Words(self, fold)


class Words:
    """Words by ASCII white space: `start`, `end` in the bytes; words first[i]:last[i] are text i's; fold lower-cases A-Z."""

    def __init__(self, text: Text, fold: bool):
        buf = text.buf
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, text.begin)
        self.last = np.searchsorted(self.start, text.end)
        self.text, self.fold = text, fold

    def hashes(self, which: int = 0) -> np.ndarray:
        values = BYTES[which]
        if self.fold:
            values = values.copy()
            values[65:91] = values[97:123]
        return Prefix(values[self.text.buf], BASES[which]).spans(self.start, self.end)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values, by its start, the place of its least value, the leftmost of equals."""
    at, least, span = np.arange(len(values)), values, 1
    while span < width:
        step = min(span, width - span)
        left, right = least[: len(least) - step], least[step:]
        take = right < left
        least = np.where(take, right, left)
        at = np.where(take, at[step:], at[: len(at) - step])
        span += step
    return at
