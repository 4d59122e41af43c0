"""Elias-Fano sequences over numpy arrays that may be memory-mapped."""

from __future__ import annotations

import numpy as np

_SELECT8 = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT8[_b, _k] = _p
_U = np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value end to end, and 8 bytes behind them."""
    parts = []
    for at in range(0, len(values), 1 << 16):
        v = values[at : at + (1 << 16)].astype(np.uint64)
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & _U(1)
        parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))  # 2**16 values fill whole bytes
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of a monotone sequence of values below universe."""
    n = len(values)
    low = Builder.width_of(n, universe)
    values = values.astype(np.uint64)
    high = (values >> _U(low)).astype(np.int64)
    size = n + (universe >> low) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
    return {"low": _pack(values & _U((1 << low) - 1), low) if low else np.zeros(8, np.uint8), "words": words, "ones": ones.astype(np.uint32 if n < 1 << 32 else np.uint64), "shape": np.array([n, low], np.int64)}


class Builder:
    """The arrays of a monotone sequence that comes part by part, its width fixed before; as lists of pieces."""

    def __init__(self, width: int):
        self.n, self.width = 0, width
        self.low: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self._rest = np.zeros(0, np.uint64)  # low bits that don't fill a byte yet
        self._done, self._last = 0, _U(0)  # whole words so far, and the word behind them

    @staticmethod
    def width_of(n: int, universe: int) -> int:
        return max(0, (universe // max(1, n)).bit_length() - 1)

    def add(self, values: np.ndarray) -> None:
        """Values no lower than those before."""
        if not len(values):
            return
        values = values.astype(np.uint64)
        if self.width:
            low = np.concatenate([self._rest, values & _U((1 << self.width) - 1)])
            whole = len(low) & ~7
            self.low.append(_pack(low[:whole], self.width)[:-8])
            self._rest = low[whole:].copy()
        at = (values >> _U(self.width)).astype(np.int64) + np.arange(self.n, self.n + len(values))
        bits = np.zeros(((int(at[-1]) >> 6) + 1 - self._done) * 64, np.uint8)
        bits[at - self._done * 64] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        words[0] |= self._last
        self.words.append(words[:-1])
        self._done, self._last = self._done + len(words) - 1, words[-1]
        self.n += len(values)

    def arrays(self, universe: int) -> dict[str, list[np.ndarray]]:
        """As build() gives them, and `zeros`, the zeros before each word."""
        more = max(0, -(-(self.n + (universe >> self.width) + 2) // 64) - self._done - 1)
        words = [*self.words, np.array([self._last], np.uint64), np.zeros(more, np.uint64)]
        kind = np.uint32 if sum(map(len, words)) * 64 < 1 << 32 else np.uint64
        ones, zeros, seen, at = [np.zeros(1, kind)], [np.zeros(1, kind)], 0, 0
        for w in words:
            n = seen + np.cumsum(np.bitwise_count(w), dtype=np.int64)
            ones.append(n.astype(kind))
            zeros.append((np.arange(at + 1, at + 1 + len(w)) * 64 - n).astype(kind))
            at, seen = at + len(w), int(n[-1]) if len(n) else seen
        return {"low": [*self.low, _pack(self._rest, self.width)], "words": words, "ones": ones, "zeros": zeros, "shape": [np.array([self.n, self.width], np.int64)]}


class EliasFano:
    """Random access and successor search in a sequence, for whole arrays of queries."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["shape"])
        self.words, self.ones, self.zeros = arrays["words"], arrays["ones"], arrays.get("zeros")
        low = arrays["low"]
        self.low = np.ndarray(max(1, len(low) - 7), "<u8", low, strides=(1,))
        self.mask = _U((1 << self.width) - 1)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    @staticmethod
    def _inside(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one of each word."""
        at = np.zeros(len(word), np.uint8)
        for half in (32, 16, 8):
            n = np.bitwise_count(word & _U((1 << half) - 1))
            up = k >= n
            k = k - n * up
            shift = up.view(np.uint8) * np.uint8(half)
            word = word >> shift
            at += shift
        return at + _SELECT8[(word & _U(0xFF)).astype(np.int64), k]

    def select1(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        return w * 64 + self._inside(self.words[w], i - self.ones[w].astype(np.int64))

    def select0(self, i: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        w = np.searchsorted(self.zeros, i.astype(self.zeros.dtype), side="right") - 1
        return w * 64 + self._inside(~self.words[w], i - self.zeros[w].astype(np.int64))

    def _after(self, p: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the next one (flip: zero) behind p; -1 if p's word holds none."""
        word = self.words[p >> 6]
        rest = ((~word if flip else word) >> (p & 63).astype(np.uint64)) >> _U(1)
        lowest = np.bitwise_count((rest & (~rest + _U(1))) - _U(1))
        return np.where(rest != 0, p + 1 + lowest, -1)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places i and i + 1."""
        one = self.select1(i)
        two = self._after(one, False)
        far = np.flatnonzero(two < 0)
        two[far] = self.select1(i[far] + 1)
        value = lambda at, k: ((at - k).astype(np.uint64) << _U(self.width) | self._lows(k)).astype(np.int64)
        return value(one, i), value(two, i + 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        return ((self.select1(i) - i).astype(np.uint64) << _U(self.width) | self._lows(i)).astype(np.int64)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each value within [begin, end), -1 if it isn't there: from the first value of its high part on, the successor."""
        found = np.full(len(value), -1, np.int64)
        todo = np.flatnonzero(end > begin)
        high = value[todo] >> self.width
        low = value[todo].astype(np.uint64) & self.mask
        # the values with this high part, as far as they lie in the range
        zero = self.select0(np.maximum(high - 1, 0))
        lo = zero + 1 - high
        after = self._after(zero, True)
        lowest = high == 0
        lo[lowest] = 0
        far = np.flatnonzero((after < 0) | lowest)
        after[far] = self.select0(high[far])
        hi = np.minimum(after - high, end[todo])
        lo = np.maximum(lo, begin[todo])
        last = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            middle = (lo[live] + hi[live]) >> 1
            less = self._lows(middle) < low[live]
            lo[live[less]] = middle[less] + 1
            hi[live[~less]] = middle[~less]
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < last)
        hit = there[self._lows(lo[there]) == low[there]]
        found[todo[hit]] = lo[hit]
        return found
