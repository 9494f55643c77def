"""A compressed full-text index over numbers: a wavelet matrix on the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` symbols, by prefix doubling.

    Searches for patterns of up to ``depth`` symbols need no finer order.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)

    def ranked(keys: np.ndarray) -> np.ndarray:
        step = np.empty(n, np.int64)
        step[0] = 0
        step[1:] = keys[order][1:] != keys[order][:-1]
        rank[order] = step.cumsum()
        return rank

    ranked(text)
    known = 1
    while known < depth:
        after = np.zeros(n, np.int64)
        after[: n - known] = rank[known:] + 1
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        ranked(keys)
        known *= 2
    return order


class _Bits:
    """A packed bit vector that counts ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.uint32).cumsum(dtype=np.uint32)
        self.before = np.concatenate((np.zeros(1, np.uint32), ones[:-1]))
        self.zeros = len(bits) - int(ones[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class FMIndex:
    """Backward search over ``text``, whose symbols are 0 ... ``symbols`` - 1.

    0 parts sequences and must end the text; patterns do not hold it.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.suffixes = sorted_suffixes(text, depth)
        self.starts = np.concatenate(([0], np.bincount(text, minlength=symbols).cumsum()))
        transform = text[self.suffixes - 1]  # the last symbol stands before the first
        self.width = max(1, int(symbols - 1).bit_length())
        self.levels: list[_Bits] = []
        for level in range(self.width):
            bits = (transform >> (self.width - 1 - level)) & 1
            self.levels.append(_Bits(bits.astype(bool)))
            transform = np.concatenate((transform[bits == 0], transform[bits == 1]))
        every = np.arange(symbols, dtype=np.int64)
        self.first = self._descend(every, np.zeros(symbols, np.int64))

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            ones = bits.rank(places)
            right = (symbols >> (self.width - 1 - level)) & 1
            places = np.where(right == 1, bits.zeros + ones, places - ones)
        return places

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns that begin with one symbol more."""
        base = self.starts[symbols] - self.first[symbols]
        return base + self._descend(symbols, low), base + self._descend(symbols, high)

    def matches(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) for every row of symbols, matched from its last symbol backwards.

        A row is left as soon as its pattern occurs once at most: its length is
        then shorter than the row.
        """
        n, size = windows.shape
        last = windows[:, -1]
        low, high = self.starts[last].copy(), self.starts[last + 1].copy()
        length = np.ones(n, np.int64)
        going = np.flatnonzero(high - low > 1)
        for step in range(2, size + 1):
            if not len(going):
                break
            low[going], high[going] = self.extend(
                windows[going, size - step], low[going], high[going]
            )
            length[going] = step
            going = going[high[going] - low[going] > 1]
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest place in the text among the suffixes of each interval."""
        kinds, which = np.unique(low, return_inverse=True)
        ends = np.zeros(len(kinds), np.int64)
        ends[which] = high
        cuts = np.stack((kinds, ends), axis=1).ravel()
        padded = np.append(self.suffixes, np.iinfo(np.int64).max)
        return np.minimum.reduceat(padded, cuts)[::2][which]
