"""A compressed FM-index of word sequences: a wavelet matrix of packed bits over the Burrows-Wheeler transform, against which streams of words are searched backwards, many at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by some words at once and then by doubling what is not told apart. ends marks separators, each unlike any other and before all words, so a suffix is told apart by the end of its sequence."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    rank = text.astype(np.int64)
    marks = np.flatnonzero(ends)
    rank[~ends] += len(marks)
    rank[marks] = np.arange(len(marks))
    bits = max(1, int(rank.max()).bit_length())
    h = max(1, 62 // bits)
    key = rank.copy()
    for j in range(1, h):
        key <<= bits
        key[: max(0, n - j)] |= rank[j:]
    order = np.argsort(key)
    live, rows, key = np.arange(n), order, key[order]
    while True:
        # a suffix has the place of the first of its group as rank, so what is settled stays as it is
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        live = live[~(fresh & np.concatenate([fresh[1:], [True]]))]
        if not len(live):
            return order
        rows = order[live]
        key = rank[rows] * n + rank[rows + h]
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[live] = rows
        h *= 2


class Wavelet:
    """Wavelet matrix: for each bit of the symbols, from the highest, the bits in packed words with a count before each word."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.n = depth, len(symbols)
        self.bits, self.before, self.zeros = [], [], []
        for level in range(depth):
            bit = (symbols >> (depth - 1 - level) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            self.bits.append(np.packbits(padded, bitorder="little").view(np.uint64))
            self.before.append(np.concatenate([[0], np.cumsum(padded.reshape(-1, 64).sum(1, dtype=np.int32))[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the prefix of `place` symbols ends in the last level, for its share of each symbol."""
        for level in range(self.depth):
            word, off = place >> 6, (place & 63).astype(np.uint64)
            ones = self.before[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << off) - np.uint64(1)))
            place = np.where(symbol >> (self.depth - 1 - level) & 1, self.zeros[level] + ones, place - ones)
        return place


class FMIndex:
    """Of sequences with weights: how often, by weight, a pattern occurs in them. The sequences themselves are not kept."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        at = np.cumsum(sizes + 1) - 1  # each sequence's separator
        ends = np.zeros(len(words) + len(sizes), bool)
        ends[at] = True
        self.alphabet, code = np.unique(words, return_inverse=True)
        text = np.zeros(len(ends), np.int64)
        text[~ends] = code + 1
        order = suffix_array(text, ends)
        self.n = len(text)
        self.tree = Wavelet(text[order - 1], max(1, len(self.alphabet).bit_length()))
        every = np.arange(len(self.alphabet) + 1)
        self.origin = self.tree.walk(every, np.zeros(len(every), np.int64))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(every)))[:-1]])
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        total = np.concatenate([[0], np.cumsum(weights[of[order]])])
        self.weight = total.astype(np.uint32) if total[-1] < 1 << 32 else total

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The words of a stream as the index has them; 0, which matches nothing, for others."""
        at = np.minimum(np.searchsorted(self.alphabet, words), max(0, len(self.alphabet) - 1))
        return np.where(self.alphabet[at] == words, at + 1, 0) if len(self.alphabet) else np.zeros(len(words), np.int64)

    def matching(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics of a coded stream by backward search: how many words before each end, and not before its begin, occur together at least `least` times."""
        out = end - begin
        live = np.arange(len(begin))
        lo, hi, at = np.zeros(len(begin), np.int64), np.full(len(begin), self.n), end - 1
        while len(live):
            c = text[at]
            both = self.tree.walk(np.concatenate([c, c]), np.concatenate([lo, hi])).reshape(2, -1) - self.origin[c] + self.smaller[c]
            lo, hi = both
            ok = (c > 0) & (self.weight[hi].astype(np.int64) - self.weight[lo].astype(np.int64) >= least)
            out[live[~ok]] = end[live[~ok]] - 1 - at[~ok]
            ok &= at > begin[live]
            live, lo, hi, at = live[ok], lo[ok], hi[ok], at[ok] - 1
        return out

    def repeated_windows(self, words: np.ndarray, sizes: np.ndarray, width: int, least: int = 2) -> np.ndarray:
        """Streams some sequences against the index: for each the windows that occur at least `least` times, as bits from the first (at most 62 windows).

        Where the matching statistic of an end falls short, no window that covers the word it stops at and
        reaches that end is repeated, so the search goes on behind that word. How far a repeated window can
        be extended is halved, first about the word where the extension to the end of the sequence stopped.
        """
        text, start = self.codes(words), np.cumsum(sizes) - sizes
        masks = np.zeros(len(sizes), np.int64)
        ones = lambda n: (np.int64(1) << n) - 1
        live = np.flatnonzero(sizes >= width)
        last = sizes[live] - width
        behind = sizes[live] - self.matching(text, start[live], start[live] + sizes[live], least)
        masks[live] = ones(last + 1) & ~ones(np.minimum(behind, last + 1))
        last = np.minimum(last, behind - 1)
        s = np.zeros(len(live), np.int64)  # the window looked at
        low, high, end = s + width - 1, last + width + 1, s + width  # ends known to be repeated from s, and not to be, and the next to try
        stopped = s.copy()  # where the matching statistic of `high` begins
        while True:
            stay = s <= last
            live, last, s, low, high, end, stopped = (x[stay] for x in (live, last, s, low, high, end, stopped))
            if not len(live):
                return masks
            length = self.matching(text, start[live] + s, start[live] + end, least)
            hit, first = length == end - s, end == s + width
            stopped = np.where(hit, stopped, end - length)
            guess = np.where(hit, np.where(first, high - 1, np.where(end > low + 1, end + 1, 0)), stopped - 1)
            low, high = np.where(hit, end, low), np.where(hit, high, end)
            done = high - low == 1
            some = done & (low >= s + width)
            masks[live[some]] |= ones(low[some] - width + 1) & ~ones(s[some])
            s = np.where(done, np.maximum(high - width, stopped), s)
            end = np.where(done, s + width, np.where((low < guess) & (guess < high), guess, (low + high) // 2))
            low, high = np.where(done, s + width - 1, low), np.where(done, last + width + 1, high)
            stopped = np.where(done, 0, stopped)
