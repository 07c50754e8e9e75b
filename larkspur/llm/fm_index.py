"""A compressed FM-index over sequences of words, with numpy.

The Burrows-Wheeler transform of the sequences is kept in a wavelet matrix: one bitvector a level,
packed to 64 bits a word with a running count for each, so a symbol takes about ``1.5 * log2(sigma)`` bits.
Backward search runs for many patterns in step.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n + 64) // 64 * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([np.zeros(1, np.int32), np.cumsum(ones[:-1], dtype=np.int32)])
        self.ones = int(ones.sum())
        self.zeros = n - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """A sequence of symbols below ``2**levels``."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows = levels, []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bits = ((now >> level) & 1).astype(bool)
            self.rows.append(BitVector(bits))
            now = np.concatenate([now[~bits], now[bits]])

    def rank_span(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pattern: where its symbol's range starts on the last level, and how many of the symbol come
        before ``lo`` and ``hi`` there."""
        start = np.zeros(len(symbol), np.int64)
        k = len(symbol)
        for level, row in zip(range(self.levels - 1, -1, -1), self.rows):
            one = ((symbol >> level) & 1).astype(bool)
            ranks = row.rank(np.concatenate([start, lo, hi]))
            three = []
            for part, at in zip((ranks[:k], ranks[k : 2 * k], ranks[2 * k :]), (start, lo, hi)):
                three.append(np.where(one, row.zeros + part, at - part))
            start, lo, hi = three
        return start, lo - start, hi - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length until all ranks differ."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    step = np.concatenate([[0], np.cumsum(symbols[order][1:] != symbols[order][:-1])])
    rank[order] = step
    length = 1
    while step[-1] < n - 1:
        key = rank * (n + 1)
        key[: n - length] += rank[length:] + 1
        order = np.argsort(key)
        ordered = key[order]
        step = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = step
        length *= 2
    return order


class FMIndex:
    """Index of many sequences, given one after the other in ``words`` and cut at ``bounds``.

    The sequences are turned round before sorting, so that backward search extends a pattern to
    the right. ``owner`` (one value a sequence) is what a search reports the least of."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, owner: np.ndarray):
        count = len(bounds) - 1
        self.alphabet, symbol = np.unique(words, return_inverse=True)
        n = len(words) + count
        sequence = np.repeat(np.arange(count), np.diff(bounds))
        text = np.empty(n, np.int64)
        # separators differ from each other, so that no comparison runs into the next sequence
        text[np.arange(len(words)) + sequence] = symbol + count
        text[bounds[1:] + np.arange(count)] = np.arange(count)
        text = text[::-1]
        order = suffix_array(text)
        of = np.empty(n, np.int64)
        of[np.arange(len(words)) + sequence] = sequence
        of[bounds[1:] + np.arange(count)] = np.arange(count)
        self.owners = owner[of[::-1][order]]
        last = np.maximum(text[order - 1] - count + 1, 0)  # separators are symbol 0 here
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.bwt = WaveletMatrix(last, self.levels)
        self.first = count + np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=len(self.alphabet)))])
        self.symbol = symbol

    def shared_windows(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For windows of ``length`` words that begin at ``starts`` in the index's own words: the least owner
        among all places where the window occurs, and the number of places.

        A window whose interval has shrunk to one place occurs there only and is done."""
        symbol = self.symbol
        lo, hi = self.first[symbol[starts]], self.first[symbol[starts] + 1]
        places = np.ones(len(starts), np.int64)
        least = np.full(len(starts), np.iinfo(np.int64).max)
        live = np.arange(len(starts))
        for k in range(1, length):
            open_ = hi - lo > 1
            live, lo, hi = live[open_], lo[open_], hi[open_]
            if not len(live):
                return least, places
            c = symbol[starts[live] + k]
            _, before, after = self.bwt.rank_span(c + 1, lo, hi)
            lo, hi = self.first[c] + before, self.first[c] + after
        places[live] = hi - lo
        # intervals of one depth are disjoint or equal
        some, back = np.unique(lo, return_inverse=True)
        ends = np.empty(len(some), np.int64)
        ends[back] = hi
        edges = np.stack([some, ends], axis=1).ravel()
        if len(edges):
            tail = edges[-1] >= len(self.owners)
            least[live] = np.minimum.reduceat(self.owners, edges[:-1] if tail else edges)[0::2][back]
        return least, places
