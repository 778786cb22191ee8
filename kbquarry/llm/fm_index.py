"""A compressed FM-index in numpy: suffix sorting, wavelet matrix, backward search over many streams at once.

The indexed text is a set of passages with a separator after each.  Passages carry weights (how often they occur), so an
interval of the suffix array has a weight: the number of places in the corpus where its string occurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols at least (prefix doubling), then by place.  A pair of ranks and
    the place share one integer, so that plain sorting does."""
    n = len(text)
    width = max(1, n.bit_length(), int(text.max()).bit_length() + 1)
    rank, length = text.astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - length)] = rank[length:] + 1
        length *= 2
        if 3 * width <= 63:
            both = np.sort((((rank << width) + behind) << width) + np.arange(n))
            order, both = both & ((1 << width) - 1), both >> width
        else:
            both = (rank << width) + behind
            order = np.argsort(both, kind="stable")
            both = both[order]
        fresh = np.concatenate([[0], np.cumsum(both[1:] != both[:-1])])
        if length >= depth or fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh


#: The bits below each place of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        part = self.words.take(word)
        part &= _BELOW.take(at & 63)
        return self.before.take(word) + np.bitwise_count(part)


class FMIndex:
    """``text``: symbols from 0 (the separator) to ``top``; ``weights``: of each place."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int):
        order = suffix_array(text, depth)
        current = text[order - 1]  # the Burrows-Wheeler transform
        self.mass = np.concatenate([[0], np.cumsum(weights[order])])
        top = int(text.max())
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels: list[tuple[int, Bits, int]] = []
        for b in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (current >> b) & 1
            self.levels.append((b, Bits(bit), int(len(bit) - bit.sum())))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        symbols = np.arange(top + 1)
        self.first = self._down(symbols, np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol & (1 << b)).astype(bool), zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + string, from those of string."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.start.take(symbol) - self.first.take(symbol)
        return base + both[: len(lo)], base + both[len(lo) :]

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.mass.take(hi) - self.mass.take(lo)


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, last: np.ndarray, window: int, least: int = 2) -> np.ndarray:
    """For each stream, a bit mask of the window starts s = 0 .. last whose string has a weight of ``least`` or more.

    Matching statistics by backward search, all streams in step.  ``open_`` is the last start not settled yet; from the end of
    its window the search goes left while the weight suffices.  If it stops at i, the starts between have been reached, and
    windows that hold all of text[i..end] are out.  What is rare there is mostly short: probes of 4, 8, 16 .. words from i on
    look for a shorter rare string, which settles all starts whose windows hold it, before the search goes on from the next
    open window.
    """
    mask = np.zeros(len(begin), np.int64)
    lane = np.nonzero(last >= 0)[0]
    open_ = last[lane].copy()
    end = open_ + window - 1
    at, fresh, probe = end.copy(), np.ones(len(lane), bool), np.zeros(len(lane), bool)
    block, span = end.copy(), np.full(len(lane), 4)
    lo, hi = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    while len(lane):
        symbol = text.take(begin[lane] + at)
        go = np.nonzero(~fresh)[0]
        lo2, hi2 = index.start.take(symbol), index.start.take(symbol + 1)
        if len(go):
            lo2[go], hi2[go] = index.extend(symbol[go], lo[go], hi[go])
        rare = index.weight(lo2, hi2) < least
        stop = rare | (at == 0) | (probe & (at <= open_))
        lo, hi, fresh = lo2, hi2, stop
        k = np.nonzero(stop)[0]
        if len(k):
            here, plain, out = at[k], ~probe[k], rare[k]
            reach = np.where(out, here + 1, here)  # leftmost start reached
            count = np.where(plain, np.maximum(0, open_[k] - reach + 1), 0)
            mask[lane[k]] |= ((np.int64(1) << count) - 1) << np.where(count > 0, reach, 0)
            found = out & (plain | (here >= open_[k]))
            block[k], span[k] = np.where(found, here, block[k]), np.where(found, 4, span[k] * 2)
            open_[k] = np.where(found, np.minimum(np.where(plain, here, open_[k]), end[k] - window), open_[k])
            open_[k[plain & ~out]] = -1  # reached the first word
            after = open_[k] + window - 1
            probe[k] = block[k] + span[k] - 1 < after
            end[k] = np.where(probe[k], block[k] + span[k] - 1, after)
        at = np.where(stop, end, at - 1)
        on = open_ >= 0
        if not on.all():
            lane, open_, end, at, fresh, probe, block, span, lo, hi = (x[on] for x in (lane, open_, end, at, fresh, probe, block, span, lo, hi))
    return mask
