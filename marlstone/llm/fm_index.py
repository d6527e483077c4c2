"""A compressed full-text index over word sequences, and matching statistics of other sequences by backward search.

What is kept of a text of n words: the Burrows-Wheeler transform in a wavelet matrix; for each match length below the
width a bit vector of where suffixes that agree on so many words begin; their common lengths, cut at the width; the owner
at the rows of every ``SAMPLE``-th word of a piece (the sampled suffix array); and the least owner of each window that
occurs more than once.  The text, the suffix array and a table of owners by position are dropped after building.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8
_U64 = np.uint64


class BitVector:
    """Bits with rank, and the nearest set bit at or before, or at or after, a position; bit 0 is set for the latter."""

    def __init__(self, bit: np.ndarray):
        self.n = len(bit)
        packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bit.astype(np.uint8), bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        count = np.bitwise_count(self.words)
        self.block = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(count, out=self.block[1:])
        self.past = self.next = None

    def with_neighbours(self) -> BitVector:
        own = np.arange(len(self.words), dtype=np.int64) * 64
        last = np.where(self.words > 0, own + self._high(self.words), 0)
        self.past = np.concatenate(([0], np.maximum.accumulate(last)))[:-1].astype(np.int32)
        first = np.where(self.words > 0, own + self._low(self.words), self.n)
        self.next = np.concatenate((np.minimum.accumulate(first[::-1])[::-1][1:], [self.n])).astype(np.int32)
        return self

    @staticmethod
    def _high(w: np.ndarray) -> np.ndarray:
        for k in (1, 2, 4, 8, 16, 32):
            w = w | (w >> _U64(k))
        return np.bitwise_count(w).astype(np.int64) - 1

    @staticmethod
    def _low(w: np.ndarray) -> np.ndarray:
        return np.bitwise_count((w & (~w + _U64(1))) - _U64(1)).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        at = i >> 6
        return self.block[at] + np.bitwise_count(self.words[at] & ((_U64(1) << (i & 63).astype(_U64)) - _U64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(_U64)) & _U64(1)

    def before(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        own = self.words[at] & (~_U64(0) >> (63 - (i & 63)).astype(_U64))
        return np.where(own > 0, at * 64 + self._high(own), self.past[at])

    def after(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        own = self.words[at] & (~_U64(0) << (i & 63).astype(_U64))
        return np.where(own > 0, at * 64 + self._low(own), self.next[at])

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.block.nbytes + (0 if self.past is None else self.past.nbytes + self.next.nbytes)


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit vector for each level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.levels.append(BitVector(bit))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.base = self._place(np.arange(sigma), np.zeros(sigma, np.int64)).astype(np.int32)

    def _place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[k].rank(i)
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self._place(symbol, i) - self.base[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and how often each occurs before."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            bit, ones = self.levels[k].get(i).astype(np.int64), self.levels[k].rank(i)
            symbol = symbol * 2 + bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return symbol, i - self.base[symbol]

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.levels) + self.base.nbytes


class FMIndex:
    """Index over pieces, each a list of words with the number of the document that owns it, for matches up to width."""

    def __init__(self, pieces: list[list[bytes]], owners: np.ndarray, width: int):
        self.width, self.vocab = width, {}
        k = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        flat = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for p in pieces for w in p), np.int64, int(size.sum()))
        first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]  # a separator ends each piece
        n = self.n = int(size.sum()) + k
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[first + size] = False
        text[inside] = flat
        rank = np.where(inside, text + k - 1, 0)
        rank[~inside] = np.arange(k)  # separators differ, so no match crosses one
        rank = np.unique(rank, return_inverse=True)[1]
        ranks, step = [rank], 1
        while rank.max(initial=0) < n - 1 or step < width:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1]
            step *= 2
            ranks.append(rank)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        symbols = len(self.vocab) + 1
        bwt = text[suffix - 1]
        self.wavelet = WaveletMatrix(bwt, symbols)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols)))).astype(np.int32)[:-1]
        common = np.zeros(n + 1, np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            x, y = suffix[:-1] + common[1:n], suffix[1:] + common[1:n]
            fits = (x < n) & (y < n)
            same = fits & (ranks[level][np.where(fits, x, 0)] == ranks[level][np.where(fits, y, 0)])
            common[1:n] += same * (1 << level)
        self.common = np.minimum(common, width).astype(np.uint8)  # of a suffix and the one before
        self.heads = [BitVector(self.common[:n] < d).with_neighbours() for d in range(1, width)]  # bit 0 is always set
        head = np.flatnonzero(self.common[:n] < width)
        spread = np.diff(np.append(head, n))
        by_row = np.repeat(owners, size + 1)[suffix]
        several = np.zeros(n, bool)
        several[head[spread > 1]] = True
        self.several = BitVector(several)
        self.least = np.minimum.reduceat(by_row, head)[spread > 1] if n else np.zeros(0, np.int64)
        offset = np.arange(n) - np.repeat(first, size + 1)
        sampled = (offset % SAMPLE == 0)[suffix] & (text[suffix] > 0)
        self.sampled, self.owner = BitVector(sampled), by_row[sampled]

    @property
    def nbytes(self) -> int:
        return self.wavelet.nbytes + self.start.nbytes + self.common.nbytes + sum(h.nbytes for h in self.heads) + self.several.nbytes + self.least.nbytes + self.sampled.nbytes + self.owner.nbytes

    def encode(self, words: list[bytes]) -> list[int]:
        return [self.vocab.get(w, 0) for w in words]

    def _shorter(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first length words of matches."""
        a, b = np.zeros_like(low), np.full_like(high, self.n)
        for d in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero(length == d)
            a[at], b[at] = self.heads[d - 1].before(low[at]), self.heads[d - 1].after(high[at])
        return a, b

    def matching_statistics(self, queries: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each position of the queries, in their order: the query, the place in it, how many words from there on
        (width at most) occur in the index, and the suffix interval of those.

        The queries are streamed right to left in lockstep.  A match that can't be extended by the word to the left is
        cut to the next shorter length at which its interval grows, until it can.
        """
        size = np.array([len(q) for q in queries], np.int64)
        if not size.sum():
            return (np.zeros(0, np.int64),) * 5
        flat = np.array([s for q in queries for s in q], np.int64)
        first = np.cumsum(size) - size
        live = np.flatnonzero(size)
        live = live[np.argsort(-size[live], kind="stable")]
        lengths, lows, highs = (np.zeros(len(flat), np.int64) for _ in range(3))
        low, high, length = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            at = first[live] + size[live] - 1 - step
            c = flat[at]
            a, b = self.start[c] + self.wavelet.rank(c, low), self.start[c] + self.wavelet.rank(c, high)
            void = c == 0
            a[void], b[void], length[void] = 0, self.n, -1
            todo = np.flatnonzero((a >= b) & ~void)
            while len(todo):
                shorter = np.maximum(self.common[low[todo]], np.where(high[todo] < self.n, self.common[high[todo]], 0)).astype(np.int64)
                length[todo] = shorter
                low[todo], high[todo] = self._shorter(low[todo], high[todo], shorter)
                s = c[todo]
                a[todo], b[todo] = self.start[s] + self.wavelet.rank(s, low[todo]), self.start[s] + self.wavelet.rank(s, high[todo])
                todo = todo[a[todo] >= b[todo]]
            low, high, length = a.astype(np.int64), b.astype(np.int64), length + 1
            lengths[at], lows[at], highs[at] = length, low, high
            full = np.flatnonzero(length == self.width)
            if len(full) and self.width > 1:
                length[full] = self.width - 1
                low[full], high[full] = self._shorter(low[full], high[full], length[full])
            elif len(full):
                length[full], low[full], high[full] = 0, 0, self.n
            step += 1
            still = int(np.searchsorted(-size[live], -step, side="left"))
            live, low, high, length = live[:still], low[:still], high[:still], length[:still]
        query = np.repeat(np.arange(len(size)), size)
        return query, np.arange(len(flat)) - first[query], lengths, lows, highs

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner of the occurrences in each suffix interval of a match of width words.

        A window that occurs once is followed to the left, word by word, to a row whose owner is kept.
        """
        out = np.zeros(len(low), np.int64)
        many = high - low > 1
        out[many] = self.least[self.several.rank(low[many])]
        at = np.flatnonzero(~many)
        row = low[at]
        while len(at):
            ends = self.sampled.get(row) > 0
            out[at[ends]] = self.owner[self.sampled.rank(row[ends])]
            at, row = at[~ends], row[~ends]
            symbol, seen = self.wavelet.access(row)
            row = (self.start[symbol] + seen).astype(np.int64)
        return out
