"""FM-index over a sequence of word numbers, in numpy: many searches at a time.

0 separates runs; no search crosses it. Ranks come from a wavelet matrix whose bit
rows carry a count for every 64 bits. Suffix positions are kept for every
SAMPLE-th place and for the first place of every run, so that locating
never walks over a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; every separator counts as a symbol of its own.

    A suffix's rank is the first place of its group; only groups of several suffixes are sorted on, by one sort of
    (rank, rank of what follows, position) packed in 64 bits as long as n has 21 bits at most.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    if seq[-1] != 0:  # nothing lies beyond the last separator
        got = suffix_array(np.append(seq, 0))
        return got[got < n]
    gaps = np.flatnonzero(seq == 0)
    first = seq.astype(np.int64) + len(gaps) - 1
    first[gaps] = np.arange(len(gaps))
    size = np.bincount(first)
    rank = (np.cumsum(size) - size)[first]
    todo, step, bits = np.flatnonzero(size[first] > 1), 1, n.bit_length()
    while len(todo):
        here, after = rank[todo].astype(np.uint64), rank[todo + step].astype(np.uint64)
        if bits <= 21:
            key = np.sort((here << np.uint64(2 * bits)) | (after << np.uint64(bits)) | todo.astype(np.uint64))
            todo = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            here, pair = (key >> np.uint64(2 * bits)).astype(np.int64), key >> np.uint64(bits)
            new = pair[1:] != pair[:-1]
        else:
            order = np.lexsort((after, here))
            todo, here, after = todo[order], here[order].astype(np.int64), after[order]
            new = (here[1:] != here[:-1]) | (after[1:] != after[:-1])
        begin = np.flatnonzero(np.concatenate([[True], new]))
        group = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        place = here + np.arange(len(todo)) - np.repeat(group, np.diff(np.append(group, len(todo))))
        size = np.diff(np.append(begin, len(todo)))
        rank[todo] = np.repeat(place[begin], size)
        todo = todo[np.repeat(size, size) > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    def __init__(self, values: np.ndarray, width: int):
        self.n, self.rows = len(values), []
        values = values.astype(np.int32 if width < 32 else np.int64)
        for level in range(width - 1, -1, -1):
            bits = ((values >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.rows.append((packed, before, int(self.n - bits.sum()), level))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(packed[i >> 6] & mask).astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i values."""
        lo, i = np.zeros(len(i), np.int64), i.copy()
        for packed, before, zeros, level in self.rows:
            one = ((c >> level) & 1).astype(bool)
            ones_lo, ones_i = self._ones(packed, before, lo), self._ones(packed, before, i)
            lo = np.where(one, zeros + ones_lo, lo - ones_lo)
            i = np.where(one, zeros + ones_i, i - ones_i)
        return i - lo

    def get(self, i: np.ndarray) -> np.ndarray:
        i, value = i.copy(), np.zeros(len(i), np.int64)
        for packed, before, zeros, level in self.rows:
            one = (packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(packed, before, i)
            value |= one.astype(np.int64) << level
            i = np.where(one, zeros + ones, i - ones)
        return value


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int):
        """seq: numbers below symbols; 0 separates."""
        seq = np.asarray(seq, np.int64)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = WaveletMatrix(np.where(sa > 0, seq[sa - 1], 0) if self.n else seq, max(1, int(symbols - 1).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        keep = sa % SAMPLE == 0
        keep |= np.where(sa > 0, seq[sa - 1], 0) == 0
        self.sampled = np.packbits(np.concatenate([keep, np.zeros(-self.n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.sampled_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.sampled).astype(np.int64))])
        self.samples = sa[keep]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each phrase; a phrase is a row, filled with 0 in front."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            go = np.flatnonzero((c > 0) & (lo < hi))
            if len(go):
                lo[go] = self.below[c[go]] + self.bwt.rank(c[go], lo[go])
                hi[go] = self.below[c[go]] + self.bwt.rank(c[go], hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes given by their place in the order."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            done = (self.sampled[r >> 6] >> (r & 63).astype(np.uint64)) & np.uint64(1) == 1
            got = todo[done]
            out[got] = self.samples[WaveletMatrix._ones(self.sampled, self.sampled_before, rows[got])] + steps[got]
            todo = todo[~done]
            if len(todo):
                c = self.bwt.get(rows[todo])
                rows[todo] = self.below[c] + self.bwt.rank(c, rows[todo])
                steps[todo] += 1
        return out
