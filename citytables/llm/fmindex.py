"""FM-index over whole numbers, in numpy: wavelet matrix with packed ranks, sampled suffix positions.

All searches take many patterns or texts at once; each step of a backward search is a few array operations.
No match crosses a separator.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, separators: int = -1) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling over those not yet told apart.

    Values up to separators are ordered by their place, so no suffix is compared beyond one.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = text[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (first[1:] <= separators)])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    k = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at) or k >= n:
            return order
        pos = order[at]
        ahead = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)], -1)
        key = np.lexsort((ahead, rank[pos]))
        pos, ahead = pos[key], ahead[key]
        order[at] = pos
        own = rank[pos]
        changed = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        new[at] = changed
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[pos] = start[at]
        k *= 2


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones ahead of each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ahead = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.ones = int(ones.sum())
        self.n = n

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ahead[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.depth):
            bit = ((values >> (self.depth - 1 - level)) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of the first i values after all levels, following the bits of each symbol."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbols >> (self.depth - 1 - level)) & 1
            r = bits.rank(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i).astype(np.int64)
            r = bits.rank(i)
            i = np.where(one == 1, zeros + r, i - r)
            out = out * 2 + one
        return out


class FMIndex:
    """Index of a text of values 1 .. top; 0 may separate its parts. longest: that of matching statistics, if wanted."""

    def __init__(self, text: np.ndarray, top: int | None = None, sample: int = 8, longest: int = 0):
        text = np.append(np.asarray(text, dtype=np.int64) + 1, 0)  # 0 ends the text, 1 separates
        self.top = int(text.max()) if top is None else top + 1
        order = suffix_array(text, separators=1)
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=self.top + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])[: self.top + 1]
        self.tree = WaveletMatrix(bwt, self.top)
        symbols = np.arange(self.top + 1)
        self.base = self.tree.down(symbols, np.zeros(self.top + 1, dtype=np.int64))
        sampled = (order % sample == 0) | (bwt <= 1)  # with the places behind separators, so that locate never steps over one
        self.marks = Bits(sampled)
        self.samples = order[sampled].astype(np.int64)
        self.n = len(text)
        self.longest = longest
        if longest:
            self._intervals(text, order)

    def _rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.tree.down(symbols, i) - self.base[symbols]

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbol + P from the rows lo .. hi of P; symbols as in the text given."""
        s = symbols + 1
        start = self.before[s]
        return start + self._rank(s, lo), start + self._rank(s, hi)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo .. hi of each pattern (all of one length); empty where it doesn't occur."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        live = np.arange(m)
        for j in range(length - 1, -1, -1):
            if not len(live):
                break
            lo[live], hi[live] = self.extend(patterns[live, j], lo[live], hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def _intervals(self, text: np.ndarray, order: np.ndarray) -> None:
        """What neighbouring rows have in common, up to longest, and the rows alike for so long."""
        common = np.zeros(self.n, dtype=np.int64)
        live = np.arange(1, self.n)
        for j in range(self.longest):
            x = text[np.minimum(order[live - 1] + j, self.n - 1)]
            live = live[(x > 1) & (x == text[np.minimum(order[live] + j, self.n - 1)])]
            if not len(live):
                break
            common[live] = j + 1
        begin = np.flatnonzero(common < self.longest)
        nth = np.searchsorted(begin, np.arange(self.n), side="right")
        self.common = common.astype(np.int32)
        self.first_row, self.end_row = begin[nth - 1].astype(np.int32), np.append(begin, self.n)[nth].astype(np.int32)

    def _widened(self, lo, hi, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest wider interval of each (of a shorter match), with the length of its match."""
        edge = np.append(self.common, 0)
        size = np.where(size > 0, np.maximum(edge[lo], edge[hi]), 0)
        lo, hi = lo.copy(), hi.copy()
        for d in np.unique(size).tolist():
            on = np.flatnonzero(size == d)
            begin = np.flatnonzero(self.common < d) if d else np.zeros(1, dtype=np.int64)
            nth = np.searchsorted(begin, lo[on], side="right")
            lo[on], hi[on] = begin[nth - 1], np.append(begin, self.n)[nth]
        return lo, hi, size

    def matching_statistics(self, queries: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the streamed texts queries[starts[i] : starts[i] + sizes[i]] the length of the longest match
        that begins there, up to the index's longest, and the rows lo .. hi of the index where it is.

        Values as in the text; 0, and values that the text lacks, match nothing. Each text is read from its end, all in
        lockstep: a match grows by one backward step; where it can't, it loses words at its right end
        until it can.
        """
        size, lo, hi = (np.zeros(len(queries), dtype=np.int64) for _ in range(3))
        n = len(starts)
        now, at_lo, at_hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, self.n, dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        longest_first = sizes[order]
        for t in range(int(sizes.max(initial=0))):
            own = order[: np.searchsorted(-longest_first, -t, side="left")]  # texts of more than t words
            place = starts[own] + sizes[own] - 1 - t
            c = queries[place]
            known = (c > 0) & (c < self.top)
            no = own[~known]
            now[no], at_lo[no], at_hi[no] = 0, 0, self.n
            todo, c = own[known], c[known]
            while len(todo):
                a, z = self.extend(c, at_lo[todo], at_hi[todo])
                good = a < z
                hit = todo[good]
                at_lo[hit], at_hi[hit], now[hit] = a[good], z[good], now[hit] + 1
                todo, c = todo[~good], c[~good]
                none = now[todo] == 0
                at_lo[todo[none]], at_hi[todo[none]] = 0, self.n
                todo, c = todo[~none], c[~none]
                if len(todo):
                    at_lo[todo], at_hi[todo], now[todo] = self._widened(at_lo[todo], at_hi[todo], now[todo])
            over = own[now[own] >= self.longest]
            now[over] = self.longest
            row = at_lo[over]
            at_lo[over], at_hi[over] = self.first_row[row], self.end_row[row]
            size[place], lo[place], hi[place] = now[own], at_lo[own], at_hi[own]
        return size, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the nearest sampled position."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marks.get(at) == 1
            out[todo[hit]] = self.samples[self.marks.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                s = self.tree.access(at)
                at = self.before[s] + self._rank(s, at)
            steps += 1
        return out

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pattern, text position) of all rows of all intervals."""
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return which, self.locate(rows)
