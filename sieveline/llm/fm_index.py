"""An FM-index over integer symbols: a bit-packed wavelet matrix, capped common prefixes and the least document below suffixes.

The suffix array itself is not kept.  What stays of each symbol is a bit and
a half on each level of the wavelet matrix, one byte for the common prefix with the
suffix before, and the rank of its document with minima over small blocks.

Matching statistics come from backward search: a pattern is read from right to
left, the interval of the match so far is extended by the next symbol, and
where that fails it is widened to the interval of its longest prefix that
more suffixes have.  All patterns of a call run in step with each other, one
move a step, as numpy operations.
"""

from __future__ import annotations

import numpy as np

from .text import U


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(U)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = i >> 6
        below = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)


class BlockMin:
    """Minima of ranges, and the nearest smaller value on either side; rows of minima are kept of blocks only."""

    SIZE = 8

    def __init__(self, values: np.ndarray):
        n, b = len(values), self.SIZE
        self.top = np.iinfo(values.dtype).max
        self.n = n
        self.values = np.full((n // b + 2) * b, self.top, values.dtype)
        self.values[:n] = values
        self.rows = [self.values.reshape(-1, b).min(axis=1)]
        while 2 << (len(self.rows) - 1) <= len(self.rows[0]):
            v, h = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(v[:-h], v[h:]))

    def _few(self, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
        """Minima of ranges of at most ``width`` values."""
        at = lo[:, None] + np.arange(width)
        return np.where(at < hi[:, None], self.values[np.minimum(at, len(self.values) - 1)], self.top).min(axis=1)

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of each range, the type's largest number for empty ones."""
        b = self.SIZE
        short = hi - lo <= 2 * b
        out = np.full(len(lo), self.top, self.values.dtype)
        k = np.flatnonzero(short)
        if len(k):
            n = int((hi[k] - lo[k]).max(initial=0))
            if n > 0:
                out[k] = self._few(lo[k], hi[k], n)
        k = np.flatnonzero(~short)
        if len(k):
            first, last = -(-lo[k] // b), hi[k] // b
            v = np.minimum(self._few(lo[k], first * b, b), self._few(last * b, hi[k], b))
            level = np.frexp(last - first)[1] - 1
            for x in np.unique(level):
                at = np.flatnonzero(level == x)
                row = self.rows[x]
                v[at] = np.minimum(v[at], np.minimum(row[first[at]], row[last[at] - (1 << int(x))]))
            out[k] = v
        return out

    def next_below(self, i: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The first place at or behind i whose value is below x, else the length."""
        return self._nearest(i, x, 1)

    def last_below(self, i: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The last place at or before i whose value is below x, else -1."""
        return self._nearest(i, x, -1)

    def _nearest(self, i: np.ndarray, x: np.ndarray, way: int) -> np.ndarray:
        """First within the block of i, then over blocks in leaps, then within the block found."""
        b, blocks = self.SIZE, len(self.rows[0])
        out = np.full(len(i), self.n if way > 0 else -1)
        steps = np.arange(b) * way

        def inside(k: np.ndarray, start: np.ndarray, stay: np.ndarray) -> np.ndarray:
            """Sets what is found among the b values from start on that lie in the block ``stay``; which are not found."""
            at = start[:, None] + steps
            hit = (at // b == stay[:, None]) & (self.values[np.clip(at, 0, len(self.values) - 1)] < x[k][:, None])
            found = hit.any(axis=1)
            out[k[found]] = start[found] + way * hit[found].argmax(axis=1)
            return ~found

        k = np.arange(len(i))
        k = k[inside(k, i, i // b)]
        block = i[k] // b + way
        live = (block >= 0) & (block < blocks)
        k, block = k[live], block[live]
        level, up = np.zeros(len(k), np.int64), np.ones(len(k), bool)
        todo = np.arange(len(k))
        while len(todo):
            lv, at = level[todo], block[todo]
            low = np.where(way > 0, at, at - (1 << lv) + 1)
            fits = (low >= 0) & (low + (1 << lv) <= blocks)
            clear = np.zeros(len(todo), bool)
            for q in np.unique(lv[fits]):
                s = np.flatnonzero(fits & (lv == q))
                clear[s] = self.rows[q][low[s]] >= x[k[todo[s]]]
            block[todo] = np.where(clear, at + way * (1 << lv), at)
            up[todo] &= clear
            level[todo] = np.where(up[todo], np.minimum(lv + 1, len(self.rows) - 1), lv - 1)
            todo = todo[level[todo] >= 0]
        live = (block >= 0) & (block < blocks)
        k, block = k[live], block[live]
        inside(k, block * b + (0 if way > 0 else b - 1), block)
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, docs: np.ndarray, depth: int):
        """symbols: integers from 0; 0 is a separator, which patterns do not contain, and the last symbol. docs: the document of each symbol.

        Suffixes are sorted by their first ``depth`` symbols, as far as patterns of that length need.
        """
        self.sigma, self.n = int(symbols.max(initial=0)) + 1, len(symbols)
        order, lcp = self._suffixes(symbols, depth)
        self.lcp = BlockMin(lcp)
        self.docs = BlockMin(docs.astype(np.int32)[order])
        self.below = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=self.sigma), out=self.below[1:])
        self.levels: list[tuple[int, Bits, int]] = []
        cur = symbols[order - 1]  # the first suffix is preceded by the last symbol
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (cur >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones), int(len(cur) - np.count_nonzero(ones))))
            cur = np.concatenate([cur[~ones], cur[ones]])
        self.start = self._down(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    @staticmethod
    def _suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by prefix doubling, and the common prefix (at most 254) of each suffix with the one before, from the ranks of all rounds."""
        rank = symbols.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        h, ranks = 1, [rank.astype(np.int32)]
        while h < depth:
            after = np.zeros_like(rank)
            after[:-h] = rank[h:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key)
            new = np.zeros(len(key), np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty_like(key)
            rank[order] = np.cumsum(new)
            h *= 2
            ranks.append(rank.astype(np.int32))
            if rank[order[-1]] == len(rank) - 1:
                break
        n = len(symbols)
        a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            r = ranks[level]
            same = np.flatnonzero((a < n) & (b < n))
            same = same[r[a[same]] == r[b[same]]]
            for v in (a, b, lcp):
                v[same] += 1 << level
        out = np.zeros(n + 1, np.uint8)
        out[1:-1] = np.minimum(lcp, 254)
        return order, out

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern from intervals of patterns."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.below[c] - self.start[c]
        return base + both[: len(c)], base + both[len(c) :]

    def widen(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals and lengths of the longest prefixes that more suffixes have."""
        v = self.lcp.values
        size = np.maximum(v[lo], v[hi])
        lo, hi = np.where(size > 0, self.lcp.last_below(lo, size), 0), np.where(size > 0, self.lcp.next_below(hi, size), self.n)
        return lo, hi, size.astype(np.int64)

    def statistics(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Where matches of ``least`` symbols begin: the pattern and the place in it.

        Of each place of the patterns symbols[start:end] the longest match in a document below the pattern's
        own is followed; places from which none can reach ``least`` are left out.
        """
        k = np.flatnonzero((end - start >= least) & (doc > 0))
        at, lo, hi, size = end[k].copy(), np.zeros(len(k), np.int64), np.full(len(k), self.n), np.zeros(len(k), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(k):
            a, b = self.extend(symbols[at - 1], lo, hi)
            good = a < b
            s = np.flatnonzero(good)
            good[s] = self.docs.over(a[s], b[s]) < doc[k[s]]
            stuck = ~good & (size > 0)
            lo, hi = np.where(good, a, lo), np.where(good, b, hi)
            size = np.where(good, size + 1, size)
            at = np.where(stuck, at, at - 1)
            s = np.flatnonzero(stuck)
            if len(s):
                lo[s], hi[s], size[s] = self.widen(lo[s], hi[s])
            s = np.flatnonzero(good & (size >= least))
            if len(s):
                found.append((k[s], at[s] - start[k[s]]))
            live = (at > start[k]) & (at - start[k] + size >= least)
            k, at, lo, hi, size = (x[live] for x in (k, at, lo, hi, size))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
