"""Compressed FM-index over word sequences, in numpy.

The Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with sampled
ranks. Suffixes are ordered by their first 64 words, which is all that patterns of up to
63 words need. Many patterns are searched in lockstep.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        k = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k] + np.bitwise_count(self.words[k] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.levels, now = [], symbols
        for b in range(max(1, int(symbols.max(initial=0)).bit_length()) - 1, -1, -1):
            bit = (now >> b) & 1
            self.levels.append((b, Bits(bit), int(len(bit) - bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i entries."""
        lo = np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            r_lo, r_hi = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + r_lo, lo - r_lo), np.where(one, zeros + r_hi, i - r_hi)
        return i - lo


class FmIndex:
    """Index of several word sequences, each with an owner number.

    ``pieces``: arrays of word codes from 1 on; 0 parts the pieces. ``window``: length of
    match that is reported, up to 62.
    """

    def __init__(self, pieces: list[np.ndarray], owners: np.ndarray, window: int):
        if not 0 < window <= DEPTH - 2:
            raise ValueError("window must be between 1 and 62")
        self.window = window
        sizes = np.array([len(p) + 1 for p in pieces])
        text = np.zeros(sizes.sum() + 1, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for a, p in zip(at, pieces):
            text[a : a + len(p)] = p
        owner = np.concatenate([np.repeat(owners, sizes), [np.iinfo(np.int64).max]])
        order, rank, half = self._sort(text)
        bwt = text[order - 1]
        self.tree = WaveletMatrix(bwt)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
        # suffixes that agree in their first ``window`` words form a class
        n, shift = len(text), window - DEPTH // 2
        tail = half[np.minimum(order + shift, n - 1)] if shift >= 0 else half[order]
        same = (half[order][1:] == half[order][:-1]) & (tail[1:] == tail[:-1])
        if shift < 0:
            raise ValueError("window must be at least 32")
        first = np.concatenate([[True], ~same])
        self.class_of = np.cumsum(first) - 1
        self.class_at = np.append(np.flatnonzero(first), n)
        self.least = np.minimum.reduceat(owner[order], self.class_at[:-1])

    @staticmethod
    def _sort(text: np.ndarray):
        """Suffix order by DEPTH words, ranks for it, and ranks for half of DEPTH (prefix doubling)."""
        n, half = len(text), None
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        k = 1
        order = np.arange(n)
        while k < DEPTH:
            if k == DEPTH // 2:
                half = rank
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            k *= 2
        return order, rank, half

    def search(self, pattern: np.ndarray) -> tuple[int, int]:
        """Interval of the suffixes that begin with the pattern."""
        at = np.array([0, self.class_at[-1]], np.int64)
        for c in pattern[::-1]:
            if not 0 < c < len(self.starts) - 1 or at[0] >= at[1]:
                return 0, 0
            at = self.starts[c] + self.tree.rank(np.array([c, c]), at)
        return int(at[0]), int(at[1])

    def _shorter(self, pattern: np.ndarray) -> tuple[int, int, int]:
        """Longest prefix of the pattern that occurs (by bisection: shorter ones then occur too)."""
        low, high = 0, len(pattern)
        best = (0, int(self.class_at[-1]), 0)
        while low < high:
            mid = (low + high + 1) // 2
            a, b = self.search(pattern[:mid])
            if a < b:
                low, best = mid, (a, b, mid)
            else:
                high = mid - 1
        return best

    def matching(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each query and each place where a window of it fits: the least owner of an equal
        window in the index, or -1 where the matching statistic is below the window.

        Backward search from the right end: one step prepends a word; once the match is longer
        than the window, its interval is widened to that of its first ``window`` words.
        """
        out = [np.full(max(0, len(q) - self.window + 1), -1, np.int64) for q in queries]
        sizes = np.array([len(q) for q in queries], np.int64)
        by = np.argsort(-sizes, kind="stable")
        width = int(sizes.max(initial=0))
        grid = np.zeros((len(queries), width), np.int64)
        for row, q in enumerate(by):
            if sizes[q]:
                grid[row, width - sizes[q] :] = queries[q]
        found = np.full((len(queries), width), -1, np.int64)
        lo = np.zeros(len(queries), np.int64)
        hi = np.full(len(queries), self.class_at[-1], np.int64)
        length = np.zeros(len(queries), np.int64)
        limit = len(self.starts) - 1
        for step in range(width):
            m = int(np.searchsorted(-sizes[by], -step, side="left"))  # queries longer than step
            c = grid[:m, width - 1 - step]
            known = (c > 0) & (c < limit)
            safe = np.where(known, c, 0)
            at = np.concatenate([lo[:m], hi[:m]])
            r = self.tree.rank(np.concatenate([safe, safe]), at)
            a, b = self.starts[safe] + r[:m], self.starts[safe] + r[m:]
            hit = known & (a < b)
            lo[:m], hi[:m] = np.where(hit, a, 0), np.where(hit, b, self.class_at[-1])
            held = length[:m].copy()
            length[:m] = np.where(hit, length[:m] + 1, 0)
            for row in np.flatnonzero(known & ~hit & (held > 0)):
                lo[row], hi[row], length[row] = self._shorter(grid[row, width - 1 - step :][: held[row]])
            full = np.flatnonzero(length[:m] >= self.window)
            if len(full):
                k = self.class_of[lo[full]]
                lo[full], hi[full] = self.class_at[k], self.class_at[k + 1]
                length[full] = self.window
                found[full, width - 1 - step] = self.least[k]
        for row, q in enumerate(by):
            if len(out[q]):
                a = width - sizes[q]
                out[q][:] = found[row, a : a + len(out[q])]
        return out
