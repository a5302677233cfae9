"""A compressed FM-index over word symbols: backward search on a wavelet matrix, capped matching statistics.

Texts are arrays of symbols 1..sigma, each followed by the separator 0. Suffixes are ordered by their first
32 symbols, which is exact for every search of at most ``cap`` < 32 symbols. Many queries are searched at
once, one symbol of each per step. Once built, the index holds the wavelet matrix, a byte per suffix (what it shares
with the one before) and the least value of each run of suffixes that share ``cap`` symbols; no suffix array.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


class WaveletMatrix:
    """Bits of each level in 64-bit words with a running count per word."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = symbols
        for level in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros((len(bit) >> 6) + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((words, before, int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before its lo and before its hi."""
        n, top = len(symbol), len(self.levels) - 1
        at, start = np.concatenate([lo, hi]), np.zeros(n, np.int64)
        for k, (words, before, zeros) in enumerate(self.levels):
            both = np.concatenate([at, start])
            word = both >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            one = np.tile((symbol >> (top - k) & 1).astype(bool), 3)
            both = np.where(one, zeros + ones, both - ones)
            at, start = both[: 2 * n], both[2 * n :]
        return at[:n] - start, at[n:] - start


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, cap: int, values: np.ndarray | None = None) -> None:
        """``text``: symbols with separators, ending in one. Searches see at most ``cap`` symbols; ``values``: one per place of the text."""
        if not 0 < cap < DEPTH:
            raise ValueError("cap must be under the suffixes' sorted depth")
        n = len(text)
        if n >= 1 << 30:
            raise ValueError("a shard is under 2^30 symbols")
        self.cap, self.n = cap, n
        rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
        ranks, h = [rank], 1  # by the first 1, 2, 4, 8, 16 symbols
        while True:
            key = rank * np.int64(n + 1)
            key[: n - h] += rank[h:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            h *= 2
            if h == DEPTH:
                break
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
            ranks.append(rank)
        self.bwt = WaveletMatrix(text[order - 1], sigma)  # the text's end, a separator, precedes its start
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.lcp = np.zeros(n + 1, np.uint8)  # symbols that each suffix shares with the one before, up to DEPTH - 1
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.uint8)
        for level in range(len(ranks) - 1, -1, -1):
            same = (np.maximum(a, b) < n) & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
            step = same * (1 << level)
            a, b, shared = a + step, b + step, shared + step.astype(np.uint8)
        self.lcp[1:n] = shared
        self._begins: dict[int, np.ndarray] = {}
        self.least = None if values is None else np.minimum.reduceat(values[order], self.begins(cap))

    def begins(self, depth: int) -> np.ndarray:
        """Where the maximal runs of suffixes sharing ``depth`` symbols begin, and the end."""
        if depth not in self._begins:
            self._begins[depth] = np.flatnonzero(self.lcp[: self.n] < depth).astype(np.int32)
        return self._begins[depth]

    def run(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, begin and end of the run of ``depth`` that holds each suffix."""
        begin = self.begins(depth)
        which = np.searchsorted(begin, at, side="right") - 1
        return which, begin[which], np.where(which + 1 < len(begin), begin[np.minimum(which + 1, len(begin) - 1)], self.n)

    def matching_statistics(self, query: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of the concatenated queries (each up to its entry of ``ends``): the length, at most
        ``cap``, of the longest match that starts there, and its suffix interval. Symbols not of the index: 0."""
        length, low, high = np.zeros(len(query), np.uint8), np.zeros(len(query), np.int32), np.zeros(len(query), np.int32)
        starts = np.concatenate([[0], ends[:-1]])
        order = np.argsort(starts - ends, kind="stable")  # longest first: those that go on are a prefix
        at, stop = ends[order] - 1, starts[order]
        lo, hi, m = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64), np.zeros(len(at), np.int64)
        live = int((at >= stop).sum())
        while live:
            at, stop, lo, hi, m = at[:live], stop[:live], lo[:live], hi[:live], m[:live]
            c = query[at]
            todo = np.flatnonzero(c > 0)
            lo2, hi2, m2 = np.zeros(live, np.int64), np.full(live, self.n, np.int64), np.zeros(live, np.int64)
            while len(todo):
                a, b = self.bwt.rank(c[todo], lo[todo], hi[todo])
                base = self.before[c[todo]]
                ok = b > a
                hit = todo[ok]
                lo2[hit], hi2[hit], m2[hit] = base[ok] + a[ok], base[ok] + b[ok], m[hit] + 1
                todo = todo[~ok]
                todo = todo[m[todo] > 0]
                if len(todo):  # shorten the match from its right end to its parent, and try again
                    m[todo] = np.minimum(np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]]), m[todo])
                    for d in np.unique(m[todo]).tolist():
                        some = todo[m[todo] == d]
                        lo[some], hi[some] = self.run(lo[some], d)[1:] if d else (0, self.n)
            long = np.flatnonzero(m2 > self.cap)
            if len(long):
                lo2[long], hi2[long] = self.run(lo2[long], self.cap)[1:]
                m2[long] = self.cap
            length[at], low[at], high[at] = m2, lo2, hi2
            lo, hi, m, at = lo2, hi2, m2, at - 1
            live = int((at >= stop).sum())
        return length, low, high
