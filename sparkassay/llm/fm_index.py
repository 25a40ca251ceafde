"""FM-index over a sequence of integer symbols: suffix array, BWT in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` by prefix doubling; after each round only suffixes whose rank is shared go on."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    order = np.argsort(s, kind="stable")
    v = s[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = start[np.cumsum(new) - 1]  # a group's rank is its first place, so that groups keep their rank when split
    k = 1
    shared = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(shared):
        pos = order[shared]
        a, b = rank[pos], rank[np.minimum(pos + k, n)]
        by = np.lexsort((b, a))
        pos, a, b = pos[by], a[by], b[by]
        order[shared] = pos
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        start = np.flatnonzero(new)
        rank[pos] = shared[start[np.cumsum(new) - 1]]
        shared = shared[~(new & np.append(new[1:], True))]
        k *= 2
    return order


class FMIndex:
    """``symbols``: integers from 1; a unique smallest end symbol 0 is added. All queries take arrays of patterns or rows."""

    def __init__(self, symbols: np.ndarray):
        s = np.append(symbols.astype(np.int64), 0)
        n = self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        top = int(s.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        self.levels: list[tuple[np.ndarray, int]] = []
        bits = max(1, top.bit_length())
        level = bwt
        base = np.zeros(top + 1, np.int64)
        alphabet = np.arange(top + 1)
        for k in range(bits - 1, -1, -1):
            bit = (level >> k) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = n - int(ones[-1])
            self.levels.append((ones, zeros))
            up = (alphabet >> k) & 1
            base = np.where(up == 1, zeros + ones[base], base - ones[base])
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.base, self.bits = base, bits
        sampled = sa % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` stands in the first ``i`` places of the BWT."""
        for level, (ones, zeros) in enumerate(self.levels):
            up = (c >> (self.bits - 1 - level)) & 1
            o = ones[i]
            i = np.where(up == 1, zeros + o, i - o)
        return i - self.base[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of ``patterns`` (all of one length): ranges of suffixes that begin with them."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            inside = c < len(self.base)
            hi[live[~inside]] = lo[live[~inside]]
            live, c = live[inside], c[inside]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        c, i = np.zeros(len(row), np.int64), row
        for ones, zeros in self.levels:
            o = ones[i]
            up = ones[i + 1] - o
            c = 2 * c + up
            i = np.where(up == 1, zeros + o, i - o)
        return self.before[c] + i - self.base[c]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in those rows, from the samples."""
        rows, out, walked = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = self.sampled[rows[todo]]
            hit = todo[at]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + walked[hit]
            todo = todo[~at]
            rows[todo] = self.step(rows[todo])
            walked[todo] += 1
        return out
