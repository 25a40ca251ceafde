"""Elias-Fano sequences and an n-gram trie over them, in one anonymous memory map."""

from __future__ import annotations

import mmap

import numpy as np

#: log10 probabilities are stored in 16 bits, in steps of 1 / STEPS; NONE stands for no entry.
STEPS, NONE = 4096, 65535
#: Words of 64 bits between two entries of a rank directory.
GROUP = 4
_ONE = np.uint64(1)


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, NONE - 1).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return np.where(q == NONE, -np.inf, q.astype(np.float64) / -STEPS)


class Store:
    """Arrays gathered first and then laid out one after the other in a memory map."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.at: list[int] = []
        self.size = 0
        self.map: mmap.mmap | None = None

    def keep(self, a: np.ndarray) -> int:
        """The number by which ``close`` makes the array available."""
        self.parts.append(np.ascontiguousarray(a))
        self.at.append(self.size)
        self.size += -(-a.nbytes // 64) * 64
        return len(self.parts) - 1

    def close(self) -> list[np.ndarray]:
        self.map = mmap.mmap(-1, max(64, self.size))
        out = []
        for a, at in zip(self.parts, self.at):
            self.map[at : at + a.nbytes] = a.tobytes()
            out.append(np.frombuffer(self.map, a.dtype, a.size, at))
        self.parts = []
        return out


class EliasFano:
    """An ascending sequence of integers, packed: low bits as they are, high bits in unary, with a directory of their ones and zeros."""

    def __init__(self, values: np.ndarray, store: Store):
        n = self.n = len(values)
        v = values.astype(np.int64)
        top = int(v[-1]) if n else 0
        self.low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = (v >> self.low_bits) + np.arange(n)
        size = n + (top >> self.low_bits) + 2
        words = np.zeros(-(-size // (64 * GROUP)) * GROUP, np.uint64)
        bit = _ONE << (high & 63).astype(np.uint64)
        at = high >> 6
        if n:
            head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            words[at[head]] = np.bitwise_or.reduceat(bit, head)
        ones = np.bitwise_count(words).reshape(-1, GROUP).sum(1, dtype=np.int64)
        self._parts = [store.keep(words), store.keep(np.cumsum(ones) - ones)]
        width = np.uint64(self.low_bits)
        low = v.astype(np.uint64) & ((_ONE << width) - _ONE)
        place = np.arange(n, dtype=np.uint64) * width
        packed = np.zeros(int(n * self.low_bits // 64) + 2, np.uint64)
        if n and self.low_bits:
            word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            packed[word[head]] = np.bitwise_or.reduceat(low << shift, head)
            over = np.flatnonzero(shift + width > np.uint64(64))  # at most one value runs over the end of a word
            packed[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        self._parts.append(store.keep(packed))

    def open(self, arrays: list[np.ndarray]) -> None:
        self.words, self.ones, self.low = (arrays[k] for k in self._parts)
        self.zeros = np.arange(len(self.ones)) * (64 * GROUP) - self.ones

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of one (or zero) number ``k``."""
        directory = self.ones if ones else self.zeros
        group = np.searchsorted(directory, k, "right") - 1
        left = k - directory[group]
        at = group * GROUP
        for _ in range(GROUP - 1):
            have = np.bitwise_count(self.words[at]).astype(np.int64)
            if not ones:
                have = 64 - have
            on = left >= have
            left = left - np.where(on, have, 0)
            at = at + on
        word = self.words[at] if ones else ~self.words[at]
        place = at * 64
        for width in (32, 16, 8, 4, 2, 1):
            have = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= have
            left = left - np.where(on, have, 0)
            word = np.where(on, word >> np.uint64(width), word)
            place = place + np.where(on, width, 0)
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        place = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        up = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (((self.low[word] >> shift) | up) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by number."""
        return ((self._select(i, True) - i) << self.low_bits) | self._low(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part; all of them beyond the largest."""
        k = np.minimum(high, self._most() + 1) - 1
        return np.where(k < 0, 0, self._select(np.maximum(k, 0), False) - np.maximum(k, 0))

    def _most(self) -> int:
        """The largest high part."""
        if not hasattr(self, "_top"):
            self._top = int(self.at(np.array([self.n - 1]))[0]) >> self.low_bits if self.n else 0
        return self._top

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first value that is at least ``x``, whether it equals ``x``)."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        a, b = self._before(high), self._before(high + 1)
        end = b.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):  # binary search among equal high parts
            mid = (a[todo] + b[todo]) >> 1
            less = self._low(mid) < low[todo]
            a[todo[less]], b[todo[~less]] = mid[less] + 1, mid[~less]
            todo = todo[a[todo] < b[todo]]
        found = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < end)
        found[inside] = self._low(a[inside]) == low[inside]
        return a, found


class Level:
    """The ids below the nodes of the level above: pointers to each node's range, and the ids, each plus the last value before its range, so that the whole is one ascending sequence."""

    def __init__(self, parent: np.ndarray, ids: np.ndarray, parents: int, store: Store):
        """``ids`` from 1 on, ascending within each of the ascending ``parent`` numbers."""
        count = np.bincount(parent, minlength=parents)
        end = np.cumsum(count)
        last = np.zeros(parents, np.int64)
        full = count > 0
        last[full] = ids[end[full] - 1]
        before = np.cumsum(last) - last
        self.pointers = EliasFano(np.concatenate([[0], end]), store)
        self.ids = EliasFano(ids + before[parent], store)

    def open(self, arrays: list[np.ndarray]) -> None:
        self.pointers.open(arrays)
        self.ids.open(arrays)

    def find(self, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of the nodes ``ids`` below ``parent`` (-1: none): a successor search relative to the context's range."""
        out = np.full(len(ids), -1)
        ask = np.flatnonzero(parent >= 0)
        if not len(ask) or not self.ids.n:
            return out
        node, back = np.unique(parent[ask], return_inverse=True)
        begin, end = self.pointers.at(node), self.pointers.at(node + 1)
        base = np.where(begin > 0, self.ids.at(np.maximum(begin - 1, 0)), 0)
        at, found = self.ids.successor(base[back] + ids[ask])
        found &= at < end[back]
        out[ask[found]] = at[found]
        return out


class Trie:
    """Three levels: words, the words that follow them, and those that follow such a pair. Pairs and triples have a quantised log10 share; pairs also the quantised log10 of what is left to the shorter context."""

    def __init__(self, words: np.ndarray, pair_parent: np.ndarray, pair_ids: np.ndarray, pair_share: np.ndarray, pair_left: np.ndarray, triple_parent: np.ndarray, triple_ids: np.ndarray, triple_share: np.ndarray):
        """``words`` ascending; parents are numbers within the level above, in order, and ids ascend within each parent."""
        store = Store()
        self.words = EliasFano(words, store)
        self.pairs = Level(pair_parent, pair_ids, len(words), store)
        self.triples = Level(triple_parent, triple_ids, len(pair_ids), store)
        kept = [store.keep(quantise(x)) for x in (pair_share, pair_left, triple_share)]
        arrays = store.close()
        self.store = store
        for part in (self.words, self.pairs, self.triples):
            part.open(arrays)
        self.pair_share, self.pair_left, self.triple_share = (arrays[k] for k in kept)

    def word(self, ids: np.ndarray) -> np.ndarray:
        at, found = self.words.successor(ids)
        return np.where(found, at, -1)

    def pair(self, word: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of pairs, their quantised share, and what is left to the shorter context; NONE where there is no pair)."""
        at = self.pairs.find(word, ids)
        some = at >= 0
        share, left = np.full(len(ids), NONE, np.uint16), np.full(len(ids), NONE, np.uint16)
        share[some], left[some] = self.pair_share[at[some]], self.pair_left[at[some]]
        return at, share, left

    def triple(self, pair: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = self.triples.find(pair, ids)
        share = np.full(len(ids), NONE, np.uint16)
        share[at >= 0] = self.triple_share[at[at >= 0]]
        return share
