"""Operator 2: token counts by a finite-state transducer compiled from a BPE vocabulary.

A sequence of pieces is a text's BPE encoding exactly if each two neighbours encode to themselves, so the encoding of a
prefix is fixed by its last piece and the encoding of what stands before that piece. A state therefore holds, for each
start from which a piece may still go on, the vocabulary-trie node, the piece that ended there and how many fewer tokens
the prefix had up to there; pieces are bounded, so states are finite in number. Transitions are deterministic and carry
the change of the token count. They are compiled when first met and kept in a hash table of bounded size.

Texts are cut into chunks that run side by side, a character of every chunk at each step. A chunk's map takes entry
states to (exit state, tokens). Chunks are cut before a word where one begins; a new word starts alike after any state, so
that map is constant. Inside a longer word a chunk runs in several lanes, one for each state that the characters before
the cut lead to from some places further back. An inclusive prefix scan composes the maps of each text in log2 steps and
picks the lanes that meet. Where none does, chunks get a lane more, from the state that stands before them, all at once, and the
scan is repeated; so counts never rest on a guess.

Null and empty texts have no tokens; texts of any length count whole, in time linear in their length; repeated rows get equal
counts. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .pieces import SPACE, PieceModel, load
from .sentencepiece_codec import model_bytes

CHUNK = 256
#: Characters before a cut inside a word, and lanes: from so many places, one after the other, the states at the cut are found.
WARM, LANES = 48, 4
#: States after which compilation starts anew (memory only; counts are the same).
MAX_STATES = 300_000
START, NONE, ANY = 0, -1, -2


class Transducer:
    """States, transitions and counts for one model; compiles what it meets."""

    def __init__(self, model: PieceModel):
        self.model = model
        chars = sorted({c for p in model.id_of for c in p})
        #: class of each code point: 1 and up for characters of the vocabulary, then four for unknown ones by UTF-8 length; 0 pads
        self.unknown_from = len(chars) + 1
        self.classes = len(chars) + 5
        cp = np.arange(0x110000)
        width = 1 + (cp > 0x7F).astype(int) + (cp > 0x7FF) + (cp > 0xFFFF)
        self.class_of = (self.unknown_from + width - 1).astype(np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.space = int(self.class_of[ord(SPACE)])
        self.class_of[32] = self.space
        self.char_of = [""] + chars
        self.worst = int(model.rank.max()) + 1
        self.rank_of = [*model.rank.tolist(), self.worst]
        self.story: dict[int, tuple[list[int], list[int], list[int]]] = {}
        self.children: list[dict[str, int]] = [{}]
        self.piece_at = [NONE]
        for p, i in model.id_of.items():
            got, told = self._merge([model.id_of[c] for c in p])
            if got != [i]:
                continue  # no merging ever makes it
            self.story[i] = told
            node = 0
            for c in p:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.piece_at.append(NONE)
                node = nxt
            self.piece_at[node] = i
        #: pieces below each node that has few; an entry from which none of them fits is dead, and dropping it joins states
        self.below: list[list[int] | None] = [[] for _ in self.children]
        for node in range(len(self.children) - 1, -1, -1):  # children have larger numbers
            found: list[int] | None = []
            for child in self.children[node].values():
                under = self.below[child]
                found = None if found is None or under is None else found + under + [self.piece_at[child]] * (self.piece_at[child] != NONE)
                if found is not None and len(found) > 12:
                    found = None
            self.below[node] = found
        self.alive: dict[int, bool] = {}
        self.spacy = {i for p, i in model.id_of.items() if p[-1] == SPACE}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, NONE, 0),)]
        self.number = {self.states[0]: START}
        self.bits = 18
        self.keys, self.next, self.delta, self.used = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32), 0

    def _merge(self, sym: list[int]) -> tuple[list[int], tuple[list[int], list[int], list[int]]]:
        """What symbols merge to in the library's order (best rank first, leftmost among equals), and the story: each merge's rank, and the last and first symbol before each and in the end."""
        pairs, rank, size = self.model.pairs, self.rank_of, self.model.size
        sym = list(sym)
        made = [pairs.get(a * size + b, NONE) for a, b in zip(sym, sym[1:])]
        ranks = [rank[m] for m in made]  # the last rank, of NONE, is the worst
        told, lasts, firsts = [], [sym[-1]], [sym[0]]
        while ranks:
            at = ranks.index(best := min(ranks))
            if best == self.worst:
                break
            sym[at : at + 2] = [made[at]]
            del made[at], ranks[at]
            for k in (at - 1, at):
                if 0 <= k < len(made):
                    made[k] = pairs.get(sym[k] * size + sym[k + 1], NONE)
                    ranks[k] = rank[made[k]]
            told.append(best)
            lasts.append(sym[-1])
            firsts.append(sym[0])
        return sym, ([*told, self.worst], lasts, firsts)

    def _fit(self, a: int, b: int) -> bool:
        """Whether the two pieces side by side encode to themselves: no merge across their border ever comes first."""
        (ra, last, _), (rb, _, first) = self.story[a], self.story[b]
        pairs, rank, size, worst = self.model.pairs, self.rank_of, self.model.size, self.worst
        i = j = 0
        while True:
            across, na, nb = rank[pairs.get(last[i] * size + first[j], NONE)], ra[i], rb[j]
            if across < na and across <= nb:
                return False
            if na <= nb:
                if na == worst:
                    return True
                i += 1
            else:
                j += 1

    def _alive(self, node: int, before: int) -> bool:
        under = self.below[node]
        if under is None:
            return True
        key = node * self.model.size + before
        got = self.alive.get(key)
        if got is None:
            if len(self.alive) > 1_000_000:
                self.alive.clear()
            got = self.alive[key] = any(self._fit(before, p) for p in under)
        return got

    def _step(self, state: int, cls: int) -> tuple[int, int]:
        if cls >= self.unknown_from:
            return START, cls - self.unknown_from + 1
        entries, c = self.states[state], self.char_of[cls]
        last = entries[-1][1]
        if c == SPACE and last != NONE and last not in self.spacy:
            entries = self.states[START]  # no piece goes on over a space that follows another character
        new, piece, count = [], NONE, 0
        for node, before, rel in entries:
            child = self.children[node].get(c)
            if child is None:
                continue
            p = self.piece_at[child]
            if piece == NONE and p != NONE and (before == NONE or self._fit(before, p)):
                piece, count = p, rel + 1
            if self.children[child] and (before == NONE or self._alive(child, before)):
                new.append((child, before, rel))
        made = (*[(n, b, r - count) for n, b, r in new], (0, piece, 0))
        at = self.number.get(made)
        if at is None:
            at = self.number[made] = len(self.states)
            self.states.append(made)
        return at, count

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, which keys are missing): each key's slot, or the empty one where it belongs."""
        at = self._slot(keys)
        got = self.keys[at]
        todo = np.flatnonzero(got != keys)
        while len(todo := todo[self.keys[at[todo]] >= 0]):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            todo = todo[self.keys[at[todo]] != keys[todo]]
        return at, self.keys[at] != keys

    def _compile(self, keys: np.ndarray) -> None:
        keys = np.unique(keys)
        made = np.array([self._step(*divmod(k, self.classes)) for k in keys.tolist()], np.int32).reshape(-1, 2)
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys >= 0
            old = self.keys[full], self.next[full], self.delta[full]
            while 2 * (self.used + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.next, self.delta = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            self._put(*old)
        self._put(keys, made[:, 0], made[:, 1])
        self.used += len(keys)

    def _put(self, keys: np.ndarray, nxt: np.ndarray, delta: np.ndarray) -> None:
        todo = np.arange(len(keys))
        while len(todo):  # of keys that want one slot the last written gets it; the others try again
            at, _ = self._find(keys[todo])
            self.keys[at] = keys[todo]
            won = self.keys[at] == keys[todo]
            self.next[at[won]], self.delta[at[won]] = nxt[todo[won]], delta[todo[won]]
            todo = todo[~won]

    def run(self, columns: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, tokens) of lanes; ``columns`` has a row of classes for each step, 0 where a lane has ended."""
        state, count = entry.astype(np.int64), np.zeros(len(entry), np.int64)
        for cls in columns:
            keys = state * self.classes + cls
            at, missing = self._find(keys)
            if missing.any():
                self._compile(keys[missing & (cls > 0)])
                at, _ = self._find(keys)
            live = cls > 0
            state = np.where(live, self.next[at], state)
            count += np.where(live, self.delta[at], 0)
        return state, count


def scan(entry: np.ndarray, exit_: np.ndarray, count: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of state maps: [n, lanes] arrays of entry (NONE: no lane; ANY: entered from every state), exit (NONE: undefined) and tokens.

    ``head``: index of the first map of each one's text. Gives for lane 0 of that first map the exit and tokens after each map.
    """
    fro = np.arange(len(head))  # the first map in what has been composed so far, entered through its lanes
    lanes_to, lanes_total = exit_.copy(), count.copy()
    while (fro > head).any():
        i = np.flatnonzero(fro > head)
        j = fro[i] - 1  # composed with what ends just before
        mid, mid_count = lanes_to[j], lanes_total[j]
        into = entry[fro[i]][:, None, :]
        match = ((mid[:, :, None] == into) | (into == ANY)) & (mid[:, :, None] >= 0)
        which = match.argmax(2)
        ok = match.any(2)
        rows = np.arange(len(i))[:, None]
        new_to = np.where(ok, lanes_to[i][rows, which], -1)
        new_total = mid_count + np.where(ok, lanes_total[i][rows, which], 0)
        lanes_to[i], lanes_total[i] = new_to, new_total
        fro[i] = fro[j]
    return lanes_to[:, 0], lanes_total[:, 0]


class Counter:
    def __init__(self, data: bytes):
        self.machine = Transducer(load(data))

    def count_slice(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row of UTF-8 bytes."""
        m, n = self.machine, len(offs) - 1
        if len(m.states) > MAX_STATES:
            m._clear()
        if not len(buf):
            return np.zeros(n, np.int64)
        chars_to = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]  # code points before each row
        cps = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        full = np.flatnonzero(chars_to[1:] > chars_to[:-1])
        cls = np.insert(m.class_of[cps], chars_to[full], m.space)  # the dummy prefix
        begin = chars_to[full] + np.arange(len(full))
        end = chars_to[full + 1] + np.arange(len(full)) + 1
        cuts, row = self._cut(cls, begin, end)
        size = np.diff(np.append(cuts, len(cls)))
        head = np.searchsorted(row, row)
        known = (cls[cuts] == m.space) & ((cls[np.maximum(cuts - 1, 0)] != m.space) | (cuts == begin[row]))
        known |= cuts == begin[row]
        first = np.arange(len(head)) == head
        entry = np.full((len(cuts), LANES), NONE, np.int64)
        entry[:, 0] = np.where(first, START, np.where(known, ANY, NONE))
        inside = np.flatnonzero(~known)
        for k in range(LANES if len(inside) else 0):
            fro = np.maximum(cuts[inside] - WARM - k, begin[row[inside]])
            entry[inside, k], _ = self._lanes(cls, fro, cuts[inside] - fro, np.full(len(inside), START))
        for k in range(1, LANES):  # lanes of one state are one lane
            entry[(entry[:, :k] == entry[:, k : k + 1]).any(1), k] = NONE
        exit_, count = np.full(entry.shape, NONE, np.int64), np.zeros(entry.shape, np.int64)
        at, lane = np.nonzero(entry != NONE)
        exit_[at, lane], count[at, lane] = self._lanes(cls, cuts[at], size[at], np.maximum(entry[at, lane], START))
        to, total = scan(entry, exit_, count, head)
        while len(lost := np.flatnonzero(to < 0)):
            # the first of a text that is lost is entered from the true state, others from what their neighbour's last lane leaves
            before = np.where(to[lost - 1] >= 0, to[lost - 1], exit_[lost - 1].max(1))
            new = np.full((len(entry), 1), NONE, np.int64)
            lost, before = lost[~known[lost]], before[~known[lost]]
            fresh = (before >= 0) & ~(entry[lost] == before[:, None]).any(1)
            new[lost[fresh], 0] = before[fresh]
            entry, exit_, count = np.hstack([entry, new]), np.hstack([exit_, np.full_like(new, NONE)]), np.hstack([count, np.zeros_like(new)])
            exit_[lost[fresh], -1], count[lost[fresh], -1] = self._lanes(cls, cuts[lost[fresh]], size[lost[fresh]], before[fresh])
            to, total = scan(entry, exit_, count, head)
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
        out = np.zeros(n, np.int64)
        out[full] = total[last]
        return out

    def _cut(self, cls: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of chunks, their row): near each multiple of CHUNK the next start of a word, or that place itself if the word is longer."""
        pieces = np.maximum(1, -(-(end - begin) // CHUNK))
        row = np.repeat(np.arange(len(begin)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[row] + k * CHUNK
        space = cls == self.machine.space
        starts = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))
        nxt = np.append(starts, len(cls))[np.searchsorted(starts, at)]
        cuts = np.where((k > 0) & (nxt < np.minimum(at + CHUNK, end[row])), nxt, at)
        keep = np.append(True, cuts[1:] > cuts[:-1])
        return cuts[keep], row[keep]

    def _lanes(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = np.arange(int(size.max()))[:, None]
        at = np.minimum(start[None, :] + step, len(cls) - 1)
        columns = np.where(step < size[None, :], cls[at], 0)
        return self.machine.run(columns, entry)

    def count(self, texts: list[bytes]) -> np.ndarray:
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return self.count_slice(np.frombuffer(b"".join(texts), np.uint8), offs)


_counters: dict[bytes, Counter] = {}


def counter(data: bytes) -> Counter:
    if data not in _counters:
        _counters.clear()
        _counters[data] = Counter(data)
    return _counters[data]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    data = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(data)
        for b in batches:
            t = shared.Texts(b.column(1))
            n = [c.count_slice(buf, offs) for _, _, buf, offs in t.slices()]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([shared.row_ids(b.column(0)), pa.array(np.diff(t.offs)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return shared.only(docs, key, text).mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(shared.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
