"""Operator 7: language-model scores from an Elias-Fano n-gram trie.

A trigram model with back-off over words and an end token, counted over all training documents:

* ``p(w | u v) = s3 c(u v w) / c(u v) + (1 - s3) p(w | v)`` with ``s3 = SHARE3 c(u v) / (c(u v) + LAG3)``,
* ``p(w | v) = s2 c(v w) / c(v) + (1 - s2) p(w)`` with ``s2 = SHARE2 c(v) / (c(v) + LAG2)``,
* ``p(w) = (1 - z) c(w) / N`` and ``z = (words counted once + 1) / (N + 1)`` for the one unknown word (Good and Turing).

It is normalised over the known words and the unknown one. A text's first token follows a start symbol; the second one's
context is that symbol and the first.

A task cuts its rows into blocks and asks shards in two rounds; answers go back to the block, where they meet the block's
tokens, packed as numbers of its distinct words. So texts are never shuffled, and no task holds the whole model.

1. Words, as 64-bit hashes: a shard sums their counts and gives each known word an id of its own, frequent words small ones.
2. Pairs and triples of ids, each pair with its followers. A shard owns the contexts that a hash deals to it. It sums their counts over all blocks
   and builds its part of the trie from them: the contexts' first words, the words that follow and the words that follow
   both, each level an ascending sequence with monotone pointers to it, and quantised smoothed probabilities beside, in one
   memory map. What blocks ask is then found in the trie by successor searches within the context's range.

``docs`` should be a table or another scan that gives a task the same rows again if it is repeated; both rounds read it.

Null and empty texts are the end token alone. A null doc_id trains. Rows are scored each by itself; repeated rows count
each time. Without training documents N and V are 0 and every token is unknown. Texts of any length are scored whole; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .blobs import pack, shard_of, unpack
from .ef_trie import NONE, Trie, restore

SHARE2, LAG2, SHARE3, LAG3 = 0.3, 20.0, 0.5, 0.5
#: Tokens and rows that close a block.
BLOCK, BLOCK_ROWS = 1 << 20, 1 << 17
#: Shards for each shuffle partition.
SHARDS = 2
END = np.uint64(0x27D4EB2F165667C5)
HOME, TOTAL = -1, -2


def held_out(key: str = "doc_id", of: int = 7, left: int = 2):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == left, F.lit(False))


class Block:
    """The tokens of a run of rows."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = [[], [], [], [], []]
        self.tokens = self.rows = 0

    def add(self, ids: np.ndarray, present: np.ndarray, held: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> None:
        w = shared.Words(buf, offs)
        for part, x in zip(self.parts, (ids, present, held, np.diff(w.first) + 1, np.insert(w.hash, w.first[1:], END))):
            part.append(x)
        self.tokens += len(w) + len(ids)
        self.rows += len(ids)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """(distinct words, how often training rows hold each, number of each token's word, (ids, present, held, tokens of rows))."""
        ids, present, held, n, h = (np.concatenate(x) for x in self.parts)
        known, at = np.unique(h, return_inverse=True)
        return known, np.bincount(at[np.repeat(~held, n)], minlength=len(known)), at, (ids, present, held, n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    number, block = TaskContext.get().partitionId() << 32, Block()
    for b in batches:
        ids = shared.row_ids(b.column(0))
        present, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        held = b.column(1).to_numpy(zero_copy_only=False)
        for at, to, buf, offs in shared.Texts(b.column(2)).slices():
            block.add(ids[at:to], present[at:to], held[at:to], buf, offs)
            if block.tokens >= BLOCK or block.rows >= BLOCK_ROWS:
                yield number, block
                number, block = number + 1, Block()
    if block.rows:
        yield number, block


_ROUND = "block long, shard int, blob binary, more binary"


def _rows(block: list, shard: list, blob: list, more: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary()), pa.array(more or [None] * len(block), pa.binary())], ["block", "shard", "blob", "more"])


def _scanned(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), held_out(f"`{key}`").alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))


def word_counts(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """First round: the counts and ids of each block's words (block, shard, blob), and a row of each shard's sums (block TOTAL, tokens, types, once)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            known, count, _, _ = block.words()
            cuts = np.searchsorted(shard_of(known, shards), np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            yield _rows([number] * len(full), full, [pack(known[cuts[s] : cuts[s + 1]], count[cuts[s] : cuts[s + 1]]) for s in full])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for block, shard, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
                held.setdefault(shard, []).append((block, blob))
        for shard in sorted(held):
            blocks, asked = zip(*((block, unpack(blob)) for block, blob in held.pop(shard)))
            known, back = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([c for _, c in asked]), minlength=len(known)).astype(np.int64)
            rank = np.empty(len(known), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(known))
            ids, out, at = 1 + rank * shards + shard, [], 0
            for k, _ in asked:
                own = back[at : at + len(k)]
                at += len(k)
                out.append(pack(total[own], np.where(total[own] > 0, ids[own], 0)))
            yield pa.RecordBatch.from_arrays([*_rows([*blocks, TOTAL], [shard] * (len(out) + 1), [*out, None]).columns[:3], *[pa.array([None] * len(out) + [int(x)], pa.int64()) for x in (total.sum(), (total > 0).sum(), (total == 1).sum())]], ["block", "shard", "blob", "tokens", "types", "once"])

    asked = _scanned(docs, text, key).mapInArrow(ask, _ROUND).select("block", "shard", "blob")
    return asked.repartition(shared.partitions(docs.sparkSession), "shard").mapInArrow(answer, "block long, shard int, blob binary, tokens long, types long, once long")


def _homes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(block, HOME, rows, number of each token's word): what a block needs once it is answered."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            _, _, at, rows = block.words()
            yield _rows([number], [HOME], [pack(*rows)], [pack(at)])

    return _scanned(docs, text, key).mapInArrow(home, _ROUND)


class Asked:
    """A block with its words' counts and ids: its known pairs and triples, in the order in which they are asked and answered."""

    def __init__(self, table: pa.Table, shards: int):
        answers = []
        for shard, blob, more in zip(*(table[c].to_pylist() for c in ("shard", "blob", "more"))):
            if shard == HOME:
                rows, at = unpack(blob), unpack(more)[0]
            else:
                answers.append((shard, blob))
        self.ids, self.present, held, self.n = rows
        self.held = held.astype(bool)
        count, word = (np.concatenate(x) for x in zip(*(unpack(blob) for _, blob in sorted(answers))))  # shards are ranges, so their words follow each other
        if len(count) != at.max() + 1:
            raise RuntimeError("docs gave other rows when they were read again; write them to a table first")
        # the start symbol is word 0; it stands as often as the end token
        self.first = np.cumsum(self.n) - self.n
        last = np.zeros(len(at), bool)
        last[self.first + self.n - 1] = True
        start = count[at[last][0]] if len(at) else 0
        self.count, self.word = np.concatenate([[start], count]), np.concatenate([[0], word])
        self.w = at + 1
        begins = np.zeros(len(at), bool)
        begins[self.first] = True
        self.v = np.where(begins, 0, np.concatenate([[0], self.w[:-1]]))
        size = len(self.word)
        known = self.count[self.w] > 0
        follows = known & (self.count[self.v] > 0)
        train = np.repeat(~self.held, self.n)
        # pairs
        key = self.v[follows] * size + self.w[follows]
        pair, at_pair = np.unique(key, return_inverse=True)
        pair_count = np.bincount(at_pair[train[follows]], minlength=len(pair))
        self.u_of, self.v_of = np.divmod(pair, size)
        shard = (shared.mix(shared.mix(self.word[self.u_of].astype(np.uint64)) + self.word[self.v_of].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.word[self.v_of], self.word[self.u_of], shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.u_of, self.v_of, self.pair_count, self.shard = self.u_of[order], self.v_of[order], pair_count[order], shard[order]
        self.pair = np.full(len(at), -1)
        self.pair[follows] = place[at_pair]
        # triples: a known pair after a known pair of the same row
        before = np.where(begins, -1, np.concatenate([[-1], self.pair[:-1]]))
        third = (before >= 0) & known
        rank = np.empty(size, np.int64)
        rank[np.argsort(self.word, kind="stable")] = np.arange(size)  # so that followers ascend by id
        triple, at_triple = np.unique(before[third] * size + rank[self.w[third]], return_inverse=True)
        self.triple_count = np.bincount(at_triple[train[third]], minlength=len(triple))
        self.context, follower = np.divmod(triple, size)
        self.follower = self.word[np.argsort(self.word, kind="stable")][follower]
        self.triple = np.full(len(at), -1)
        self.triple[third] = at_triple
        self.before = before

    def asks(self) -> Iterator[tuple[int, bytes]]:
        """(shard, what is asked of it)."""
        n_followers = np.bincount(self.context, minlength=len(self.shard))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.shard)) + 1, [len(self.shard)]]) if len(self.shard) else np.zeros(1, np.int64)
        triples = np.searchsorted(self.context, cuts)
        for a, b, x, y in zip(cuts, cuts[1:], triples, triples[1:]):
            u = self.u_of[a:b]
            head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            parts = [pack(self.word[u[head]], self.count[u[head]], np.diff(np.append(head, b - a))), pack(self.word[self.v_of[a:b]], self.pair_count[a:b], n_followers[a:b]), pack(self.follower[x:y], self.triple_count[x:y])]
            yield int(self.shard[a]), b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parts(blob: bytes) -> list[list[np.ndarray]]:
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "little")
        out.append(unpack(blob[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _log10(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


def _share(c: np.ndarray, most: float, lag: float) -> np.ndarray:
    return most * c / (c + lag)


def answered(blobs: list[bytes]) -> list[bytes]:
    """Builds a shard's trie of all that its blocks counted, and answers each from it: quantised shares of pairs, what pairs leave to the shorter context, and shares of triples."""
    asked = [_parts(b) for b in blobs]
    u = [np.repeat(a[0][0], a[0][2]) for a in asked]
    sizes = [(len(x), len(a[2][0])) for x, a in zip(u, asked)]
    first, at_first = np.unique(np.concatenate(u), return_inverse=True)
    first_count = np.zeros(len(first), np.int64)
    for a in asked:
        first_count[np.searchsorted(first, a[0][0])] = a[0][1]
    v = np.concatenate([a[1][0] for a in asked])
    wide = int(v.max()) + 1
    pair, at_pair = np.unique(at_first * wide + v, return_inverse=True)
    sum_of = lambda at, c, n: np.bincount(at, weights=c, minlength=n).astype(np.int64)
    pair_count = sum_of(at_pair, np.concatenate([a[1][1] for a in asked]), len(pair))
    parent = at_pair[np.repeat(np.arange(len(at_pair)), np.concatenate([a[1][2] for a in asked]))]
    w = np.concatenate([a[2][0] for a in asked])
    broad = int(w.max(initial=0)) + 1
    triple, at_triple = np.unique(parent * broad + w, return_inverse=True)
    triple_count = sum_of(at_triple, np.concatenate([a[2][1] for a in asked]), len(triple))
    # the trie holds what training rows hold
    some, counted = np.flatnonzero(pair_count), np.flatnonzero(triple_count)
    c, parent_count = pair_count[some].astype(float), first_count[pair[some] // wide].astype(float)
    number = np.cumsum(pair_count > 0) - 1
    below = triple[counted] // broad
    share = _share(pair_count[below].astype(float), SHARE3, LAG3)
    trie = Trie(first, pair[some] // wide, pair[some] % wide, _log10(_share(parent_count, SHARE2, LAG2) * c / parent_count), _log10(1 - _share(c, SHARE3, LAG3)), number[below], triple[counted] % broad, _log10(share * triple_count[counted] / pair_count[below]))
    node, pair_share, pair_left = trie.pair(trie.word(first)[pair // wide], pair % wide)
    triple_share = trie.triple(node[triple // broad], triple % broad)
    out, at, to = [], 0, 0
    for n, m in sizes:
        mine, own = at_pair[at : at + n], at_triple[to : to + m]
        at, to = at + n, to + m
        parts = pack(pair_share[mine], pair_left[mine]), pack(triple_share[own])
        out.append(b"".join(len(p).to_bytes(4, "little") + p for p in parts))
    return out


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    partitions = shared.partitions(docs.sparkSession)
    shards = SHARDS * partitions
    words = shared.materialize(word_counts(docs, shards, text, key), "word-counts")
    sums = words.where(F.col("block") == TOTAL).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once")]).first()
    n, types, unknown = sums.tokens, sums.types, (sums.once + 1) / (sums.tokens + 1)
    # both uses of the blocks share one exchange
    blocks = _homes(docs, text, key).unionByName(words.where(F.col("block") != TOTAL).select("block", "shard", "blob", F.lit(None).cast("binary").alias("more"))).groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        number = table["block"][0].as_py()
        asks = list(Asked(table, shards).asks())
        return pa.Table.from_batches([_rows([number] * len(asks), [s for s, _ in asks], [b for _, b in asks])]).select(["block", "shard", "blob"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for block, shard, blob in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(shard, []).append((block, blob))
        for shard in sorted(held):
            numbers, blobs = zip(*held.pop(shard))
            yield _rows(list(numbers), [shard] * len(numbers), answered(list(blobs))).select(["block", "shard", "blob"])

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        a = Asked(own, shards)
        parts = [_parts(blob) for _, blob in sorted(zip(got["shard"].to_pylist(), got["blob"].to_pylist()))]
        pair_share, pair_left, triple_share = (np.concatenate([x[k][j] for x in parts] or [np.zeros(0, np.int64)]) for k, j in ((0, 0), (0, 1), (1, 0)))
        prob = lambda q, at, default: np.where(at >= 0, np.append(10.0 ** restore(q), default)[at], default)
        count = a.count.astype(float)
        c = count[a.w]
        one = np.where(c > 0, (1 - unknown) * c / max(n, 1), unknown)
        two = prob(pair_share, a.pair, 0.0) + (1 - _share(count, SHARE2, LAG2))[a.v] * one
        # a context that was never seen leaves all to the shorter one
        left = np.where(pair_left == NONE, 0, pair_left)
        p = prob(triple_share, a.triple, 0.0) + prob(left, a.before, 1.0) * two
        base = np.log10((c + 1) / (n + 1 * (types + 1)))
        add = lambda x: np.add.reduceat(x, a.first)
        columns = [pa.array(a.ids, mask=a.present == 0), pa.array(a.held), pa.array(a.n), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(a.n), n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = blocks.applyInArrow(ask, "block long, shard int, blob binary").repartition(partitions, "shard")
    answers = asked.mapInArrow(answer, "block long, shard int, blob binary")
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(shared.documents(spark, sf_dir))
