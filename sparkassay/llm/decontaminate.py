"""Operator 6: benchmark decontamination with one FM-index for each training shard.

A test item's windows (10 consecutive words, or the whole of a shorter item) are the phrases. In a shard (the rows of a
task, up to a bounded size of text) words outside the phrases' vocabulary can't be part of a hit, so only runs of
vocabulary words at least as long as the shortest phrase go into the shard's FM-index, with separators between them.
All phrases are searched backwards at once, occurrences are located by sampled suffix positions, and their spans merged.

No row leaves its task. The phrases are sent to the tasks: a block of items holds about BLOCK_BYTES of text, and with a
larger benchmark a task searches each shard for the blocks one after another and merges their spans row by row. A task
holds the phrases of all blocks.

Null and empty texts have no words. Items without an id or without words take no part. Each row is judged by itself,
whatever its id, and stays one row; repeated rows are judged alike, and an empty table or benchmark gives no hit. Texts are
searched whole. Further columns are not read by :func:`find` and kept by :func:`keep_clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
SCHEMA = "n_words long, spans array<struct<first: long, past: long>>, item_ids array<long>"


class Phrases:
    """Distinct windows as symbol rows by length, with the items that hold each."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        offs = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        w = shared.Words(np.frombuffer(b"".join(t for _, t in items), np.uint8), offs, shared.ALNUM)
        self.vocabulary, symbol = np.unique(w.hash, return_inverse=True)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        symbol = symbol + 2  # 0 ends a shard, 1 separates runs
        found: dict[bytes, set[int]] = {}
        for k, (item, _) in enumerate(items):
            mine = symbol[w.first[k] : w.first[k + 1]]
            n = min(window, len(mine))
            for at in range(len(mine) - n + 1 if n else 0):
                found.setdefault(mine[at : at + n].tobytes(), set()).add(item)
        self.groups: list[tuple[np.ndarray, int]] = []  # (patterns, number of the first)
        self.items: list[np.ndarray] = []
        by_length: dict[int, list[bytes]] = {}
        for p in found:
            by_length.setdefault(len(p) // symbol.itemsize, []).append(p)
        for n, patterns in sorted(by_length.items()):
            self.groups.append((np.frombuffer(b"".join(patterns), symbol.dtype).reshape(-1, n), len(self.items)))
            self.items += [np.array(sorted(found[p]), np.int64) for p in patterns]
        self.shortest = min(by_length, default=0)
        self.item_count = np.array([len(x) for x in self.items], np.int64)
        self.item_offs = np.concatenate([[0], np.cumsum(self.item_count)])
        self.item_flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)

    def symbols(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of words in the vocabulary, their symbols)."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[where] == hashes[at]
        return at[hit], where[hit] + 2


class Shard:
    """Runs of vocabulary words of a number of rows."""

    def __init__(self, phrases: Phrases):
        self.p, self.rows, self.n_words = phrases, 0, []
        self.sym, self.row, self.word = [], [], []

    def add(self, buf: np.ndarray, offs: np.ndarray) -> None:
        w = shared.Words(buf, offs, shared.ALNUM)
        self.n_words.append(np.diff(w.first))
        if len(w) and len(self.p.vocabulary):
            at, sym = self.p.symbols(w.hash)
            if len(at):
                row = w.row[at]
                head = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])
                run = np.cumsum(head) - 1
                long_run = np.bincount(run)[run] >= self.p.shortest
                at, sym, row, head = at[long_run], sym[long_run], row[long_run], head[long_run]
                gaps = np.flatnonzero(head)  # a separator before each run
                self.sym.append(np.insert(sym, gaps, 1))
                self.row.append(np.insert(row + self.rows, gaps, -1))
                self.word.append(np.insert(at - w.first[row], gaps, -1))
        self.rows += len(offs) - 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each row; row, first, past of merged spans; row and item of items found)."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        if not self.sym:
            return n_words, none, none, none, none, none
        sym, row, word = (np.concatenate(x) for x in (self.sym, self.row, self.word))
        index = FMIndex(sym)
        cover = np.zeros(len(sym) + 1, np.int64)
        rows, items = [], []
        for patterns, number in self.p.groups:
            lo, hi = index.search(patterns)
            times = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(patterns)), times)
            if not len(which):
                continue
            place = index.locate(np.repeat(lo, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times))
            np.add.at(cover, place, 1)
            np.add.at(cover, place + patterns.shape[1], -1)
            pair = np.unique(row[place] * len(self.p.items) + which + number)
            r, k = np.divmod(pair, len(self.p.items))
            count = self.p.item_count[k]
            rows.append(np.repeat(r, count))
            items.append(self.p.item_flat[np.repeat(self.p.item_offs[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
        at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        if not len(at):
            return n_words, none, none, none, none, none
        head = np.concatenate([[True], at[1:] != at[:-1] + 1])  # separators are never covered, so spans end with their run
        tail = np.append(head[1:], True)
        found = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return n_words, row[at[head]], word[at[head]], word[at[tail]] + 1, found[0], found[1]


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    order = np.argsort(row, kind="stable")
    offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), values.take(pa.array(order)))


def _merged(hits: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hits of several blocks in the same rows as those of one; spans that overlap or touch become one."""
    if len(hits) == 1:
        return hits[0]
    row, first, past, item_row, item = (np.concatenate([h[k] for h in hits]) for k in range(1, 6))
    if not len(row):
        return hits[0]
    width = past.max() + 1  # rows don't touch
    order = np.lexsort((first, row))
    row, first = row[order], first[order]
    lo, hi = row * width + first, np.maximum.accumulate(row * width + past[order])
    head = np.concatenate([[True], lo[1:] > hi[:-1]])
    tail = np.append(head[1:], True)
    found = np.unique(np.stack([item_row, item]), axis=1)
    return hits[0][0], row[head], first[head], (hi - row * width)[tail], found[0], found[1]


def _search(sent: list, window: int, batches: Iterator[pa.RecordBatch], text_at: int, add) -> Iterator[pa.RecordBatch]:
    """Hands each shard's rows, with their results over all blocks ``sent``, to ``add``."""
    blocks = [Phrases(s.value, window) for s in sent]
    for b in batches:
        texts = shared.Texts(b.column(text_at))
        found, begun, size = [Shard(p) for p in blocks], 0, 0
        for at, to, buf, offs in texts.slices():
            for shard in found:
                shard.add(buf, offs)
            size += len(buf)
            if size >= SHARD_BYTES or to == len(texts):
                yield add(b.slice(begun, to - begun), _merged([shard.hits() for shard in found]))
                found, begun, size = [Shard(p) for p in blocks], to, 0


def _blocks(benchmark: DataFrame, block_bytes: int, text: str, key: str):
    items = shared.only(benchmark, key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).toDF("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):  # by hash, so a block is about block_bytes
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in block.collect()])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, spans, item_ids) of every row: merged spans of hit words as word numbers [first, past), and the items whose windows occur, sorted."""

    sent = list(_blocks(benchmark, block_bytes, item_text, item_key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(rows: pa.RecordBatch, got) -> pa.RecordBatch:
            n_words, row, first, past, item_row, item = got
            spans = pa.StructArray.from_arrays([pa.array(first), pa.array(past)], ["first", "past"])
            return pa.RecordBatch.from_arrays([shared.row_ids(rows.column(0)), pa.array(n_words.astype(np.int64)), _lists(row, len(n_words), spans), _lists(item_row, len(n_words), pa.array(item))], [key, "n_words", "spans", "item_ids"])

        yield from _search(sent, window, batches, 1, add)

    return shared.only(docs, key, text).mapInArrow(run, f"{key} long, {SCHEMA}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_hit_words: int = 0, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with at most ``max_hit_words`` words inside test phrases."""
    text_at = docs.columns.index(text)
    sent = list(_blocks(benchmark, block_bytes, "text", "item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(rows: pa.RecordBatch, got) -> pa.RecordBatch:
            n_words, row, first, past, _, _ = got
            return rows.filter(pa.array(shared.by_row(past - first, row, len(n_words)) <= max_hit_words))

        yield from _search(sent, window, batches, text_at, add)

    return shared.map_rows(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.past - x.first)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.col("item_ids").cast("array<string>"))), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, i, places.n, item_id FROM places JOIN windows ON places.n = windows.n AND places.s = windows.s),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""
