"""Operator 3: n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows are classes of documents with equal shingle sets, columns the shingles (by 48 bits of their hash; shingles that share
them are one column, which can only add candidates). All columns have one global order: by their count over all rows, then
by code. Two sets can only reach the threshold if they share a column among each one's first ``n - ceil(t n) + 1``, and only
if at the first column they share each has as much left as the least overlap that the two sizes ask for. Only entries that
can meet these bounds are multiplied.

Counting. A task cuts its rows into blocks. A block sends its codes, packed, to shards by code range; a code that a block
holds several times goes once, with its count, and its rows stay with the block. A shard sums the counts over blocks and
answers each block with the codes that stand in more than one row. So a shingle that a third of all rows hold is one entry
for each block.

Products, in blocks of columns:

1. Hubs. The row of a column with the fewest rarer shingles is its hub, and each row of the column meets the hub: as many
   products as entries, whatever the width. Pairs that pass the bounds are decided by the two whole texts; links are
   contracted to components.
2. The rest. Columns that still hold several components are multiplied in full between different components, without rows
   that no row of the column could reach by its size. Overlaps are summed over columns, and pairs are discarded whose sum and
   what the rest could add stay below what the sizes ask for. Pairs left are decided by their texts, so no link is lost.

Both products group and join by column with partial sums, and Spark's adaptive execution splits a column that stands out.

Null and empty texts have no shingles and are their own component; so is a row without doc_id (component null). Rows that
share a doc_id are one vertex, whatever texts they hold. Texts are taken whole. Repeated rows are copies of each other. Further
columns are not read. ``docs`` should be a table or another scan that gives a task the same rows again if it is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .blobs import pack, shard_of, unpack
from .components import components

SHINGLE, PERCENT = 5, 80
#: Ids (8 bytes each) up to which they are sent to every task.
BROADCAST_IDS = 1_000_000
#: Entries and rows that close a block.
BLOCK, BLOCK_ROWS = 1 << 19, 1 << 16
#: Shards for each shuffle partition; a task handles its shards one after the other.
SHARDS = 2
#: Bits of a shingle's hash that are dropped from its column's code.
DROP = np.uint64(16)
_A = np.uint64(0xD6E8FEB86659FD93)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(flat sorted distinct shingle hashes, offsets of each row)."""
    w = shared.Words(buf, offs)
    n_rows = len(offs) - 1
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    count = np.diff(w.first)
    h = np.zeros(len(w), np.uint64)
    for k in range(min(size, len(w))):
        h[: len(w) - k] = h[: len(w) - k] * _A + w.hash[k:]
    h = shared.mix(h)
    valid = np.arange(len(w)) + size <= w.first[1:][w.row]
    for r in np.flatnonzero((count > 0) & (count < size)):  # a short text is one shingle
        x = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for v in w.hash[w.first[r] : w.first[r + 1]]:
                x = x * _A + v
        h[w.first[r]] = shared.mix(np.array([x]) ^ _A)[0]
        valid[w.first[r]] = True
    flat = h[valid]
    to = np.concatenate([[0], np.cumsum(np.bincount(w.row[valid], minlength=n_rows))])
    for a, b in zip(to[:-1].tolist(), to[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    starts = to[:-1][to[:-1] < to[1:]]
    keep[starts] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[to]


def set_keys(flat: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    none = np.zeros(1, np.uint64)
    one = np.concatenate([none, np.cumsum(shared.mix(flat ^ _A), dtype=np.uint64)])
    two = np.concatenate([none, np.cumsum(shared.mix(flat + _A), dtype=np.uint64)])
    return (one[to[1:]] - one[to[:-1]]).view(np.int64), (two[to[1:]] - two[to[:-1]]).view(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Columns, from the rarest on, among which a set of ``n`` shares one with any set it links to."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


HOME, ASK, ANSWER = 0, 1, 2


class Block:
    """Rows of a task and the incidence of one row of each class among them."""

    def __init__(self):
        self.ids, self.present, self.n, self.k1, self.k2, self.flat = [], [], [], [], [], []
        self.entries = self.rows = 0

    def add(self, ids: np.ndarray, present: np.ndarray, flat: np.ndarray, cut: np.ndarray) -> None:
        k1, k2 = set_keys(flat, cut)
        for held, x in ((self.ids, ids), (self.present, present), (self.n, np.diff(cut)), (self.k1, k1), (self.k2, k2), (self.flat, flat >> DROP)):
            held.append(x)
        self.entries += len(flat)
        self.rows += len(ids)

    def full(self) -> bool:
        return self.entries >= BLOCK or self.rows >= BLOCK_ROWS

    def close(self, shards: int) -> tuple[bytes, bytes, list[tuple[int, bytes]]]:
        """(rows, entries of codes held several times, [(shard, codes each with its row, or less than 0: how often it is held)])."""
        ids, present, n, k1, k2, flat = (np.concatenate(x) for x in (self.ids, self.present, self.n, self.k1, self.k2, self.flat))
        fit = np.flatnonzero(present & (n > 0))  # a row without an id is not posted, so it never stands for its class
        order = fit[np.lexsort((k2[fit], k1[fit]))]
        posted = np.zeros(len(n), bool)
        if len(order):
            posted[order[np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])]] = True
        code, row = flat[np.repeat(posted, n)], np.repeat(np.arange(len(n))[posted], n[posted])
        order = np.argsort(code)
        code, row = code[order], row[order]
        head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(code)))
        many = np.repeat(count > 1, count)
        ask, mark = code[head], np.where(count > 1, -count, row[head])
        cuts = np.searchsorted(shard_of(ask << DROP, shards), np.arange(shards + 1))
        asked = [(s, pack(ask[a:b], mark[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return pack(ids, present, n, k1, k2), pack(code[many], row[many]), asked


def place(rows: list[np.ndarray], own: list[np.ndarray], answers: list[list[np.ndarray]], percent: int) -> list[np.ndarray]:
    """(column, row, position) of a block's entries within the prefixes, without those of columns that no other row holds."""
    n = rows[2]
    code, mark, count = (np.concatenate(x) for x in zip(*answers)) if answers else (np.zeros(0, np.int64),) * 3
    alone = mark >= 0
    shared_code, shared_count = code[~alone], count[~alone]
    order = np.argsort(shared_code)
    at = order[np.searchsorted(shared_code, own[0], sorter=order)]
    code, row, count = np.concatenate([code[alone], own[0]]), np.concatenate([mark[alone], own[1]]), np.concatenate([count[alone], shared_count[at]])
    order = np.lexsort((code, count, row))
    code, row = code[order], row[order]
    held = np.bincount(row, minlength=len(n))
    # what no other row holds comes first, in any order
    position = np.arange(len(row)) - (np.cumsum(held) - held)[row] + (n - held)[row]
    keep = position < prefix_length(n, percent)[row]
    return [code[keep], row[keep], position[keep]]


def incidence(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of two kinds: (false, doc_id, k1, k2, n) of each document; (true, doc_id, k1, null, n, column, pos) of each entry that is multiplied."""
    tasks = shared.partitions(docs.sparkSession)
    shards = SHARDS * tasks
    binary = "kind int, shard int, block long, blob binary, more binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def closed(block: Block) -> pa.RecordBatch:
            rows, own, asked = block.close(shards)
            kind = [HOME] + [ASK] * len(asked)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([number % shards, *(s for s, _ in asked)], pa.int32()), pa.array([number] * len(kind), pa.int64()), pa.array([rows, *(x for _, x in asked)], pa.binary()), pa.array([own] + [None] * len(asked), pa.binary())], ["kind", "shard", "block", "blob", "more"])

        block = Block()
        for b in batches:
            ids = shared.row_ids(b.column(0))
            present, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for at, to, buf, offs in shared.Texts(b.column(1)).slices():
                block.add(ids[at:to], present[at:to], *shingles(buf, offs, size))
                if block.full():
                    yield closed(block)
                    block, number = Block(), number + 1
        if block.rows:
            yield closed(block)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "block", "blob", "more"]
        held: dict[int, list] = {}
        for b in batches:
            home = np.flatnonzero(b.column(0).to_numpy() == HOME)
            if len(home):
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(home)) for k in (0, 2, 3, 4)], names)
            for kind, shard, block, blob in zip(*(b.column(k).to_pylist() for k in range(4))):
                if kind == ASK:
                    held.setdefault(shard, []).append((block, blob))
        for shard in sorted(held):
            blocks, asked = zip(*((block, unpack(blob)) for block, blob in held.pop(shard)))
            code, mark = (np.concatenate(x) for x in zip(*asked))
            order = np.argsort(code)
            ordered = code[order]
            head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            count = np.empty(len(code), np.int64)
            count[order] = np.repeat(np.add.reduceat(np.maximum(1, -mark)[order], head), np.diff(np.append(head, len(code))))
            del order, ordered
            out, at = [], 0
            for c, m in asked:
                n = count[at : at + len(c)]
                at += len(c)
                send = np.flatnonzero(n > 1)
                out.append(pack(c[send], m[send], n[send]))
            yield pa.RecordBatch.from_arrays([pa.array([ANSWER] * len(out), pa.int32()), pa.array(blocks, pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, answers = {}, {}
        for b in batches:
            for kind, block, blob, more in zip(*(c.to_pylist() for c in b.columns)):
                if kind == HOME:
                    home[block] = (blob, more)
                else:
                    answers.setdefault(block, []).append(blob)
        names = ["entry", "doc_id", "k1", "k2", "n", "column", "pos"]
        for block, (rows, own) in home.items():
            rows, own = unpack(rows), unpack(own)
            ids, present, n, k1, k2 = rows
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), pa.array(ids, mask=present == 0), pa.array(k1), pa.array(k2), pa.array(n), none, none], names)
            column, row, position = place(rows, own, [unpack(x) for x in answers.pop(block, [])], percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(row), bool)), pa.array(ids[row]), pa.array(k1[row]), pa.nulls(len(row), pa.int64()), pa.array(n[row]), pa.array(column), pa.array(position)], names)

    asked = shared.only(docs, key, text).mapInArrow(shared.released(ask), binary).repartition(tasks, "shard")
    answered = asked.mapInArrow(shared.released(answer), "kind int, block long, blob binary, more binary").repartition(tasks, "block")
    return answered.mapInArrow(shared.released(settle), "entry boolean, doc_id long, k1 long, k2 long, n long, column long, pos long")


def _reaches(n: Column, pos: Column, other_n: Column, other_pos: Column, percent: int) -> Column:
    """Whether from here on, where each has ``n - pos`` left, two sets can still have the overlap that their sizes ask for."""
    return (100 + percent) * F.least(n - pos, other_n - other_pos) >= percent * (n + other_n)


def _ordered(met: DataFrame, *more: str) -> DataFrame:
    """(ka, kb, a, b) of rows (k1, doc_id, hub_k1, hub_id), the smaller class first."""
    first = F.col("k1") < F.col("hub_k1")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(pick("k1", "hub_k1").alias("ka"), pick("hub_k1", "k1").alias("kb"), pick("doc_id", "hub_id").alias("a"), pick("hub_id", "doc_id").alias("b"), *more)


def _hub_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each row of a column with its hub, the one with the fewest rarer shingles; each pair of classes once."""
    hubs = entries.groupBy("column").agg(F.min(F.struct("pos", "k1", "doc_id", "n")).alias("h"), F.max("k1").alias("x"), F.min("k1").alias("y")).where("x <> y")
    hubs = hubs.select("column", F.col("h.k1").alias("hub_k1"), F.col("h.doc_id").alias("hub_id"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
    met = entries.join(hubs, "column").where(F.col("k1") != F.col("hub_k1")).where(_reaches(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), percent))
    # a hub pair is met only where that hub is, so its sum over columns would bound nothing
    return _ordered(met).groupBy("ka", "kb").agg(F.min("a").alias("a"), F.min("b").alias("b"))


def _bounded(met: DataFrame) -> DataFrame:
    """(ka, kb, a, b) of pairs met at columns, whose overlap summed over columns (``common``) can with what the last of them left to the two (``rest``) reach what they need."""
    # a class posted by several blocks, or a pair met from both sides, is one at each column
    each = _ordered(met, "column", "need", "left").groupBy("ka", "kb", "column").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.min("need").alias("need"), F.min("left").alias("left"))
    both = each.groupBy("ka", "kb").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("common"), F.min("left").alias("rest"), F.min("need").alias("need"))
    return both.where("common - 1 + rest >= need").select("ka", "kb", "a", "b")


def _rest_pairs(entries: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a column, without those that the bounds exclude."""
    reach = F.expr(f"{100 + percent} * (n - pos) - {percent} * n")
    labelled = entries.join(roots, entries.doc_id == roots.node, "left").select("column", "doc_id", "k1", "n", "pos", F.coalesce("root", "doc_id").alias("label"))
    ends = labelled.groupBy("column").agg(F.min(F.struct("pos", "k1", "label")).alias("h"), F.min("label").alias("x"), F.max("label").alias("y"), F.max(reach).alias("far"), F.min("n").alias("small")).where("x <> y")
    # a row whose size the farthest reach of the column excludes, or that reaches none of its sizes, has no partner there
    mixed = labelled.join(ends.select("column", F.col("h.label").alias("main"), "far", "small"), "column").where((F.col("far") >= percent * F.col("n")) & (reach >= percent * F.col("small")))
    # few rows are left of many partitions; rebalanced, they are few files
    mixed = shared.materialize(mixed.select("column", "doc_id", "k1", "n", "pos", "label", "main").hint("rebalance"), "mixed")
    one = mixed.where("label <> main").select("column", F.col("doc_id").alias("hub_id"), F.col("k1").alias("hub_k1"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("label").alias("hub_label"))
    met = mixed.join(one, "column").where((F.col("label") != F.col("hub_label")) & _reaches(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), percent))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("hub_n")) / (100 + percent))
    return _bounded(met.withColumn("need", need).withColumn("left", F.least(F.expr("n - pos"), F.expr("hub_n - hub_pos"))))


def _small(ids: DataFrame) -> DataFrame:
    """With a broadcast hint while the ids are few, so that only the texts they name are shuffled; beyond, Spark joins both sides by id."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def overlaps(x: np.ndarray, x_row: np.ndarray, y: np.ndarray, y_row: np.ndarray, rows: int) -> np.ndarray:
    """For each row the shingles that both sides hold; each side's are distinct within a row."""
    h, row = np.concatenate([x, y]), np.concatenate([x_row, y_row])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    return np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows)


def decide(docs: DataFrame, pairs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """(a, b): the documents of ``pairs`` whose whole texts link. Only documents of some pair are read into the joins."""
    ids = _small(shared.materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids"))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).join(ids, "doc_id", "left_semi")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, buf, offs in shared.Texts(b.column(1)).slices():
                k1, _ = set_keys(*shingles(buf, offs, size))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(k1), b.column(1).slice(at, to - at)], ["doc_id", "k", "t"])

    # rows that share a doc_id but not their words are different classes; repeated ones are one. Written after the shuffle, a few texts are few files
    texts = shared.materialize(texts.mapInArrow(shared.released(keyed), "doc_id long, k long, t string").dropDuplicates(["doc_id", "k"]), "pair-texts")
    rows = pairs.join(texts.toDF("a", "ka", "ta"), ["a", "ka"]).join(texts.toDF("b", "kb", "tb"), ["b", "kb"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = shared.Texts(batch.column(2)), shared.Texts(batch.column(3))
            link, at = np.zeros(batch.num_rows, bool), 0
            both = left.offs + right.offs
            while at < batch.num_rows:  # about a slice of text at a time
                to = min(batch.num_rows, max(at + 1, int(np.searchsorted(both, both[at] + shared.SLICE_BYTES, "right")) - 1))
                sides = []
                for t in (left, right):
                    flat, cut = shingles(t.buf[t.offs[at] : t.offs[to]], t.offs[at : to + 1] - t.offs[at], size)
                    sides.append((flat, np.repeat(np.arange(to - at), np.diff(cut)), np.diff(cut)))
                (x, x_row, nx), (y, y_row, ny) = sides
                common = overlaps(x, x_row, y, y_row, to - at)
                link[at:to] = (common > 0) & (100 * common >= percent * (nx + ny - common))
                at = to
            got = batch.filter(pa.array(link))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["a", "b"])

    return rows.mapInArrow(shared.released(run), "a long, b long")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    table = shared.materialize(incidence(docs, size, percent, text, key), "incidence")
    rows = table.where("NOT entry").select("doc_id", "n", "k1", "k2")
    entries = table.where("entry").select("column", "doc_id", "k1", "n", "pos")
    # classes of equal sets: the smallest doc_id of each, counted in salted parts first, as one class may hold a third of all rows
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt")
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    parts = some.groupBy("k1", "k2", salt).agg(F.min("doc_id").alias("part"))
    tops = parts.groupBy("k1", "k2").agg(F.min("part").alias("top"))
    copies = some.select("doc_id", "k1", "k2", salt).join(parts.join(tops, ["k1", "k2"]), ["k1", "k2", "salt"]).where("doc_id <> top").select(F.col("doc_id").alias("a"), F.col("top").alias("b")).distinct()
    pairs = shared.materialize(_hub_pairs(entries, percent), "hub-pairs")
    links = shared.materialize(decide(docs, pairs, size, percent, text, key).unionByName(copies), "links")
    roots = components(links)
    rest = shared.materialize(_rest_pairs(entries, roots, percent), "rest-pairs")
    if rest.limit(1).count():
        more = shared.materialize(decide(docs, rest, size, percent, text, key), "links")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return rows.join(roots, rows.doc_id == roots.node, "left").select(rows.doc_id, F.col("n").alias("n_shingles"), F.coalesce("root", rows.doc_id).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are whatever their names, without those whose component has a smaller doc_id. Rows without doc_id stay."""
    found = shared.materialize(join(docs, text=text, key=key).where("component_id <> doc_id").select(F.col("doc_id").alias("__assay_gone")).distinct(), "near-copies")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.join(found, plain[f"c{docs.columns.index(key)}"] == found["__assay_gone"], "left_anti").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(shared.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, doc_id, count(*) AS n FROM shingles GROUP BY r, doc_id),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM common JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y
  WHERE 100 * c >= 80 * (a.n + b.n - c) AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL),
both_ways AS (SELECT u, v FROM linked UNION SELECT v, u FROM linked),
reach AS (SELECT u, v FROM both_ways UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u),
smallest AS (SELECT u, min(v) AS least FROM reach GROUP BY u)
SELECT words.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(words.doc_id, coalesce(least, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (r) LEFT JOIN smallest ON words.doc_id = smallest.u
"""
