"""Operator 8: line deduplication over sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least ``min_chars``
code points that ``min_docs`` documents hold lose their lines in all but the largest doc_id that holds them.

Keys go as 128-bit hashes to shards. A shard keeps a cuckoo filter and a sorted table of exact reference counts. The filter
tells new keys from possibly known ones: new keys join the table without a look-up, the others are looked up exactly.
Mappers count keys within each batch first, so a line found everywhere reaches its shard as one row a batch.
:class:`LineStore` writes filters and tables between updates: an insertion adds to the counts of the shards, a deletion takes
from them, and a key whose count reaches 0 leaves table and filter. Postings (key, doc_id) tell which keys a deleted
document held, and which document is the largest when the largest goes. So the store always judges as if built anew.

Verdicts go back to texts by broadcast while they are few (their size is checked), else by a join on doc_id and text hash.

Null and empty texts are one empty line. A row is a document: repeated rows count once each, and rows that share the
largest doc_id all keep their lines. A null doc_id counts as smaller than any other. Texts of any length are split whole.
All columns of ``docs`` stay; :func:`dedup` replaces columns that are named n_lines or n_dropped, :func:`keep_first` doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .blobs import pack, unpack

MIN_CHARS, MIN_DOCS = 20, 3
#: Verdicts (24 bytes each) up to which they are sent to every task; beyond, texts and verdicts are joined.
BROADCAST_VERDICTS = 1_000_000
NULL_ID = -(1 << 63)


class Lines:
    """Lines of a slice: bytes [start, end), row, key hashes and whether the key is long enough to count."""

    __slots__ = ("end", "first", "k1", "k2", "long", "row", "start")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, min_chars: int):
        feeds = np.flatnonzero(buf == 10)
        feed_row = np.searchsorted(offs, feeds, "right") - 1
        n_rows = len(offs) - 1
        self.start = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
        per_row = 1 + np.bincount(feed_row, minlength=n_rows)
        self.first = np.concatenate([[0], np.cumsum(per_row)])
        self.row = np.repeat(np.arange(n_rows), per_row)
        # a row's empty last line and the next row's first line start at one place: both are there, in order
        self.end = np.empty_like(self.start)
        self.end[:-1] = self.start[1:] - 1
        self.end[self.first[1:] - 1] = offs[1:]
        solid = np.flatnonzero(shared.SPACED[buf])
        a = np.searchsorted(solid, self.start)
        b = np.searchsorted(solid, self.end)
        some = b > a
        fro, to = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        fro[some], to[some] = solid[a[some]], solid[b[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        self.long = points[to] - points[fro] >= max(min_chars, 1)
        self.k1, self.k2 = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        at = np.flatnonzero(self.long)
        if len(at):
            low = shared.lowered(buf)
            self.k1[at] = shared.span_hash(low, fro[at], (to - fro)[at], 1)
            self.k2[at] = shared.span_hash(low, fro[at], (to - fro)[at], 2)

    def postings(self) -> np.ndarray:
        """One index of a line for each distinct long key of each row."""
        at = np.flatnonzero(self.long)
        order = at[np.lexsort((self.k2[at], self.k1[at], self.row[at]))]
        r, a, b = self.row[order], self.k1[order], self.k2[order]
        return order[np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; array operations, several inserts a round. Deletion undoes insertion."""

    def __init__(self, expected: int):
        self.bits = max(4, int(expected / 3.2).bit_length())
        self.table = np.zeros((1 << self.bits, 4), np.uint16)
        self.spilled: dict[tuple[int, int], int] = {}  # (lower bucket, fingerprint) that found no place; still exact

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        fp = (keys >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (keys & mask).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (shared.mix(fp.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(keys)
        hit = ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(1)
        if self.spilled:
            hit |= np.array([(min(a, b), f) in self.spilled for a, b, f in zip(one.tolist(), two.tolist(), fp.tolist())], bool)
        return hit

    def insert(self, keys: np.ndarray) -> None:
        fp, bucket, other = self._places(keys)
        for turn in range(500):
            if not len(fp):
                return
            free = self.table[bucket] == 0
            move = ~free.any(1) & (self.table[other] == 0).any(1)
            bucket = np.where(move, other, bucket)
            _, chosen = np.unique(bucket, return_index=True)  # one for each bucket and round
            rest = np.ones(len(fp), bool)
            rest[chosen] = False
            b, f = bucket[chosen], fp[chosen]
            free = self.table[b] == 0
            slot = np.where(free.any(1), free.argmax(1), (f + turn) % 4)
            out = self.table[b, slot]
            self.table[b, slot] = f
            kicked = out != 0
            moved = self._other(b[kicked], out[kicked])
            fp = np.concatenate([fp[rest], out[kicked]])
            bucket = np.concatenate([bucket[rest], moved])
            other = np.concatenate([other[rest], b[kicked]])
        for b, o, f in zip(bucket.tolist(), other.tolist(), fp.tolist()):
            key = (min(b, o), f)
            self.spilled[key] = self.spilled.get(key, 0) + 1

    def delete(self, keys: np.ndarray) -> None:
        """Takes away one fingerprint for each key; only keys that were inserted may be deleted."""
        fp, one, two = self._places(keys)
        while len(fp):
            at_one = self.table[one] == fp[:, None]
            bucket = np.where(at_one.any(1), one, two)
            hit = self.table[bucket] == fp[:, None]
            there = hit.any(1)
            place = bucket * 4 + hit.argmax(1)
            for b, o, f in zip(one[~there].tolist(), two[~there].tolist(), fp[~there].tolist()):
                key = (min(b, o), f)
                self.spilled[key] = self.spilled.get(key, 0) - 1
                if self.spilled[key] <= 0:
                    self.spilled.pop(key)
            fp, one, two, place = fp[there], one[there], two[there], place[there]
            _, chosen = np.unique(place, return_index=True)  # keys of one place wait for the next round
            self.table.reshape(-1)[place[chosen]] = 0
            rest = np.ones(len(fp), bool)
            rest[chosen] = False
            fp, one, two = fp[rest], one[rest], two[rest]


def _find(k1: np.ndarray, k2: np.ndarray, ask1: np.ndarray, ask2: np.ndarray) -> np.ndarray:
    """Places of keys in a table sorted by (k1, k2); -1 where they aren't."""
    out = np.full(len(ask1), -1)
    todo, at = np.arange(len(ask1)), np.searchsorted(k1, ask1)
    while len(todo):  # keys that share the first half stand side by side
        ok = at < len(k1)
        todo, at = todo[ok], at[ok]
        ok = k1[at] == ask1[todo]
        todo, at = todo[ok], at[ok]
        hit = k2[at] == ask2[todo]
        out[todo[hit]] = at[hit]
        todo, at = todo[~hit], at[~hit] + 1
    return out


class Shard:
    """One shard's cuckoo filter and exact table, sorted by key, of references and largest document."""

    def __init__(self, expected: int = 1 << 14):
        self.filter, self.room = CuckooFilter(expected), expected
        self.k1, self.k2, self.refs, self.largest = (np.zeros(0, np.int64) for _ in range(4))

    def _put(self, k1: np.ndarray, k2: np.ndarray, refs: np.ndarray, largest: np.ndarray) -> None:
        order = np.lexsort((k2, k1))
        self.k1, self.k2, self.refs, self.largest = k1[order], k2[order], refs[order], largest[order]

    def insert(self, k1: np.ndarray, k2: np.ndarray, refs: np.ndarray, largest: np.ndarray) -> None:
        if not len(k1):
            return
        order = np.lexsort((k2, k1))  # equal keys of a batch meet first
        k1, k2, refs, largest = k1[order], k2[order], refs[order], largest[order]
        head = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        k1, k2, refs, largest = k1[head], k2[head], np.add.reduceat(refs, head), np.maximum.reduceat(largest, head)
        if len(self.k1) + len(k1) > self.room:
            while self.room < len(self.k1) + len(k1):
                self.room *= 2
            self.filter = CuckooFilter(self.room)
            self.filter.insert(self.k1.view(np.uint64))
        maybe = np.flatnonzero(self.filter.contains(k1.view(np.uint64)))  # no false negatives: unseen keys need no look-up
        at = _find(self.k1, self.k2, k1[maybe], k2[maybe])
        known, at = maybe[at >= 0], at[at >= 0]
        self.refs[at] += refs[known]
        self.largest[at] = np.maximum(self.largest[at], largest[known])
        new = np.ones(len(k1), bool)
        new[known] = False
        self.filter.insert(k1[new].view(np.uint64))
        self._put(*(np.concatenate(x) for x in ((self.k1, k1[new]), (self.k2, k2[new]), (self.refs, refs[new]), (self.largest, largest[new]))))

    def delete(self, k1: np.ndarray, k2: np.ndarray, refs: np.ndarray, largest: np.ndarray) -> None:
        """Takes ``refs`` (distinct keys) from the counts; ``largest`` is the largest document that still holds a key. Keys without references leave."""
        at = _find(self.k1, self.k2, k1, k2)
        k1, refs, largest, at = k1[at >= 0], refs[at >= 0], largest[at >= 0], at[at >= 0]
        self.refs[at] -= refs
        self.largest[at] = largest
        stay = self.refs > 0
        self.filter.delete(self.k1[~stay].view(np.uint64))
        self.k1, self.k2, self.refs, self.largest = (x[stay] for x in self.table())

    def table(self) -> list[np.ndarray]:
        return [self.k1, self.k2, self.refs, self.largest]

    def dump(self) -> tuple[bytes, bytes, bytes]:
        """(table, filter, what found no place in it)."""
        spilled = np.array([(b, f, n) for (b, f), n in self.filter.spilled.items()], np.int64).reshape(-1, 3).T
        return pack(*self.table()), pack(self.filter.table.reshape(-1).view(np.int64)), pack(*map(np.ascontiguousarray, spilled))

    @classmethod
    def load(cls, table: bytes, places: bytes, spilled: bytes) -> Shard:
        s = cls.__new__(cls)
        s.k1, s.k2, s.refs, s.largest = unpack(table)
        s.filter = CuckooFilter.__new__(CuckooFilter)
        s.filter.table = unpack(places)[0].view(np.uint16).reshape(-1, 4).copy()
        s.filter.bits = len(s.filter.table).bit_length() - 1
        s.filter.spilled = {(b, f): n for b, f, n in zip(*(x.tolist() for x in unpack(spilled)))}
        s.room = int(3.2 * len(s.filter.table) / 2)
        return s


COUNTS = "k1 long, k2 long, refs long, largest long"
INSERT, DELETE = 0, 1


def postings(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k1, k2, doc_id, t): each long key of each row once; a null doc_id is NULL_ID; ``t`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = shared.row_ids(b.column(0)).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for at, to, buf, offs in shared.Texts(b.column(1)).slices():
                lines = Lines(buf, offs, min_chars)
                own = lines.postings()
                row = lines.row[own]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lines.k1[own].view(np.int64), lines.k2[own].view(np.int64), ids[at:to][row], text_hash(buf, offs)[row])], ["k1", "k2", "doc_id", "t"])

    return shared.only(docs, key, text).mapInArrow(run, "k1 long, k2 long, doc_id long, t long")


def text_hash(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return shared.span_hash(buf, offs[:-1], np.diff(offs), 3).view(np.int64)


def _counted(posted: DataFrame) -> DataFrame:
    """(k1, k2, refs, largest) of postings, counted within batches."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, d = (c.to_numpy() for c in b.columns)
            if not len(k1):
                continue
            order = np.lexsort((k2, k1))
            k1, k2, d = k1[order], k2[order], d[order]
            head = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(k1[head]), pa.array(k2[head]), pa.array(np.diff(np.append(head, len(k1)))), pa.array(np.maximum.reduceat(d, head))], ["k1", "k2", "refs", "largest"])

    return posted.select("k1", "k2", "doc_id").mapInArrow(combine, COUNTS)


def _gathered(batches: Iterator[pa.RecordBatch], held: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of some batches at a time, ever more of them, so that what they are merged into is copied few times."""
    some, rows = [], 0
    for b in batches:
        some.append([c.to_numpy() for c in b.columns])
        rows += b.num_rows
        if rows >= held:
            yield [np.concatenate(x) for x in zip(*some)]
            some, rows, held = [], 0, min(2 * held, 1 << 20)
    if some:
        yield [np.concatenate(x) for x in zip(*some)]


def reference_counts(posted: DataFrame) -> DataFrame:
    """(k1, k2, refs, largest) of postings: counted within batches, then in shards by key."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shard()
        for columns in _gathered(batches):
            s.insert(*columns)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in s.table()], ["k1", "k2", "refs", "largest"])

    return _counted(posted).repartition(shared.partitions(posted.sparkSession), "k1").mapInArrow(shard, COUNTS)


def drop_lines(docs: DataFrame, posted: DataFrame, verdicts: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id", broadcast: int = BROADCAST_VERDICTS) -> DataFrame:
    """``docs`` with ``text`` rewritten where lines go, and with __assay_lines and __assay_dropped, their numbers. Lines go whose key is in ``verdicts`` (k1, k2, largest) with another document as largest. A text that loses nothing stays as it is."""
    width, more = len(docs.columns), [("__assay_lines", T.LongType()), ("__assay_dropped", T.LongType())]
    text_at, key_at = docs.columns.index(text), docs.columns.index(key)

    def rewrite(b: pa.RecordBatch, gone) -> pa.RecordBatch:
        texts = shared.Texts(b.column(text_at))
        ids = shared.row_ids(b.column(key_at)).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        n_lines, n_dropped, changed = [], [], {}
        for at, to, buf, offs in texts.slices():
            lines = Lines(buf, offs, min_chars)
            drop = gone(lines, ids[at:to], at)
            n_lines.append(np.diff(lines.first))
            dropped = np.bincount(lines.row[drop], minlength=to - at)
            n_dropped.append(dropped)
            for r in np.flatnonzero(dropped):
                own = slice(lines.first[r], lines.first[r + 1])
                changed[at + int(r)] = b"\n".join(buf[s:e].tobytes() for s, e, d in zip(lines.start[own], lines.end[own], drop[own]) if not d).decode()
        column = b.column(text_at)
        if changed:
            mask = np.zeros(len(ids), bool)
            mask[list(changed)] = True
            column = pc.replace_with_mask(column.cast(pa.string()), pa.array(mask), pa.array([changed[r] for r in sorted(changed)], pa.string()))
        flat = [column if k == text_at else b.column(k) for k in range(width)]
        counts = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (n_lines, n_dropped)]
        return pa.RecordBatch.from_arrays([*flat, *counts], [str(k) for k in range(width + 2)])

    few = verdicts.limit(broadcast + 1).count()
    if few <= broadcast:
        table = verdicts.select("k1", "k2", "largest").toArrow()
        k1, k2, largest = (table[c].to_numpy() for c in ("k1", "k2", "largest"))
        order = np.lexsort((k2, k1))
        sent = docs.sparkSession.sparkContext.broadcast((k1[order], k2[order], largest[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k1, k2, largest = sent.value

            def gone(lines: Lines, ids: np.ndarray, at: int) -> np.ndarray:
                out = np.zeros(len(lines.row), bool)
                own = np.flatnonzero(lines.long)
                found = _find(k1, k2, lines.k1[own].view(np.int64), lines.k2[own].view(np.int64))
                own, found = own[found >= 0], found[found >= 0]
                out[own] = largest[found] != ids[lines.row[own]]
                return out

            for b in batches:
                yield rewrite(b, gone)

        return shared.map_rows(docs, run, *more)

    # rows of equal id and text lose the same lines, so a list is never longer than one text's lines
    losing = posted.join(verdicts.select("k1", "k2", "largest"), ["k1", "k2"]).where("doc_id != largest")
    lists = losing.groupBy(F.col("doc_id").alias("__assay_id"), F.col("t").alias("__assay_t")).agg(F.sort_array(F.collect_set(F.struct("k1", "k2"))).alias("__assay_gone"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = shared.Texts(b.column(text_at))
            own = [*b.columns, pa.array(text_hash(texts.buf, texts.offs)), shared.row_ids(b.column(key_at)).fill_null(NULL_ID)]
            yield pa.RecordBatch.from_arrays(own, [str(k) for k in range(width + 2)])

    keyed = shared.map_rows(docs, hashed, ("__assay_hash", T.LongType()), ("__assay_key", T.LongType())).toDF(*[f"c{k}" for k in range(width)], "__assay_hash", "__assay_key")
    on = (F.col("__assay_key") == F.col("__assay_id")) & (F.col("__assay_hash") == F.col("__assay_t"))
    joined = keyed.join(lists, on, "left").drop("__assay_hash", "__assay_key", "__assay_id", "__assay_t")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone_of = b.column(width)
            count = np.diff(gone_of.offsets.to_numpy())
            g1, g2 = (p.to_numpy(zero_copy_only=False) for p in gone_of.flatten().flatten()) if count.sum() else (np.zeros(0, np.int64),) * 2
            row = np.repeat(np.arange(len(count)), count)

            def gone(lines: Lines, ids: np.ndarray, at: int, g1=g1, g2=g2, row=row) -> np.ndarray:
                # lines and keys that go, of equal row and key, stand side by side once sorted
                own = np.flatnonzero(lines.long)
                mine = slice(*np.searchsorted(row, [at, at + len(ids)]))
                r = np.concatenate([row[mine] - at, lines.row[own]])
                a, z = np.concatenate([g1[mine], lines.k1[own].view(np.int64)]), np.concatenate([g2[mine], lines.k2[own].view(np.int64)])
                of_list = np.arange(len(r)) < mine.stop - mine.start
                order = np.lexsort((~of_list, z, a, r))
                r, a, z, of_list = r[order], a[order], z[order], of_list[order]
                head = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])]) if len(r) else np.zeros(0, bool)
                drops = of_list[np.flatnonzero(head)][np.cumsum(head) - 1] & ~of_list if len(r) else of_list
                out = np.zeros(len(lines.row), bool)
                out[own[order[drops] - (mine.stop - mine.start)]] = True
                return out

            yield rewrite(b, gone)

    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)] + [T.StructField(*x) for x in more]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run_joined(batches):
            yield b.rename_columns([f.name for f in fields])

    return joined.mapInArrow(named, T.StructType(fields)).toDF(*docs.columns, *[name for name, _ in more])


def _judged(docs: DataFrame, min_chars: int, min_docs: int, text: str, key: str, broadcast: int) -> DataFrame:
    posted = shared.materialize(postings(docs, min_chars, text, key), "line-postings")
    verdicts = shared.materialize(reference_counts(posted).where(F.col("refs") >= min_docs), "line-verdicts")
    return drop_lines(docs, posted, verdicts, min_chars, text, key, broadcast)


def _named(judged: DataFrame, columns: list[str]) -> DataFrame:
    own = [F.col(f"`{c}`") for c in columns if c not in ("n_lines", "n_dropped")]
    return judged.select(*own, F.col("__assay_lines").alias("n_lines"), F.col("__assay_dropped").alias("n_dropped"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id", broadcast: int = BROADCAST_VERDICTS) -> DataFrame:
    """``docs`` without the repeated lines, its columns, and n_lines and n_dropped."""
    return _named(_judged(docs, min_chars, min_docs, text, key, broadcast), docs.columns)


def keep_first(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id", broadcast: int = BROADCAST_VERDICTS) -> DataFrame:
    """``docs`` without the repeated lines, exactly its columns."""
    return shared.only(_judged(docs, min_chars, min_docs, text, key, broadcast), *docs.columns)


class LineStore:
    """Incremental line deduplication: each shard's cuckoo filter and reference counts are kept between updates.

    ``insert`` adds documents, ``delete`` takes back all that the documents of some ids added (a null id names the rows without
    id). Both read the changed documents' postings and rewrite the shards; texts inserted before aren't read again.
    """

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None):
        self.spark, self.min_chars, self.min_docs, self.shards = spark, min_chars, min_docs, shards or shared.partitions(spark)
        self.posted = spark.createDataFrame([], "k1 long, k2 long, doc_id long, t long")
        self.state = spark.createDataFrame([], "shard int, counts binary, places binary, spilled binary")

    def _update(self, changes: DataFrame, kind: int) -> None:
        """Adds or takes ``changes`` (k1, k2, refs, largest) in the shards."""
        none = lambda *names: [F.lit(None).cast(t).alias(x) for x, t in names]
        shard = F.pmod(F.xxhash64("k1"), F.lit(self.shards)).cast("int").alias("shard")
        rows = changes.select(shard, *none(("counts", "binary"), ("places", "binary"), ("spilled", "binary")), "k1", "k2", "refs", "largest")
        kept = self.state.select("*", *none(("k1", "long"), ("k2", "long"), ("refs", "long"), ("largest", "long")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            state: dict[int, Shard] = {}
            for b in batches:
                table = pa.Table.from_batches([b])
                whole = pc.is_valid(b.column(1))
                for s, *parts in zip(*(c.to_pylist() for c in table.filter(whole).columns[:4])):
                    state[s] = Shard.load(*parts)
                delta = table.filter(pc.invert(whole))
                number = delta["shard"].to_numpy()
                columns = [delta[c].to_numpy() for c in ("k1", "k2", "refs", "largest")]
                for s in np.unique(number).tolist():
                    held.setdefault(s, []).append([c[number == s] for c in columns])
            for s in sorted(set(held) | set(state)):
                own = state.pop(s, None) or Shard()
                if s in held:
                    columns = [np.concatenate(x) for x in zip(*held.pop(s))]
                    own.insert(*columns) if kind == INSERT else own.delete(*columns)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in own.dump())], ["shard", "counts", "places", "spilled"])

        both = kept.unionByName(rows).repartition(self.shards, "shard")
        self.state = shared.materialize(both.mapInArrow(run, "shard int, counts binary, places binary, spilled binary"), "line-shards")

    def insert(self, docs: DataFrame) -> None:
        new = shared.materialize(postings(docs, self.min_chars), "line-postings")
        self._update(_counted(new), INSERT)
        self.posted = self.posted.unionByName(new)

    def delete(self, doc_ids: DataFrame) -> None:
        gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        rest = shared.materialize(self.posted.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id", "t"), "line-postings")
        taken = self.posted.join(gone, "doc_id", "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("refs"))
        left = rest.groupBy("k1", "k2").agg(F.max("doc_id").alias("left"))
        self._update(taken.join(left, ["k1", "k2"], "left").select("k1", "k2", "refs", F.coalesce("left", F.lit(NULL_ID)).alias("largest")), DELETE)
        self.posted = rest

    def counts(self) -> DataFrame:
        """(k1, k2, refs, largest) of the keys that documents in the store hold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for table in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(table)], ["k1", "k2", "refs", "largest"])

        return self.state.select("counts").mapInArrow(run, COUNTS)

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs``, and n_lines and n_dropped, judged by the documents now in the store, of which ``docs`` are some."""
        verdicts = shared.materialize(self.counts().where(F.col("refs") >= self.min_docs), "line-verdicts")
        return _named(drop_lines(docs, postings(docs, self.min_chars), verdicts, self.min_chars), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(shared.only(shared.documents(spark, sf_dir), "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, count(DISTINCT r) AS n, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
judged AS (SELECT r, keyed.doc_id, i, line, held.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM top AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
