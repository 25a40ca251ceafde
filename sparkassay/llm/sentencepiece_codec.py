"""Operator 1: SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text becomes units (a run of spaces with the word behind it; control characters apart) that no merge can cross.
All new units of a batch are merged together: one flat symbol array, the minimum pair rank of each unit by a segmented
minimum, that rank's leftmost occurrences merged at once, then compaction, until no unit has a pair left. A unit's later
occurrences wait for the next round when an earlier merge makes a pair of the same or a better rank, so the order equals
the library's priority queue.

Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole. Each row stands
alone, so repeated rows and ties get equal results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .pieces import NO_RANK, SPACE, PieceModel, load

_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n\r\t]*|[\n\r\t]+|[^{SPACE}\n\r\t]+")
#: Distinct units a worker keeps before it starts its store anew (memory only; results are the same).
STORE_UNITS = 150_000


def merge_units(model: PieceModel, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets) of the units."""
    n = len(units)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    size = np.array([len(u) for u in units], np.int64)
    cps = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sym = model.char_id[cps]
    sym = np.where(sym < 0, -1 - cps, sym).astype(np.int32)  # negative: an unknown character
    unit = np.repeat(np.arange(n), size)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank, made = _pairs(model, sym, unit)
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(rank, starts)
        length = np.diff(np.concatenate([starts, [len(sym)]]))
        live = np.repeat(best != NO_RANK, length)
        if not live.all():
            done.append((unit[~live], sym[~live]))
            sym, unit, rank, made = sym[live], unit[live], rank[live], made[live]
            if not len(sym):
                break
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            length = np.diff(np.concatenate([starts, [len(sym)]]))
            best = best[best != NO_RANK]
        cand = np.flatnonzero(rank == np.repeat(best, length))
        run = np.cumsum(np.concatenate([[0], (np.diff(cand) > 1) | (unit[cand[1:]] != unit[cand[:-1]])]))
        first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        at = cand[(np.arange(len(cand)) - first[run]) % 2 == 0]  # of overlapping ones the leftmost go
        at = _in_order(model, sym, unit, made, rank, at)
        sym = sym.copy()
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        sym, unit, rank, made = sym[keep], unit[keep], rank[keep], made[keep]
        touched = np.zeros(len(sym) + 1, bool)
        touched[moved[at]] = touched[moved[at] - 1] = True  # the last cell takes -1
        again = np.flatnonzero(touched[:-1])
        right = np.minimum(again + 1, len(sym) - 1)
        r, m = model.joined(sym[again], sym[right])
        apart = (again + 1 >= len(sym)) | (unit[again] != unit[right])
        rank[again], made[again] = np.where(apart, NO_RANK, r), m
    unit, sym = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(unit, kind="stable")
    return _spell_unknown(model, unit[order], sym[order], n)


def _pairs(model: PieceModel, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank, made = model.joined(sym[:-1], sym[1:])
    rank = np.where(unit[:-1] == unit[1:], rank, NO_RANK)
    return np.append(rank, NO_RANK), np.append(made, -1)


def _in_order(model: PieceModel, sym: np.ndarray, unit: np.ndarray, made: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each unit the merges up to the first one that makes a neighbouring pair at least as good as the present rank."""
    same = unit[at[1:]] == unit[at[:-1]]
    if not same.any():
        return at
    n, r, u = len(sym), rank[at], unit[at]
    beyond = np.minimum(at + 2, n - 1)
    right, _ = model.joined(made[at], sym[beyond])
    bad = (right <= r) & (at + 2 < n) & (unit[beyond] == u)
    prior = np.concatenate([[False], same & (at[1:] - at[:-1] == 2)])
    left_sym = np.where(prior, np.concatenate([[-1], made[at[:-1]]]), sym[np.maximum(at - 1, 0)])
    left, _ = model.joined(left_sym, made[at])
    bad |= (left <= r) & (at > 0) & (unit[np.maximum(at - 1, 0)] == u)
    if not bad.any():
        return at
    seen = np.cumsum(bad) - bad  # of earlier merges, counted over all units
    head = np.concatenate([[True], ~same])
    base = seen[np.flatnonzero(head)][np.cumsum(head) - 1]
    return at[seen == base]


def _spell_unknown(model: PieceModel, unit: np.ndarray, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    unknown = sym < 0
    if unknown.any():
        cp = np.where(unknown, -1 - sym.astype(np.int64), 0)
        width = 1 + (cp > 0x7F).astype(int) + (cp > 0x7FF) + (cp > 0xFFFF)
        which = np.repeat(np.arange(len(sym)), width)
        k = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
        w, c = width[which], cp[which]
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w]
        byte = np.where(k == 0, head | (c >> (6 * (w - 1))), 0x80 | ((c >> (6 * np.maximum(w - 1 - k, 0))) & 0x3F))
        sym, unit = np.where(unknown[which], model.byte_ids[byte & 0xFF], sym[which]), unit[which]
    return sym.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=n))])


class _Units(dict):
    """Number of each unit met. A word stands for itself with one space before it, or, from a line feed on, for itself; a tuple for its only item."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key[0] if isinstance(key, tuple) else key if key[:1] == "\n" else SPACE + key)
        return n


def _split(text: str) -> list:
    if not text:
        return []
    if "  " in text or text[0] == " " or SPACE in text:
        return [(u,) for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]
    return text.replace("\n", " \n").split(" ")


class Codec:
    """Encodes and decodes batches; keeps the ids of the units it has met."""

    def __init__(self, data: bytes):
        self.model = load(data)
        self._clear()

    def _clear(self) -> None:
        self.known = _Units()
        self.ids, self.offs, self.used = np.zeros(1 << 20, np.int32), np.zeros(1, np.int64), 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of the texts."""
        if len(self.known) > STORE_UNITS:
            self._clear()
        split = [_split(t) for t in texts]
        of = np.array(list(map(self.known.__getitem__, chain.from_iterable(split))), np.int64)
        new, self.known.new = self.known.new, []
        if new:
            ids, offs = merge_units(self.model, new)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.offs = np.concatenate([self.offs, self.used + offs[1:]])
            self.used += len(ids)
        counts = self.offs[of + 1] - self.offs[of]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.offs[of] - (ends - counts), counts) + np.arange(total)]
        units_to = np.cumsum([len(x) for x in split]) if split else np.zeros(0, np.int64)
        return flat, np.concatenate([[0], np.concatenate([[0], ends])[units_to]]).astype(np.int64)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The texts in UTF-8: byte pieces join, a bad byte becomes U+FFFD, the dummy space in front goes."""
        m = self.model
        size = m.text_offs[ids + 1] - m.text_offs[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = m.text_bytes[np.repeat(m.text_offs[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        out, first = [], m.byte_ids[0]
        to = ends[offs]
        for k in range(len(offs) - 1):
            mine = flat[to[k] : to[k + 1]]
            if mine[:1] == b" " and not first <= ids[offs[k]] < first + 256:
                mine = mine[1:]
            try:
                mine.decode()
            except UnicodeDecodeError:
                mine = self._decode_slowly(ids[offs[k] : offs[k + 1]])
            out.append(mine)
        return out

    def _decode_slowly(self, ids: np.ndarray) -> bytes:
        m, out, run = self.model, b"", b""
        first = int(m.byte_ids[0])

        def runs(raw: bytes) -> bytes:
            good = b""
            while raw:
                try:
                    raw.decode()
                    return good + raw
                except UnicodeDecodeError as e:
                    good, raw = good + raw[: e.start] + b"\xef\xbf\xbd", raw[e.start + 1 :]
            return good

        seen = False
        for i in ids.tolist():
            if first <= i < first + 256:
                run += bytes([i - first])
                continue
            out, run = out + runs(run), b""
            piece = m.text_bytes[m.text_offs[i] : m.text_offs[i + 1]].tobytes()
            if not out and not seen and piece[:1] == b" " and i != m.unknown:
                piece, seen = piece[1:], True
            out += piece
        return out + runs(run)


_codecs: dict[bytes, Codec] = {}


def codec(data: bytes) -> Codec:
    if data not in _codecs:
        _codecs.clear()
        _codecs[data] = Codec(data)
    return _codecs[data]


def model_bytes(path: str) -> bytes:
    """A vocabulary file of fixed size, read on the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _strings(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row."""
    return _run(docs, path, text, key, "ids array<int>", lambda ids, offs, c: [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))], ["ids"])


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes its ids again, and digests both."""

    def digests(ids: np.ndarray, offs: np.ndarray, c: Codec) -> list[pa.Array]:
        spelled = ",".join(map(str, ids.tolist()))  # once for the slice; cut below
        width = 2 + np.searchsorted([10, 100, 1000, 10_000, 100_000, 1_000_000], ids, "right")  # digits and a comma
        cut = np.concatenate([[0], np.cumsum(width)])[offs]
        shas = [hashlib.sha256(spelled[a : max(a, b - 1)].encode()).hexdigest() for a, b in zip(cut[:-1], cut[1:])]
        return [pa.array(np.diff(offs)), pa.array(shas), pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(ids, offs)])]

    return _run(docs, path, text, key, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, ["n_tokens", "ids_sha256", "decoded_sha256"])


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids array<int>); null ids give a null text."""
    data = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data)
        for b in batches:
            lists = b.column(1)
            offs = lists.offsets.to_numpy().astype(np.int64)
            texts = c.decode(lists.values.to_numpy(zero_copy_only=False).astype(np.int32)[offs[0] : offs[-1]], offs - offs[0])
            gone = lists.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([shared.row_ids(b.column(0)), pa.array([None if g else t.decode() for g, t in zip(gone, texts)], pa.string())], [key, "text"])

    return shared.only(rows, key, ids).mapInArrow(shared.released(run), f"{key} long, text string")


def _run(docs: DataFrame, path: str, text: str, key: str, schema: str, made, names: list[str]) -> DataFrame:
    data = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data)
        for b in batches:
            t = shared.Texts(b.column(1))
            keys = shared.row_ids(b.column(0))
            for at, to, buf, offs in t.slices():
                ids, cut = c.encode(_strings(buf, offs))
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), *made(ids, cut, c)], [key, *names])

    return shared.only(docs, key, text).mapInArrow(shared.released(run), f"{key} long, {schema}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(shared.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
