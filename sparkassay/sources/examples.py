"""Record files of serialized examples.

A file is a sequence of records: the length (8 bytes, little end first), its checksum (4), the bytes, their checksum (4). The
bytes are a protocol-buffer message: field 1 holds a map from names to features, and a feature is a list of byte strings
(field 1), of 32-bit floats (2) or of 64-bit integers (3), numbers packed or one by one. Files whose names end in .gz are
uncompressed. A file is read by one task.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTES, FLOAT, INT = 1, 2, 3


def records(raw: bytes) -> Iterator[bytes]:
    """The records of a file's bytes; ValueError if the file is cut off."""
    at = 0
    while at < len(raw):
        if at + 12 > len(raw):
            raise ValueError("a record's head is cut off")
        (size,) = struct.unpack_from("<Q", raw, at)
        at += 12
        if at + size + 4 > len(raw):
            raise ValueError("a record is cut off")
        yield raw[at : at + size]
        at += size + 4


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int, Any]]:
    """(number, wire type, value) of a message's fields."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} is not known")
        yield number, wire, value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _values(kind: int, raw: bytes) -> list:
    out: list = []
    for number, wire, value in _fields(raw):
        if number != 1:
            continue
        if kind == BYTES:
            out.append(value)
        elif kind == FLOAT:
            out += struct.unpack(f"<{len(value) // 4}f", value)
        elif wire == 0:
            out.append(_signed(value))
        else:
            at = 0
            while at < len(value):
                x, at = _varint(value, at)
                out.append(_signed(x))
    return out


def decode(example: bytes) -> dict[str, tuple[int, list]]:
    """{name: (kind, values)}; a feature without a list has kind 0."""
    out = {}
    for number, _, features in _fields(example):
        if number != 1:
            continue
        for entry_number, _, entry in _fields(features):
            if entry_number != 1:
                continue
            name, feature = "", b""
            for k, _, v in _fields(entry):
                if k == 1:
                    name = v.decode()
                elif k == 2:
                    feature = v
            kind, values = 0, []
            for k, _, v in _fields(feature):
                if k in (BYTES, FLOAT, INT):
                    kind, values = k, _values(k, v)
            out[name] = (kind, values)
    return out


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """A column of lists for each feature: strings if all its values are UTF-8, else binary, doubles or longs; null where an example lacks the feature. A feature of several kinds raises."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = records(gzip.decompress(content) if name.endswith(".gz") else content)
                while some := [r for _, r in zip(range(1000), found)]:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["example"])

    examples = files.mapInArrow(split, "example binary")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int]] = {}
        binary: set[str] = set()
        for b in batches:
            for raw in b.column(0).to_pylist():
                for name, (kind, values) in decode(raw).items():
                    seen.setdefault(name, set()).add(kind)
                    if kind == BYTES and name not in binary:
                        try:
                            b"\n".join(values).decode()
                        except UnicodeDecodeError:
                            binary.add(name)
        rows = [(n, k, n in binary) for n, ks in seen.items() for k in ks]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.bool_()))], ["name", "kind", "binary"])

    found: dict[str, set[int]] = {}
    binary = set()
    for r in examples.mapInArrow(kinds, "name string, kind int, binary boolean").groupBy("name", "kind").agg(F.bool_or("binary").alias("binary")).collect():
        found.setdefault(r.name, set()).add(r.kind)
        if r.binary:
            binary.add(r.name)
    columns = []
    for name in sorted(found):
        ks = found[name] - {0}
        if len(ks) > 1:
            raise ValueError(f"{name} has values of several kinds")
        kind = next(iter(ks), BYTES)
        columns.append((name, T.BinaryType() if name in binary else {BYTES: T.StringType(), FLOAT: T.DoubleType(), INT: T.LongType()}[kind]))
    schema = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in columns])
    arrow = {T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.LongType(): pa.int64()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            decoded = [decode(raw) for raw in b.column(0).to_pylist()]
            cells = []
            for name, t in columns:
                values = [d[name][1] if name in d and d[name][0] else None for d in decoded]
                if isinstance(t, T.StringType):
                    values = [None if v is None else [x.decode() for x in v] for v in values]
                cells.append(pa.array(values, pa.list_(arrow[t])))
            yield pa.RecordBatch.from_arrays(cells, [n for n, _ in columns])

    return examples.mapInArrow(rows, schema) if columns else examples.select()
