"""Collected statistics as files: one text or compressed file, records in shards, Parquet; and how they are found and merged again."""

from __future__ import annotations

import json
import zlib
from typing import Any

from pyspark.sql import SparkSession

from ..functions import files

Stats = dict[str, dict[str, Any]]
#: First bytes of the compressed form.
MAGIC = b"assay\x01"


def to_json(stats: Stats) -> str:
    return json.dumps({name: s | {"cross": [[*k, v] for k, v in s.get("cross", {}).items()]} for name, s in stats.items()})


def from_json(text: str) -> Stats:
    out = json.loads(text)
    for s in out.values():
        s["cross"] = {(x, y): v for x, y, v in s["cross"]}
        for f in s["features"].values():
            f["histograms"] = {k: [tuple(b) for b in buckets] for k, buckets in f["histograms"].items()}
    return out


def write_text(spark: SparkSession, stats: Stats, path: str) -> None:
    files.write(spark, path, to_json(stats).encode())


def write_binary(spark: SparkSession, stats: Stats, path: str) -> None:
    """One compressed file."""
    files.write(spark, path, MAGIC + zlib.compress(to_json(stats).encode()))


def _records(stats: Stats) -> list[tuple[str, str]]:
    """(path, JSON of one feature of one slice); a slice's own figures stand under the empty path."""
    out = []
    for name, s in stats.items():
        out.append(("", to_json({name: s | {"features": {}}})))
        out += [(p, to_json({name: {"features": {p: f}}})) for p, f in s["features"].items()]
    return out


def write_records(spark: SparkSession, stats: Stats, path: str, shards: int | None = None, columnar: bool = False) -> list[str]:
    """A record a line: in ``path``, or dealt by feature to ``path-00000-of-0000N``. ``columnar``: the same also as Parquet in ``path.parquet``. Returns the files."""
    records, out = _records(stats), []
    n = shards or 1
    if n < 1:
        raise ValueError("at least one shard is needed")
    for k in range(n):
        name = path if shards is None else f"{path}-{k:05d}-of-{n:05d}"
        files.write(spark, name, "".join(line + "\n" for p, line in records if zlib.crc32(p.encode()) % n == k).encode())
        out.append(name)
    if columnar:
        spark.createDataFrame(records, "path string, record string").coalesce(1).write.mode("overwrite").parquet(f"{path}.parquet")
    return out


def write_records_and_binary(spark: SparkSession, stats: Stats, records: str, binary: str, shards: int = 1, columnar: bool = False) -> None:
    write_records(spark, stats, records, shards, columnar)
    write_binary(spark, stats, binary)


def merge(parts: list[Stats]) -> Stats:
    """Shards as one; a feature of a slice may stand in one shard only."""
    out: Stats = {}
    for part in parts:
        for name, s in part.items():
            whole = out.setdefault(name, {"features": {}})
            for p, f in s["features"].items():
                if p in whole["features"]:
                    raise ValueError(f"{p} of slice {name} is there twice")
                whole["features"][p] = f
            for k, v in s.items():
                if k == "cross":
                    whole["cross"] = whole.get("cross", {}) | v
                elif k != "features":
                    whole[k] = v
    return out


def _parsed(raw: bytes) -> list[Stats]:
    if raw.startswith(MAGIC):
        return [from_json(zlib.decompress(raw[len(MAGIC) :]).decode())]
    return [from_json(line) for line in raw.decode().splitlines() if line]


def load_text(spark: SparkSession, path: str) -> Stats:
    return merge(_parsed(files.read(spark, path)))


load_binary = load_records = load_text


def load_sharded(spark: SparkSession, prefix: str) -> Stats:
    """All of ``prefix-*-of-*``; OSError if a shard is missing."""
    found = files.matching(spark, f"{prefix}-*-of-*")
    if not found or len(found) != int(found[0].rsplit("-", 1)[1].split(".")[0]):
        raise OSError(f"{len(found)} shards at {prefix}")
    return merge([part for f in found for part in _parsed(files.read(spark, f))])


def load(spark: SparkSession, path: str) -> Stats:
    """Whatever was written to ``path``: text, compressed, records, shards of them, or their Parquet; OSError if there is nothing."""
    if files.is_folder(spark, path):
        return merge([from_json(r.record) for r in spark.read.parquet(path).collect()])
    if files.exists(spark, path):
        return load_text(spark, path)
    return load_sharded(spark, path)
