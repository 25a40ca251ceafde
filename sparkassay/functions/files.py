"""Small whole files on whatever file system Spark reads, through Hadoop's interface."""

from __future__ import annotations

import gzip

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _at(spark, path)
    return bool(fs.exists(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    _, p, fs = _at(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted."""
    _, p, fs = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def read(spark: SparkSession, path: str) -> bytes:
    """The bytes of a file, uncompressed if its name ends in .gz; OSError if there is none."""
    jvm, p, fs = _at(spark, path)
    if not fs.exists(p):
        raise OSError(f"no file {path}")
    source = fs.open(p)
    try:
        raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source))  # type: ignore[union-attr]
    finally:
        source.close()
    return gzip.decompress(raw) if path.endswith(".gz") else raw


def write(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    _, p, fs = _at(spark, path)
    sink = fs.create(p, overwrite)
    try:
        sink.write(bytearray(gzip.compress(data, mtime=0) if path.endswith(".gz") else data))
    finally:
        sink.close()


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _at(spark, path)
    fs.delete(p, True)
