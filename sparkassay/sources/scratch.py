"""Intermediate tables in the cluster's shared folder, and their removal."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..functions import files

#: How Hadoop writes scratch tables to local folders: without checksum files, as it starts a process for each file to set its permissions. Until
#: that process runs its program, it counts with all the memory of the executor that started it. Other file systems don't heed this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Folders of each open scope; the first list is that of the whole process.
_made: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` or, where that is unset, the context's checkpoint folder. Only a session on one machine may have neither: it gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="assay-")
        spark.conf.set("spark.checkpoint.dir", where)
        _made[0].append(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of that name that isn't there yet; it goes with its scope, at the latest when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again, so that a lost executor costs no rerun of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made within are removed in the end, but for the last one, which then belongs to the scope around; it is what the list given holds."""
    _made.append([])
    kept: list[str] = []
    try:
        yield kept
    finally:
        *gone, last = _made.pop() or [""]
        remove(spark, gone)
        if last:
            kept.append(last)
            _made[-1].append(last)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files.remove(spark, path)
        for held in _made:
            if path in held:
                held.remove(path)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        remove(spark, [p for held in _made for p in held])
    except Exception:  # noqa: BLE001  the session may be closing
        return
