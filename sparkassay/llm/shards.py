"""Operator 10: dataset sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards. Shards of one tier (sizes on disk within a factor ``fanout``) are merged
once ``fanout`` of them, or a target's worth, have gathered. What a merge would set off in the next tiers is worked out from
sizes first, so one compaction rewrites a row at most once, and all of them about log(target / arrival) times. A run's files
are read by one task and written as one file of about ``target_bytes``; nothing is shuffled or joined.

Each change writes new files first and then commits a manifest: a version lists the shards it adds and removes, and each
``CHECKPOINT``-th version lists all. A version is written beside and then given its final name, which fails if another
writer was first (a hard link on local file systems, a rename elsewhere: the store must refuse to rename onto a file, as
HDFS does). The writer then tries the next version, and raises ``Conflict`` if what it removes is gone. So a reader sees one
version or the next, never a mixture. ``vacuum`` removes manifests beyond the newest ``keep`` and the files that no
remaining version names, if they are older than a grace period, in which other writers commit what they have written.

All data moves through Spark's readers and writers and the manifest through Hadoop's file system, so a lost executor
costs the repetition of its tasks, and any store that Spark reads will do.

Rows are kept as they are, in any order: null and empty texts, null ids, ties and repeated rows included, and all columns, whatever their
names. A file larger than the target stays as it is. An empty table adds no shard but a version.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

TARGET_BYTES, FANOUT = 64 << 20, 4
#: Runs merged in one job; the rest follow in further jobs of the same commit.
RUNS_A_JOB = 128
#: Each version of which this is a factor lists all shards.
CHECKPOINT = 16
#: Spark 4.1 joins the single partitions of a union into one, unless told not to.
ZIPPED_UNIONS = "spark.sql.unionOutputPartitioning"
KEEP_VERSIONS, GRACE_SECONDS = 10, 24 * 3600


class Conflict(RuntimeError):
    """Another writer has removed what this change builds on."""


class ShardStore:
    """A dataset in ``path``: ``manifest/v<N>.json`` describes the shards of each version, ``data/`` holds them."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self.jvm = spark._jvm
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    # --- manifest
    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/manifest")
        if not self.fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        oldest = self._load("oldest")["version"] if "oldest.json" in names else 0
        return sorted(v for v in (int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")) if v >= oldest)

    def _load(self, name: str) -> dict:
        source = self.fs.open(self._path(f"{self.path}/manifest/{name}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"file", "tier", "rows", "bytes"}]}; a version that is no longer kept raises KeyError."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "shards": []}
        version = have[-1] if version is None else version
        if version not in have:
            raise KeyError(f"version {version} is not kept")
        steps, at = [], version
        while not steps or not steps[-1]["full"]:
            steps.append(self._load(f"v{at}"))
            at -= 1
        shards: dict[str, dict] = {}
        for step in reversed(steps):
            for file in step["remove"]:
                del shards[file]
            shards.update({s["file"]: s for s in step["add"]})
        return {"version": version, "schema": steps[0]["schema"], "shards": [shards[f] for f in sorted(shards)]}

    def _publish(self, version: int, step: dict) -> bool:
        """Whether this writer was the first to write the version."""
        final = self._path(f"{self.path}/manifest/v{version}.json")
        beside = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        sink = self.fs.create(beside, False)
        sink.write(bytearray(json.dumps(step).encode()))
        sink.close()
        try:
            if self.fs.getUri().getScheme() != "file":
                return not self.fs.exists(final) and self.fs.rename(beside, final)
            local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            try:  # a rename would replace a file that is there
                self.jvm.java.nio.file.Files.createLink(local(final), local(beside))
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception):
                    return False
                raise
        finally:
            self.fs.delete(beside, False)

    def _commit(self, add: list[dict], remove: list[str], schema: str) -> dict:
        while True:
            base = self.manifest()
            if base["schema"] and base["schema"] != schema:
                raise ValueError(f"the dataset has columns {base['schema']}, not {schema}")
            have = {s["file"]: s for s in base["shards"]}
            if gone := set(remove) - set(have):
                raise Conflict(f"{len(gone)} shards to replace are in version {base['version']} no longer")
            version = base["version"] + 1
            full = version % CHECKPOINT == 0 or version == 1
            shards = [s for f, s in have.items() if f not in set(remove)] + add
            step = {"version": version, "schema": schema, "full": full, "add": shards if full else add, "remove": [] if full else sorted(remove)}
            if self._publish(version, step):
                return {"version": version, "schema": schema, "shards": shards}

    # --- files
    def tier(self, size: int) -> int:
        """0 for the target's size and more, one more for each ``fanout``-th of it."""
        tier = 0
        while size * 2 < self.target and tier < 12:
            size, tier = max(1, size) * self.fanout, tier + 1
        return tier

    def _files(self, where: str) -> list[tuple[str, int]]:
        status = self.fs.listStatus(self._path(where))
        return sorted((s.getPath().toString(), s.getLen()) for s in status if s.getPath().getName().endswith(".parquet"))

    def _folder(self, kind: str) -> str:
        return f"{self.path}/data/{kind}-{uuid.uuid4().hex}"

    def append(self, arrivals: DataFrame) -> dict:
        """Commits the rows as small shards, one for each partition they arrive in."""
        where = self._folder("arrival")
        arrivals.write.option("compression", "zstd").parquet(where)
        return self._arrived(where, arrivals._jdf.schema().toDDL())

    def adopt(self, folder: str, schema: str) -> dict:
        """Commits a folder of Parquet files as shards. It is moved into the store, on the same file system, without being read."""
        where = self._folder("arrival")
        self.fs.mkdirs(self._path(f"{self.path}/data"))
        if not self.fs.rename(self._path(folder), self._path(where)):
            raise OSError(f"{folder} could not be moved")
        return self._arrived(where, schema)

    def _arrived(self, where: str, schema: str) -> dict:
        sizes = self._files(where)
        # counts come from the files' footers
        counted = self.spark.read.schema(schema).parquet(where).groupBy(F.col("_metadata.file_name").alias("f")).count() if sizes else None
        rows = dict(counted.collect()) if sizes else {}
        shards = [{"file": f, "tier": self.tier(n), "rows": rows[f.rpartition("/")[2]], "bytes": n} for f, n in sizes if rows.get(f.rpartition("/")[2])]
        return self._commit(shards, [], schema)

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge, each of two shards or more: of each tier below the target's those that reach ``fanout`` or a target's worth of bytes, larger ones first, filled up to the target; and on with what they would give."""
        groups = [([s], s["bytes"]) for s in sorted(shards, key=lambda s: (-s["bytes"], s["file"]))]
        while True:
            merged, rest = [], []
            by_tier: dict[int, list] = {}
            for g in groups:
                by_tier.setdefault(self.tier(g[1]), []).append(g)
            for tier, own in sorted(by_tier.items()):
                if tier == 0 or len(own) < self.fanout and sum(n for _, n in own) < self.target:
                    rest += own
                    continue
                run: list[dict] = []
                size = held = 0
                for g, n in own:
                    run, size, held = run + g, size + n, held + 1
                    if size >= self.target:
                        merged.append((run, size, held))
                        run, size, held = [], 0, 0
                if held:
                    merged.append((run, size, held))
            groups = sorted(rest + [(run, size) for run, size, _ in merged], key=lambda g: (-g[1], g[0][0]["file"]))
            if all(held < 2 for _, _, held in merged):
                return [run for run, _ in groups if len(run) > 1]

    def compact(self) -> dict:
        """Merges what the tiers ask for and commits it. A row is rewritten once at most."""
        base = self.manifest()
        runs = self.plan(base["shards"])
        if not runs:
            return base
        add = []
        for at in range(0, len(runs), RUNS_A_JOB):
            some, where = runs[at : at + RUNS_A_JOB], self._folder("merged")
            # each run is one partition, so the k-th part file is the k-th run
            read = [self.spark.read.schema(base["schema"]).parquet(*[s["file"] for s in run]).coalesce(1) for run in some]
            zipped = self.spark.conf.get(ZIPPED_UNIONS, None)
            self.spark.conf.set(ZIPPED_UNIONS, "false")
            try:
                reduce(DataFrame.unionAll, read).write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(where)
            finally:
                self.spark.conf.unset(ZIPPED_UNIONS) if zipped is None else self.spark.conf.set(ZIPPED_UNIONS, zipped)
            for file, size in self._files(where):
                run = some[int(file.rpartition("/part-")[2][:5])]
                add.append({"file": file, "tier": self.tier(size), "rows": sum(s["rows"] for s in run), "bytes": size})
        return self._commit(add, [s["file"] for run in runs for s in run], base["schema"])

    def vacuum(self, keep: int = KEEP_VERSIONS, grace_seconds: float = GRACE_SECONDS) -> int:
        """Removes manifests before the newest ``keep``, and files that no remaining version names and that are older than the grace period; how many files."""
        kept = self.versions()[-max(1, keep) :]
        if not kept:
            return 0
        named = {s["file"].rpartition("/data/")[2] for v in kept for s in self.manifest(v)["shards"]}
        sink = self.fs.create(self._path(f"{self.path}/manifest/oldest.json"), True)
        sink.write(bytearray(json.dumps({"version": kept[0]}).encode()))
        sink.close()
        # the oldest version kept is read from the last full one up to it
        for s in self.fs.listStatus(self._path(f"{self.path}/manifest")):
            name = s.getPath().getName()
            if name.startswith("v") and int(name[1:-5]) < kept[0] - kept[0] % CHECKPOINT:
                self.fs.delete(s.getPath(), False)
        gone, oldest = 0, (time.time() - grace_seconds) * 1000
        data = self._path(f"{self.path}/data")
        for folder in self.fs.listStatus(data) if self.fs.exists(data) else []:
            for f in self.fs.listStatus(folder.getPath()):
                name = f.getPath().toString().rpartition("/data/")[2]
                if name.endswith(".parquet") and name not in named and f.getModificationTime() <= oldest:
                    gone += bool(self.fs.delete(f.getPath(), False))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``__assay_shard``: the name of the file that holds each."""
        m = self.manifest(version)
        if not m["shards"]:
            return self.spark.createDataFrame([], m["schema"] or "doc_id long, text string").withColumn("__assay_shard", F.lit(None).cast("string"))
        return self.spark.read.schema(m["schema"]).parquet(*[s["file"] for s in m["shards"]]).withColumn("__assay_shard", F.col("_metadata.file_name"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four parts by doc_id, are compacted after each, and are returned with their final shard: (doc_id, shard, tier, version, n_bytes, text_sha256)."""
    docs = shared.documents(spark, sf_dir)
    arrivals, parts = shared.scratch_path(spark, "arrivals"), 4
    part = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(parts))
    docs.withColumn("__assay_part", part).write.option("compression", "zstd").partitionBy("__assay_part").parquet(arrivals)
    store = ShardStore(spark, shared.scratch_path(spark, "shards"))
    for k in range(parts):
        if store.fs.exists(store._path(f"{arrivals}/__assay_part={k}")):
            store.adopt(f"{arrivals}/__assay_part={k}", docs._jdf.schema().toDDL())
        else:
            store.append(docs.limit(0))
        store.compact()
    store.vacuum(1, 0)  # no one else writes to this store
    m = store.manifest()
    table = spark.createDataFrame([(s["file"].rpartition("/")[2], s["tier"]) for s in m["shards"]], "__assay_name string, tier int")
    rows = store.read().join(F.broadcast(table), F.col("__assay_shard") == F.col("__assay_name"), "left")
    n_bytes, digest = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256)
    return rows.select("doc_id", F.col("__assay_shard").alias("shard"), "tier", F.lit(m["version"]).cast("long").alias("version"), n_bytes.alias("n_bytes"), digest.alias("text_sha256"))
