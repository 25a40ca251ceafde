"""Contracts for statistics of one's own; each gives (slice, path, name, value) rows and can stand in ``StatsOptions.generators``.

* :class:`FeatureGenerator`: aggregate expressions of one feature's values; all features go through one aggregate.
* :class:`Composite`: parts with a key, each computed once however many share it, and what is made of them.
* :class:`BatchGenerator`: an accumulator that takes Arrow batches and is merged, where expressions don't do.
* :class:`PartitionedGenerator`: a function of a whole random partition, and the mean over partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import STRUCT, Feature, features
from ..operators.basic import WEIGHT, _by_shape
from ..operators.slicing import SLICE

#: Groups in which tasks' accumulators are merged first.
LOTS = 128
ROWS = f"{SLICE} string, path string, name string, value double"


class FeatureGenerator:
    """``aggregates(feature, value)`` gives {name: aggregate of a numeric result}; none for features that it passes over."""

    def __init__(self, aggregates: Callable[[Feature, Column], dict[str, Column]]):
        self.aggregates = aggregates

    def __call__(self, rows: DataFrame) -> DataFrame:
        out = None
        fs = [f for f in features(rows.schema) if f.type != STRUCT and f.steps[0] not in (SLICE, WEIGHT)]
        by_names: dict[tuple[str, ...], list[Feature]] = {}
        for f in fs:
            names = tuple(self.aggregates(f, f.read))
            if names:
                by_names.setdefault(names, []).append(f)
        for names, some in by_names.items():  # features of equal result share an aggregate
            got = _by_shape(rows, some, self.aggregates)
            cells = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]
            got = got.select(SLICE, "path", F.inline(F.array(*cells)))
            out = got if out is None else out.unionByName(got)
        return out if out is not None else rows.sparkSession.createDataFrame([], ROWS)


class Part:
    """A shared piece: an aggregate of a row's columns under a key."""

    def __init__(self, key: str, aggregate: Column):
        self.key, self.aggregate = key, aggregate


class Composite:
    """``make`` gets {key: column of the part} and gives {(path, name): column}; parts of equal key, also of other composites given to :func:`composed`, are one aggregate."""

    def __init__(self, parts: list[Part], make: Callable[[dict[str, Column]], dict[tuple[str, str], Column]]):
        self.parts, self.make = parts, make

    def __call__(self, rows: DataFrame) -> DataFrame:
        return composed([self])(rows)


def composed(composites: list[Composite]) -> Callable[[DataFrame], DataFrame]:
    """All composites in one aggregate."""

    def run(rows: DataFrame) -> DataFrame:
        parts = {p.key: p.aggregate for c in composites for p in c.parts}
        at = {k: f"p{i}" for i, k in enumerate(parts)}
        wide = rows.groupBy(SLICE).agg(*[a.alias(at[k]) for k, a in parts.items()])
        made = [(*where, value) for c in composites for where, value in c.make({p.key: F.col(at[p.key]) for p in c.parts}).items()]
        cells = [F.struct(F.lit(path).alias("path"), F.lit(name).alias("name"), value.cast("double").alias("value")) for path, name, value in made]
        return wide.select(SLICE, F.inline(F.array(*cells)))

    return run


class BatchGenerator:
    """``create()`` makes an accumulator, ``add(accumulator, batch)`` and ``merge(a, b)`` give one, ``extract(accumulator)`` gives (path, name, value) rows. Accumulators are pickled between tasks.

    A task adds all batches of a slice; what tasks made is merged in two steps, LOTS lots first.
    """

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, accumulator: Any, batch: pa.RecordBatch) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def extract(self, accumulator: Any) -> list[tuple[str, str, float]]:
        raise NotImplementedError

    def __call__(self, rows: DataFrame) -> DataFrame:
        at = rows.columns.index(SLICE)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, Any] = {}
            for b in batches:
                keys = b.column(at)
                for key in keys.unique().to_pylist():
                    own = b.filter(pa.compute.equal(keys, key))
                    held[key] = self.add(held[key] if key in held else self.create(), own)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pickle.dumps(x) for x in held.values()], pa.binary())], [SLICE, "acc"])

        def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            whole = self.create()
            for raw in pdf["acc"]:
                whole = self.merge(whole, pickle.loads(raw))
            return pd.DataFrame({SLICE: [key[0]], "acc": [pickle.dumps(whole)]})

        def extracted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            whole = pickle.loads(merged(key, pdf)["acc"][0])
            return pd.DataFrame([(key[0], p, n, float(v)) for p, n, v in self.extract(whole)], columns=[SLICE, "path", "name", "value"])

        parts = rows.mapInArrow(partial, f"{SLICE} string, acc binary").withColumn("lot", F.spark_partition_id() % LOTS)
        lots = parts.groupBy(SLICE, "lot").applyInPandas(merged, f"{SLICE} string, acc binary")
        return lots.groupBy(SLICE).applyInPandas(extracted, ROWS)


class PartitionedGenerator:
    """``compute(pandas rows)`` gives {(path, name): value} for each of ``partitions`` random parts of at most ``cap`` rows; the results are their mean, and min, max and deviation as name_min, name_max, name_std_dev. Names that fewer than ``least`` parts give are left out."""

    def __init__(self, compute: Callable[[pd.DataFrame], dict[tuple[str, str], float]], partitions: int = 8, cap: int = 5000, least: int = 1, seed: int = 0):
        if partitions < 1 or cap < 1:
            raise ValueError("partitions and cap must be at least 1")
        self.compute, self.partitions, self.cap, self.least, self.seed = compute, partitions, cap, least, seed

    def __call__(self, rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c not in (SLICE, WEIGHT)]
        dealt = rows.withColumn("__h", F.xxhash64(F.lit(self.seed), F.monotonically_increasing_id())).withColumn("__part", F.pmod("__h", F.lit(self.partitions)))
        # the rank filter runs before the shuffle too, so a part's rows beyond the cap stay where they are
        sample = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(SLICE, "__part").orderBy("__h"))).where(F.col("__r") <= self.cap)

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(key[0], p, n, float(v)) for (p, n), v in self.compute(pdf[own]).items()], columns=[SLICE, "path", "name", "value"])

        per = sample.groupBy(SLICE, "__part").applyInPandas(run, ROWS)
        got = per.groupBy(SLICE, "path", "name").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n")).where(F.col("n") >= self.least)
        cells = [F.struct(F.concat("name", F.lit(suffix)).alias("name"), F.col(c).alias("value")) for suffix, c in (("", "mean"), ("_min", "least"), ("_max", "most"), ("_std_dev", "sd"))]
        return got.select(SLICE, "path", F.inline(F.array(*cells)))
