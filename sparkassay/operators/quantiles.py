"""Exact quantiles at any size, and the two histograms that follow from them.

The rule for k buckets over total weight W: boundary i is the smallest value whose cumulative weight exceeds i W / k (the
largest value for i = k). Distinct values with their weights are range-partitioned and written once; each partition sums
its own cumulative weights and only its total travels, so no task holds all values of a feature.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import FLOAT, INT, features, numeric
from .basic import WEIGHT, exploded
from .slicing import SLICE
from ..sources.scratch import scratch

FINE = 100


def numeric_values(df: DataFrame, paths: list[str] | None = None, weighted: bool = False) -> DataFrame:
    """(slice, path, value, w): distinct numeric values with their count or weight, NaN left out."""
    fs = [f for f in features(df.schema) if f.type in (INT, FLOAT) and f.steps[0] not in (SLICE, WEIGHT) and (paths is None or f.path in paths)]
    parts = []
    scalars = [f for f in fs if f.scalar]
    if scalars:
        cells = F.array(*[F.struct(F.lit(f.path).alias("path"), numeric(f.read, f.leaf).cast("double").alias("value")) for f in scalars])
        parts.append(df.select(SLICE, WEIGHT, F.inline(cells)))
    for f in fs:
        if not f.scalar:
            rows, value = exploded(df, f)
            parts.append(rows.select(SLICE, WEIGHT, F.lit(f.path).alias("path"), numeric(value, f.leaf).cast("double").alias("value")))
    rows = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL AND NOT isnan(value)")
    return rows.groupBy(SLICE, "path", "value").agg((F.sum(WEIGHT) if weighted else F.count("*").cast("double")).alias("w"))


def valencies(df: DataFrame) -> DataFrame:
    """(slice, path, value, w): how often each number of values occurs."""
    fs = [f for f in features(df.schema) if not f.repeated and f.steps[0] not in (SLICE, WEIGHT)]
    cells = F.array(*[F.struct(F.lit(f.path).alias("path"), f.sizes().cast("double").alias("value")) for f in fs])
    return df.select(SLICE, F.inline(cells)).where("value IS NOT NULL").groupBy(SLICE, "path", "value").agg(F.count("*").cast("double").alias("w"))


def level_valencies(df: DataFrame) -> DataFrame | None:
    """(slice, path, level, value, w): how often each list length occurs at the levels below the first of nested lists; None without such features."""
    cells = []
    for f in features(df.schema):
        if f.repeated or f.nest < 2 or f.steps[0] in (SLICE, WEIGHT):
            continue
        lists = F.filter(f.read, lambda x: x.isNotNull())
        for level in range(2, f.nest + 1):
            cells.append(F.struct(F.lit(f.path).alias("path"), F.lit(level).alias("level"), F.transform(lists, F.size).alias("sizes")))
            if level < f.nest:
                lists = F.filter(F.flatten(lists), lambda x: x.isNotNull())
    if not cells:
        return None
    rows = df.select(SLICE, F.inline(F.array(*cells))).select(SLICE, "path", "level", F.explode("sizes").alias("size"))
    return rows.groupBy(SLICE, "path", "level", F.col("size").cast("double").alias("value")).agg(F.count("*").cast("double").alias("w"))


def cumulative(values: DataFrame) -> DataFrame:
    """``values`` with ``cum`` (weight up to and with each value) and ``total`` of its slice and path."""
    spark = values.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.where("w > 0").repartitionByRange(n, SLICE, "path", "value").withColumn("part", F.spark_partition_id())
    stored = scratch(ranged, "ranged")  # written, as ranges are sampled anew in each run
    totals = stored.groupBy(SLICE, "path", "part").agg(F.sum("w").alias("part_w"))  # a row for each path and range
    before = Window.partitionBy(SLICE, "path").orderBy("part")
    offsets = totals.withColumn("offset", F.sum("part_w").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_w")).withColumn("total", F.sum("part_w").over(Window.partitionBy(SLICE, "path")))
    within = Window.partitionBy(SLICE, "path", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = stored.withColumn("local", F.sum("w").over(within))
    return local.join(offsets.drop("part_w"), [SLICE, "path", "part"]).select(SLICE, "path", "value", "w", (F.col("local") + F.col("offset")).alias("cum"), "total")


def grid(cum: DataFrame, k: int) -> DataFrame:
    """(slice, path, i, q, cum, total): boundaries 0..k and the weight up to and with each."""
    first = F.ceil((F.col("cum") - F.col("w")) * k / F.col("total"))
    # boundaries i with cum - w <= i W / k < cum, and k itself at the last value
    last = F.ceil(F.col("cum") * k / F.col("total")) - 1
    last = F.when(F.col("cum") >= F.col("total") * (1 - 1e-12), F.lit(k)).otherwise(last)
    return cum.where(last >= first).select(SLICE, "path", F.explode(F.sequence(first, last)).alias("i"), F.col("value").alias("q"), "cum", "total")


def median(cum: DataFrame) -> DataFrame:
    """(slice, path, median): the middle boundary, no interpolation."""
    return cum.where("cum > total / 2 AND cum - w <= total / 2").select(SLICE, "path", F.col("value").alias("median"))


# --- histograms from boundaries: a few numbers of one feature, in plain Python


def quantile_counts(q: list[float], cum: list[float]) -> list[float]:
    """Bucket counts from boundaries and cumulative weights: equal upper ends share evenly; what lies at the first boundary is spread over the leading buckets that end there, or goes to the first bucket."""
    counts = [b - a for a, b in zip(cum, cum[1:])]
    out, i = [], 0
    while i < len(counts):
        j = i
        while j + 1 < len(counts) and q[j + 2] == q[i + 1]:
            j += 1
        share = sum(counts[i : j + 1]) / (j - i + 1)
        out += [share] * (j - i + 1)
        i = j + 1
    lead = 1
    while lead < len(out) and q[lead + 1] == q[1]:
        lead += 1
    return [c + (cum[0] / lead if k < lead else 0) for k, c in enumerate(out)]


def quantile_histogram(q: list[float], cum: list[float], buckets: int) -> list[tuple[float, float, float]]:
    """(low, high, count) of ``buckets`` from a grid that is a multiple as fine."""
    step = (len(q) - 1) // buckets
    ends = [q[i * step] for i in range(buckets + 1)]
    counts = quantile_counts(ends, [cum[i * step] for i in range(buckets + 1)])
    return list(zip(ends, ends[1:], counts))


def standard_histogram(q: list[float], cum: list[float], buckets: int) -> list[tuple[float, float, float]]:
    """(low, high, count) of equal width between the finite ends; each fine bucket is spread evenly over its own width; infinities get buckets of their own."""
    fine = list(zip(q, q[1:], quantile_counts(q, cum)))
    finite = [x for x in q if math.isfinite(x)]
    low_inf = sum(c for a, b, c in fine if b == -math.inf)
    high_inf = sum(c for a, b, c in fine if a == math.inf)
    out = []
    lo, hi = (min(finite), max(finite)) if finite else (0.0, 0.0)
    counts = [0.0] * buckets
    width = (hi - lo) / buckets

    def put(x: float, c: float) -> None:
        k = min(buckets - 1, max(0, math.ceil((x - lo) / width - 1e-9) - 1)) if width > 0 else 0  # a bucket holds its upper end
        counts[k] += c

    for a, b, c in fine:
        if a == b == -math.inf or a == b == math.inf:
            continue
        if a == -math.inf and b == math.inf:
            low_inf, high_inf = low_inf + c / 2, high_inf + c / 2
        elif a == -math.inf:
            put(b, c)  # the values of the bucket end at b; the infinite ones have been counted before it
        elif b == math.inf:
            high_inf += c
        elif a == b or width <= 0:
            put(b, c)
        else:
            for k in range(buckets):
                x, y = lo + k * width, lo + (k + 1) * width if k < buckets - 1 else hi
                part = max(0.0, min(b, y) - max(a, x)) / (b - a)
                counts[k] += c * part
    if -math.inf in q:
        out.append((-math.inf, -math.inf, low_inf))
    if finite:
        out += [(lo + k * width, lo + (k + 1) * width if k < buckets - 1 else hi, counts[k]) for k in range(buckets)] if width > 0 else [(lo, hi, sum(counts))]
    if math.inf in q:
        out.append((math.inf, math.inf, high_inf))
    return out


def histograms(values: DataFrame, quantile_buckets: int = 10, standard_buckets: int = 10, kinds: tuple[str, ...] = ("STANDARD", "QUANTILES"), summed: bool = False) -> DataFrame:
    """(slice, path, kind, bucket, low, high, count) of values, or of their ``cumulative`` table if ``summed``. The step after the grid handles one feature's boundaries (100 for each bucket) at a time."""
    fine = FINE * quantile_buckets if "STANDARD" in kinds else quantile_buckets
    points = grid(values if summed else cumulative(values), fine)
    schema = f"{SLICE} string, path string, kind string, bucket int, low double, high double, count double"

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        q, cum = pdf["q"].tolist(), pdf["cum"].tolist()
        rows = []
        if "QUANTILES" in kinds:
            rows += [("QUANTILES", k, *b) for k, b in enumerate(quantile_histogram(q, cum, quantile_buckets))]
        if "STANDARD" in kinds:
            rows += [("STANDARD", k, *b) for k, b in enumerate(standard_histogram(q, cum, standard_buckets))]
        return pd.DataFrame([(key[0], key[1], *r) for r in rows], columns=[SLICE, "path", "kind", "bucket", "low", "high", "count"])

    return points.groupBy(SLICE, "path").applyInPandas(build, schema)


def approximate(df: DataFrame, k: int = 10) -> DataFrame:
    """(slice, path, quantiles array<double>) by sketches in one aggregate: rank error well below 1 %."""
    fs = [f for f in features(df.schema) if f.type in (INT, FLOAT) and f.scalar and f.steps[0] not in (SLICE, WEIGHT)]
    marks = F.array(*[F.lit(i / k) for i in range(k + 1)])
    cells = F.array(*[F.struct(F.lit(f.path).alias("path"), numeric(f.read, f.leaf).cast("double").alias("value")) for f in fs])
    rows = df.select(SLICE, F.inline(cells)).where("value IS NOT NULL AND NOT isnan(value)")
    return rows.groupBy(SLICE, "path").agg(F.percentile_approx("value", marks, 10000).alias("quantiles"))
