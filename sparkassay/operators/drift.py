"""Distances between two value distributions, as joins of value counts, and between two histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slicing import SLICE


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both sides for each (slice, path, value), and each side's total; a value missing on a side counts 0."""
    left = a.select(SLICE, "path", "value", F.col("cnt").cast("double").alias("ca"), F.lit(0.0).alias("cb"))
    right = b.select(SLICE, "path", "value", F.lit(0.0).alias("ca"), F.col("cnt").cast("double").alias("cb"))
    both = left.unionByName(right).groupBy(SLICE, "path", "value").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    totals = both.groupBy(SLICE, "path").agg(F.sum("ca").alias("ta"), F.sum("cb").alias("tb"))
    return both.join(totals, [SLICE, "path"])


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(slice, path, l_infinity, l_infinity_value, normalized_abs_difference, jensen_shannon) of two tables of value counts. Of equal largest differences the last value is named."""
    p, q = F.col("ca") / F.col("ta"), F.col("cb") / F.col("tb")
    m = (p + q) / 2
    kl = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = aligned(a, b).where("ta > 0 AND tb > 0")
    got = both.groupBy(SLICE, "path").agg(F.max(F.struct(F.abs(p - q).alias("d"), F.col("value"))).alias("top"), F.max(F.abs(F.col("ca") - F.col("cb")) / (F.col("ta") + F.col("tb"))).alias("nad"), (F.sum(kl(p) + kl(q)) / 2).alias("jsd"))
    return got.select(SLICE, "path", F.col("top.d").alias("l_infinity"), F.col("top.value").alias("l_infinity_value"), F.col("nad").alias("normalized_abs_difference"), F.least(F.greatest("jsd", F.lit(0.0)), F.lit(1.0)).alias("jensen_shannon"))


def count_distances(a: dict[str, float], b: dict[str, float]) -> dict[str, float | str]:
    """The same of one feature's collected counts, neither empty."""
    ta, tb = sum(a.values()), sum(b.values())
    shares = {v: (a.get(v, 0) / ta, b.get(v, 0) / tb) for v in {*a, *b}}
    worst = max(shares, key=lambda v: (abs(shares[v][0] - shares[v][1]), v))
    divergence = sum(x * math.log2(2 * x / (x + y)) / 2 for pair in shares.values() for x, y in (pair, pair[::-1]) if x)
    return {"l_infinity": abs(shares[worst][0] - shares[worst][1]), "l_infinity_value": worst, "normalized_abs_difference": max(abs(a.get(v, 0) - b.get(v, 0)) for v in shares) / (ta + tb), "jensen_shannon": min(1.0, max(0.0, divergence))}


Bucket = tuple[float, float, float]


def histogram_jsd(a: list[Bucket], b: list[Bucket], nan_a: float = 0, nan_b: float = 0) -> float:
    """Jensen-Shannon divergence of two histograms of a feature: uniform within buckets, points apart; infinite and NaN mass never matches the other side's."""
    spans = [[x for x in h if math.isfinite(x[0]) and math.isfinite(x[1]) and x[0] < x[1] and x[2] > 0] for h in (a, b)]
    points: list[dict[float, float]] = [{}, {}]
    odd = [nan_a, nan_b]
    for side, h in enumerate((a, b)):
        for lo, hi, c in h:
            if not (math.isfinite(lo) and math.isfinite(hi)):
                odd[side] += c
            elif lo == hi:
                points[side][lo] = points[side].get(lo, 0) + c
    ends = sorted({x for h in spans for lo, hi, _ in h for x in (lo, hi)})
    cells: list[list[float]] = [[], []]
    for lo, hi in zip(ends, ends[1:]):
        for side in (0, 1):
            cells[side].append(sum(c * max(0.0, min(hi, y) - max(lo, x)) / (y - x) for x, y, c in spans[side]))
    for x in sorted({*points[0], *points[1]}):
        for side in (0, 1):
            cells[side].append(points[side].get(x, 0))
    cells[0] += [odd[0], 0]
    cells[1] += [0, odd[1]]
    total = [sum(c) for c in cells]
    if not total[0] or not total[1]:
        return 0.0 if total[0] == total[1] else 1.0
    out = 0.0
    for x, y in zip(*cells):
        p, q = x / total[0], y / total[1]
        m = (p + q) / 2
        out += sum(v * math.log2(v / m) for v in (p, q) if v > 0) / 2
    return min(1.0, max(0.0, out))
