"""Value counts and what follows from them: exact top-k, uniques, rank histograms; sketches for the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import INT, STRING, STRUCT, features, numeric
from .basic import WEIGHT, exploded
from .slicing import SLICE

TOP, RANKS, LONG_STRING = 20, 1000, 1024
#: Lots in which the tasks' most frequent values are merged, one number after the other, before one task ranks what is left.
LOTS = (64, 8)
BAD_UTF8, LARGE = "__BYTES_VALUE__", "__LARGE_BYTES__"


def text_of(value: Column, f) -> Column:
    """A categorical value as string; strings that are not UTF-8 share one placeholder."""
    if f.type == STRING:
        s = value.cast("string")
        return F.when(value.isNull(), None).otherwise(F.coalesce(F.try_validate_utf8(s), F.lit(BAD_UTF8)))
    return numeric(value, f.leaf).cast("string")


def categorical_features(df: DataFrame, categorical: list[str] | None = None):
    chosen = set(categorical or [])
    return [f for f in features(df.schema) if f.type != STRUCT and f.steps[0] not in (SLICE, WEIGHT) and (f.type == STRING or f.boolean or f.path in chosen)]


def value_counts(df: DataFrame, categorical: list[str] | None = None) -> DataFrame:
    """(slice, path, value, cnt, wcnt) over strings, booleans and the features listed as categorical, of ``prepared`` rows.

    Scalars are turned into rows within one pass (one generate, no scan for each column); counting is partial before the shuffle.
    """
    fs = categorical_features(df, categorical)
    parts = []
    scalars = [f for f in fs if f.scalar]
    if scalars:
        cells = F.array(*[F.struct(F.lit(f.path).alias("path"), text_of(f.read, f).alias("value")) for f in scalars])
        parts.append(df.select(SLICE, WEIGHT, F.inline(cells)))
    for f in fs:
        if not f.scalar:
            rows, value = exploded(df, f)
            parts.append(rows.select(SLICE, WEIGHT, F.lit(f.path).alias("path"), text_of(value, f).alias("value")))
    if not parts:
        return df.limit(0).select(SLICE, F.lit("").alias("path"), F.lit("").alias("value"), F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("wcnt"))
    rows = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL")
    return rows.groupBy(SLICE, "path", "value").agg(F.count("*").alias("cnt"), F.sum(WEIGHT).alias("wcnt"))


def top(counts: DataFrame, k: int = TOP, by: str = "cnt", threshold: float = 1) -> DataFrame:
    """(slice, path, rank, value, cnt, wcnt): the k most frequent; of equal counts the larger value first.

    Each task keeps k values of a path, then each lot does, so the last task reads k of each of the last lots however many values there are.
    """
    keys, order = [SLICE, "path"], [F.desc(by), F.desc("value")]
    # the filters are on the bare row number, as Spark then applies them before the shuffle too
    kept = counts.where(F.col(by) >= threshold).withColumn("__lot", F.spark_partition_id())
    for n in LOTS:
        kept = kept.withColumn("__lot", F.col("__lot") % n)
        kept = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__lot").orderBy(*order))).where(F.col("__r") <= k)
    kept = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k)
    return kept.withColumn("rank", F.col("__r") - 1).drop("__lot", "__r")


def rank_histogram(counts: DataFrame, buckets: int = RANKS) -> DataFrame:
    """(slice, path, low_rank, high_rank, label, sample_count)."""
    return top(counts, buckets).select(SLICE, "path", F.col("rank").alias("low_rank"), F.col("rank").alias("high_rank"), F.col("value").alias("label"), F.col("cnt").cast("double").alias("sample_count"))


def uniques(counts: DataFrame) -> DataFrame:
    """(slice, path, unique)."""
    return counts.groupBy(SLICE, "path").agg(F.count("*").alias("unique"))


def sketched(df: DataFrame, categorical: list[str] | None = None, k: int = TOP, items: int = 16384, long_string: int = LONG_STRING) -> DataFrame:
    """(slice, path, unique, top array<struct<value, cnt>>) from sketches in one aggregate: bounded memory for any number of values. Long strings count as one placeholder unless listed as categorical."""
    chosen = set(categorical or [])
    rows = []
    for f in categorical_features(df, categorical):
        r, value = exploded(df, f)
        v = text_of(value, f)
        if f.type == STRING and f.path not in chosen:
            v = F.when(F.octet_length(v) > long_string, F.lit(LARGE)).otherwise(v)
        rows.append(r.select(SLICE, F.lit(f.path).alias("path"), v.alias("value")))
    melted = reduce(DataFrame.unionByName, rows).where("value IS NOT NULL")
    got = melted.groupBy(SLICE, "path").agg(F.approx_count_distinct("value", 0.01).alias("unique"), F.expr(f"approx_top_k(value, {k}, {items})").alias("found"))
    return got.select(SLICE, "path", "unique", F.transform("found", lambda x: F.struct(x["item"].alias("value"), x["count"].alias("cnt"))).alias("top"))
