"""Schemas, anomalies and statistics as DataFrames for reading."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.schema import Schema
from .validation import Anomalies


def schema_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    """(feature, type, presence, valency, domain)."""
    rows = []
    for p, f in schema.features.items():
        pr = f.presence
        presence = "" if pr is None else "required" if pr.min_fraction == 1 else "optional"
        v = f.value_count
        valency = "" if v is None or (v.min == v.max == 1) else "single" if (v.min, v.max) == (0, 1) else f"[{'' if v.min is None else v.min},{'*' if v.max is None else v.max}]"
        d = f.domain
        domain = f.domain_ref or ("-" if d is None else d.kind if d.min is None and d.max is None else f"{d.kind} min: {d.min} max: {d.max}")
        rows.append((p, f.type or "", presence, valency, domain))
    return spark.createDataFrame(rows, "feature string, type string, presence string, valency string, domain string")


def domains_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    return spark.createDataFrame([(n, ", ".join(f"'{v}'" for v in vs)) for n, vs in schema.string_domains.items()], "domain string, values string")


def anomalies_frame(spark: SparkSession, anomalies: Anomalies) -> DataFrame:
    """(feature, severity, type, short_description, long_description), a row for each reason."""
    return spark.createDataFrame(anomalies.rows(), "feature string, severity string, type string, short_description string, long_description string")


def distances_frame(spark: SparkSession, anomalies: Anomalies) -> DataFrame:
    """(path, kind, measure, value, threshold) of measured drift and skew."""
    return spark.createDataFrame([(d["path"], d["kind"], d["measure"], float(d["value"]), float(d["threshold"])) for d in anomalies.distances], "path string, kind string, measure string, value double, threshold double")


def compare_slices(spark: SparkSession, stats: dict[str, dict[str, Any]], a: str, b: str) -> DataFrame:
    """(path, statistic, a, b) of two slices' numbers side by side."""
    for s in (a, b):
        if s not in stats:
            raise ValueError(f"no slice {s}")
    rows = []
    for p in {**stats[a]["features"], **stats[b]["features"]}:
        x, y = stats[a]["features"].get(p, {}), stats[b]["features"].get(p, {})
        for k in ("num_non_missing", "num_missing", "tot_num_values", "mean", "std_dev", "num_zeros", "min", "median", "max", "unique", "avg_length"):
            if x.get(k) is not None or y.get(k) is not None:
                rows.append((p, k, *[float(v[k]) if v.get(k) is not None else None for v in (x, y)]))
    return spark.createDataFrame(rows, "path string, statistic string, a double, b double")
