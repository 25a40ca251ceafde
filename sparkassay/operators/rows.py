"""Row-level validation: the schema as one boolean column for each (path, anomaly), so rows are judged in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import STRUCT, Feature, features, numeric
from ..functions.schema import Schema
from .inference import TYPES


def predicates(df: DataFrame, schema: Schema, environment: str | None = None) -> dict[str, Column]:
    """{``path_ANOMALY``: whether the row shows it}."""
    out: dict[str, Column] = {}
    have = {f.path: f for f in features(df.schema) if not f.repeated}
    gone = schema.deprecated_paths()
    for path, f in have.items():
        entry = schema.features.get(path)
        if path in gone:
            continue
        if entry is None:
            out[f"{path}_SCHEMA_NEW_COLUMN"] = f.read.isNotNull()
            continue
        if not schema.in_environment(entry, environment):
            out[f"{path}_SCHEMA_NEW_COLUMN"] = f.read.isNotNull()
            continue
        required = entry.presence is not None and (entry.presence.min_fraction == 1 or (entry.presence.min_count or 0) > 0)
        if required:
            out[f"{path}_FEATURE_TYPE_NOT_PRESENT"] = f.read.isNull()
        if entry.value_count is not None:
            if entry.value_count.min is not None:
                out[f"{path}_FEATURE_TYPE_LOW_NUMBER_VALUES"] = f.sizes() < entry.value_count.min
            if entry.value_count.max is not None:
                out[f"{path}_FEATURE_TYPE_HIGH_NUMBER_VALUES"] = f.sizes() > entry.value_count.max
        if f.type == STRUCT:
            continue
        if entry.type and TYPES.get(f.type, f.type) != entry.type:
            out[f"{path}_UNEXPECTED_DATA_TYPE"] = f.read.isNotNull()
            continue
        out |= {f"{path}_{k}": c for k, c in _domain(f, schema, path).items()}
    for path, entry in schema.features.items():
        needed = not entry.is_deprecated and path not in gone and entry.presence is not None and (entry.presence.min_count or 0) > 0 and schema.in_environment(entry, environment)
        if needed and path not in have:
            out[f"{path}_SCHEMA_MISSING_COLUMN"] = F.lit(True)
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def _domain(f: Feature, schema: Schema, path: str) -> dict[str, Column]:
    entry = schema.features[path]
    d = entry.domain
    values = schema.string_domains.get(entry.domain_ref) if entry.domain_ref is not None else d.values if d is not None and d.kind == "string" else None

    def any_value(test) -> Column:
        return test(f.read) if f.scalar else F.exists(F.coalesce(f.values(), F.array().cast(T.ArrayType(f.leaf))), test)

    def num(x: Column) -> Column:
        return F.expr("1") * (x.try_cast("double") if f.type == "STRING" else numeric(x, f.leaf).cast("double"))

    if values is not None:
        return {"ENUM_TYPE_UNEXPECTED_STRING_VALUES": any_value(lambda x: ~x.cast("string").isin(values))}
    if d is None:
        return {}
    out = {}
    if d.kind == "bool":
        if f.type == "INT":
            out = {"BOOL_TYPE_SMALL_INT": any_value(lambda x: num(x) < 0), "BOOL_TYPE_BIG_INT": any_value(lambda x: num(x) > 1)}
        elif f.type == "FLOAT":
            out = {"BOOL_TYPE_UNEXPECTED_FLOAT": any_value(lambda x: ~num(x).isin(0.0, 1.0))}
        else:
            known = [v for v in (d.true_value, d.false_value) if v is not None]
            out = {"BOOL_TYPE_UNEXPECTED_STRING": any_value(lambda x: ~x.cast("string").isin(known))}
    elif d.kind in ("int", "float"):
        word = d.kind.upper()
        if f.type == "STRING":
            bad = {"int": "INT_TYPE_NOT_INT_STRING", "float": "FLOAT_TYPE_STRING_NOT_FLOAT"}[d.kind]
            out[bad] = any_value(lambda x: x.isNotNull() & x.cast("string").try_cast("bigint" if d.kind == "int" else "double").isNull())
        if d.min is not None:
            out[f"{word}_TYPE_SMALL_{word}"] = any_value(lambda x: num(x) < d.min)
        if d.max is not None:
            out[f"{word}_TYPE_BIG_{word}"] = any_value(lambda x: ~F.isnan(num(x)) & (num(x) > d.max))
        if d.disallow_nan and f.type == "FLOAT":
            out["FLOAT_TYPE_HAS_NAN"] = any_value(lambda x: F.isnan(num(x)))
        if d.disallow_inf and f.type == "FLOAT":
            out["FLOAT_TYPE_HAS_INF"] = any_value(lambda x: F.abs(num(x)) == float("inf"))
    return out


def anomalous(df: DataFrame, schema: Schema, environment: str | None = None) -> DataFrame:
    """``df``'s rows once for each ``reason`` they show."""
    tests = predicates(df, schema, environment)
    if not tests:
        return df.limit(0).withColumn("reason", F.lit(""))
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    return df.withColumn("reason", F.explode(found))


def anomaly_counts(df: DataFrame, schema: Schema, environment: str | None = None) -> DataFrame:
    """(reason, examples): one aggregate of all predicates, without an explode."""
    tests = predicates(df, schema, environment)
    wide = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(tests.values())])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(f"r{i}").alias("examples")) for i, k in enumerate(tests)]))).where("examples > 0")


def samples(df: DataFrame, schema: Schema, n: int, seed: int = 0, environment: str | None = None) -> DataFrame:
    """At most ``n`` random rows for each reason."""
    rows = anomalous(df, schema, environment)
    h = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    w = Window.partitionBy("reason").orderBy("__h")
    return rows.withColumn("__h", h).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__h", "__r")


def custom(df: DataFrame, rules: dict[str, str], severity: str = "ERROR") -> DataFrame:
    """(rule, severity, passed) of boolean SQL over a one-row or tidy frame of statistics: a rule holds if it is true in every row."""
    wide = df.agg(*[F.bool_and(F.expr(sql)).alias(f"r{i}") for i, sql in enumerate(rules.values())])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(F.col(f"r{i}"), F.lit(False)).alias("passed")) for i, k in enumerate(rules)])))
