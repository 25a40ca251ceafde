"""Presence, valency, moments and lengths: one wide aggregate over all features of a table, with partial aggregation by Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import BYTES, FLOAT, INT, STRING, STRUCT, Feature, features, numeric
from .slicing import SLICE, with_slices

#: Features aggregated together; more would outgrow generated code.
GROUP = 16
WEIGHT = "__weight"
#: Weighted means of a slice by path, beside its rows.
MEANS = "__means"


def number(value: Column, f: Feature) -> Column:
    """A leaf as double, NaN as null."""
    v = numeric(value, f.leaf).cast("double")
    return F.when(~F.isnan(v), v) if f.type == FLOAT else v


def prepared(df: DataFrame, weight: str | None = None, slices=None, columns: list[str] | None = None) -> DataFrame:
    """Only the columns asked for (missing ones are ignored), with a slice key and a weight for each row."""
    if columns is not None:
        keep = [c for c in df.columns if c in set(columns) or c == weight]
        needed = {k for s in slices or [] for k in getattr(s, "columns", [])}
        df = df.select(*[f"`{c}`" for c in df.columns if c in set(keep) | needed])
    if weight is not None:
        w = F.col(f"`{weight}`").cast("double")
        df = df.withColumn(WEIGHT, F.when(w.isNull(), F.raise_error(F.lit(f"weight {weight} must have one value in each example"))).otherwise(w))
    else:
        df = df.withColumn(WEIGHT, F.lit(1.0))
    return with_slices(df, slices)


def _unpivot(df: DataFrame, aggs: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate of all columns of all paths, as rows (slice, path, statistics)."""
    paths, out = list(aggs), []
    for at in range(0, len(paths), GROUP):
        part = paths[at : at + GROUP]
        wide = df.groupBy(SLICE).agg(F.count("*").alias("n"), F.sum(WEIGHT).alias("w"), *[c.alias(f"c{i}_{s}") for i, p in enumerate(part) for s, c in aggs[p].items()])
        rows = [F.struct(F.lit(p).alias("path"), F.col("n"), F.col("w"), *[F.col(f"c{i}_{s}").alias(s) for s in aggs[p]]) for i, p in enumerate(part)]
        out.append(wide.select(SLICE, F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, out)


def _top(fs: list[Feature]) -> list[Feature]:
    return [f for f in fs if not f.repeated]


def _own(df: DataFrame) -> list[Feature]:
    return [f for f in features(df.schema) if f.steps[0] not in (SLICE, WEIGHT, MEANS)]


def _common_aggs(f: Feature, weighted: bool) -> dict[str, Column]:
    if f.repeated:
        cells = f.read
        lens = F.transform(F.filter(cells, lambda x: x.isNotNull()), F.size if f.nest else lambda x: F.lit(1))
        a = {"non_missing": F.sum(F.coalesce(F.size(F.filter(cells, lambda x: x.isNotNull())), F.lit(0)).cast("long")), "tot": F.sum(F.when(cells.isNotNull(), F.aggregate(lens, F.lit(0), lambda s, x: s + x)).cast("long")), "least": F.min(F.array_min(lens)).cast("long"), "most": F.max(F.array_max(lens)).cast("long"), "all": F.sum(F.when(cells.isNotNull(), F.size(cells)).cast("long"))}
    else:
        size = f.sizes()
        a = {"non_missing": F.count(f.read), "tot": F.sum(size), "least": F.min(size), "most": F.max(size), "all": F.count("*")}
    if weighted:
        a |= {"w_present": F.sum(F.when(f.read.isNotNull(), F.col(WEIGHT))), "w_tot": F.sum(F.col(WEIGHT) * f.sizes()) if not f.repeated else F.lit(None).cast("double")}
    return a


def _common_out(got: DataFrame, fs: list[Feature], weighted: bool) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for f in fs for x in (f.path, f.type)])
    out = [
        SLICE,
        "path",
        kinds[F.col("path")].alias("type"),
        F.col("n").alias("num_examples"),
        F.coalesce("non_missing", F.lit(0)).alias("num_non_missing"),
        (F.coalesce("all", F.lit(0)) - F.coalesce("non_missing", F.lit(0))).alias("num_missing"),
        F.col("least").alias("min_num_values"),
        F.col("most").alias("max_num_values"),
        F.when(F.col("non_missing") > 0, F.col("tot") / F.col("non_missing")).alias("avg_num_values"),
        F.coalesce("tot", F.lit(0)).alias("tot_num_values"),
    ]
    if weighted:
        present = F.coalesce("w_present", F.lit(0.0))
        out += [F.col("w").alias("weighted_num_examples"), present.alias("weighted_num_non_missing"), (F.col("w") - present).alias("weighted_num_missing"), F.coalesce("w_tot", F.lit(0.0)).alias("weighted_tot_num_values"), F.when(present > 0, F.coalesce("w_tot", F.lit(0.0)) / present).alias("weighted_avg_num_values")]
    return got.select(*out)


def common(df: DataFrame, weighted: bool = False) -> DataFrame:
    """(slice, path, type, num_examples, num_non_missing, num_missing, min/max/avg/tot_num_values) of ``prepared`` rows; features inside arrays of structs count the parent's values as their examples."""
    fs = _own(df)
    return _common_out(_unpivot(df, {f.path: _common_aggs(f, weighted) for f in fs}), fs, weighted)


def levels(df: DataFrame) -> DataFrame:
    """(slice, path, level, num_missing, num_non_missing, min/max/tot_num_values) of features with nested lists, a row for each list level."""
    aggs, out = {}, []
    for f in _top(features(df.schema)):
        if f.nest < 2 or f.steps[0] in (SLICE, WEIGHT):
            continue
        lists = F.array(f.read)
        for level in range(f.nest):
            present = F.filter(lists, lambda x: x.isNotNull())
            sizes = F.transform(present, F.size)
            aggs[f"{f.path}\0{level + 1}"] = {"missing": F.sum((F.size(lists) - F.size(present)).cast("long")), "present": F.sum(F.size(present).cast("long")), "least": F.min(F.array_min(sizes)).cast("long"), "most": F.max(F.array_max(sizes)).cast("long"), "tot": F.sum(F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("long"))}
            lists = F.flatten(present)
    if not aggs:
        return df.limit(0).select(SLICE, F.lit("").alias("path"), *[F.lit(0).cast("long").alias(c) for c in ("level", "num_missing", "num_non_missing", "min_num_values", "max_num_values", "tot_num_values")])
    parts = F.split("path", "\0")
    return _unpivot(df, aggs).select(SLICE, parts[0].alias("path"), parts[1].cast("long").alias("level"), F.col("missing").alias("num_missing"), F.col("present").alias("num_non_missing"), F.col("least").alias("min_num_values"), F.col("most").alias("max_num_values"), F.col("tot").alias("tot_num_values"))


def exploded(df: DataFrame, f: Feature) -> tuple[DataFrame, Column]:
    """Rows with one leaf value each, and that value."""
    if f.scalar:
        return df, f.read
    kept = [c for c in (SLICE, WEIGHT, MEANS) if c in df.columns]
    return df.select(*kept, F.explode(f.values()).alias("__value")), F.col("__value")


def _by_shape(df: DataFrame, fs: list[Feature], aggs_of) -> DataFrame | None:
    """Scalars in one aggregate; lists, exploded, one each."""
    parts = []
    scalars = {f.path: aggs_of(f, f.read) for f in fs if f.scalar}
    if scalars:
        parts.append(_unpivot(df, scalars))
    for f in fs:
        if not f.scalar:
            rows, value = exploded(df, f)
            parts.append(_unpivot(rows, {f.path: aggs_of(f, value)}))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _numeric_aggs(f: Feature, value: Column, weighted: bool) -> dict[str, Column]:
    inf = float("inf")
    raw = numeric(value, f.leaf).cast("double")
    x = number(value, f)
    finite = F.when((x < inf) & (x > -inf), x)
    out = {"mean": F.avg(x), "sd": F.stddev_pop(finite), "num_zeros": F.count_if(x == 0), "num_nan": F.count_if(F.isnan(raw)) if f.type == FLOAT else F.lit(0).cast("long"), "pos_inf": F.count_if(x == inf), "neg_inf": F.count_if(x == -inf), "min": F.min(x), "max": F.max(x), "finite_min": F.min(finite), "finite_max": F.max(finite), "values": F.count(x)}
    if weighted:
        w = F.when(x.isNotNull(), F.col(WEIGHT))
        out |= {"sw": F.sum(w), "swdd": F.sum(w * F.pow(x - F.element_at(MEANS, F.lit(f.path)), F.lit(2)))}
    return out


def _numeric_out(got: DataFrame, *more) -> DataFrame:
    any_inf = (F.col("pos_inf") + F.col("neg_inf")) > 0
    out = [SLICE, "path", F.col("mean"), F.when(any_inf, F.lit(0.0)).otherwise(F.col("sd")).alias("std_dev"), "num_zeros", "num_nan", "pos_inf", "neg_inf", "min", "max", "finite_min", "finite_max"]
    return got.where("values > 0 OR num_nan > 0").select(*out, *more)


def numeric_stats(df: DataFrame, weighted: bool = False) -> DataFrame | None:
    """(slice, path, mean, std_dev, num_zeros, num_nan, pos_inf, neg_inf, min, max, finite_min, finite_max); NaN takes no part in moments, infinities do, as limits: with both the mean is NaN and the deviation 0."""

    def sums(f: Feature, value: Column) -> dict[str, Column]:
        x = number(value, f)
        w = F.when(x.isNotNull(), F.col(WEIGHT))
        return {"mean": F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))}

    fs = [f for f in _own(df) if f.type in (INT, FLOAT)]
    if weighted and fs:  # deviations from the mean, as squares of large values would cancel out; a row for each slice is joined
        means = _by_shape(df, fs, sums).groupBy(SLICE).agg(F.map_from_entries(F.collect_list(F.struct("path", "mean"))).alias(MEANS))
        df = df.join(F.broadcast(means), SLICE)
    got = _by_shape(df, fs, lambda f, value: _numeric_aggs(f, value, weighted))
    if got is None:
        return None
    if not weighted:
        return _numeric_out(got)
    every = means.select(SLICE, F.explode(MEANS).alias("path", "weighted_mean"))
    got = got.join(F.broadcast(every), [SLICE, "path"], "left")
    return _numeric_out(got, "weighted_mean", F.when(F.col("sw") != 0, F.sqrt(F.col("swdd") / F.col("sw"))).alias("weighted_std_dev"))


def covariances(df: DataFrame, paths: list[str]) -> DataFrame:
    """(slice, path_x, path_y, count, covariance): the sample covariance matrix of single-valued numeric features, over rows that have both."""
    fs = {f.path: f for f in features(df.schema)}
    pairs = [(a, b) for i, a in enumerate(paths) for b in paths[i:]]
    x = lambda p: number(fs[p].read, fs[p])
    wide = df.groupBy(SLICE).agg(*[c for k, (a, b) in enumerate(pairs) for c in (F.covar_samp(x(a), x(b)).alias(f"v{k}"), F.count_if(x(a).isNotNull() & x(b).isNotNull()).alias(f"n{k}"))])
    cells = [F.struct(F.lit(a).alias("path_x"), F.lit(b).alias("path_y"), F.col(f"n{k}").alias("count"), F.col(f"v{k}").alias("covariance")) for k, (a, b) in enumerate(pairs)]
    return wide.select(SLICE, F.inline(F.array(*cells)))


def _textual(df: DataFrame, categorical: list[str] | None) -> list[Feature]:
    chosen = set(categorical or [])
    return [f for f in _own(df) if (f.type in (STRING, BYTES) or f.path in chosen) and f.type != STRUCT]


def _string_aggs(f: Feature, value: Column) -> dict[str, Column]:
    as_bytes = F.octet_length(value) if f.type == STRING else F.length(numeric(value, f.leaf).cast("string"))
    bad = F.count_if(~F.is_valid_utf8(value.cast("string"))) if f.type == STRING else F.lit(0).cast("long")
    return {"values": F.count(value), "avg_length": F.avg(as_bytes), "invalid_utf8_count": bad, "min_num_bytes": F.min(as_bytes).cast("long"), "max_num_bytes": F.max(as_bytes).cast("long")}


def _string_out(got: DataFrame) -> DataFrame:
    return got.where("values > 0").select(SLICE, "path", "avg_length", "invalid_utf8_count", "min_num_bytes", "max_num_bytes", F.col("avg_length").alias("avg_num_bytes"))


def string_stats(df: DataFrame, categorical: list[str] | None = None) -> DataFrame | None:
    """(slice, path, avg_length in bytes, invalid_utf8_count, min/max/avg_num_bytes); features listed as categorical count the length of their text."""
    got = _by_shape(df, _textual(df, categorical), _string_aggs)
    return None if got is None else _string_out(got)


def profile(df: DataFrame, categorical: list[str] | None, keep: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame | None]:
    """{"common", "numeric", "string"}: what :func:`common`, :func:`numeric_stats` and :func:`string_stats` give without weights, with one pass over each scalar column. ``keep`` writes the aggregates, a row for each feature and slice, as each is read for several frames."""
    texts, every = {f.path for f in _textual(df, categorical)}, _own(df)
    kinds = {"c": lambda f: True, "n": lambda f: f.type in (INT, FLOAT), "s": lambda f: f.path in texts}
    make = {"c": lambda f: _common_aggs(f, False), "n": lambda f: _numeric_aggs(f, f.read, False), "s": lambda f: _string_aggs(f, f.read)}
    by: dict[str, list[Feature]] = {}
    for f in every:
        if f.scalar and f.type != STRUCT:
            by.setdefault("".join(k for k, fits in kinds.items() if fits(f)), []).append(f)
    parts: dict[str, list[DataFrame]] = {k: [] for k in kinds}
    for names, fs in by.items():
        wide = keep(_unpivot(df, {f.path: {f"{k}_{s}": c for k in names for s, c in make[k](f).items()} for f in fs}))
        for k in names:
            cells = [F.col(c).alias(c[2:]) for c in wide.columns if c.startswith(f"{k}_")]
            parts[k].append(wide.select(SLICE, "path", *(["n", "w"] if k == "c" else []), *cells))
    rest = [f for f in every if not f.scalar or f.type == STRUCT]
    if rest:
        parts["c"].append(_unpivot(df, {f.path: _common_aggs(f, False) for f in rest}))
        for k, aggs in (("n", lambda f, v: _numeric_aggs(f, v, False)), ("s", _string_aggs)):
            got = _by_shape(df, [f for f in rest if kinds[k](f)], aggs)
            if got is not None:
                parts[k].append(got.drop("n", "w"))
    whole = {k: reduce(lambda x, y: x.unionByName(y), p) if p else None for k, p in parts.items()}
    return {"common": _common_out(whole["c"], every, False), "numeric": _numeric_out(whole["n"]) if whole["n"] is not None else None, "string": _string_out(whole["s"]) if whole["s"] is not None else None}


def empty_values(df: DataFrame) -> DataFrame | None:
    """(slice, path, int_minus_one, str_empty, list_empty): placeholders that stand for nothing."""

    def aggs(f: Feature, value: Column) -> dict[str, Column]:
        return {"int_minus_one": F.count_if(numeric(value, f.leaf) == -1) if f.type == INT else F.lit(0).cast("long"), "str_empty": F.count_if(F.octet_length(value) == 0) if f.type == STRING else F.lit(0).cast("long")}

    fs = [f for f in _top(features(df.schema)) if f.type != STRUCT and f.steps[0] not in (SLICE, WEIGHT)]
    got = _by_shape(df, fs, aggs)
    if got is None:
        return None
    nested = {f.path: {"list_empty": F.sum(F.aggregate(F.filter(f.read, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + F.when(F.size(x) == 0, 1).otherwise(0)).cast("long"))} for f in fs if f.nest == 2}
    if not nested:
        return got.select(SLICE, "path", "int_minus_one", "str_empty", F.lit(0).cast("long").alias("list_empty"))
    lists = _unpivot(df, nested).select(SLICE, "path", "list_empty")
    return got.join(lists, [SLICE, "path"], "left").select(SLICE, "path", "int_minus_one", "str_empty", F.coalesce("list_empty", F.lit(0)).alias("list_empty"))
