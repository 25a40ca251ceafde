"""Slices: each row falls into any number of named parts, the whole table among them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "slice"
ALL = "All Examples"


def _texts(name: str, have: Column, wanted: list | None) -> Column:
    have = F.filter(have, lambda x: x.isNotNull() & (x.isin(wanted) if wanted is not None else F.lit(True)))
    return F.transform(have, lambda x: F.concat(F.lit(f"{name}_"), x.cast("string")))


def _crossed(keys: Column, texts: Column) -> Column:
    return F.flatten(F.transform(keys, lambda a: F.transform(texts, lambda b: F.when(a == "", b).otherwise(F.concat(a, F.lit("_"), b)))))


@dataclass(frozen=True)
class FeatureSlicer:
    """Slices by distinct values of features; ``values`` None takes all, a list only those. Keys join ``name_value`` of all present features, by name."""

    values: dict[str, list | None]

    @property
    def columns(self) -> list[str]:
        return list(self.values)

    def keys(self, schema: T.StructType) -> Column:
        """array<string> of a row's keys."""
        parts = []
        for name in sorted(self.values):
            kind, wanted, col = schema[name].dataType, self.values[name], F.col(f"`{name}`")
            leaf = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if isinstance(leaf, (T.FloatType, T.DoubleType)):
                raise TypeError(f"{name}: slices need string or integer features")
            if wanted is not None:
                if isinstance(leaf, T.IntegralType):
                    try:
                        wanted = [int(x) for x in wanted]
                    except ValueError as e:
                        raise ValueError(f"{name}: slice values must be integers") from e
                else:
                    wanted = [x if isinstance(x, str) else str(x) for x in wanted]
            have = F.array_distinct(col) if isinstance(kind, T.ArrayType) else F.array(col)
            parts.append((col, _texts(name, have, wanted)))
        out = F.array(F.lit(""))
        for col, text in parts:  # a missing feature drops out of the key; one without a wanted value leaves the row out
            out = F.when(col.isNull(), out).otherwise(_crossed(out, text))
        return F.filter(out, lambda x: x != "")


Slicer = FeatureSlicer | Callable[[], Column]


def keys(df: DataFrame, slicers: list | None) -> Column:
    """array<string> of all slices of a row: the whole table, and each slicer's."""
    parts = [F.array(F.lit(ALL))]
    for s in slicers or []:
        parts.append(F.coalesce(s.keys(df.schema) if isinstance(s, FeatureSlicer) else s(), F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.array_distinct(F.concat(*parts))


def with_slices(df: DataFrame, slicers: list | None = None) -> DataFrame:
    """A row for each slice; without slicers a constant column and no explode."""
    if not slicers:
        return df.withColumn(SLICE, F.lit(ALL))
    return df.withColumn(SLICE, F.explode(keys(df, slicers)))


def slice_count(rows: DataFrame) -> DataFrame:
    """(slices): how many slices ``prepared`` rows fall into."""
    return rows.select(SLICE).distinct().agg(F.count("*").alias("slices"))


def from_config(specs: list[dict]) -> list[FeatureSlicer]:
    """Slicers from specs with ``feature_keys`` and ``feature_values``; the empty spec is the whole table, always there."""
    out = []
    for spec in specs:
        values: dict[str, list | None] = {k: None for k in spec.get("feature_keys", [])}
        for k, v in spec.get("feature_values", {}).items():
            values[k] = list(v) if isinstance(v, (list, tuple)) else [v]
        if values:
            out.append(FeatureSlicer(values))
    return out


def sql_slices(df: DataFrame, statements: dict[str, str]) -> list:
    """An extension: named slices by boolean SQL over a row's columns."""
    return [lambda n=name, s=sql: F.when(F.expr(s), F.array(F.lit(n))) for name, sql in statements.items()]
