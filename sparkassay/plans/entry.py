"""Statistics straight from where data lie: CSV files, row files, pandas."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.schema import Schema
from ..sources import examples, readers, statistics_io
from .statistics import StatsOptions, generate_statistics

Stats = dict[str, dict[str, Any]]


def _collected(df: DataFrame, options: StatsOptions | None, output_path: str | None) -> Stats:
    stats = generate_statistics(df, options).collect()
    if output_path is not None:
        statistics_io.write_binary(df.sparkSession, stats, output_path)
    return stats


def statistics_from_csv(spark: SparkSession, path: str, column_names: list[str] | None = None, delimiter: str = ",", output_path: str | None = None, options: StatsOptions | None = None, schema: Schema | None = None) -> Stats:
    """Statistics of CSV files by slice; without ``column_names`` all files start with one header. Written to ``output_path`` too, if given. ValueError for missing or empty files and differing headers."""
    names = column_names
    if names is None:
        readers.csv_header(spark, path, delimiter)
    return _collected(readers.read_csv(spark, path, names, delimiter, schema), options, output_path)


def statistics_from_rows(spark: SparkSession, path: str, format: str = "parquet", output_path: str | None = None, options: StatsOptions | None = None, schema: T.StructType | None = None, **reader_options) -> Stats:
    """Statistics of row files that Spark reads: Parquet, JSON, ORC and others, and of record files of serialized examples (format ``examples``); compression by suffix."""
    if format == "examples":
        return _collected(examples.read_examples(spark, path), options, output_path)
    return _collected(readers.read_rows(spark, path, format, schema, **reader_options), options, output_path)


def statistics_from_pandas(spark: SparkSession, pdf: pd.DataFrame, options: StatsOptions | None = None, n_jobs: int = 1) -> Stats:
    """Statistics of a pandas table, in ``n_jobs`` partitions; columns of other than primitive types are left out, booleans count as categories."""
    if n_jobs < 1:
        raise ValueError("n_jobs must be at least 1")
    return _collected(readers.from_pandas(spark, pdf).repartition(n_jobs), options, None)
