"""Profiles of streams, an extension: windowed statistics with a watermark, and batch-wise validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import FLOAT, INT, STRING, features
from ..functions.schema import Schema
from ..operators import rows
from ..operators.basic import number


def windowed(stream: DataFrame, time: str, window: str, watermark: str = "0 seconds", columns: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """(start, end, path, num_examples, num_non_missing, mean, std_dev, min, max) of each window and scalar feature; works on bounded tables too."""
    fs = [f for f in features(stream.schema) if f.scalar and f.type in (INT, FLOAT, STRING) and f.path != time and (columns is None or f.path in columns)]
    base = stream.withWatermark(time, watermark) if stream.isStreaming else stream
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fs):
        aggs.append(F.count(f.read).alias(f"c{i}"))
        if f.type != STRING:
            x = number(f.read, f)
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    wide = base.groupBy(F.window(time, window, slide).alias("w")).agg(*aggs)
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(f.path).alias("path"), F.col("n").alias("num_examples"), F.col(f"c{i}").alias("num_non_missing"), *[(F.col(f"{k}{i}") if f.type != STRING else none).alias(a) for k, a in (("m", "mean"), ("s", "std_dev"), ("l", "min"), ("h", "max"))]) for i, f in enumerate(fs)]
    return wide.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.inline(F.array(*cells)))


def validated(stream: DataFrame, schema: Schema) -> DataFrame:
    """A stream's rows once for each anomaly they show: stateless, so it runs as it is on streams."""
    return rows.anomalous(stream, schema)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every micro-batch to ``handle``, for whole-dataset statistics of each span."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
