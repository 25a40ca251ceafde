"""Where tables come from: CSV with inferred types, row files, pandas, dictionaries, vocabularies."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import Schema


def csv_header(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    """Column names that all files of ``path`` share; ValueError for missing, empty or differing ones. First blocks of the files are read."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path).withColumn("f", F.col("_metadata.file_path")).withColumn("b", F.col("_metadata.file_block_start"))
        firsts = lines.where("b = 0").groupBy("f").agg(F.first("value").alias("v")).collect()
        files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    except AnalysisException as e:
        raise ValueError(f"no files at {path}") from e
    if not files or any(not f.length for f in files):
        raise ValueError(f"{path} is missing or has an empty file")
    headers = {r.v for r in firsts}
    if len(headers) != 1:
        raise ValueError(f"files of {path} have different headers")
    return next(csv.reader([headers.pop()], delimiter=delimiter))


def read_csv(spark: SparkSession, path: str, column_names: list[str] | None = None, delimiter: str = ",", schema: Schema | None = None, multivalent: list[str] | None = None, secondary_delimiter: str = "|") -> DataFrame:
    """A CSV table; names from the first line unless given. Types: whole numbers, then floating ones, then strings, over all rows; blanks are null, blank lines are skipped. Multivalent columns are split into lists."""
    lists = set(multivalent or [])
    raw = spark.read.csv(path, header=column_names is None, sep=delimiter, inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="")
    if column_names is not None:
        raw = raw.toDF(*column_names)
    return typed(raw, schema, lists, secondary_delimiter)


def typed(raw: DataFrame, schema: Schema | None = None, lists: set[str] | None = None, secondary: str = "|") -> DataFrame:
    """Strings as the narrowest type that holds all values of a column, found in one aggregate; with a schema, its types."""
    lists = lists or set()
    names = raw.columns
    cells = {n: F.split(F.col(f"`{n}`"), "\\" + secondary) if n in lists else F.array(f"`{n}`") for n in names}
    if schema is not None:
        kinds = {n: schema.features[n].type if n in schema.features else None for n in names}
    else:
        kinds = dict.fromkeys(names)
    open_names = [n for n in names if kinds[n] is None]
    if open_names:
        aggs = []
        for i, n in enumerate(open_names):
            some = F.filter(cells[n], lambda x: x.isNotNull() & (x != ""))
            aggs += [F.bool_and(F.forall(some, lambda x: x.rlike(r"^[+-]?[0-9]+$") & x.try_cast("bigint").isNotNull())).alias(f"i{i}"), F.bool_and(F.forall(some, lambda x: x.rlike(r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|nan|Infinity|NaN)$"))).alias(f"f{i}"), F.sum(F.size(some)).alias(f"n{i}")]
        got = raw.agg(*aggs).first()
        for i, n in enumerate(open_names):
            kinds[n] = "BYTES" if not got[f"n{i}"] else "INT" if got[f"i{i}"] else "FLOAT" if got[f"f{i}"] else "BYTES"
    spark_types = {"INT": "bigint", "FLOAT": "double", "BYTES": "string"}
    out = []
    for n in names:
        values = F.transform(cells[n], _caster(spark_types[kinds[n]]))
        if n in lists:
            out.append(F.when(F.col(f"`{n}`").isNotNull(), values).alias(n))
        else:
            out.append(values[0].alias(n))
    return raw.select(*out)


def _caster(kind: str):
    return lambda x: F.when(x != "", x.try_cast(kind) if kind != "string" else x)


def read_rows(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """A table of row files: Parquet, JSON, ORC or whatever Spark reads; compression by suffix."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    """Columns of primitive types only; booleans stay booleans, whose statistics are those of 0 and 1."""
    keep = [c for c in pdf.columns if pdf[c].dtype.kind in "biuf" or pdf[c].dropna().map(lambda v: isinstance(v, (str, bytes, bool, int, float))).all()]
    return spark.createDataFrame(pdf[keep].astype({c: object for c in keep if pdf[c].dtype.kind == "O"}))


def from_dicts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Examples as name -> list or None; a name without any value becomes a column of nulls. Values of other kinds raise TypeError."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {}
    for n in names:
        kind: type | None = None
        for r in rows:
            v = r.get(n)
            for x in list(v) if v is not None and not isinstance(v, (str, bytes)) else []:
                x = x.item() if hasattr(x, "item") else x
                if not isinstance(x, (bool, int, float, str, bytes)):
                    raise TypeError(f"{n}: values of type {type(x).__name__} are not supported")
                kind = float if {kind, type(x)} == {int, float} else type(x)
            if v is not None and isinstance(v, (str, bytes)):
                raise TypeError(f"{n}: an example is a list of values")
        kinds[n] = {None: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}[kind]
    fields = T.StructType([T.StructField(n, T.ArrayType(kinds[n])) for n in names])
    cast = lambda v, n: None if v is None else [float(x) if isinstance(kinds[n], T.DoubleType) else (x.item() if hasattr(x, "item") else x) for x in v]
    return spark.createDataFrame([tuple(cast(r.get(n), n) for n in names) for r in rows], fields)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id): a token a line, numbered by line within a file; uncompressed by suffix. A vocabulary file is read by one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("id", "token"))
    return lines.where("token <> ''").select("token", F.col("id").cast("long").alias("id"))
