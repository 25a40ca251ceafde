"""Feature skew: rows of two tables joined on identifiers and compared feature by feature."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "__MISSING_VALUE__"


def _missing(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | (F.size(c) == 0) if isinstance(kind, T.ArrayType) else c.isNull()


def _rounded(c: Column, kind: T.DataType, digits: int | None) -> Column:
    """Half-even rounding of floating values, in lists too."""
    if digits is None:
        return c
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return F.transform(c, lambda x: F.bround(x.cast("double"), digits))
    return F.bround(c.cast("double"), digits) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


class FeatureSkew:
    """Base and test rows with equal identifiers, compared.

    Rows with a missing or empty identifier take no part and are counted. An identifier that occurs more than once on a side
    is left out, unless ``duplicates``, when all pairs are compared. Identifiers are joined by value, not by a hash.
    """

    def __init__(self, base: DataFrame, test: DataFrame, identifiers: list[str], ignore: list[str] | None = None, digits: int | None = None, duplicates: bool = False):
        if not identifiers:
            raise ValueError("at least one identifier is needed")
        self.ids, self.digits, self.duplicates = list(identifiers), digits, duplicates
        skip = {*identifiers, *(ignore or [])}
        self.base_kinds = {f.name: f.dataType for f in base.schema.fields if f.name not in skip}
        self.test_kinds = {f.name: f.dataType for f in test.schema.fields if f.name not in skip}
        self.names = sorted({*self.base_kinds, *self.test_kinds})
        self.base, self.test = self._side(base, "b"), self._side(test, "t")

    def _side(self, df: DataFrame, tag: str) -> DataFrame:
        kinds = self.base_kinds if tag == "b" else self.test_kinds
        gone = reduce(Column.__or__, [_missing(F.col(f"`{i}`"), df.schema[i].dataType) for i in self.ids])
        cols = [F.col(f"`{n}`").alias(f"{tag}_{k}") for k, n in enumerate(self.names) if n in kinds]
        return df.select(gone.alias("no_id"), *[F.col(f"`{i}`").alias(f"id{k}") for k, i in enumerate(self.ids)], *cols)

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.where("NOT no_id").drop("no_id")

    def pairs(self) -> DataFrame:
        """Joined rows with ``code<k>`` for each feature: 0 both missing, 1 match, 2 base only, 3 test only, 4 mismatch, 5 missing and empty."""
        keys = [f"id{k}" for k in range(len(self.ids))]
        base, test = self._keyed(self.base), self._keyed(self.test)
        if not self.duplicates:
            # counted with partial sums, so that an identifier that many rows share is dropped before it is gathered
            base, test = (x.join(x.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").select(*keys), keys, "left_semi") for x in (base, test))
        return base.join(test, keys).select(*keys, *base.columns[len(keys) :], *test.columns[len(keys) :], *[self._code(k, n).alias(f"code{k}") for k, n in enumerate(self.names)])

    def _code(self, k: int, name: str) -> Column:
        if name not in self.test_kinds or name not in self.base_kinds:
            tag, kinds, code = ("b", self.base_kinds, 2) if name in self.base_kinds else ("t", self.test_kinds, 3)
            c = F.col(f"{tag}_{k}")
            return F.when(~_missing(c, kinds[name]), code).when(c.isNotNull(), 5).otherwise(0)
        b, t, kb, kt = F.col(f"b_{k}"), F.col(f"t_{k}"), self.base_kinds[name], self.test_kinds[name]
        nb, nt = _missing(b, kb), _missing(t, kt)
        same = _rounded(b, kb, self.digits) == _rounded(t, kt, self.digits)
        return F.when(nb & nt, F.when(b.isNull() == t.isNull(), 0).otherwise(5)).when(nt, 2).when(nb, 3).when(same, 1).otherwise(4)

    def results(self) -> DataFrame:
        """(feature_name, base_count, test_count, match_count, base_only, test_only, mismatch_count, diff_count) of features that skew or match anywhere."""
        cells = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(f"code{k}").alias("code")) for k, n in enumerate(self.names)])
        n = lambda *codes: F.count_if(F.col("code").isin(*codes))
        got = self.pairs().select(F.inline(cells)).groupBy("feature_name").agg(n(1, 2, 4).alias("base_count"), n(1, 3, 4).alias("test_count"), n(1).alias("match_count"), n(2).alias("base_only"), n(3).alias("test_only"), n(4).alias("mismatch_count"), n(2, 3, 4).alias("diff_count"))
        return got.where("base_count + test_count > 0")

    def match_stats(self) -> DataFrame:
        """One row: rows with an identifier on each side, identifiers, pairs, identifiers missing on a side, duplicated ones, rows without identifier."""
        keys = [f"id{k}" for k in range(len(self.ids))]
        both = self._keyed(self.base).select(*keys, F.lit(1).alias("b"), F.lit(0).alias("t")).unionByName(self._keyed(self.test).select(*keys, F.lit(0).alias("b"), F.lit(1).alias("t")))
        per = both.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
        dup = (F.col("b") > 1) | (F.col("t") > 1)
        made = F.col("b") * F.col("t") if self.duplicates else F.when(dup, 0).otherwise(F.col("b") * F.col("t"))
        zero = lambda c, a: F.coalesce(c, F.lit(0)).cast("long").alias(a)
        ids = per.agg(zero(F.sum("b"), "base_with_id_count"), zero(F.sum("t"), "test_with_id_count"), F.count("*").alias("identifiers_count"), zero(F.sum(made), "matching_pairs_count"), F.count_if(F.col("b") == 0).alias("ids_missing_in_base_count"), F.count_if(F.col("t") == 0).alias("ids_missing_in_test_count"), F.count_if(dup).alias("duplicate_id_count"))
        b, t = (x.agg(F.count_if("no_id").alias(a)) for x, a in ((self.base, "base_missing_id_count"), (self.test, "test_missing_id_count")))
        return ids.crossJoin(b).crossJoin(t)  # three rows of totals

    def skewed_pairs(self, n: int | None = None, seed: int = 0) -> DataFrame:
        """(identifiers, matched, base_only, test_only, mismatched feature names) of pairs that skew; ``n``: a random sample of that size."""
        got = self.pairs()
        lists = [F.filter(F.array(*[F.when(F.col(f"code{k}") == code, F.lit(name)) for k, name in enumerate(self.names)]), lambda x: x.isNotNull()).alias(a) for code, a in ((1, "matched_features"), (2, "base_only_features"), (3, "test_only_features"), (4, "mismatched_features"))]
        any_skew = reduce(Column.__or__, [F.col(f"code{k}") > 1 for k in range(len(self.names))])
        out = got.where(any_skew).select(*[F.col(f"id{k}").alias(i) for k, i in enumerate(self.ids)], *lists)
        return out if n is None else out.orderBy(F.xxhash64(F.lit(seed), *self.ids)).limit(n)

    def confusion(self, features: list[str]) -> DataFrame:
        """(feature_name, base, test, count) of string features with one value; a missing value has a name of its own. Others raise."""
        for name in features:
            for kinds in (self.base_kinds, self.test_kinds):
                kind = kinds.get(name)
                leaf = kind.elementType if isinstance(kind, T.ArrayType) else kind
                if not isinstance(leaf, (T.StringType, T.BinaryType)):
                    raise ValueError(f"{name}: only string features have confusion counts")

        def text(tag: str, k: int, kind: T.DataType) -> Column:
            c = F.col(f"{tag}_{k}")
            if isinstance(kind, T.ArrayType):
                c = F.when(F.size(c) > 1, F.raise_error(F.lit("a feature has several values"))).otherwise(F.try_element_at(c, F.lit(1)))
            return F.coalesce(c.cast("string"), F.lit(MISSING))

        at = {n: k for k, n in enumerate(self.names)}
        cells = F.array(*[F.struct(F.lit(n).alias("feature_name"), text("b", at[n], self.base_kinds[n]).alias("base"), text("t", at[n], self.test_kinds[n]).alias("test")) for n in features])
        return self.pairs().select(F.inline(cells)).where(f"NOT (base = '{MISSING}' AND test = '{MISSING}')").groupBy("feature_name", "base", "test").agg(F.count("*").alias("count"))

    def write(self, path: str, pairs: int | None = None, confusion: list[str] | None = None) -> None:
        """Each result as Parquet below ``path``: features, match_stats, and if asked for a sample of that many skewed ``pairs`` and the ``confusion`` of features."""
        path = path.rstrip("/")
        self.results().write.parquet(f"{path}/features")
        self.match_stats().write.parquet(f"{path}/match_stats")
        if pairs is not None:
            self.skewed_pairs(pairs).write.parquet(f"{path}/pairs")
        if confusion:
            self.confusion(confusion).write.parquet(f"{path}/confusion")


KINDS = ("features", "match_stats", "pairs", "confusion")


def skew_results(spark: SparkSession, path: str, kind: str) -> Iterator[dict]:
    """Records of one kind that :meth:`FeatureSkew.write` left below ``path``, one partition on the driver at a time."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    for row in spark.read.parquet(f"{path.rstrip('/')}/{kind}").toLocalIterator():
        yield row.asDict(recursive=True)
