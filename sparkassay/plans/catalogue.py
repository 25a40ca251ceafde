"""The queries registered with the driver, each an operator over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import Comparator, DatasetConstraints, Domain, Feature, Presence, Schema, SparseFeature, ValueCount, WeightedFeature
from ..operators import association, basic, display, drift, inference, quantiles, rows, semantic, slicing, validation, values
from ..operators.skew import FeatureSkew
from ..operators.slicing import SLICE, FeatureSlicer
from ..streaming import profile
from . import generators
from .statistics import StatsOptions, generate_statistics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
R = 6


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- basic statistics
@query(_union([f"SELECT '{c}' AS path, count({c}) AS num_non_missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std_dev, count(*) FILTER ({c} = 0) AS num_zeros, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in LINE_NUMBERS]))
def basic_numeric(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "lineitem"), columns=LINE_NUMBERS)
    got = basic.numeric_stats(p).join(basic.common(p), [SLICE, "path"])
    return rounded(got.select("path", "num_non_missing", "mean", "std_dev", "num_zeros", "min", "max"))


@query(_union([f"SELECT '{t}' AS source, '{c}' AS path, count(*) AS num_examples, count({c}) AS num_non_missing, count(*) - count({c}) AS num_missing, count({c}) AS tot_num_values FROM {t}" for t, cs in {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "documents": ["doc_id", "text", "lang", "source", "n_chars"]}.items() for c in cs]))
def basic_counts(spark, sf_dir):
    out = None
    for t in ("customer", "part", "documents"):
        got = basic.common(basic.prepared(table(spark, sf_dir, t))).select(F.lit(t).alias("source"), "path", "num_examples", "num_non_missing", "num_missing", "tot_num_values")
        out = got if out is None else out.unionByName(got)
    return out


_EVENTS_ODD = "SELECT CASE WHEN event_id % 10 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 10 = 1 THEN 'Infinity'::DOUBLE WHEN event_id % 10 = 2 THEN NULL ELSE value END AS v FROM events"


def _odd_events(spark, sf_dir):
    e = F.col("event_id") % 10
    v = F.when(e == 0, float("nan")).when(e == 1, float("inf")).when(e == 2, None).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(v.cast("double").alias("v"))


@query(f"WITH e AS ({_EVENTS_ODD}) SELECT count(*) FILTER (isnan(v)) AS num_nan, count(*) FILTER (NOT isnan(v) AND isinf(v)) AS pos_inf, count(*) FILTER (v = 0) AS num_zeros, round(min(v) FILTER (isfinite(v)), 6) AS finite_min, round(max(v) FILTER (isfinite(v)), 6) AS finite_max, count(v) AS num_non_missing, count(*) - count(v) AS num_missing FROM e")
def nan_inf_counts(spark, sf_dir):
    p = basic.prepared(_odd_events(spark, sf_dir))
    got = basic.numeric_stats(p).join(basic.common(p), [SLICE, "path"])
    return rounded(got.select("num_nan", "pos_inf", "num_zeros", "finite_min", "finite_max", "num_non_missing", "num_missing"))


@query(_union([f"SELECT '{c}' AS path, round(avg(strlen({c})), 6) AS avg_length, min(strlen({c})) AS min_num_bytes, max(strlen({c})) AS max_num_bytes, 0::BIGINT AS invalid_utf8_count FROM documents" for c in ("text", "lang", "source")]))
def string_lengths(spark, sf_dir):
    return rounded(basic.string_stats(basic.prepared(table(spark, sf_dir, "documents"))).select("path", "avg_length", "min_num_bytes", "max_num_bytes", "invalid_utf8_count"))


@query("SELECT min(len(embedding)) AS min_num_values, max(len(embedding)) AS max_num_values, sum(len(embedding))::BIGINT AS tot_num_values, count(embedding) AS num_non_missing, (SELECT round(avg(x), 6) FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)) AS mean, (SELECT round(stddev_pop(x), 6) FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)) AS std_dev FROM embeddings")
def embedding_leaf_stats(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "embeddings"), columns=["embedding"])
    return rounded(basic.common(p).join(basic.numeric_stats(p), [SLICE, "path"]).select("min_num_values", "max_num_values", "tot_num_values", "num_non_missing", "mean", "std_dev"))


@query("WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT count(*) AS num_examples, min(len(roles)) AS min_num_values, max(len(roles)) AS max_num_values, round(avg(len(roles)), 6) AS avg_num_values, sum(len(roles))::BIGINT AS tot_num_values FROM c")
def valency_stats(spark, sf_dir):
    return rounded(basic.common(basic.prepared(_conversations(spark, sf_dir), columns=["roles"])).select("num_examples", "min_num_values", "max_num_values", "avg_num_values", "tot_num_values"))


def _conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: x["text"]).alias("texts"), F.transform("t", lambda x: F.split(x["text"], " ")).alias("words"))


@query("WITH c AS (SELECT conv_id, list(string_split(text, ' ') ORDER BY turn) AS w FROM conversations GROUP BY conv_id), d AS (SELECT unnest(w) AS x FROM c) SELECT 1::BIGINT AS level, min(len(w)) AS min_num_values, max(len(w)) AS max_num_values, sum(len(w))::BIGINT AS tot_num_values FROM c UNION ALL SELECT 2, min(len(x)), max(len(x)), sum(len(x))::BIGINT FROM d")
def nested_levels(spark, sf_dir):
    return basic.levels(basic.prepared(_conversations(spark, sf_dir), columns=["words"])).select("level", "min_num_values", "max_num_values", "tot_num_values")


@query("SELECT round(sum(l_quantity), 6) AS weighted_num_examples, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_mean, round(sqrt(sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - pow(sum(l_quantity * l_discount) / sum(l_quantity), 2)), 6) AS weighted_std_dev, round(sum(l_quantity), 6) AS weighted_tot_num_values FROM lineitem")
def weighted_moments(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "lineitem"), "l_quantity", columns=["l_discount"])
    got = basic.common(p, True).join(basic.numeric_stats(p, True), [SLICE, "path"]).where("path = 'l_discount'")
    return rounded(got.select("weighted_num_examples", "weighted_mean", "weighted_std_dev", "weighted_tot_num_values"))


@query(_union([f"SELECT '{a}' AS path_x, '{b}' AS path_y, count(*) AS count, round(covar_samp({a}, {b}), 4) + 0.0 AS covariance FROM lineitem" for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_extendedprice"), ("l_extendedprice", "l_extendedprice"))]))
def sample_covariance(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_quantity", "l_extendedprice"])
    return rounded(basic.covariances(p, ["l_quantity", "l_extendedprice"]).drop(SLICE), 4).withColumn("covariance", F.col("covariance") + 0.0)


@query("SELECT 'l_discount' AS path, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_mean FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_linenumber * l_tax) / sum(l_linenumber), 6) FROM lineitem")
def weights_by_feature(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", "l_discount", "l_tax")
    got = generate_statistics(line, StatsOptions(weight="l_quantity", feature_weights={"l_tax": "l_linenumber"})).frame("numeric")
    return rounded(got.where("path IN ('l_discount', 'l_tax')").select("path", "weighted_mean"))


@query("WITH c AS (SELECT conv_id, list(string_split(text, ' ') ORDER BY turn) AS w FROM conversations GROUP BY conv_id), d AS (SELECT unnest(w) AS x FROM c) SELECT 2 AS level, len(x)::DOUBLE AS value, count(*)::DOUBLE AS w FROM d GROUP BY 2")
def level_valencies(spark, sf_dir):
    p = basic.prepared(_conversations(spark, sf_dir).select("words"))
    return quantiles.level_valencies(p).select("level", "value", "w")


@query("SELECT count(DISTINCT l_returnflag) + 1 AS slices FROM lineitem")
def slice_count(spark, sf_dir):
    return slicing.slice_count(basic.prepared(table(spark, sf_dir, "lineitem"), slices=[FeatureSlicer({"l_returnflag": None})]))


@query("SELECT count(*) AS rows, sum(strlen(text) + strlen(lang) + strlen(source))::BIGINT AS bytes, 1::BIGINT AS slices, 3::BIGINT AS strings, 2::BIGINT AS integers FROM documents")
def run_counters(spark, sf_dir):
    got = generate_statistics(table(spark, sf_dir, "documents")).counters()
    return spark.createDataFrame([(got["rows"], got["bytes"], got["slices"], got["features"]["STRING"], got["features"]["INT"])], "rows long, bytes long, slices long, strings long, integers long")


@query("SELECT 'l_quantity' AS path, 'range' AS name, (max(l_quantity) - min(l_quantity))::DOUBLE AS value FROM lineitem UNION ALL SELECT 'l_tax', 'range', round(max(l_tax) - min(l_tax), 6) FROM lineitem UNION ALL SELECT 'l_quantity*l_tax', 'mean_product', round(avg(l_quantity * l_tax), 6) FROM lineitem UNION ALL SELECT 'l_quantity*l_tax', 'mean_quotient', round(sum(l_tax) / sum(l_quantity), 6) FROM lineitem")
def custom_generators(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_quantity", "l_tax"])
    spread = generators.FeatureGenerator(lambda f, v: {"range": F.max(v) - F.min(v)})
    n, q, t = generators.Part("n", F.count("*")), generators.Part("q", F.sum("l_quantity")), generators.Part("t", F.sum("l_tax"))
    product = generators.Composite([n, generators.Part("qt", F.sum(F.col("l_quantity") * F.col("l_tax")))], lambda c: {("l_quantity*l_tax", "mean_product"): c["qt"] / c["n"]})
    quotient = generators.Composite([n, q, t], lambda c: {("l_quantity*l_tax", "mean_quotient"): c["t"] / c["q"]})
    return rounded(spread(p).unionByName(generators.composed([product, quotient])(p)).drop(SLICE))


@query("SELECT count(*) FILTER (v = -1) AS int_minus_one, count(*) FILTER (strlen(s) = 0) AS str_empty FROM (SELECT CASE WHEN user_id % 7 = 0 THEN -1 ELSE user_id END AS v, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS s FROM events)")
def empty_value_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 7 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("v"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("s"))
    return basic.empty_values(basic.prepared(e)).agg(F.sum("int_minus_one").alias("int_minus_one"), F.sum("str_empty").alias("str_empty"))


# --- quantiles and histograms
@query(_union([f"SELECT path, v AS median FROM (SELECT '{c}' AS path, {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {t}) WHERE r = n // 2 + 1" for t, c in (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("customer", "c_acctbal"))]))
def median_exact(spark, sf_dir):
    line = quantiles.numeric_values(basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_quantity", "l_extendedprice"]))
    cust = quantiles.numeric_values(basic.prepared(table(spark, sf_dir, "customer"), columns=["c_acctbal"]))
    return quantiles.median(quantiles.cumulative(line.unionByName(cust))).select("path", "median")


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem) SELECT i::BIGINT AS i, v AS q FROM s JOIN range(0, 11) t(i) ON r = least(floor(i * n / 10), n - 1)::BIGINT")
def quantile_boundaries(spark, sf_dir):
    line = quantiles.numeric_values(basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_extendedprice"]))
    return quantiles.grid(quantiles.cumulative(line), 10).select("i", "q")


@query("""WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem),
q AS (SELECT i, v FROM s JOIN range(0, 11) t(i) ON r = least(floor(i * n / 10), n - 1)::BIGINT),
c AS (SELECT i, v, (SELECT count(*) FROM lineitem WHERE l_extendedprice <= v) AS cum FROM q)
SELECT (b.i - 1)::INTEGER AS bucket, a.v AS low, b.v AS high, round((b.cum - a.cum + CASE WHEN b.i = 1 THEN a.cum ELSE 0 END)::DOUBLE, 6) AS count FROM c a JOIN c b ON b.i = a.i + 1""")
def quantiles_histogram(spark, sf_dir):
    line = quantiles.numeric_values(basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_extendedprice"]))
    return rounded(quantiles.histograms(line, kinds=("QUANTILES",)).select("bucket", "low", "high", "count"))


_EDGES = "WITH m AS (SELECT min({c}) AS lo, max({c}) AS hi, {n}::DOUBLE AS n FROM lineitem) SELECT '{c}' AS path, k::INTEGER AS bucket, round(lo + k * (hi - lo) / 10, 6) AS low, round(CASE WHEN k = 9 THEN hi ELSE lo + (k + 1) * (hi - lo) / 10 END, 6) AS high, true AS near, round(n, 3) AS total FROM m, range(0, 10) t(k)"


def _near(got: DataFrame, rows: DataFrame, weight: Column) -> DataFrame:
    """Equal-width buckets beside their exact weights: a bucket's count is interpolated in a grid of thousandths, so it may be off by what a few cells of the grid hold, and by what stands on its edges."""
    # weights below and up to an edge bracket what an interpolation may say
    edges = got.join(rows, "path").groupBy("path", "bucket", "low", "high", "count").agg(F.sum(F.when((F.col("v") > F.col("low")) & (F.col("v") < F.col("high")), weight).otherwise(0)).alias("inner"), F.sum(F.when((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")), weight).otherwise(0)).alias("outer"), F.sum(weight).alias("total"))
    slack = F.col("total") * 0.005
    near = (F.col("count") >= F.col("inner") - slack) & (F.col("count") <= F.col("outer") + slack)
    return rounded(edges.select("path", "bucket", "low", "high", near.alias("near"), F.round("total", 3).alias("total")))


@query(_union([f"SELECT * FROM ({_EDGES.format(c=c, n='count(*)')})" for c in ("l_extendedprice", "l_discount")]))
def standard_histogram(spark, sf_dir):
    line = quantiles.numeric_values(basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_extendedprice", "l_discount"]))
    got = quantiles.histograms(line, kinds=("STANDARD",)).select("path", "bucket", "low", "high", "count")
    return _near(got, line.select("path", F.col("value").alias("v"), "w"), F.col("w"))


@query(_EDGES.format(c="l_discount", n="sum(l_quantity)"))
def weighted_histogram(spark, sf_dir):
    line = quantiles.numeric_values(basic.prepared(table(spark, sf_dir, "lineitem"), "l_quantity", columns=["l_discount"]), ["l_discount"], True)
    got = quantiles.histograms(line, kinds=("STANDARD",)).select("path", "bucket", "low", "high", "count")
    return _near(got, line.select("path", F.col("value").alias("v"), "w"), F.col("w"))


@query(_union([f"SELECT '{c}' AS path, i::INTEGER AS i, true AS within FROM range(0, 11) t(i)" for c in LINE_NUMBERS]))
def quantiles_approx(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "lineitem"), columns=LINE_NUMBERS)
    marks = quantiles.approximate(p).select("path", F.posexplode("quantiles").alias("i", "q"))
    exact = quantiles.numeric_values(p)
    total = exact.groupBy("path").agg(F.sum("w").alias("n"))
    # the share below and the share up to a mark bracket its rank, to 1 %
    ranks = exact.join(F.broadcast(marks), "path").groupBy("path", "i").agg(F.sum(F.when(F.col("value") < F.col("q"), F.col("w")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("q"), F.col("w")).otherwise(0)).alias("upto"))
    share = F.col("i") / 10
    return ranks.join(total, "path").select("path", "i", ((F.col("below") / F.col("n") <= share + 0.01) & (F.col("upto") / F.col("n") >= share - 0.01)).alias("within"))


# --- values
_TOP = "SELECT '{c}' AS path, value, cnt, rank FROM (SELECT {c} AS value, count(*) AS cnt, (row_number() OVER (ORDER BY count(*) DESC, {c} DESC) - 1)::INTEGER AS rank FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank < {k}"


@query(_union([_TOP.format(c=c, t="part", k=20) for c in ("p_name", "p_brand", "p_type")]))
def topk_strings(spark, sf_dir):
    return values.top(values.value_counts(basic.prepared(table(spark, sf_dir, "part")))).select("path", "value", "cnt", "rank")


@query("SELECT o_orderpriority AS value, round(sum(o_totalprice), 4) AS wcnt FROM orders GROUP BY 1")
def topk_weighted(spark, sf_dir):
    counts = values.value_counts(basic.prepared(table(spark, sf_dir, "orders"), "o_totalprice", columns=["o_orderpriority"]))
    return rounded(values.top(counts, by="wcnt").select("value", "wcnt"), 4)


@query("SELECT * FROM (SELECT event_type AS label, (row_number() OVER (ORDER BY count(*) DESC, event_type DESC) - 1)::INTEGER AS low_rank, count(*)::DOUBLE AS sample_count FROM events GROUP BY event_type) WHERE low_rank < 1000")
def rank_histogram(spark, sf_dir):
    return values.rank_histogram(values.value_counts(basic.prepared(table(spark, sf_dir, "events"), columns=["event_type"]))).select("label", "low_rank", "sample_count")


@query(_union([f"SELECT '{c}' AS path, count(DISTINCT {c}) AS \"unique\" FROM {t}" for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"))]))
def uniques_exact(spark, sf_dir):
    counts = values.value_counts(basic.prepared(table(spark, sf_dir, "orders"))).unionByName(values.value_counts(basic.prepared(table(spark, sf_dir, "part"))))
    return values.uniques(counts).select("path", "unique")


_SKETCHED = "SELECT '{c}' AS path, true AS near, (SELECT count(*) FROM (SELECT {c} FROM part GROUP BY 1)) <= 1000 AS few, CASE WHEN (SELECT count(DISTINCT {c}) FROM part) <= 1000 THEN (SELECT max(c) FROM (SELECT count(*) AS c FROM part GROUP BY {c})) END AS most"


@query(_union([_SKETCHED.format(c=c) for c in ("p_name", "p_brand", "p_type")]))
def uniques_and_topk_sketch(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "part"))
    exact = values.uniques(values.value_counts(p)).select("path", F.col("unique").alias("exact"))
    got = values.sketched(p).join(exact, "path")
    few = F.col("exact") <= 1000
    return got.select("path", (F.abs(F.col("unique") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("near"), few.alias("few"), F.when(few, F.array_max(F.transform("top", lambda x: x["cnt"]))).alias("most"))


@query("SELECT l_linenumber::VARCHAR AS value, count(*) AS cnt FROM lineitem GROUP BY 1")
def topk_categorical_ints(spark, sf_dir):
    return values.value_counts(basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_linenumber"]), ["l_linenumber"]).select("value", "cnt")


# --- slices
_SLICE_NUMBERS = "count(*) AS num_examples, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std_dev"


def _sliced_quantity(spark, sf_dir, slicers):
    p = basic.prepared(table(spark, sf_dir, "lineitem"), slices=slicers, columns=["l_quantity"])
    got = basic.numeric_stats(p).where("path = 'l_quantity'").join(basic.common(p), [SLICE, "path"])
    return rounded(got.select(SLICE, "num_examples", "mean", "std_dev"))


@query(f"SELECT 'l_returnflag_' || l_returnflag AS slice, {_SLICE_NUMBERS} FROM lineitem GROUP BY 1 UNION ALL SELECT 'All Examples', {_SLICE_NUMBERS} FROM lineitem")
def slice_by_flag(spark, sf_dir):
    return _sliced_quantity(spark, sf_dir, [FeatureSlicer({"l_returnflag": None})])


@query(f"SELECT 'l_linestatus_' || l_linestatus || '_l_returnflag_' || l_returnflag AS slice, {_SLICE_NUMBERS} FROM lineitem GROUP BY 1 UNION ALL SELECT 'All Examples', {_SLICE_NUMBERS} FROM lineitem")
def slice_by_two_features(spark, sf_dir):
    return _sliced_quantity(spark, sf_dir, [FeatureSlicer({"l_returnflag": None, "l_linestatus": None})])


@query(f"SELECT 'l_linenumber_' || l_linenumber AS slice, {_SLICE_NUMBERS} FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY 1 UNION ALL SELECT 'All Examples', {_SLICE_NUMBERS} FROM lineitem")
def slice_values_in(spark, sf_dir):
    return _sliced_quantity(spark, sf_dir, [FeatureSlicer({"l_linenumber": ["1", "3"]})])


@query(f"SELECT 'big' AS slice, {_SLICE_NUMBERS} FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT 'All Examples', {_SLICE_NUMBERS} FROM lineitem")
def slice_by_sql(spark, sf_dir):
    big = lambda: F.when(F.col("l_quantity") > 25, F.array(F.lit("big")))
    return _sliced_quantity(spark, sf_dir, [big])


# --- composite features and association
@query("WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS v, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN list(turn ORDER BY turn) ELSE list(turn ORDER BY turn)[2:] END AS i FROM conversations GROUP BY conv_id) SELECT count(*) FILTER (v IS NULL AND i IS NOT NULL) AS missing_value, count(*) FILTER (i IS NULL AND v IS NOT NULL) AS missing_index, min(coalesce(len(i), 0) - coalesce(len(v), 0)) AS min_length_diff, max(coalesce(len(i), 0) - coalesce(len(v), 0)) AS max_length_diff FROM c")
def sparse_feature_stats(spark, sf_dir):
    return association.sparse(_sparse_rows(spark, sf_dir), "v", ["i"]).select("missing_value", F.col("missing_index")[0].alias("missing_index"), F.col("min_length_diff")[0].alias("min_length_diff"), F.col("max_length_diff")[0].alias("max_length_diff"))


def _sparse_rows(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    i = F.transform("texts", lambda x, k: k.cast("long"))
    return basic.prepared(c.select(F.col("texts").alias("v"), F.when(F.col("conv_id") % 3 == 1, i).when(F.col("conv_id") % 3 == 2, F.slice(i, F.lit(2), F.size(i))).alias("i")))


@query("WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS v, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN list(turn ORDER BY turn) ELSE list(turn ORDER BY turn)[2:] END AS i FROM conversations GROUP BY conv_id) SELECT count(*) FILTER (v IS NULL AND i IS NOT NULL) AS missing_value, count(*) FILTER (i IS NULL AND v IS NOT NULL) AS missing_weight, min(coalesce(len(i), 0) - coalesce(len(v), 0)) AS min_weight_length_diff, max(coalesce(len(i), 0) - coalesce(len(v), 0)) AS max_weight_length_diff FROM c")
def weighted_feature_stats(spark, sf_dir):
    return association.weighted_feature(_sparse_rows(spark, sf_dir), "v", "i").select("missing_value", "missing_weight", "min_weight_length_diff", "max_weight_length_diff")


_PAIRS = [("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_discount", "l_tax"), ("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_tax"), ("l_quantity", "l_tax")]


@query(_union([f"SELECT '{a}' AS path_x, '{b}' AS path_y, count(*) AS count, round(covar_pop({a}, {b}), 4) + 0.0 AS covariance, round(corr({a}, {b}), 4) AS correlation FROM lineitem" for a, b in _PAIRS]))
def cross_cov_corr(spark, sf_dir):
    p = basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(association.cross(p).select("path_x", "path_y", "count", "covariance", "correlation"), 4).withColumn("covariance", F.col("covariance") + 0.0)


_LIFT = """WITH n AS (SELECT count(*) AS n FROM {t}), x AS (SELECT {x} AS x, {w} AS c FROM {t} WHERE {x} IS NOT NULL GROUP BY 1), y AS (SELECT {y} AS y, {w} AS c FROM {t} WHERE {y} IS NOT NULL GROUP BY 1), xy AS (SELECT {x} AS x, {y} AS y, {w} AS c FROM {t} GROUP BY 1, 2)
SELECT x.x, y.y, round((coalesce(xy.c, 0) / x.c) / (y.c / n.n), 6) AS lift, round(x.c, 4)::DOUBLE AS x_count, round(coalesce(xy.c, 0), 4)::DOUBLE AS xy_count FROM x, y, n LEFT JOIN xy ON xy.x = x.x AND xy.y = y.y"""


def _lift(p, **kw):
    return rounded(association.lift(p, **kw).select("x", "y", "lift", F.round("x_count", 4).alias("x_count"), F.round("xy_count", 4).alias("xy_count")))


@query(_LIFT.format(t="lineitem", x="l_returnflag", y="l_linestatus", w="count(*)::DOUBLE"))
def lift_categorical(spark, sf_dir):
    return _lift(basic.prepared(table(spark, sf_dir, "lineitem"), columns=["l_returnflag", "l_linestatus"]), y="l_linestatus", xs=["l_returnflag"])


@query(_LIFT.format(t="lineitem", x="l_returnflag", y="l_linestatus", w="sum(l_discount)"))
def lift_weighted(spark, sf_dir):
    return _lift(basic.prepared(table(spark, sf_dir, "lineitem"), "l_discount", columns=["l_returnflag", "l_linestatus"]), y="l_linestatus", xs=["l_returnflag"], weighted=True)


@query(_LIFT.format(t="part", x="p_brand", y="CASE WHEN p_size < 10 THEN '[-inf,10)' WHEN p_size < 30 THEN '[10,30)' ELSE '[30,inf)' END", w="count(*)::DOUBLE"))
def lift_bucketed_y(spark, sf_dir):
    return _lift(basic.prepared(table(spark, sf_dir, "part"), columns=["p_brand", "p_size"]), y="p_size", xs=["p_brand"], boundaries=[10, 30])


@query(f"WITH l AS ({_LIFT.format(t='part', x='p_type', y='p_brand', w='count(*)::DOUBLE')}) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY lift DESC, x DESC) AS r FROM l) WHERE r <= 3")
def lift_topk(spark, sf_dir):
    return _lift(basic.prepared(table(spark, sf_dir, "part"), columns=["p_type", "p_brand"]), y="p_brand", xs=["p_type"], top_k=3)


@query("WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1, 2), x AS (SELECT x, sum(c) AS c FROM c GROUP BY 1), y AS (SELECT y, sum(c) AS c FROM c GROUP BY 1), n AS (SELECT sum(c) AS n FROM c) SELECT round((SELECT -sum(c / n * log2(c / n)) FROM x, n) + (SELECT -sum(c / n * log2(c / n)) FROM y, n) - (SELECT -sum(c / n * log2(c / n)) FROM c, n), 6) AS mi")
def mi_categorical(spark, sf_dir):
    return rounded(association.mutual_information(basic.prepared(table(spark, sf_dir, "lineitem")), "l_returnflag", "l_linestatus").select("mi"))


@query("WITH c AS (SELECT event_type, count(*)::DOUBLE AS c FROM events GROUP BY 1), n AS (SELECT sum(c) AS n FROM c) SELECT round(-sum(c / n * log2(c / n)), 6) AS entropy FROM c, n")
def entropy(spark, sf_dir):
    return rounded(association.entropy(basic.prepared(table(spark, sf_dir, "events")), ["event_type"]).select("entropy"))


@query("SELECT 'l_quantity' AS path, abs(corr(l_extendedprice, l_quantity)) > 0.3 AS informs FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_extendedprice, l_discount)) > 0.3 FROM lineitem UNION ALL SELECT 'l_returnflag', abs(corr(l_extendedprice, (l_returnflag = 'N')::INTEGER)) > 0.3 FROM lineitem")
def mi_knn(spark, sf_dir):
    """All rows, in random partitions of about 400, which the estimator takes whole."""
    line = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_returnflag", "l_discount")
    p, n = basic.prepared(line), max(1, line.count() // 400)
    got = association.adjusted_information(p, "l_extendedprice", ["l_quantity", "l_returnflag", "l_discount"], partitions=n, cap=5000)
    return got.select("path", (F.col("adjusted_mutual_information") > 0.05).alias("informs"))


@query("WITH p AS (SELECT l_orderkey % 10 AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std_dev, count(*) AS num_partitions FROM p")
def partitioned_meta_stats(spark, sf_dir):
    per = basic.prepared(table(spark, sf_dir, "lineitem")).groupBy(SLICE, (F.col("l_orderkey") % 10).alias("k")).agg(F.avg("l_quantity").alias("mean")).withColumn("path", F.lit("l_quantity"))
    return rounded(association.partitioned(per, "mean", 2).drop(SLICE, "path"))


# --- semantic domains
_NL = "WITH w AS (SELECT list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '') AS w FROM (SELECT substr({t}, 1, 100) AS {c} FROM documents)) SELECT count(*) AS considered, count(*) FILTER (len(w) >= 3 AND list_sum(list_transform(w, lambda x: length(x))) / len(w) BETWEEN 2.5 AND 8) AS matched FROM w"


@query(_NL.format(c="t", t="text"))
def nl_domain(spark, sf_dir):
    """A missing text counts as a blank one, as in SQL."""
    texts = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    return semantic.natural_language(basic.prepared(texts), "text").select("considered", "matched")


@query("SELECT count(*) AS considered, '%Y-%m-%d' AS format, count(*) AS matched FROM orders")
def time_domain_string(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return semantic.time_strings(basic.prepared(o), "d").select("considered", "format", "matched")


@query("SELECT count(*) AS considered, 'UNIX_SECONDS' AS format, count(*) FILTER (epoch(o_orderdate)::BIGINT >= 631152000 AND epoch(o_orderdate)::BIGINT < 1893456000) AS matched FROM orders")
def time_domain_int(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").cast("long").alias("d"))
    return semantic.time_integers(basic.prepared(o), "d").select("considered", "format", "matched")


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'png' WHEN page_id % 5 = 1 THEN 'gif' WHEN page_id % 5 = 2 THEN 'jpeg' WHEN page_id % 5 = 3 THEN 'bmp' ELSE 'UNKNOWN' END AS format, count(*) AS count FROM pages GROUP BY 1")
def image_domain(spark, sf_dir):
    heads = {0: "89504E470D0A1A0A", 1: "474946383961", 2: "FFD8FFE0", 3: "424D0000"}
    v = F.col("html").cast("binary")
    for k, h in heads.items():
        v = F.when(F.col("page_id") % 5 == k, F.concat(F.unhex(F.lit(h)), F.col("html").cast("binary"))).otherwise(v)
    got = semantic.images(basic.prepared(table(spark, sf_dir, "pages").select(v.alias("image"))), "image")
    return got.select(F.explode("formats").alias("format", "count"))


_TOKENS = "t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM documents), v AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM benchmark)"


def _tokens(spark, sf_dir):
    rows_ = semantic.tokens(basic.prepared(table(spark, sf_dir, "documents"), columns=["doc_id", "text"]), "text", "doc_id")
    vocab = semantic.tokens(basic.prepared(table(spark, sf_dir, "benchmark")), "text", "item_id").select("token").distinct()
    return rows_, vocab


@query(f"WITH {_TOKENS}, p AS (SELECT doc_id, count(*) AS n, count(v.token) AS k, sum(length(t.token)) AS c FROM t LEFT JOIN v ON t.token = v.token GROUP BY 1) SELECT sum(n)::BIGINT AS num_tokens, sum(k)::BIGINT AS in_vocabulary, round(sum(k) / sum(n), 6) AS feature_coverage, round(sum(c) / sum(n), 6) AS avg_token_length, min(n) AS min_sequence_length, max(n) AS max_sequence_length FROM p")
def nl_coverage(spark, sf_dir):
    return rounded(semantic.token_coverage(*_tokens(spark, sf_dir)).select("num_tokens", "in_vocabulary", "feature_coverage", "avg_token_length", "min_sequence_length", "max_sequence_length"))


@query("WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM t), p AS (SELECT token, doc_id, count(*) AS c FROM t WHERE token IN ('the', 'de', 'und') GROUP BY 1, 2) SELECT token, sum(c)::BIGINT AS frequency, round(count(*) / any_value(n), 6) AS fraction_of_sequences, max(c) AS per_sequence_max FROM p, n GROUP BY 1")
def nl_token_stats(spark, sf_dir):
    return rounded(semantic.token_stats(_tokens(spark, sf_dir)[0], ["the", "de", "und"]).select("token", "frequency", "fraction_of_sequences", "per_sequence_max"))


# --- inference and validation
def _stats(df, **kw):
    return generate_statistics(df, StatsOptions(histograms=False, **kw)).collect()["All Examples"]


@query(_union([f"SELECT '{c}' AS feature, '{k}' AS type, 'required' AS presence, '{v}' AS domain FROM (SELECT 1)" for c, k, v in (("o_orderkey", "INT", "-"), ("o_custkey", "INT", "-"), ("o_orderstatus", "BYTES", "o_orderstatus"), ("o_totalprice", "FLOAT", "-"), ("o_orderpriority", "BYTES", "o_orderpriority"))]))
def infer_schema(spark, sf_dir):
    o = table(spark, sf_dir, "orders").drop("o_orderdate")
    return display.schema_frame(spark, inference.infer_schema(_stats(o))).select("feature", "type", "presence", "domain")


@query("SELECT 'o_orderstatus' AS domain, string_agg('''' || v || '''', ', ' ORDER BY v) AS \"values\" FROM (SELECT DISTINCT o_orderstatus AS v FROM orders) UNION ALL SELECT 'o_orderpriority', string_agg('''' || v || '''', ', ' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)")
def infer_enum_values(spark, sf_dir):
    return display.domains_frame(spark, inference.infer_schema(_stats(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))))


def _events_schema() -> Schema:
    return Schema({"event_type": Feature("event_type", "BYTES", Presence(1, 1.0), ValueCount(1, 1), domain=Domain("string", values=["click", "view"])), "value": Feature("value", "FLOAT", Presence(1, 1.0), domain=Domain("float", min=0, max=50)), "user_id": Feature("user_id", "BYTES"), "gone": Feature("gone", "INT", Presence(1))})


_ANOMALIES = """SELECT 'event_type' AS feature, 'ENUM_TYPE_UNEXPECTED_STRING_VALUES' AS type FROM (SELECT count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view')) WHERE n > 0
UNION ALL SELECT 'value', 'FLOAT_TYPE_SMALL_FLOAT' FROM (SELECT min(value) AS m FROM events) WHERE m < 0
UNION ALL SELECT 'value', 'FLOAT_TYPE_BIG_FLOAT' FROM (SELECT max(value) AS m FROM events) WHERE m > 50
UNION ALL SELECT 'user_id', 'UNEXPECTED_DATA_TYPE' UNION ALL SELECT 'event_id', 'SCHEMA_NEW_COLUMN' UNION ALL SELECT 'gone', 'SCHEMA_MISSING_COLUMN'"""


@query(_ANOMALIES)
def validate_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return display.anomalies_frame(spark, validation.validate(_stats(e), _events_schema())).select("feature", "type")


@query("SELECT count(*) AS remaining FROM (SELECT 1 WHERE false)")
def update_schema(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    s = _stats(e)
    return display.anomalies_frame(spark, validation.validate(s, inference.update_schema(_events_schema(), s))).agg(F.count("*").alias("remaining"))


@query("SELECT 'event_type_ENUM_TYPE_UNEXPECTED_STRING_VALUES' AS reason, count(*) AS examples FROM events WHERE event_type NOT IN ('click', 'view') HAVING count(*) > 0 UNION ALL SELECT 'value_FLOAT_TYPE_BIG_FLOAT', count(*) FROM events WHERE value > 50 HAVING count(*) > 0 UNION ALL SELECT 'value_FLOAT_TYPE_SMALL_FLOAT', count(*) FROM events WHERE value < 0 HAVING count(*) > 0 UNION ALL SELECT 'user_id_UNEXPECTED_DATA_TYPE', count(*) FROM events UNION ALL SELECT 'event_id_SCHEMA_NEW_COLUMN', count(*) FROM events UNION ALL SELECT 'gone_SCHEMA_MISSING_COLUMN', count(*) FROM events")
def row_anomalies(spark, sf_dir):
    return rows.anomaly_counts(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), _events_schema())


@query("SELECT 'event_type_ENUM_TYPE_UNEXPECTED_STRING_VALUES' AS reason, least(count(*), 5) AS rows, true AS distinct_rows FROM events WHERE event_type NOT IN ('click', 'view') HAVING count(*) > 0 UNION ALL SELECT 'value_FLOAT_TYPE_BIG_FLOAT', least(count(*), 5), true FROM events WHERE value > 50 HAVING count(*) > 0 UNION ALL SELECT 'value_FLOAT_TYPE_SMALL_FLOAT', least(count(*), 5), true FROM events WHERE value < 0 HAVING count(*) > 0 UNION ALL SELECT 'event_id_SCHEMA_NEW_COLUMN', least(count(*), 5), true FROM events UNION ALL SELECT 'gone_SCHEMA_MISSING_COLUMN', least(count(*), 5), true FROM events")
def anomaly_samples(spark, sf_dir):
    got = rows.samples(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), _events_schema(), 5)
    return got.groupBy("reason").agg(F.count("*").alias("rows"), (F.count_distinct("event_id") == F.count("*")).alias("distinct_rows"))


@query("SELECT 'slice(l_returnflag_' || l_returnflag || ')::l_quantity' AS feature, 'FLOAT_TYPE_BIG_FLOAT' AS type FROM lineitem GROUP BY l_returnflag HAVING max(l_quantity) > 40 UNION ALL SELECT 'slice(All Examples)::l_quantity', 'FLOAT_TYPE_BIG_FLOAT' FROM lineitem HAVING max(l_quantity) > 40")
def sliced_validation(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    stats = generate_statistics(p, StatsOptions(allowlist=["l_quantity"], slicers=[FeatureSlicer({"l_returnflag": None})], histograms=False)).collect()
    got = validation.validate_slices(stats, Schema({"l_quantity": Feature("l_quantity", "FLOAT", domain=Domain("float", max=40)), "l_returnflag": Feature("l_returnflag", "BYTES")}))
    out = [(p_, r.type) for a in got.values() for p_, x in a.features.items() for r in x.reasons]
    return spark.createDataFrame(out, "feature string, type string")


_YEARS = "a AS (SELECT l_returnflag AS v, count(*)::DOUBLE AS c FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01 00:00:00' GROUP BY 1), b AS (SELECT l_returnflag AS v, count(*)::DOUBLE AS c FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01 00:00:00' GROUP BY 1), j AS (SELECT v, coalesce(a.c, 0) AS ca, coalesce(b.c, 0) AS cb, (SELECT sum(c) FROM a) AS ta, (SELECT sum(c) FROM b) AS tb FROM a FULL JOIN b USING (v))"


@query(f"WITH {_YEARS} SELECT round(max(abs(ca / ta - cb / tb)), 6) AS l_infinity, round(max(abs(ca - cb) / (ta + tb)), 6) AS normalized_abs_difference, round(sum(CASE WHEN ca > 0 THEN ca / ta * log2(2 * ca / ta / (ca / ta + cb / tb)) / 2 ELSE 0 END + CASE WHEN cb > 0 THEN cb / tb * log2(2 * cb / tb / (ca / ta + cb / tb)) / 2 ELSE 0 END), 6) AS jensen_shannon FROM j")
def drift_distances(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    old, new = (values.value_counts(basic.prepared(line.where(c), columns=["l_returnflag"])) for c in ("l_shipdate < TIMESTAMP '1998-07-01 00:00:00'", "l_shipdate >= TIMESTAMP '1998-07-01 00:00:00'"))
    return rounded(drift.distances(old, new).select("l_infinity", "normalized_abs_difference", "jensen_shannon"))


_PRICES = "m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), h AS (SELECT l_shipdate < TIMESTAMP '1998-07-01 00:00:00' AS old, least(floor((l_extendedprice - lo) * 10 / (hi - lo)), 9) AS k FROM lineitem, m), c AS (SELECT k, count(*) FILTER (old)::DOUBLE AS a, count(*) FILTER (NOT old)::DOUBLE AS b FROM h GROUP BY 1), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)"


@query(f"WITH {_PRICES} SELECT 'l_extendedprice' AS path, 'drift' AS kind, 'jensen_shannon_divergence' AS measure, 0.1::DOUBLE AS threshold, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 > 0.1 AS high FROM p")
def drift_numeric(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_shipdate")
    a, b = (generate_statistics(line.where(c).drop("l_shipdate")).collect()["All Examples"] for c in ("l_shipdate < TIMESTAMP '1998-07-01 00:00:00'", "l_shipdate >= TIMESTAMP '1998-07-01 00:00:00'"))
    schema = Schema({"l_extendedprice": Feature("l_extendedprice", "FLOAT", drift_comparator=Comparator(jensen_shannon_divergence=0.1))})
    got = display.distances_frame(spark, validation.validate(b, schema, previous=a))
    return got.select("path", "kind", "measure", "threshold", (F.col("value") > F.col("threshold")).alias("high"))


@query("WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT 'COMPARATOR_LOW_NUM_EXAMPLES' AS type FROM (SELECT (SELECT n FROM y ORDER BY y DESC LIMIT 1) / (SELECT count(*) FROM orders) AS r) WHERE r < 0.9")
def dataset_num_examples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    last = o.agg(F.max(F.year("o_orderdate"))).first()[0]
    stats = [_stats(x.select("o_orderkey")) for x in (o, o.where(F.year("o_orderdate") == last))]
    schema = Schema({"o_orderkey": Feature("o_orderkey", "INT")}, dataset_constraints=DatasetConstraints(num_examples_drift_min=0.9))
    got = validation.validate(stats[1], schema, previous=stats[0])
    return spark.createDataFrame([(r.type,) for r in got.dataset], "type string")


@query("SELECT 'positive' AS rule, bool_and(l_quantity > 0) AS passed FROM lineitem UNION ALL SELECT 'few', bool_and(l_quantity < 10) FROM lineitem")
def custom_validation(spark, sf_dir):
    return rows.custom(table(spark, sf_dir, "lineitem"), {"positive": "l_quantity > 0", "few": "l_quantity < 10"}).select("rule", "passed")


# --- anomalies by family: each rule has a case that it reports and one that it doesn't
def _reported(spark, got: validation.Anomalies) -> DataFrame:
    return spark.createDataFrame([(p, r.type) for p, x in got.features.items() for r in x.reasons] + [("", r.type) for r in got.dataset], "feature string, type string")


def _cases(cases: list[tuple[str, str, str]]) -> str:
    """Rows (feature, type) of the cases whose condition, over ``s``, holds."""
    return _union([f"SELECT '{f}' AS feature, '{t}' AS type FROM s WHERE {c}" for f, t, c in cases])


_ORDERS_NULLED = "o AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS a, CASE WHEN o_orderkey < 0 THEN 1 END AS b, CASE WHEN o_orderkey % 4 = 0 THEN [1, 2, 3] ELSE [1] END AS list, [[1, 2], [3]] AS nested FROM orders)"


@query(f"WITH {_ORDERS_NULLED}, s AS (SELECT count(*) AS n, count(a) AS here, count(b) AS nowhere, min(len(list)) AS least, max(len(list)) AS most, max(len(nested)) AS deep FROM o) " + _cases([("some", "FEATURE_TYPE_LOW_NUMBER_PRESENT", "here < n"), ("some", "FEATURE_TYPE_LOW_FRACTION_PRESENT", "here::DOUBLE / n < 0.9"), ("none", "FEATURE_TYPE_NOT_PRESENT", "nowhere = 0"), ("list", "FEATURE_TYPE_LOW_NUMBER_VALUES", "least < 2"), ("list", "FEATURE_TYPE_HIGH_NUMBER_VALUES", "most > 2"), ("nested", "VALUE_NESTEDNESS_MISMATCH", "deep > 1"), ("shaped", "INVALID_FEATURE_SHAPE", "least <> most")]))
def anomalies_of_presence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    lists = F.when(k % 4 == 0, F.array(*[F.lit(x) for x in (1, 2, 3)])).otherwise(F.array(F.lit(1)))
    df = o.select(F.when(k % 4 != 0, F.col("o_custkey")).alias("some"), F.when(k < 0, F.lit(1)).alias("none"), lists.alias("list"), F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("nested"), lists.alias("shaped"))
    n = o.count()
    schema = Schema({"some": Feature("some", "INT", Presence(n, 0.9)), "none": Feature("none", "INT", Presence(1)), "list": Feature("list", "INT", value_count=ValueCount(2, 2)), "nested": Feature("nested", "INT", value_count=ValueCount(1, 2)), "shaped": Feature("shaped", "INT", shape=[1])})
    return _reported(spark, validation.validate(_stats(df), schema))


_VALUES_SQL = "s AS (SELECT min(l_linenumber) AS least, max(l_linenumber) AS most, max(l_quantity) AS much, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS statuses FROM lineitem)"


@query(f"WITH {_VALUES_SQL} " + _cases([("small", "INT_TYPE_SMALL_INT", "least < 2"), ("small", "INT_TYPE_BIG_INT", "most > 5"), ("words", "INT_TYPE_NOT_INT_STRING", "flags > 0"), ("texts", "INT_TYPE_INT_STRING", "false"), ("floats", "FLOAT_TYPE_STRING_NOT_FLOAT", "flags > 0"), ("bools", "BOOL_TYPE_BIG_INT", "most > 1"), ("nan", "FLOAT_TYPE_HAS_NAN", "most >= 2"), ("inf", "FLOAT_TYPE_HAS_INF", "most >= 3"), ("flags", "FEATURE_TYPE_LOW_UNIQUE", "flags < 10"), ("statuses", "FEATURE_TYPE_HIGH_UNIQUE", "statuses > 1"), ("wrong", "DOMAIN_INVALID_FOR_TYPE", "true"), ("lost", "INVALID_DOMAIN_SPECIFICATION", "true"), ("untyped", "FEATURE_MISSING_TYPE", "true")]))
def anomalies_of_values(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    df = line.select(n.alias("small"), F.col("l_returnflag").alias("words"), n.cast("string").alias("texts"), F.col("l_returnflag").alias("floats"), n.alias("bools"), F.when(n == 2, F.lit(float("nan"))).otherwise(n.cast("double")).alias("nan"), F.when(n == 3, F.lit(float("inf"))).otherwise(n.cast("double")).alias("inf"), F.col("l_returnflag").alias("flags"), F.col("l_linestatus").alias("statuses"), n.alias("wrong"), F.col("l_linestatus").alias("lost"), n.alias("untyped"))
    schema = Schema({"small": Feature("small", "INT", domain=Domain("int", min=2, max=5)), "words": Feature("words", "BYTES", domain=Domain("int")), "texts": Feature("texts", "BYTES", domain=Domain("int")), "floats": Feature("floats", "BYTES", domain=Domain("float")), "bools": Feature("bools", "INT", domain=Domain("bool")), "nan": Feature("nan", "FLOAT", domain=Domain("float", disallow_nan=True)), "inf": Feature("inf", "FLOAT", domain=Domain("float", disallow_inf=True)), "flags": Feature("flags", "BYTES", unique_min=10), "statuses": Feature("statuses", "BYTES", unique_max=1), "wrong": Feature("wrong", "INT", domain=Domain("image")), "lost": Feature("lost", "BYTES", domain_ref="nowhere"), "untyped": Feature("untyped", "")})
    return _reported(spark, validation.validate(_stats(df), schema))


@query(f"WITH {_YEARS}, d AS (SELECT max(abs(ca / ta - cb / tb)) AS l, max(abs(ca - cb) / (ta + tb)) AS a, sum(CASE WHEN ca > 0 THEN ca / ta * log2(2 * ca / ta / (ca / ta + cb / tb)) / 2 ELSE 0 END + CASE WHEN cb > 0 THEN cb / tb * log2(2 * cb / tb / (ca / ta + cb / tb)) / 2 ELSE 0 END) AS j, any_value(ta) AS ta, any_value(tb) AS tb FROM j), s AS (SELECT * FROM d) " + _cases([("l_returnflag", "COMPARATOR_L_INFTY_HIGH", "l > 0.0001"), ("l_returnflag", "COMPARATOR_NORMALIZED_ABSOLUTE_DIFFERENCE_HIGH", "a > 0.1"), ("l_returnflag", "COMPARATOR_JENSEN_SHANNON_DIVERGENCE_HIGH", "j > 0.0000001"), ("new", "COMPARATOR_CONTROL_DATA_MISSING", "true"), ("", "COMPARATOR_LOW_NUM_EXAMPLES", "tb / ta < 0.5"), ("", "COMPARATOR_HIGH_NUM_EXAMPLES", "tb / ta > 0.01"), ("", "DATASET_LOW_NUM_EXAMPLES", "true"), ("", "DATASET_HIGH_NUM_EXAMPLES", "tb > 1")]))
def anomalies_of_comparison(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    old, new = (line.where(c).select("l_returnflag") for c in ("l_shipdate < TIMESTAMP '1998-07-01 00:00:00'", "l_shipdate >= TIMESTAMP '1998-07-01 00:00:00'"))
    limits = Comparator(infinity_norm=0.0001, normalized_abs_difference=0.1, jensen_shannon_divergence=0.0000001)
    schema = Schema({"l_returnflag": Feature("l_returnflag", "BYTES", drift_comparator=limits), "new": Feature("new", "INT", drift_comparator=Comparator(infinity_norm=0.1))}, dataset_constraints=DatasetConstraints(num_examples_drift_min=0.5, num_examples_version_max=0.01, min_examples_count=10**12, max_examples_count=1))
    before = _stats(old)
    return _reported(spark, validation.validate(_stats(new.withColumn("new", F.lit(1))), schema, previous=before, version=before))


_SPARSE_SQL = "c AS (SELECT conv_id, list(text ORDER BY turn) AS v, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN list(turn ORDER BY turn) ELSE list(turn ORDER BY turn)[2:] END AS i FROM conversations GROUP BY conv_id), s AS (SELECT count(*) FILTER (i IS NULL) AS missing, min(coalesce(len(i), 0) - len(v)) AS low, max(coalesce(len(i), 0) - len(v)) AS high FROM c)"


@query(f"WITH {_SPARSE_SQL} " + _cases([("pair", "SPARSE_FEATURE_MISSING_INDEX", "missing > 0"), ("pair", "SPARSE_FEATURE_LENGTH_MISMATCH", "low <> 0 OR high <> 0"), ("v", "SPARSE_FEATURE_NAME_COLLISION", "true"), ("weighed", "WEIGHTED_FEATURE_MISSING_WEIGHT", "missing > 0"), ("weighed", "WEIGHTED_FEATURE_LENGTH_MISMATCH", "low <> 0 OR high <> 0")]))
def anomalies_of_composites(spark, sf_dir):
    rows_ = _sparse_rows(spark, sf_dir).select("v", "i")
    stats = _stats(rows_, sparse_features={"pair": ("v", ["i"])}, weighted_features={"weighed": ("v", "i")})
    schema = Schema({"v": Feature("v", "BYTES"), "i": Feature("i", "INT")}, sparse_features=[SparseFeature("pair", "v", ["i"]), SparseFeature("v", "v", [])], weighted_features=[WeightedFeature("weighed", "v", "i")])
    return _reported(spark, validation.validate(stats, schema))


@query(f"WITH {_TOKENS}, p AS (SELECT doc_id, count(*) AS n, count(v.token) AS k, sum(length(t.token)) AS c, count(*) FILTER (t.token = 'the') AS the FROM t LEFT JOIN v ON t.token = v.token GROUP BY 1), s AS (SELECT sum(k) / sum(n) AS coverage, sum(c) / sum(n) AS length, count(*) FILTER (the > 0) / count(*) AS share, min(the) AS least, max(the) AS most FROM p) " + _cases([("text", "FEATURE_COVERAGE_TOO_LOW", "coverage < 0.999"), ("text", "FEATURE_COVERAGE_TOO_SHORT_AVG_TOKEN_LENGTH", "length < 50"), ("text", "SEQUENCE_VALUE_TOO_SMALL_FRACTION", "share < 0.99"), ("text", "SEQUENCE_VALUE_TOO_FEW_OCCURRENCES", "least < 1"), ("text", "SEQUENCE_VALUE_TOO_MANY_OCCURRENCES", "most > 2"), ("text", "STATS_NOT_AVAILABLE", "true")]))
def anomalies_of_natural_language(spark, sf_dir):
    """The last constraint is on a token that was not followed."""
    docs = table(spark, sf_dir, "documents").select("text")
    stats = _stats(docs, natural_language={"text": {"vocabulary": _tokens(spark, sf_dir)[1], "tokens": ["the"]}})
    limits = [{"token": "the", "min_fraction": 0.99, "min_per_sequence": 1, "max_per_sequence": 2}, {"token": "unfollowed", "min_fraction": 0.5}]
    schema = Schema({"text": Feature("text", "BYTES", domain=Domain("natural_language", coverage_min=0.999, min_avg_token_length=50, token_constraints=limits))})
    return _reported(spark, validation.validate(stats, schema))


@query("WITH s AS (SELECT count(*) FILTER (page_id % 5 = 4) / count(*) AS unknown, max(strlen(html)) AS longest FROM pages) " + _cases([("image", "LOW_SUPPORTED_IMAGE_FRACTION", "1 - unknown < 0.95"), ("image", "MAX_IMAGE_BYTE_SIZE_EXCEEDED", "longest > 10"), ("made", "DERIVED_FEATURE_INVALID_SOURCE", "true"), ("given", "DERIVED_FEATURE_BAD_LIFECYCLE", "true")]))
def anomalies_of_images_and_sources(spark, sf_dir):
    heads = {0: "89504E470D0A1A0A", 1: "474946383961", 2: "FFD8FFE0", 3: "424D0000"}
    v = F.col("html").cast("binary")
    for k, h in heads.items():
        v = F.when(F.col("page_id") % 5 == k, F.concat(F.unhex(F.lit(h)), F.col("html").cast("binary"))).otherwise(v)
    df = table(spark, sf_dir, "pages").select(v.alias("image"), F.col("page_id").alias("made"), F.col("page_id").alias("given"))
    source = {"deriver": "copy", "sources": ["page_id"]}
    stats = _stats(df, semantic_domains=True, derived={"made": source, "given": source})
    schema = Schema({"image": Feature("image", "BYTES", domain=Domain("image", minimum_supported_image_fraction=0.95, max_image_byte_size=10)), "made": Feature("made", "INT", derived_source={"deriver": "other", "sources": ["page_id"]}), "given": Feature("given", "INT")})
    return _reported(spark, validation.validate(stats, schema))


@query("WITH s AS (SELECT min(l_linenumber) AS least, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_discount) AS discounts, count(*) AS n FROM lineitem) " + _cases([("broken", "ENUM_TYPE_INVALID_UTF8", "n > 0"), ("below", "BOOL_TYPE_SMALL_INT", "least - 5 < 0"), ("half", "BOOL_TYPE_UNEXPECTED_FLOAT", "discounts > 2"), ("letters", "BOOL_TYPE_UNEXPECTED_STRING", "flags > 2"), ("nameless", "FEATURE_MISSING_NAME", "true"), ("share", "INVALID_SCHEMA_SPECIFICATION", "true"), ("counted", "FEATURE_TYPE_NO_UNIQUE", "true"), ("day", "SEMANTIC_DOMAIN_UPDATE", "n >= 100"), ("several", "ENUM_TYPE_UNEXPECTED_STRING_VALUES", "flags > 1"), ("several", "FEATURE_TYPE_HIGH_UNIQUE", "flags > 1"), ("mass", "ENUM_TYPE_UNEXPECTED_STRING_VALUES", "(SELECT count(*) FROM lineitem WHERE l_returnflag <> 'N') > 0.05 * n")]))
def anomalies_of_schema(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    df = line.select(F.unhex(F.lit("FF")).cast("string").alias("broken"), F.when(n == 1, F.lit(-5)).otherwise(F.lit(1)).alias("below"), F.col("l_discount").alias("half"), flag.alias("letters"), n.alias("nameless"), n.alias("share"), n.alias("counted"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), flag.alias("several"), flag.alias("mass"))
    schema = Schema({"broken": Feature("broken", "BYTES", domain=Domain("string", values=["a"])), "below": Feature("below", "INT", domain=Domain("bool")), "half": Feature("half", "FLOAT", domain=Domain("bool")), "letters": Feature("letters", "BYTES", domain=Domain("bool", true_value="A", false_value="N")), "nameless": Feature("", "INT"), "share": Feature("share", "INT", Presence(min_fraction=1.5)), "counted": Feature("counted", "INT", unique_min=1), "day": Feature("day", "BYTES"), "several": Feature("several", "BYTES", domain=Domain("string", values=["N"]), unique_max=1), "mass": Feature("mass", "BYTES", domain=Domain("string", values=["N"]), min_domain_mass=0.95)})
    stats, days = _stats(df), _stats(df.select("day"), semantic_domains=True)
    return _reported(spark, validation.validate(stats | {"features": stats["features"] | days["features"]}, schema))


# --- skew
_TEST_SQL = "t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)"


def _skew(spark, sf_dir, **kw):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    t = o.where(k % 11 != 0).withColumns({"o_totalprice": F.when(k % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(k % 7 != 0, F.col("o_orderstatus"))})
    return FeatureSkew(o, t, ["o_orderkey"], **kw)


@query(f"WITH {_TEST_SQL}, j AS (SELECT o.o_totalprice AS a, t.o_totalprice AS b, o.o_orderstatus AS c, t.o_orderstatus AS d, o.o_orderpriority AS e, t.o_orderpriority AS f FROM orders o JOIN t USING (o_orderkey)) " + _union([f"SELECT '{n}' AS feature_name, count({x}) AS base_count, count({y}) AS test_count, count(*) FILTER ({x} = {y}) AS match_count, count(*) FILTER ({y} IS NULL AND {x} IS NOT NULL) AS base_only, count(*) FILTER ({x} IS NULL AND {y} IS NOT NULL) AS test_only, count(*) FILTER ({x} <> {y}) AS mismatch_count, count(*) FILTER ({x} IS DISTINCT FROM {y}) AS diff_count FROM j" for n, x, y in (("o_totalprice", "a", "b"), ("o_orderstatus", "c", "d"), ("o_orderpriority", "e", "f"))]))
def skew_features(spark, sf_dir):
    return _skew(spark, sf_dir).results()


@query(f"WITH {_TEST_SQL} SELECT (SELECT count(*) FROM orders) AS base_with_id_count, (SELECT count(*) FROM t) AS test_with_id_count, (SELECT count(*) FROM orders) AS identifiers_count, (SELECT count(*) FROM t) AS matching_pairs_count, 0::BIGINT AS ids_missing_in_base_count, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0) AS ids_missing_in_test_count, 0::BIGINT AS duplicate_id_count, 0::BIGINT AS base_missing_id_count, 0::BIGINT AS test_missing_id_count")
def skew_match_stats(spark, sf_dir):
    return _skew(spark, sf_dir).match_stats()


@query(f"WITH {_TEST_SQL} SELECT o.o_orderstatus AS base, coalesce(t.o_orderstatus, '__MISSING_VALUE__') AS test, count(*) AS count FROM orders o JOIN t USING (o_orderkey) GROUP BY 1, 2")
def skew_confusion(spark, sf_dir):
    return _skew(spark, sf_dir).confusion(["o_orderstatus"]).select("base", "test", "count")


@query(f"WITH {_TEST_SQL} SELECT o.o_orderkey, CASE WHEN o.o_totalprice <> t.o_totalprice THEN 'o_totalprice' ELSE '' END AS mismatched_features, CASE WHEN t.o_orderstatus IS NULL THEN 'o_orderstatus' ELSE '' END AS base_only_features FROM orders o JOIN t USING (o_orderkey) WHERE o.o_totalprice <> t.o_totalprice OR t.o_orderstatus IS NULL")
def skew_pairs(spark, sf_dir):
    return _skew(spark, sf_dir).skewed_pairs().select("o_orderkey", *[F.concat_ws(",", c).alias(c) for c in ("mismatched_features", "base_only_features")])


# --- streams
@query("SELECT date_trunc('day', ts) AS start, count(*) AS num_examples, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1")
def windowed_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    return rounded(profile.windowed(e, "ts", "1 day", columns=["value"]).select("start", "num_examples", "mean", "min", "max"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
