"""Small inputs with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sparkassay.functions.paths import parse, serialize
from sparkassay.operators import association, basic, drift, quantiles, values
from sparkassay.operators.skew import FeatureSkew
from sparkassay.operators.slicing import FeatureSlicer, from_config, with_slices

INF, NAN = float("inf"), float("nan")


def hist(df, kind):
    return [(r.low, r.high, r["count"]) for r in df.where(F.col("kind") == kind).orderBy("bucket").collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-6)


def test_lists_of_numbers(spark):
    p = basic.prepared(spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0, 5.0],), ([1.0],)], "a array<double>"))
    c, n = basic.common(p).first(), basic.numeric_stats(p).first()
    assert (c.num_non_missing, c.min_num_values, c.max_num_values, c.avg_num_values, c.tot_num_values) == (3, 1, 3, 2.0, 6)
    assert (n["mean"], n.std_dev, n.min, n.max) == (pytest.approx(2.6666667), pytest.approx(1.49071198), 1, 5)
    v = quantiles.numeric_values(p)
    h = quantiles.histograms(v, 4, 3)
    close(hist(h, "QUANTILES"), [(1, 1, 2), (1, 3, 2), (3, 4, 1), (4, 5, 1)])
    close(hist(h, "STANDARD"), [(1, 2.3333333, 3.0049751), (2.3333333, 3.6666667, 1.0049751), (3.6666667, 5, 1.9900498)])
    assert quantiles.median(quantiles.cumulative(v)).first().median == 3.0
    close(hist(quantiles.histograms(quantiles.valencies(p), 4, kinds=("QUANTILES",)), "QUANTILES"), [(1, 1, 1), (1, 2, 1), (2, 3, 0.5), (3, 3, 0.5)])


def test_weights(spark):
    p = basic.prepared(spark.createDataFrame([([1.0, 2.0], 1.0), ([3.0, 4.0, 5.0], 2.0), ([1.0, NAN, NAN, NAN], 3.0), (None, 2.0)], "a array<double>, w double"), "w")
    c = basic.common(p, True).where("path = 'a'").first()
    n = basic.numeric_stats(p, True).where("path = 'a'").first()
    assert (c.weighted_num_non_missing, c.weighted_num_missing, c.weighted_tot_num_values) == (6, 2, 20) and c.weighted_avg_num_values == pytest.approx(3.3333333)
    assert n.num_nan == 3 and n.weighted_mean == pytest.approx(2.7272727) and n.weighted_std_dev == pytest.approx(1.5427784)
    h = quantiles.histograms(quantiles.numeric_values(p, ["a"], True), 4, 3)
    assert [x[2] for x in hist(h, "QUANTILES")] == pytest.approx([4, 3, 2, 2])
    assert [x[2] for x in hist(h, "STANDARD")] == pytest.approx([5.0091324, 2.0091324, 3.9817352])


def test_missing_weight_raises(spark):
    p = basic.prepared(spark.createDataFrame([(1, None), (2, 1.0)], "a int, w double"), "w")
    with pytest.raises(Exception, match="one value"):
        basic.common(p, True).collect()


def test_infinities(spark):
    p = basic.prepared(spark.createDataFrame([([1.0, 2.0, INF, INF, -INF],), ([3.0, 4.0, 5.0, -INF],), ([1.0, INF, -INF],)], "a array<double>"))
    n = basic.numeric_stats(p).first()
    assert math.isnan(n["mean"]) and n.std_dev == 0 and (n.min, n.max) == (-INF, INF)
    v = quantiles.numeric_values(p)
    assert quantiles.median(quantiles.cumulative(v)).first().median == 3.0
    h = quantiles.histograms(v, 4, 4)
    close(hist(h, "QUANTILES"), [(-INF, 1, 5), (1, 3, 2), (3, INF, 2.5), (INF, INF, 2.5)])
    close(hist(h, "STANDARD"), [(-INF, -INF, 3), (1, 2, 3), (2, 3, 1), (3, 4, 1), (4, 5, 1), (INF, INF, 3)])


@pytest.mark.parametrize("q, cum, want", [([1, 60, 120, 180, 240, 300], [1, 60, 120, 180, 240, 300], [60] * 5), ([1, 1, 1], [2, 2, 2], [1, 1])])
def test_quantile_counts(q, cum, want):
    assert quantiles.quantile_counts(q, cum) == pytest.approx(want)


def test_top_values(spark):
    c = values.value_counts(basic.prepared(spark.createDataFrame([(["a", "b", "c", "e"],), (["a", "c", "d", "a"],), (["a", "b", "c", "d"],)], "fa array<string>")))
    assert [(r.value, r.cnt) for r in values.top(c, 4).orderBy("rank").collect()] == [("a", 4), ("c", 3), ("d", 2), ("b", 2)]
    assert [(r.low_rank, r.label, r.sample_count) for r in values.rank_histogram(c, 3).orderBy("low_rank").collect()] == [(0, "a", 4), (1, "c", 3), (2, "d", 2)]
    assert values.uniques(c).first().unique == 5


def test_nested(spark):
    p = basic.prepared(spark.createDataFrame([([[1, 2], [], None],), (None,)], "n array<array<int>>"))
    assert [(r.num_missing, r.num_non_missing, r.tot_num_values) for r in basic.levels(p).orderBy("level").collect()] == [(1, 1, 3), (1, 2, 2)]
    s = basic.common(basic.prepared(spark.createDataFrame([([{"x": [1, 2], "y": "a"}, {"x": None, "y": None}],)], "s array<struct<x:array<int>,y:string>>")))
    got = {r.path: (r.num_non_missing, r.num_missing, r.tot_num_values) for r in s.collect()}
    assert got == {"s": (1, 0, 2), "s.x": (1, 1, 2), "s.y": (1, 1, 1)}


def test_unsupported_type(spark):
    with pytest.raises(TypeError):
        basic.common(basic.prepared(spark.sql("SELECT map('a', 1) AS m")))


def test_cross(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (3.0, 4.0, 3.0), (5.0, 6.0, 7.0), (6.0, 14.0, -1.0), (10.0, 16.0, 0.0), (None, None, None)], "a double, b double, c double")
    got = {(r.path_x, r.path_y): (r["count"], r.covariance, r.correlation) for r in association.cross(basic.prepared(d)).collect()}
    for k, want in {("a", "b"): (5, 15.6, 0.923145), ("a", "c"): (5, -5.4, -0.59476602), ("b", "c"): (5, -13.52, -0.81070298)}.items():
        assert got[k] == pytest.approx(want, rel=1e-5)


def test_lift(spark):
    rows = [("a", "cat", 0.5), ("a", "dog", 0.5), ("b", "cat", 2.0), ("a", "dog", 1.0)]
    d = spark.createDataFrame(rows, "x string, y string, w double")
    got = {(r.y, r.x): r.lift for r in association.lift(basic.prepared(d), "y", ["x"]).collect()}
    assert got == pytest.approx({("cat", "b"): 2.0, ("cat", "a"): 0.6666667, ("dog", "a"): 1.3333333, ("dog", "b"): 0.0}, rel=1e-5)
    got = {(r.y, r.x): r.lift for r in association.lift(basic.prepared(d, "w"), "y", ["x"], weighted=True).collect()}
    assert got == pytest.approx({("cat", "b"): 1.6, ("cat", "a"): 0.4, ("dog", "a"): 2.0, ("dog", "b"): 0.0})


def test_slices(spark):
    d = spark.createDataFrame([([1], ["dog"]), ([2, 1], ["cat"]), ([3], ["wolf"]), ([2, 1, 1], ["dog", "wolf"]), ([3], ["wolf"])], "a array<int>, b array<string>")
    got = {r["slice"]: r["count"] for r in with_slices(d, [FeatureSlicer({"a": None, "b": None})]).groupBy("slice").count().collect()}
    assert got == {"All Examples": 5, "a_1_b_dog": 2, "a_1_b_cat": 1, "a_2_b_cat": 1, "a_2_b_dog": 1, "a_1_b_wolf": 1, "a_2_b_wolf": 1, "a_3_b_wolf": 2}
    assert from_config([{}, {"feature_keys": ["a"], "feature_values": {"b": "cat"}}]) == [FeatureSlicer({"a": None, "b": ["cat"]})]
    with pytest.raises(ValueError):
        FeatureSlicer({"a": ["x"]}).keys(d.schema)


def test_composites(spark):
    p = basic.prepared(spark.createDataFrame([(["a"], [1], [2]), (["a", "b"], [1, 3], [2, 4])], "v array<string>, i array<int>, j array<int>"))
    r = association.sparse(p, "v", ["i", "j"]).first()
    assert (r.missing_value, r.missing_index, r.min_length_diff, r.max_length_diff) == (0, [0, 0], [0, 0], [0, 0])
    p = basic.prepared(spark.createDataFrame([(["a"], [2]), (["a"], [2, 4])], "v array<string>, w array<int>"))
    r = association.weighted_feature(p, "v", "w").first()
    assert (r.missing_value, r.missing_weight, r.min_weight_length_diff, r.max_weight_length_diff) == (0, 0, 0, 1)


def test_distances(spark):
    def counts(**kw):
        return spark.createDataFrame([("s", "p", k, v) for k, v in kw.items()], "slice string, path string, value string, cnt double")

    d = drift.distances(counts(hello=0.1, world=0.9), counts(hello=0.3, world=0.7)).first()
    assert d.l_infinity == pytest.approx(0.2) and d.normalized_abs_difference == pytest.approx(0.1)
    assert drift.distances(counts(b=0.9, c=0.1), counts(a=0.3, b=0.7)).first().l_infinity == pytest.approx(0.3)
    assert drift.distances(counts(hello=1.0, world=5.0), counts(hello=10.0, world=50.0)).first().normalized_abs_difference == pytest.approx(45 / 66)
    assert drift.distances(counts(a=1.0), counts(a=7.0)).first().jensen_shannon == pytest.approx(0)
    assert drift.histogram_jsd([(1, 2, 2), (2, 3, 2)], [(2, 4, 2), (4, 6, 2)]) == pytest.approx(0.65563906222)
    assert drift.histogram_jsd([(0, 1, 2), (1, 2, 2)], [(3, 4, 2), (4, 6, 2)]) == 1.0


def test_skew(spark):
    def rows(prefix, **cols):
        return [(f"{prefix}{i}", cols) for i in range(2)]

    cols = "id1 string, id2 string, no_skew int, ignore int, close_float double, skewed int, base_only int, test_only int"
    base = spark.createDataFrame([(f"a{i}", "b", 1, i, 1.12345, 0, 1, None) for i in range(2)], cols)
    test = spark.createDataFrame([(f"a{i}", "b", 1, 9, 1.12456, 1, None, 1) for i in range(2)], cols)
    got = {r.feature_name: r for r in FeatureSkew(base, test, ["id1", "id2"], ["ignore"]).results().collect()}
    assert set(got) == {"no_skew", "close_float", "skewed", "base_only", "test_only"}
    assert (got["skewed"].mismatch_count, got["skewed"].diff_count, got["no_skew"].match_count, got["base_only"].base_only, got["test_only"].test_only) == (2, 2, 2, 2, 2)
    assert {r.feature_name: r.match_count for r in FeatureSkew(base, test, ["id1", "id2"], ["ignore"], digits=2).results().collect()}["close_float"] == 2
    with pytest.raises(ValueError):
        FeatureSkew(base, test, [])


def test_match_stats(spark):
    base = spark.createDataFrame([(i, 1) for i in ("id0", "id0", "id1", "id4", None)], "id string, v int")
    test = spark.createDataFrame([(i, 1) for i in ("id0", "id0", "id2", "id3", "id4", None, None)], "id string, v int")
    r = FeatureSkew(base, test, ["id"], duplicates=True).match_stats().first()
    assert tuple(r) == (4, 5, 5, 5, 2, 1, 1, 1, 2)


def test_confusion(spark):
    base = spark.createDataFrame([(1, "zip"), (2, "foo"), (3, None)], "id int, v string")
    test = spark.createDataFrame([(1, None), (2, "foo"), (3, None)], "id int, v string")
    assert {tuple(r) for r in FeatureSkew(base, test, ["id"]).confusion(["v"]).collect()} == {("v", "zip", "__MISSING_VALUE__", 1), ("v", "foo", "foo", 1)}
    with pytest.raises(ValueError):
        FeatureSkew(base.withColumn("n", F.lit(1)), test.withColumn("n", F.lit(1)), ["id"]).confusion(["n"])


@pytest.mark.parametrize("steps", [("a", "b"), ("a.b", "it's"), ("(x)", "y z"), ("",)])
def test_paths(steps):
    assert parse(serialize(steps)) == steps


def test_information():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    rho = 0.8
    y = rho * x + (1 - rho**2) ** 0.5 * rng.normal(size=2000)
    assert association.knn_information(x, y, False, False) == pytest.approx(-0.5 * np.log2(1 - rho**2), abs=0.1)
    assert association.knn_information(x, rng.permutation(y), False, False) < 0.1
    label = (x > 0).astype(int)
    assert association.knn_information(x, label, False, True) == pytest.approx(1.0, abs=0.1)
    assert association.knn_information(label, label, True, True) == pytest.approx(1.0, abs=0.01)
