"""Inference, validation, row-level checks, sources."""

import pytest
from pyspark.sql import functions as F

from sparkassay.api import Comparator, DatasetConstraints, Domain, Feature, Options, Presence, Schema, SparseFeature, StatsOptions, ValueCount, anomalous, anomaly_counts, custom_validation, from_dicts, from_pandas, generate_statistics, infer_schema, read_csv, read_vocabulary, samples, update_schema, validate, validate_instance
from sparkassay.plans import statistics
from sparkassay.sources.readers import csv_header


def stats(df, **kw):
    return generate_statistics(df, StatsOptions(**kw)).collect()["All Examples"]


def types(a):
    return {(p, r.type) for p, x in a.features.items() for r in x.reasons}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, "ABC"[i % 3], float(i), i % 2, str(i), None if i == 5 else "x") for i in range(12)], "id int, kind string, v double, flag int, digits string, maybe string")


def test_inference(rows):
    s = infer_schema(stats(rows, histograms=False))
    f = s.features
    assert s.string_domains["kind"] == ["A", "B", "C"] and f["kind"].domain_ref == "kind"
    assert f["flag"].domain.kind == "bool" and f["digits"].domain.kind == "int" and f["v"].domain is None
    assert f["id"].presence == Presence(1, 1.0) and f["id"].shape == [1] and f["maybe"].presence == Presence(1) and f["maybe"].value_count == ValueCount(1, 1)
    assert not validate(stats(rows, histograms=False), s).features
    assert Schema.from_json(s.to_json()) == s


def test_anomalies_and_update(spark, rows):
    s = Schema({"id": Feature("id", "INT", domain=Domain("int", min=1, max=5)), "kind": Feature("kind", "BYTES", domain=Domain("string", values=["A"])), "v": Feature("v", "INT"), "flag": Feature("flag", "INT", domain=Domain("bool"), unique_min=9), "maybe": Feature("maybe", "BYTES", Presence(1, 1.0)), "gone": Feature("gone", "INT", Presence(1))})
    st = stats(rows, histograms=False)
    got = types(validate(st, s))
    assert got == {("id", "INT_TYPE_SMALL_INT"), ("id", "INT_TYPE_BIG_INT"), ("kind", "ENUM_TYPE_UNEXPECTED_STRING_VALUES"), ("v", "UNEXPECTED_DATA_TYPE"), ("flag", "FEATURE_TYPE_NO_UNIQUE"), ("maybe", "FEATURE_TYPE_LOW_FRACTION_PRESENT"), ("gone", "SCHEMA_MISSING_COLUMN"), ("digits", "SCHEMA_NEW_COLUMN")}
    a = validate(st, s, options=Options(new_features_are_warnings=True, severity_overrides={"SCHEMA_MISSING_COLUMN": "WARNING"}))
    assert a.features["digits"].severity == "WARNING" and a.features["gone"].severity == "WARNING" and a.features["id"].type == "MULTIPLE_REASONS"
    assert not validate(st, update_schema(s, st)).features


def test_environments(rows):
    s = Schema({"id": Feature("id", "INT", Presence(1), in_environment=["TRAINING"], not_in_environment=["SERVING"]), "label": Feature("label", "INT", Presence(1), not_in_environment=["SERVING"])}, default_environment=["TRAINING", "SERVING"])
    st = stats(rows.select("id"), histograms=False)
    assert types(validate(st, s, "SERVING")) == {("id", "SCHEMA_NEW_COLUMN")}
    assert types(validate(st, s, "TRAINING")) == {("label", "SCHEMA_MISSING_COLUMN")}


def test_comparators_and_dataset(spark):
    a = spark.createDataFrame([("hello",)] + [("world",)] * 9, "f string")
    b = spark.createDataFrame([("hello",)] * 3 + [("world",)] * 7, "f string")
    s = Schema({"f": Feature("f", "BYTES", drift_comparator=Comparator(0.1, 0.05, 0.01), skew_comparator=Comparator(0.5))}, dataset_constraints=DatasetConstraints(max_examples_count=5))
    got = validate(stats(a, histograms=False), s, previous=stats(b, histograms=False), serving=stats(b, histograms=False))
    assert types(got) == {("f", "COMPARATOR_L_INFTY_HIGH"), ("f", "COMPARATOR_NORMALIZED_ABSOLUTE_DIFFERENCE_HIGH"), ("f", "COMPARATOR_JENSEN_SHANNON_DIVERGENCE_HIGH")}
    assert {d["measure"]: d["value"] for d in got.distances if d["kind"] == "drift"}["infinity_norm"] == pytest.approx(0.2)
    assert [r.type for r in got.dataset] == ["DATASET_HIGH_NUM_EXAMPLES"]


def test_sparse_anomalies(spark):
    d = spark.createDataFrame([(["a"], [1, 2]), (None, [1])], "v array<string>, i array<int>")
    st = stats(d, histograms=False, sparse_features={"s": ("v", ["i"])})
    s = Schema({"v": Feature("v", "BYTES"), "i": Feature("i", "INT")}, sparse_features=[SparseFeature("s", "v", ["i"])])
    assert types(validate(st, s)) == {("s", "SPARSE_FEATURE_MISSING_VALUE"), ("s", "SPARSE_FEATURE_LENGTH_MISMATCH")}


def test_empty_table(spark):
    st = stats(spark.createDataFrame([], "a int, b string"), histograms=False)
    assert st["num_examples"] == 0 and validate(st, Schema({"a": Feature("a", "INT", Presence(1))})).data_missing


def test_rows(spark):
    s = Schema({"e": Feature("e", "BYTES", Presence(1), ValueCount(1, 1), domain=Domain("string", values=["A", "B", "C"])), "n": Feature("n", "INT", domain=Domain("int", min=0))})
    d = spark.createDataFrame([("D", 1, None), ("D", -1, None), ("C", 0, 5)], "e string, n int, new int")
    assert sorted(r.reason for r in anomalous(d, s).collect()) == ["e_ENUM_TYPE_UNEXPECTED_STRING_VALUES"] * 2 + ["n_INT_TYPE_SMALL_INT", "new_SCHEMA_NEW_COLUMN"]
    assert {r.reason: r.examples for r in anomaly_counts(d, s).collect()}["e_ENUM_TYPE_UNEXPECTED_STRING_VALUES"] == 2
    assert samples(d, s, 1).where("reason = 'e_ENUM_TYPE_UNEXPECTED_STRING_VALUES'").count() == 1
    assert types(validate_instance(spark, {"e": "D", "n": 1}, s)) == {("e", "ENUM_TYPE_UNEXPECTED_STRING_VALUES")}
    assert {r.rule: r.passed for r in custom_validation(d, {"ok": "n >= -1", "no": "n > 0"}).collect()} == {"ok": True, "no": False}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("int,float,str,many\n1,2.0,hello,1|2\n\n5,12.34,world,3\n,,,\n")
    d = read_csv(spark, str(tmp_path / "a.csv"), multivalent=["many"])
    assert [t for _, t in d.dtypes] == ["bigint", "double", "string", "array<bigint>"]
    assert {(r.int, r.float, r.str, tuple(r.many or ())) for r in d.collect()} == {(1, 2.0, "hello", (1, 2)), (5, 12.34, "world", (3,)), (None, None, None, ())}
    (tmp_path / "b.csv").write_text("2,1.5\n1.5,2\n")
    assert [t for _, t in read_csv(spark, str(tmp_path / "b.csv"), ["f1", "f2"]).dtypes] == ["double", "double"]
    assert csv_header(spark, str(tmp_path / "a.csv")) == ["int", "float", "str", "many"]
    with pytest.raises(ValueError):
        csv_header(spark, str(tmp_path))


def test_dicts_pandas_vocabulary(spark, tmp_path):
    import pandas as pd

    d = from_dicts(spark, [{"a": [1], "b": None}, {"a": [2.5, 3], "b": None}])
    assert d.dtypes == [("a", "array<double>"), ("b", "array<string>")]
    with pytest.raises(TypeError):
        from_dicts(spark, [{"a": [object()]}])
    p = from_pandas(spark, pd.DataFrame({"x": [1, 2], "y": ["a", None], "z": [[1], [2]]}))
    assert p.columns == ["x", "y"]
    (tmp_path / "v.txt").write_text("the\nof\n")
    assert {(r.token, r.id) for r in read_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {("the", 0), ("of", 1)}


def test_options_and_sinks(spark, rows, tmp_path):
    o = StatsOptions(num_top_values=3, slicing_config=[{"feature_keys": ["kind"]}])
    assert StatsOptions.from_json(o.to_json()).slicers == o.slicers
    for bad in ({"sample_rate": 2}, {"num_top_values": 0}):
        with pytest.raises(ValueError):
            StatsOptions(**bad)
    st = generate_statistics(rows, StatsOptions())
    st.write(str(tmp_path / "s"))
    got = statistics.load(spark, str(tmp_path / "s"))
    assert got["common"].count() == 6 and statistics.merge([got, got])["common"].count() == 12
    with pytest.raises(OSError):
        statistics.load(spark, str(tmp_path / "none"))


def test_stream(spark, rows, tmp_path):
    from sparkassay.streaming import profile

    rows.select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), "v").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = profile.windowed(s, "ts", "5 minutes", "1 minute", ["v"]).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("num_examples")).first()[0] == 12
