"""Entry points, sinks, lookups, weights by feature, generators of one's own, natural-language and image statistics, encoders, exact values."""

import gzip
import json
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkassay.api import FeatureSkew, Schema, StatisticsView, StatsOptions, generate_statistics, infer_schema, load_statistics, read_examples, skew_results, statistics_from_csv, statistics_from_pandas, statistics_from_rows, update_schema, validate, validate_instance
from sparkassay.functions import files
from sparkassay.functions.schema import Comparator, Domain, Feature, Presence, ValueCount
from sparkassay.operators import association, basic, drift, semantic, validation, values
from sparkassay.operators.slicing import SLICE, FeatureSlicer
from sparkassay.plans import generators
from sparkassay.sources import statistics_io


def stats(df, **kw):
    return generate_statistics(df, StatsOptions(**kw)).collect()["All Examples"]


def types(a):
    return {(p, r.type) for p, x in a.features.items() for r in x.reasons}


def test_weighted_deviation_of_large_values(spark):
    df = spark.createDataFrame([(1e9, 1.0), (1e9 + 1, 1.0), (1e9 + 2, 1.0)], "x double, w double")
    got = stats(df, weight="w", histograms=False)["features"]["x"]
    assert got["weighted_std_dev"] == pytest.approx(math.sqrt(2 / 3), abs=1e-9) and got["weighted_mean"] == 1e9 + 1
    lists = spark.createDataFrame([([1e9, 1e9 + 4], 3.0), ([1e9 + 2], 2.0), (None, 5.0)], "x array<double>, w double")
    got = stats(lists, weight="w", histograms=False)["features"]["x"]
    v, w = np.array([0, 4, 2.0]), np.array([3, 3, 2.0])
    assert got["weighted_std_dev"] == pytest.approx(math.sqrt(np.average((v - np.average(v, weights=w)) ** 2, weights=w)))


def test_one_pass_gives_the_same_frames(spark):
    rows = [(k, float("nan") if k == 3 else k / 2, None if k % 4 == 0 else f"é{k}", bytes([k]), k % 2 == 0, [k, k + 1] if k % 3 else None, (k, "x"), [(k, [0.5])]) for k in range(20)]
    df = spark.createDataFrame(rows, "i int, x double, s string, b binary, f boolean, l array<int>, t struct<u: int, v: string>, n array<struct<a: int, c: array<double>>>")
    for slicers in ([], [FeatureSlicer({"f": None})]):
        p = basic.prepared(df, None, slicers)
        got = basic.profile(p, ["i"], lambda wide: wide)
        for name, want in (("common", basic.common(p)), ("numeric", basic.numeric_stats(p)), ("string", basic.string_stats(p, ["i"]))):
            assert got[name].columns == want.columns
            assert sorted(map(str, got[name].collect())) == sorted(map(str, want.collect())), name


def test_weights_by_feature(spark):
    df = spark.createDataFrame([(1.0, 10.0, 1, 3, "a"), (2.0, 20.0, 2, 1, "b"), (4.0, None, 3, 1, None)], "x double, y double, w int, v int, s string")
    got = stats(df, weight="w", feature_weights={"y": "v", "s": "v"}, histograms=False)
    assert got["weighted_num_examples"] == 6
    got = got["features"]
    assert set(got) == {"x", "y", "w", "v", "s"}
    assert got["x"]["weighted_mean"] == pytest.approx(17 / 6) and got["y"]["weighted_mean"] == pytest.approx(12.5)
    assert (got["y"]["weighted_num_non_missing"], got["y"]["weighted_num_missing"], got["x"]["weighted_num_non_missing"]) == (4, 1, 6)
    s = generate_statistics(df, StatsOptions(feature_weights={"s": "v"}, histograms=False))
    assert {r.value: r.wcnt for r in s.frame("weighted_top").collect()} == {"a": 3, "b": 1}
    assert s.collect()["All Examples"]["features"]["x"].get("weighted_mean") is None


def test_time_formats():
    # All forms, in order
    assert semantic.DATES == ["%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%y-%m-%d", "%y/%m/%d", "%m-%d-%Y", "%m/%d/%Y", "%m%d%Y", "%m-%d-%y", "%m/%d/%y", "%d-%m-%Y", "%d/%m/%Y", "%d%m%Y", "%d-%B-%Y", "%d-%m-%y", "%d/%m/%y", "%d-%B-%y"]
    assert len(semantic.formats()) == 123


@pytest.mark.parametrize("value, wanted", [("2018-11-30", "%Y-%m-%d"), ("30-November-18", "%d-%B-%y"), ("2018/11/30T23:59", "%Y/%m/%dT%H:%M"), ("2018-11- 5 10:20:30.123", "%Y-%m-%d %H:%M:%S.%f"), ("2018-11- 5", "%Y-%m-%d"), ("Fri Nov  3 10:47:02 2018", "%a %b %d %H:%M:%S %Y"), ("23:59:58", "%H:%M:%S"), ("2018-13-30", None), ("about 10:20", None)])
def test_times(spark, value, wanted):
    df = basic.prepared(spark.createDataFrame([(value,)] * 3, "t string"))
    assert semantic.time_strings(df, "t", least=3).first().format == wanted


def test_time_matches_count_as_each_pattern_does(spark):
    import re

    some = ["01/02/2018", "2018-11-30 10:20", "2018-11-30T10:20:61", "20181130", "3:4", "12-11-10", "Fri Nov 30 10:47:02 2018", "2018-11- 5T1:2", "T1:2", " 1:2", "x", "12-11-10 1:2:3.4", "30-May-2018"]
    df = basic.prepared(spark.createDataFrame([(v,) for v in some], "t string"))
    for v in some:
        hits = [f for f in semantic.formats() if re.search(semantic.pattern(f), v)]
        got = semantic.time_strings(df.where(F.col("t") == v), "t", least=1, ratio=1.0).first().format
        assert got == (hits[0] if hits else None), v


def test_jpeg_size(spark):
    frame = bytes.fromhex("FFD8" + "FFE00010" + "4A46494600010100000100010000" + "FFC0" + "0011" + "08" + "0123" + "0456" + "03" + "00" * 9)
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([(frame,), (png,), (b"no image",), (None,)], "v binary")
    assert [r[0] and tuple(r[0]) for r in df.select(semantic.header_size(F.col("v"))).collect()] == [(0x456, 0x123), (640, 480), None, None]
    got = stats(df, semantic_domains=True, semantic_least_values=2, histograms=False)["features"]["v"]["custom"]
    assert got["image_formats"] == {"jpeg": 1, "png": 1, "UNKNOWN": 1} and got["image_max_width"] == 0x456 and "domain" not in got


def test_rules_of_single_examples(spark):
    schema = Schema({"a": Feature("a", "INT", Presence(1, 1.0)), "b": Feature("b", "BYTES", domain=Domain("string", values=["x"])), "u": Feature("u", "BYTES", unique_min=5)})
    got = validate_instance(spark, {"a": None, "b": ["y"], "u": ["z"]}, schema)
    # presence is a rule of datasets, the number of distinct values is not among them
    assert types(got) == {("b", "ENUM_TYPE_UNEXPECTED_STRING_VALUES"), ("u", "FEATURE_TYPE_LOW_UNIQUE")}
    # Fixed values
    assert {"FEATURE_TYPE_LOW_FRACTION_PRESENT", "FEATURE_TYPE_LOW_NUMBER_PRESENT", "FEATURE_TYPE_NOT_PRESENT", "SCHEMA_TRAINING_SERVING_SKEW", "COMPARATOR_CONTROL_DATA_MISSING", "COMPARATOR_TREATMENT_DATA_MISSING", "COMPARATOR_L_INFTY_HIGH", "COMPARATOR_JENSEN_SHANNON_DIVERGENCE_HIGH", "COMPARATOR_LOW_NUM_EXAMPLES", "COMPARATOR_HIGH_NUM_EXAMPLES", "NO_DATA_IN_SPAN", "DATASET_LOW_NUM_EXAMPLES", "DATASET_HIGH_NUM_EXAMPLES"} == validation.GLOBAL_ONLY


def test_floats_are_compared_with_32_bits(spark):
    schema = Schema({"x": Feature("x", "FLOAT", domain=Domain("float", min=0.1, max=0.3))})
    near = spark.createDataFrame([(0.1 - 1e-12,), (0.3 + 1e-12,)], "x double")
    assert not validate(stats(near), schema).features
    off = spark.createDataFrame([(0.0999,), (1e300,)], "x double")
    assert types(validate(stats(off), schema)) == {("x", "FLOAT_TYPE_SMALL_FLOAT"), ("x", "FLOAT_TYPE_BIG_FLOAT")}
    assert not validate(stats(off), update_schema(schema, stats(off))).features


def test_what_is_left_has_its_own_severity(spark, tmp_path):
    schema = Schema({"a": Feature("a", "INT", domain=Domain("int", min=5, max=6))})
    df = spark.createDataFrame([(1,), (9,)], "a int")
    o = validation.Options(severity_overrides={"INT_TYPE_BIG_INT": "WARNING"}, features_needed={"nowhere"})
    got = validate(stats(df, histograms=False), schema, options=o)
    assert got.features["a"].severity == "ERROR"
    left = got.without({"INT_TYPE_SMALL_INT"})
    assert left.features["a"].severity == "WARNING" and left.features["a"].type == "INT_TYPE_BIG_INT" and left.unneeded == ["nowhere"]
    path = str(tmp_path / "anomalies.json")
    left.write(spark, path)
    assert validation.Anomalies.load(spark, path) == left
    schema.write(spark, str(tmp_path / "schema.json.gz"))
    assert Schema.load(spark, str(tmp_path / "schema.json.gz")) == schema
    with pytest.raises(OSError):
        Schema.load(spark, str(tmp_path / "none.json"))


def test_distances_of_counts_and_of_tables_agree(spark):
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, b = ({str(k): float(n) for k, n in enumerate(rng.integers(0, 9, 12)) if n} for _ in range(2))
        rows = lambda c: spark.createDataFrame([("All Examples", "p", k, int(n)) for k, n in c.items()], f"{SLICE} string, path string, value string, cnt long")
        table = drift.distances(rows(a), rows(b)).first().asDict()
        got = drift.count_distances(a, b)
        assert got["l_infinity_value"] == table["l_infinity_value"]
        assert all(got[k] == pytest.approx(table[k]) for k in ("l_infinity", "normalized_abs_difference", "jensen_shannon"))


def test_entry_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,s\n1,a\n2,b\n,a\n")
    got = statistics_from_csv(spark, str(tmp_path / "a.csv"), output_path=str(tmp_path / "out.bin"), options=StatsOptions(num_quantile_buckets=4))
    f = got["All Examples"]["features"]
    assert f["x"]["type"] == "INT" and f["x"]["num_missing"] == 1 and f["s"]["values"] == {"a": 2, "b": 1}
    assert load_statistics(spark, str(tmp_path / "out.bin")) == got
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        statistics_from_csv(spark, str(tmp_path / "empty.csv"))
    spark.createDataFrame([(1, "a")], "x int, s string").write.json(str(tmp_path / "rows"), compression="gzip")
    assert statistics_from_rows(spark, str(tmp_path / "rows"), "json")["All Examples"]["num_examples"] == 1
    pdf = pd.DataFrame({"b": [True, False, True], "x": [1.5, 2.5, None], "o": [object()] * 3})
    got = statistics_from_pandas(spark, pdf, n_jobs=2)["All Examples"]["features"]
    assert set(got) == {"b", "x"} and got["b"]["values"] == {"1": 2, "0": 1}


def _message(*fields):
    """Protocol-buffer fields (number, bytes or int)."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += _number(number << 3) + _number(value & (1 << 64) - 1)
        else:
            out += _number(number << 3 | 2) + _number(len(value)) + value
    return out


def _number(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def _example(**features):
    entries = []
    for name, (kind, values) in features.items():
        if kind == 1:
            held = _message(*[(1, v) for v in values])
        elif kind == 2:
            held = _message((1, struct.pack(f"<{len(values)}f", *values)))
        else:  # one packed, the rest one by one
            held = _message((1, b"".join(_number(v & (1 << 64) - 1) for v in values[:1]))) + _message(*[(1, v) for v in values[1:]])
        entries.append((1, _message((1, name.encode()), (2, _message((kind, held)) if kind else b""))))
    return _message((1, _message(*entries)))


def test_record_files_of_examples(spark, tmp_path):
    some = [_example(i=(3, [5, -1]), x=(2, [0.5]), s=(1, [b"a", "é".encode()]), raw=(1, [b"\xff"])), _example(i=(3, [7]), none=(0, []), s=(1, [])), _example()]
    framed = b"".join(struct.pack("<Q", len(e)) + b"\0" * 4 + e + b"\0" * 4 for e in some)
    (tmp_path / "a.records").write_bytes(framed)
    (tmp_path / "b.records.gz").write_bytes(gzip.compress(framed))
    got = read_examples(spark, str(tmp_path))
    assert got.dtypes == [("i", "array<bigint>"), ("none", "array<string>"), ("raw", "array<binary>"), ("s", "array<string>"), ("x", "array<double>")]
    rows = [(r.i, r.none, r.raw and [bytes(v) for v in r.raw], r.s, r.x) for r in got.collect()]
    want = [([5, -1], None, [b"\xff"], ["a", "é"], [0.5]), ([7], None, None, [], None), (None, None, None, None, None)]
    assert sorted(map(str, rows)) == sorted(map(str, want * 2))
    f = statistics_from_rows(spark, str(tmp_path), "examples")["All Examples"]["features"]
    assert f["i"]["tot_num_values"] == 6 and f["i"]["num_missing"] == 2 and f["s"]["values"] == {"a": 2, "é": 2}
    (tmp_path / "c.records").write_bytes(framed[:-3])
    with pytest.raises(Exception, match="cut off"):
        read_examples(spark, str(tmp_path)).collect()


def test_integer_tokens_and_positions(spark):
    vocabulary = spark.createDataFrame([("the", 0), ("cat", 1)], "token string, id long")
    df = spark.createDataFrame([([0, 1, 9],), ([1],)], "t array<int>").coalesce(1)
    nl = stats(df, natural_language={"t": {"vocabulary": vocabulary, "tokens": ["cat"]}}, histograms=False)["features"]["t"]["custom"]["nl"]
    assert nl["feature_coverage"] == 3 / 4 and nl["tokens"]["cat"]["frequency"] == 2 and nl["histograms"]["rank"] == {"cat": 2, "the": 1, "9": 1}
    assert sum(b[2] for b in nl["tokens"]["cat"]["positions_standard"]) == pytest.approx(2)


def test_cross_plan_and_weighted_threshold(spark):
    df = spark.createDataFrame([(1, 2.0, "a", [1]), (2, 3.0, "b", [2])], "i int, x double, s string, l array<int>")
    assert association.cross_plan(basic.prepared(df), [("i", "x"), ("i", "s"), ("x", "x"), ("i", "none")]) == ([("i", "x")], [("i", "s"), ("x", "x"), ("i", "none")])
    top = generate_statistics(df, StatsOptions(weight="x", weighted_frequency_threshold=2.5)).frame("weighted_top").collect()
    assert [(r.value, r.wcnt) for r in top] == [("b", 3.0)]


def test_sinks_and_loaders(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a", [[1, 2], [3]]), (2, float("inf"), "b", [[1]]), (3, None, None, None)], "i int, x double, s string, n array<array<int>>")
    got = generate_statistics(df, StatsOptions(slicers=[FeatureSlicer({"s": None})], cross_features=[("i", "x")])).collect()
    assert got["All Examples"]["features"]["n"]["custom"]["level_2_value_list_length_standard"]
    where = lambda name: str(tmp_path / name)
    statistics_io.write_text(spark, got, where("t.json"))
    statistics_io.write_binary(spark, got, where("t.bin"))
    statistics_io.write_records(spark, got, where("t.records.gz"))
    assert len(statistics_io.write_records(spark, got, where("t.shards"), 3, columnar=True)) == 3
    statistics_io.write_records_and_binary(spark, got, where("both.records"), where("both.bin"), 2)
    for name in ("t.json", "t.bin", "t.records.gz", "t.shards", "t.shards.parquet", "both.records", "both.bin"):
        back = load_statistics(spark, where(name))
        same = [json.dumps(json.loads(statistics_io.to_json(x)), sort_keys=True) for x in (back, got)]  # as text, in which NaN equals itself
        assert same[0] == same[1] and ("i", "x") in back["All Examples"]["cross"], name
    files.remove(spark, where("t.shards-00001-of-00003"))
    for name in ("t.shards", "nothing"):
        with pytest.raises(OSError):
            load_statistics(spark, where(name))
    with pytest.raises(ValueError):
        statistics_io.merge([got, got])


def test_lookups(spark):
    df = spark.createDataFrame([(1, 2.0, "a", (1, "x")), (3, 4.0, "b", (2, "y"))], "i int, x double, s string, t struct<u: int, v: string>")
    source = {"deriver": "double", "sources": ["i"]}
    got = generate_statistics(df, StatsOptions(slicers=[FeatureSlicer({"s": None})], cross_features=[("i", "x")], derived={"x": source})).collect()
    view = StatisticsView(got)
    assert set(view.names()) == {"All Examples", "s_a", "s_b"} and view.get("none") is None
    d = view.default_or_raise()
    assert d.num_examples == 2 and d.feature(("t", "u")).numeric()["max"] == 2 and d.feature("i").string() is None and d.feature("s").string()["unique"] == 2
    assert d.feature("t").struct()["num_non_missing"] == 2 and set(d.below("t")) == {"t.u", "t.v"} and d.feature("none") is None
    assert d.cross("i", "x")["covariance"] == 1 and d.cross("x", "i") is None and d.crosses() == [("i", "x")]
    assert d.derived("double", ["i"]).path == "x" and d.derived("triple", ["i"]) is None
    got["All Examples"]["features"]["i"]["custom"]["derived_source"] = source
    with pytest.raises(ValueError):
        d.derived("double", ["i"])
    with pytest.raises(ValueError):
        StatisticsView(got, got)
    del got["All Examples"]
    with pytest.raises(ValueError):
        StatisticsView(got).default_or_raise()


def test_skew_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (3, "z")], "id int, v string")
    FeatureSkew(a, b, ["id"]).write(str(tmp_path), pairs=10, confusion=["v"])
    assert [r["mismatch_count"] for r in skew_results(spark, str(tmp_path), "features")] == [1]
    assert [r["duplicate_id_count"] for r in skew_results(spark, str(tmp_path), "match_stats")] == [1]
    assert [r["mismatched_features"] for r in skew_results(spark, str(tmp_path), "pairs")] == [["v"]]
    assert {(r["base"], r["test"]) for r in skew_results(spark, str(tmp_path), "confusion")} == {("x", "x"), ("y", "q")}
    with pytest.raises(ValueError):
        next(skew_results(spark, str(tmp_path), "other"))


class Longest(generators.BatchGenerator):
    """The longest text of each slice, in one accumulator."""

    def create(self):
        return 0

    def add(self, accumulator, batch):
        return max([accumulator, *(len(t or "") for t in batch.column(batch.schema.get_field_index("s")).to_pylist())])

    def merge(self, a, b):
        return max(a, b)

    def extract(self, accumulator):
        return [("s", "longest", accumulator)]


def test_generators(spark):
    df = spark.createDataFrame([(k, float(k % 5), "x" * (k % 7)) for k in range(300)], "i int, x double, s string").repartition(6)
    spread = generators.FeatureGenerator(lambda f, v: {"range": F.max(v) - F.min(v)} if f.type in ("INT", "FLOAT") else {})
    mean = generators.PartitionedGenerator(lambda pdf: {("x", "part_mean"): pdf["x"].mean()}, partitions=4, cap=50)
    got = generate_statistics(df, StatsOptions(generators=[spread, Longest(), mean], histograms=False)).collect()["All Examples"]["features"]
    assert got["i"]["custom"]["range"] == 299 and got["x"]["custom"]["range"] == 4 and got["s"]["custom"]["longest"] == 6
    assert 1.5 < got["x"]["custom"]["part_mean"] < 2.5 and got["x"]["custom"]["part_mean_min"] <= got["x"]["custom"]["part_mean"]
    total = generators.Part("n", F.count("*"))
    pair = generators.Composite([total, generators.Part("ix", F.sum(F.col("i") * F.col("x")))], lambda c: {("i*x", "mean"): c["ix"] / c["n"]})
    with_pair = stats(df, generators=[pair], histograms=False)
    assert with_pair["features"]["i*x"]["custom"]["mean"] == pytest.approx(sum(k * (k % 5) for k in range(300)) / 300)
    schema = infer_schema(with_pair)
    assert set(schema.features) == {"i", "x", "s"} and not validate(with_pair, schema).features
    assert generate_statistics(df, StatsOptions(generators=[pair, spread])).counters() == {"rows": 300, "bytes": sum(k % 7 for k in range(300)), "slices": 1, "features": {"INT": 1, "FLOAT": 1, "STRING": 1}, "generators": ["Composite", "FeatureGenerator"]}


def test_natural_language(spark, tmp_path):
    (tmp_path / "vocabulary.txt").write_text("the\ncat\nsat\n")
    df = spark.createDataFrame([("the cat sat",), ("the the dog",), ("a cat",), (None,)], "t string").coalesce(1)
    nl = stats(df, natural_language={"t": {"vocabulary": str(tmp_path / "vocabulary.txt"), "tokens": ["the"]}}, histograms=False)["features"]["t"]["custom"]["nl"]
    assert nl["feature_coverage"] == 6 / 8 and nl["avg_token_length"] == 22 / 8 and nl["num_sequences"] == 3
    assert nl["tokens"]["the"]["frequency"] == 3 and nl["tokens"]["the"]["per_sequence_max"] == 2 and nl["tokens"]["the"]["fraction_of_sequences"] == pytest.approx(2 / 3)
    assert nl["worst"]["coverage"][0] == {"text": "a cat", "score": 0.5} and nl["histograms"]["rank"]["the"] == 3
    assert sum(b[2] for b in nl["histograms"]["token_length_standard"]) == pytest.approx(8) and sum(b[2] for b in nl["histograms"]["sequence_length_quantiles"]) == pytest.approx(3)


def test_list_encoders():
    got = association.encode_categories([["a", "b", "a"], ["c"], ["d", "a"]], 3)
    assert got.tolist() == [[2, 1, 0], [0, 0, 1], [1, 0, 1]]
    assert association.encode_categories([["a"], ["a", "a"]], 512).tolist() == [[1], [2]]
    got = association.encode_numbers([[0.0, 10.0], [4.9]], 3)
    assert got.tolist() == [[1, 0, 1], [1, 0, 0]]


def test_information_of_lists(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.integers(0, 2))
        rows.append((str(y), [["u", "v"][y]] * 2 + ["w"], [float(y * 5), float(rng.random())], [float(rng.random()), float(rng.random())], str(rng.random())))
    df = basic.prepared(spark.createDataFrame(rows, "y string, words array<string>, near array<double>, far array<double>, alone string"))
    for parts in (1, 3):
        got = {r.path: r.adjusted_mutual_information for r in association.adjusted_information(df, "y", ["words", "near", "far", "alone"], encoding=8, column_partitions=parts).collect()}
        assert got["words"] > 0.5 and got["near"] > 0.5 and got["far"] < 0.1 and got["alone"] == 0
    assert {association.column_partition(f"f{k}", 4) for k in range(50)} == {0, 1, 2, 3}


def test_semantic_sample_and_options():
    with pytest.raises(ValueError):
        StatsOptions(semantic_sample_rate=0)
    o = StatsOptions(weight="w", feature_weights={"a": "b"}, natural_language={"t": {"vocabulary": "v.txt", "tokens": ["a"]}})
    assert StatsOptions.from_json(o.to_json()) == o
    assert values.TOP == 20 and Comparator().infinity_norm is None and ValueCount(1, 1).min == 1
