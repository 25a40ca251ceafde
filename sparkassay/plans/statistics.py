"""Planner: which statistics of a table are computed, in few passes, and their assembly by feature."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import FLOAT, INT, features, parse
from ..operators import association, basic, quantiles, semantic, values
from ..operators.slicing import ALL, SLICE, FeatureSlicer, from_config
from ..sources.readers import read_vocabulary
from ..sources.scratch import scratch


@dataclass
class StatsOptions:
    """What to compute.

    ``feature_weights``: for top-level features the column that weighs them instead of ``weight``. ``natural_language``: for text
    columns {"vocabulary": a file with a token a line or a table of ``token``, "tokens": tokens to follow, "excluded": tokens to
    pass over}. ``derived``: for paths {"deriver", "sources"}. ``semantic_sample_rate``: the share of rows that semantic domains are
    inferred from. ``generators``: functions of the prepared rows that give (slice, path, name, value) rows of their own (see
    :mod:`.generators`).
    """

    allowlist: list[str] | None = None
    slicers: list = field(default_factory=list)
    slicing_config: list[dict] | None = None
    weight: str | None = None
    sample_rate: float | None = None
    sample_seed: int = 0
    num_top_values: int = values.TOP
    num_rank_buckets: int = values.RANKS
    frequency_threshold: int = 1
    weighted_frequency_threshold: float = 0.0
    num_histogram_buckets: int = 10
    num_quantile_buckets: int = 10
    num_valency_buckets: int = 10
    histograms: bool | dict[str, bool] = True
    categorical: list[str] = field(default_factory=list)
    semantic_domains: bool = False
    semantic_least_values: int = semantic.LEAST_VALUES
    sketches: bool = False
    cross_features: list[tuple[str, str]] | None = None
    sparse_features: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    weighted_features: dict[str, tuple[str, str]] = field(default_factory=dict)
    generators: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    feature_weights: dict[str, str] = field(default_factory=dict)
    natural_language: dict[str, dict[str, Any]] = field(default_factory=dict)
    derived: dict[str, dict[str, Any]] = field(default_factory=dict)
    semantic_sample_rate: float | None = None

    def __post_init__(self):
        if self.semantic_sample_rate is not None and not 0 < self.semantic_sample_rate <= 1:
            raise ValueError("semantic_sample_rate must be in (0, 1]")
        if self.sample_rate is not None and not 0 < self.sample_rate <= 1:
            raise ValueError("sample_rate must be in (0, 1]")
        for name in ("num_top_values", "num_rank_buckets", "num_histogram_buckets", "num_quantile_buckets", "num_valency_buckets", "frequency_threshold"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.slicing_config is not None:
            if self.slicers:
                raise ValueError("give slicers or a slicing_config, not both")
            self.slicers = from_config(self.slicing_config)

    def to_json(self) -> str:
        if self.generators or any(not isinstance(s, FeatureSlicer) for s in self.slicers) or any(isinstance(n.get("vocabulary"), DataFrame) for n in self.natural_language.values()):
            raise ValueError("functions and tables have no JSON form")
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> StatsOptions:
        got = json.loads(text)
        got["slicers"] = [] if got.get("slicing_config") else [FeatureSlicer(**s) for s in got["slicers"]]
        return StatsOptions(**got)


class Statistics:
    """Frames of tidy statistics, computed when asked for, and :meth:`collect` for what schema inference and validation read."""

    def __init__(self, df: DataFrame, options: StatsOptions | None = None):
        self.options = o = options or StatsOptions()
        rows = df if o.sample_rate is None or o.sample_rate == 1 else df.sample(o.sample_rate, o.sample_seed)
        self.rows = basic.prepared(rows, o.weight, o.slicers, o.allowlist)
        self.weighted = o.weight is not None or bool(o.feature_weights)
        self.parts = self._by_weight(rows)
        self._frames: dict[str, Any] = {}

    def _by_weight(self, rows: DataFrame) -> list[tuple[DataFrame, bool]]:
        """Prepared rows for each weight, with the features that it weighs; whether they are weighted."""
        o, own = self.options, [c for c in self.rows.columns if c not in (SLICE, basic.WEIGHT)]
        by: dict[str | None, list[str]] = {}
        for c in own:
            by.setdefault(o.feature_weights.get(c, o.weight), []).append(c)
        if set(by) <= {o.weight}:
            return [(self.rows, o.weight is not None)]
        out = []
        for w, columns in by.items():
            part = basic.prepared(rows, w, o.slicers, columns)
            out.append((part.select(SLICE, basic.WEIGHT, *[f"`{c}`" for c in columns]), w is not None))
        return out

    def _each(self, compute: Callable[[DataFrame, bool], DataFrame | None]) -> DataFrame | None:
        found = [x for x in (compute(rows, weighted) for rows, weighted in self.parts) if x is not None]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found) if found else None

    def frame(self, name: str) -> DataFrame | None:
        """common, levels, numeric, string, empty, counts, top, weighted_top, ranks, unique, cumulative, histograms, weighted_histograms, valency, level_valency, median, cross, sparse, weighted_features or custom."""
        if name not in self._frames:
            self._frames[name] = getattr(self, f"_{name}")()
        return self._frames[name]

    def _common(self):
        return self._each(basic.common)

    def _levels(self):
        return basic.levels(self.rows)

    def _numeric(self):
        return self._each(basic.numeric_stats)

    def _string(self):
        return basic.string_stats(self.rows, self.options.categorical)

    def _empty(self):
        return basic.empty_values(self.rows)

    def _counts(self):
        return scratch(self._each(lambda rows, _: values.value_counts(rows, self.options.categorical)), "value-counts")  # read for top values, ranks and uniques

    def _top(self):
        return values.top(self.frame("counts"), self.options.num_top_values, threshold=self.options.frequency_threshold)

    def _weighted_top(self):
        return values.top(self.frame("counts"), self.options.num_top_values, "wcnt", self.options.weighted_frequency_threshold) if self.weighted else None

    def _ranks(self):
        return values.rank_histogram(self.frame("counts"), self.options.num_rank_buckets)

    def _unique(self):
        return values.uniques(self.frame("counts"))

    def _numeric_paths(self) -> list[str] | None:
        h = self.options.histograms
        if h is True:
            return None
        every = [f.path for f in features(self.rows.schema) if f.type in (INT, FLOAT)]
        return [] if h is False else [p for p in every if h.get(p, True)]

    def _has_numbers(self) -> bool:
        wanted = self._numeric_paths()
        return any(f.type in (INT, FLOAT) and f.steps[0] not in (SLICE, basic.WEIGHT) and (wanted is None or f.path in wanted) for f in features(self.rows.schema))

    def _cumulative(self):
        return quantiles.cumulative(quantiles.numeric_values(self.rows, self._numeric_paths()))

    def _histograms(self):
        o = self.options
        return quantiles.histograms(self.frame("cumulative"), o.num_quantile_buckets, o.num_histogram_buckets, summed=True) if self._has_numbers() else None

    def _weighted_histograms(self):
        o, paths = self.options, self._numeric_paths()
        if not (self.weighted and self._has_numbers()):
            return None
        has = lambda rows: any(f.type in (INT, FLOAT) and f.steps[0] not in (SLICE, basic.WEIGHT) and (paths is None or f.path in paths) for f in features(rows.schema))
        found = self._each(lambda rows, weighted: quantiles.numeric_values(rows, paths, True) if weighted and has(rows) else None)
        return quantiles.histograms(found, o.num_quantile_buckets, o.num_histogram_buckets) if found is not None else None

    def _valency(self):
        return quantiles.histograms(quantiles.valencies(self.rows), self.options.num_valency_buckets, kinds=("QUANTILES",))

    def _level_valency(self):
        found = quantiles.level_valencies(self.rows)
        if found is None:
            return None
        n = self.options.num_valency_buckets
        got = quantiles.histograms(found.withColumn("path", F.concat_ws("\0", "path", "level")).drop("level"), n, n)
        cut = F.split("path", "\0")
        return got.select(SLICE, cut[0].alias("path"), cut[1].cast("int").alias("level"), "kind", "bucket", "low", "high", "count")

    def _median(self):
        return quantiles.median(self.frame("cumulative")) if self._has_numbers() else None

    def _cross(self):
        return association.cross(self.rows, self.options.cross_features)

    def _sparse(self):
        return {n: association.sparse(self.rows, v, ix) for n, (v, ix) in self.options.sparse_features.items()}

    def _weighted_features(self):
        return {n: association.weighted_feature(self.rows, v, w) for n, (v, w) in self.options.weighted_features.items()}

    def _custom(self):
        out = None
        for g in self.options.generators:
            got = g(self.rows)
            out = got if out is None else out.unionByName(got)
        return out

    def collect(self) -> dict[str, dict[str, Any]]:
        """{slice: {"num_examples", "weighted_num_examples", "features": {path: statistics}, ...}}; a row for each path, so small whatever the table's size."""
        out: dict[str, dict[str, Any]] = {}
        if not self.weighted and not {"common", "numeric", "string"} & set(self._frames) and self.rows.columns != [SLICE]:
            self._frames |= basic.profile(self.rows, self.options.categorical, lambda df: scratch(df, "profile"))
        for r in self.frame("common").collect():
            d = out.setdefault(r[SLICE], {"num_examples": r.num_examples, "weighted_num_examples": None, "features": {}, "sparse": {}, "weighted": {}, "cross": {}})
            if self.options.weight is not None and parse(r.path)[0] not in self.options.feature_weights:
                d["weighted_num_examples"] = r.weighted_num_examples
            d["features"][r.path] = {k: v for k, v in r.asDict().items() if k not in (SLICE, "path", "num_examples")} | {"num_nan": 0, "levels": [], "values": None, "unique": None, "histograms": {}, "custom": {}}
        if not out:
            out[ALL] = {"num_examples": 0, "weighted_num_examples": None, "features": {}, "sparse": {}, "weighted": {}, "cross": {}}
            return out

        def put(name: str, add: Callable) -> None:
            df = self.frame(name)
            for r in df.collect() if df is not None else []:
                # a generator may name a path that is no column: a composite
                add(out[r[SLICE]]["features"].setdefault(r.path, {"type": None, "custom": {}, "histograms": {}}), r)

        plain = lambda f, r: f.update({k: v for k, v in r.asDict().items() if k not in (SLICE, "path")})
        put("numeric", plain)
        put("string", plain)
        put("levels", lambda f, r: f["levels"].append(r.asDict()))
        put("unique", plain)
        put("ranks", lambda f, r: f.__setitem__("values", (f["values"] or {}) | {r.label: r.sample_count}))
        if self.options.histograms:
            put("histograms", lambda f, r: f["histograms"].setdefault(r.kind, []).append((r.bucket, r.low, r.high, r["count"])))
            put("median", plain)
            put("level_valency", lambda f, r: f["custom"].setdefault(f"level_{r.level}_value_list_length_{r.kind.lower()}", []).append([r.bucket, r.low, r.high, r["count"]]))
        put("custom", lambda f, r: f["custom"].__setitem__(r.name, r.value))
        if self.options.cross_features is not None:
            for r in self.frame("cross").collect():
                out[r[SLICE]]["cross"][r.path_x, r.path_y] = {k: v for k, v in r.asDict().items() if k not in (SLICE, "path_x", "path_y")}
        for kind in ("sparse", "weighted"):
            for n, df in self.frame("sparse" if kind == "sparse" else "weighted_features").items():
                for r in df.collect():
                    out[r[SLICE]][kind][n] = r.asDict()
        for d in out.values():
            for f in d["features"].values():
                f["histograms"] = {k: [b[1:] for b in sorted(v)] for k, v in f["histograms"].items()}
                for k in f["custom"]:
                    if k.startswith("level_"):
                        f["custom"][k] = [b[1:] for b in sorted(f["custom"][k])]
            for path, source in self.options.derived.items():
                if path in d["features"]:
                    d["features"][path]["custom"]["derived_source"] = source
        if self.options.semantic_domains:
            self._domains(out)
        self._natural_language(out)
        return out

    def _domains(self, out: dict) -> None:
        least, rate = self.options.semantic_least_values, self.options.semantic_sample_rate
        rows = self.rows if rate is None or rate == 1 else self.rows.sample(rate, self.options.sample_seed)
        for f in features(rows.schema):
            if not f.scalar or f.steps[0] in (SLICE, basic.WEIGHT) or len(f.steps) > 1:
                continue
            name = f.steps[0]
            if f.leaf.simpleString() == "binary":
                for r in semantic.images(rows, name, least, decoder=semantic.header_size).collect():
                    custom = out[r[SLICE]]["features"][f.path]["custom"]
                    custom |= {"image_formats": dict(r.formats), "image_max_width": r.max_width, "image_max_height": r.max_height}
                    if r.is_image:
                        custom["domain"] = {"kind": "image"}
            elif f.type == "STRING":
                for r in semantic.time_strings(rows, name, least).where("format IS NOT NULL").collect():
                    out[r[SLICE]]["features"][f.path]["custom"]["domain"] = {"kind": "time", "format": r.format}
                for r in semantic.natural_language(rows, name).where("is_natural_language").collect():
                    out[r[SLICE]]["features"][f.path]["custom"].setdefault("domain", {"kind": "natural_language"})
            elif f.type == "INT" and f.leaf.simpleString() in ("int", "bigint"):
                for r in semantic.time_integers(rows, name, least).where("format IS NOT NULL").collect():
                    out[r[SLICE]]["features"][f.path]["custom"]["domain"] = {"kind": "time", "format": r.format}

    def _natural_language(self, out: dict) -> None:
        """Token statistics of the columns in ``options.natural_language``: coverage, lengths, followed tokens, the worst sequences."""
        spark = self.rows.sparkSession
        for name, asked in self.options.natural_language.items():
            vocabulary = asked.get("vocabulary")
            if isinstance(vocabulary, str):
                vocabulary = read_vocabulary(spark, vocabulary)
            elif vocabulary is None:
                vocabulary = spark.createDataFrame([], "token string")
            texts = self.rows.where(F.col(f"`{name}`").isNotNull()).select(SLICE, F.col(f"`{name}`").alias("text"), F.monotonically_increasing_id().alias("sequence"))
            tokens = scratch(semantic.tokens(texts, "text", "sequence", vocabulary), "tokens")
            for r in semantic.token_coverage(tokens, vocabulary, asked.get("excluded")).collect():
                out[r[SLICE]]["features"][name]["custom"]["nl"] = {k: v for k, v in r.asDict().items() if k != SLICE} | {"tokens": {}, "worst": {}, "histograms": {}}
            if asked.get("tokens"):
                for r in semantic.token_stats(tokens, list(asked["tokens"])).collect():
                    out[r[SLICE]]["features"][name]["custom"]["nl"]["tokens"][r.token] = {k: v for k, v in r.asDict().items() if k not in (SLICE, "token")}
            for r in semantic.worst_sequences(tokens, vocabulary).join(texts, [SLICE, "sequence"]).orderBy(SLICE, "kind", "rank").collect():
                out[r[SLICE]]["features"][name]["custom"]["nl"]["worst"].setdefault(r.kind, []).append({"text": r.text if isinstance(r.text, str) else list(r.text), "score": r.score})
            if asked.get("tokens"):
                for r in semantic.position_histograms(tokens, list(asked["tokens"]), self.options.num_histogram_buckets).orderBy(SLICE, "path", "kind", "bucket").collect():
                    held = out[r[SLICE]]["features"][name]["custom"]["nl"]["tokens"][r.path]
                    held.setdefault(f"positions_{r.kind.lower()}", []).append([r.low, r.high, r["count"]])
            for kind, df in semantic.sequence_histograms(tokens, self.options.num_histogram_buckets).items():
                for r in df.orderBy(*df.columns[:4]).collect():
                    held = out[r[SLICE]]["features"][name]["custom"]["nl"]["histograms"]
                    if kind == "rank":
                        held.setdefault(kind, {})[r.label] = r.sample_count
                    else:
                        held.setdefault(f"{kind}_{r.kind.lower()}", []).append([r.low, r.high, r["count"]])

    def counters(self) -> dict[str, Any]:
        """What a run handles: rows, bytes of text and binary values, slices, features by type, generators by name; one aggregate."""
        fs = [f for f in features(self.rows.schema) if f.steps[0] not in (SLICE, basic.WEIGHT)]
        texts = [f for f in fs if f.scalar and f.type in ("STRING", "BYTES")]
        size = reduce(Column.__add__, [F.coalesce(F.octet_length(f.read), F.lit(0)) for f in texts], F.lit(0))
        r = self.rows.agg(F.count_if(F.col(SLICE) == ALL).alias("rows"), F.sum(F.when(F.col(SLICE) == ALL, size)).alias("bytes"), F.count_distinct(SLICE).alias("slices")).first()
        kinds: dict[str, int] = {}
        for f in fs:
            kinds[f.type] = kinds.get(f.type, 0) + 1
        return {"rows": r.rows, "bytes": r.bytes or 0, "slices": r.slices, "features": kinds, "generators": [getattr(g, "__name__", type(g).__name__) for g in self.options.generators]}

    def to_nested(self) -> DataFrame:
        """One row for each (slice, path), the tidy frames as structs."""
        out = self.frame("common")
        for name in ("numeric", "string", "unique"):
            df = self.frame(name)
            if df is not None:
                cells = [c for c in df.columns if c not in (SLICE, "path")]
                out = out.join(df.select(SLICE, "path", F.struct(*cells).alias(f"{name}_stats")), [SLICE, "path"], "left")
        return out

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Each frame as Parquet under ``path``."""
        for name in ("common", "numeric", "string", "top", "ranks", "unique", "histograms", "valency"):
            df = self.frame(name)
            if df is not None:
                df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def load(spark, path: str) -> dict[str, DataFrame]:
    """Frames written by :meth:`Statistics.write`; OSError if there are none."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in ("common", "numeric", "string", "top", "ranks", "unique", "histograms", "valency"):
        try:
            out[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        except AnalysisException:
            continue
    if "common" not in out:
        raise OSError(f"no statistics in {path}")
    return out


def merge(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Shards of statistics with disjoint (slice, path) as one."""
    out: dict[str, DataFrame] = {}
    for p in parts:
        for k, df in p.items():
            out[k] = df if k not in out else out[k].unionByName(df)
    return out


def project(stats: dict[str, Any], allow: list[str] | None = None, deny: list[str] | None = None) -> dict[str, Any]:
    """Collected statistics of one slice with some features only."""
    if allow is not None and deny is not None:
        raise ValueError("give allow or deny, not both")
    keep = lambda p: (p in allow) if allow is not None else (p not in (deny or []))
    return stats | {"features": {p: f for p, f in stats["features"].items() if keep(p)}}


def generate_statistics(df: DataFrame, options: StatsOptions | None = None) -> Statistics:
    return Statistics(df, options)
