"""Validation of collected statistics against a schema: typed anomalies, drift and skew, dataset constraints.

Each rule states how the schema would have to change to accept the data; with ``update`` the change is made.
"""

from __future__ import annotations

import json
import math
import struct
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from ..functions import files
from ..functions.paths import parse, serialize
from ..functions.schema import Comparator, Domain, Feature, Schema
from .drift import count_distances, histogram_jsd
from .inference import TYPES, create, is_float, is_int, value_count, without_composites

UNKNOWN, WARNING, ERROR = "UNKNOWN", "WARNING", "ERROR"
_RANK = {UNKNOWN: 0, WARNING: 1, ERROR: 2}
# Domain kinds that a type may have.
ALLOWED = {
    "BYTES": {"bool", "int", "float", "string", "natural_language", "image", "mid", "url", "time", "struct"},
    "INT": {"bool", "int", "time", "natural_language"},
    "FLOAT": {"bool", "float", "int"},
    "STRUCT": {"struct"},
}


@dataclass
class Reason:
    type: str
    short: str
    long: str
    severity: str = ERROR


@dataclass
class Anomaly:
    path: str
    reasons: list[Reason]

    @property
    def severity(self) -> str:
        return max((r.severity for r in self.reasons), key=_RANK.__getitem__)

    @property
    def type(self) -> str:
        return self.reasons[0].type if len(self.reasons) == 1 else "MULTIPLE_REASONS"

    @property
    def short(self) -> str:
        return self.reasons[0].short if len(self.reasons) == 1 else "Multiple errors"

    @property
    def long(self) -> str:
        return " ".join(r.long for r in self.reasons)


@dataclass
class Anomalies:
    features: dict[str, Anomaly] = field(default_factory=dict)
    dataset: list[Reason] = field(default_factory=list)
    distances: list[dict[str, Any]] = field(default_factory=list)  # measured drift and skew
    data_missing: bool = False
    unneeded: list[str] = field(default_factory=list)  # needed paths that are nowhere

    def rows(self) -> list[tuple[str, str, str, str, str]]:
        """(path, severity, type, short, long) of each reason."""
        return [(p, a.severity, r.type, r.short, r.long) for p, a in sorted(self.features.items()) for r in a.reasons] + [("", ERROR, r.type, r.short, r.long) for r in self.dataset]

    def without(self, types: set[str]) -> Anomalies:
        """Reasons of some types taken out, and features with none left; descriptions and severity are those of what is left."""
        kept = {p: Anomaly(p, [r for r in a.reasons if r.type not in types]) for p, a in self.features.items()}
        return Anomalies({p: a for p, a in kept.items() if a.reasons}, [r for r in self.dataset if r.type not in types], self.distances, self.data_missing, self.unneeded)


    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Anomalies:
        got = json.loads(text)
        reasons = lambda rows: [Reason(**r) for r in rows]
        return Anomalies({p: Anomaly(p, reasons(a["reasons"])) for p, a in got["features"].items()}, reasons(got["dataset"]), got["distances"], got["data_missing"], got["unneeded"])

    def write(self, spark: SparkSession, path: str) -> None:
        """One JSON file on any file system that Spark reads."""
        files.write(spark, path, self.to_json().encode())

    @staticmethod
    def load(spark: SparkSession, path: str) -> Anomalies:
        return Anomalies.from_json(files.read(spark, path).decode())


@dataclass
class Options:
    features_needed: set[str] | None = None
    new_features_are_warnings: bool = False
    severity_overrides: dict[str, str] = field(default_factory=dict)
    exact_values: dict[str, dict[str, float]] | None = None  # all values of a path, instead of the rank histogram


def single(x: float | None) -> float | None:
    """A number as it is with 32 bits."""
    if x is None or math.isnan(x) or math.isinf(x):
        return x
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return math.copysign(math.inf, x)


class _Check:
    """One feature's statistics against its schema entry."""

    def __init__(self, path: str, f: dict[str, Any], entry: Feature, schema: Schema, use_weights: bool, options: Options, update: bool):
        self.path, self.f, self.entry, self.schema, self.options, self.update = path, f, entry, schema, options, update
        self.reasons: list[Reason] = []
        self.weighted = use_weights and f.get("weighted_num_non_missing") is not None
        pre = "weighted_" if self.weighted else ""
        self.present, self.missing = f[f"{pre}num_non_missing"], f[f"{pre}num_missing"]

    def say(self, kind: str, short: str, long: str, change=None) -> None:
        self.reasons.append(Reason(kind, short, long))
        if self.update and change is not None:
            change()

    def set(self, **values) -> Any:
        return lambda: [setattr(self.entry, k, v) for k, v in values.items()]

    def itself(self) -> None:
        """Faults of the schema entry."""
        e = self.entry
        if not e.name:
            self.say("FEATURE_MISSING_NAME", "Feature missing name", "The feature in the schema has no name.", self.set(deprecated=True))
        if not e.type:
            self.say("FEATURE_MISSING_TYPE", "Type not specified", "The feature in the schema has no type.", self.set(type=TYPES.get(self.f["type"], self.f["type"])))
        p = e.presence
        if p is not None and p.min_fraction is not None and not 0 <= p.min_fraction <= 1:
            self.say("INVALID_SCHEMA_SPECIFICATION", "min_fraction should be within [0,1]", f"The min_fraction is {p.min_fraction}.", lambda: setattr(p, "min_fraction", min(1.0, max(0.0, p.min_fraction))))
        v = e.value_count
        if v is not None and ((v.min or 0) < 0 or (v.max is not None and v.max < (v.min or 0))):
            self.say("INVALID_SCHEMA_SPECIFICATION", "ValueCount is invalid", f"The value count is [{v.min}, {v.max}].", self.set(value_count=None))
        if e.shape is not None and (v is not None or e.value_counts or any(d <= 0 for d in e.shape)):
            self.say("INVALID_SCHEMA_SPECIFICATION", "Shape is invalid", "A shape has positive dimensions and stands without value counts.", self.set(shape=None))
        d = e.domain
        if d is not None and e.type and d.kind not in ALLOWED.get(e.type, {d.kind}):
            self.say("DOMAIN_INVALID_FOR_TYPE", "Domain doesn't fit type", f"Domain {d.kind} is not for type {e.type}.", self.set(domain=None))
        if e.domain_ref is not None and e.domain_ref not in self.schema.string_domains:
            self.say("INVALID_DOMAIN_SPECIFICATION", "Missing domain", f"There is no domain {e.domain_ref}.", self.set(domain_ref=None))
        values = self._values()
        if values is not None and len(values) != len(set(values)):
            self.say("INVALID_DOMAIN_SPECIFICATION", "Domain has duplicates", "A value stands twice in the domain.", lambda: self._put_values(list(dict.fromkeys(values))))
        if d is not None and d.kind == "bool" and d.true_value is not None and d.true_value == d.false_value:
            self.say("INVALID_DOMAIN_SPECIFICATION", "True and false are the same", f"Both are {d.true_value!r}.", self.set(domain=Domain("bool")))
        if e.min_domain_mass is not None and values is None:
            self.say("INVALID_SCHEMA_SPECIFICATION", "min_domain_mass without a string domain", "min_domain_mass needs a string domain.", self.set(min_domain_mass=None))

    def _values(self) -> list[str] | None:
        e = self.entry
        if e.domain_ref is not None:
            return self.schema.string_domains.get(e.domain_ref)
        return e.domain.values if e.domain is not None and e.domain.kind == "string" else None

    def _put_values(self, values: list[str]) -> None:
        if self.entry.domain_ref is not None:
            self.schema.string_domains[self.entry.domain_ref] = values
        else:
            self.entry.domain.values = values

    def valency(self) -> None:
        e, f = self.entry, self.f
        wanted = e.value_counts or ([e.value_count] if e.value_count is not None else [])
        if not wanted:
            return
        have = f["levels"] or [f]
        if len(wanted) != len(have):
            n, many = value_count(f)
            self.say("VALUE_NESTEDNESS_MISMATCH", "Mismatched value nest level", f"The schema has {len(wanted)} levels, the data {len(have)}.", self.set(value_count=n, value_counts=many))
            return
        if not self.present:
            return
        for k, (w, x) in enumerate(zip(wanted, have)):
            low, high = x["min_num_values"], x["max_num_values"]
            if low is not None and w.min is not None and low < w.min:
                self.say("FEATURE_TYPE_LOW_NUMBER_VALUES", "Missing values", f"Some examples have fewer values than expected at level {k + 1}: {low} < {w.min}.", lambda w=w, low=low: setattr(w, "min", low or None))
            if high is not None and w.max is not None and high > w.max:
                self.say("FEATURE_TYPE_HIGH_NUMBER_VALUES", "Superfluous values", f"Some examples have more values than expected at level {k + 1}: {high} > {w.max}.", lambda w=w, high=high: setattr(w, "max", high))

    def shape(self) -> None:
        e, f = self.entry, self.f
        if e.shape is None:
            return
        levels = f["levels"] or [f]
        size = math.prod(x["min_num_values"] or 0 for x in levels)
        why = "some examples miss it" if f["num_missing"] or any(x["num_missing"] for x in f["levels"]) else "its size varies" if any(x["min_num_values"] != x["max_num_values"] for x in levels) else f"it has {size} values, not {math.prod(e.shape)}" if size != math.prod(e.shape) else ""
        if why:
            def change():
                e.shape = None
                e.value_count, e.value_counts = value_count(f)

            self.say("INVALID_FEATURE_SHAPE", "The feature has a shape, but it's not always present or its size differs", f"The feature has shape {e.shape}, but {why}.", change)

    def presence(self) -> None:
        p = self.entry.presence
        if p is None:
            return
        total = self.present + self.missing
        if p.min_count is not None and self.present < p.min_count:
            self.say("FEATURE_TYPE_LOW_NUMBER_PRESENT", "Column dropped", f"The feature was present in fewer examples than expected: {self.present} < {p.min_count}.", lambda: setattr(p, "min_count", int(self.present)))
        if p.min_fraction is not None and total > 0:
            share = self.present / total
            if share < p.min_fraction or (p.min_fraction == 1 and self.missing):
                self.say("FEATURE_TYPE_LOW_FRACTION_PRESENT", "Column dropped", f"The feature was present in fewer examples than expected: fraction {share:.6f} < {p.min_fraction}.", lambda: setattr(p, "min_fraction", share if share < 1 else None))

    def kind(self) -> bool:
        e, have = self.entry, TYPES.get(self.f["type"], self.f["type"])
        if e.type and self.f["num_non_missing"] and have != e.type:
            self.say("UNEXPECTED_DATA_TYPE", "Expected data of another type", f"Expected data of type {e.type} but got {have}.", self.set(type=have, domain=None, domain_ref=None))
            return False
        return True

    def domain(self) -> None:
        e, f, d = self.entry, self.f, self.entry.domain
        kind = f["type"]
        values = self._values()
        if values is not None:
            self._enum(values)
        elif d is None and e.domain_ref is None and "domain" in f["custom"]:
            self.say("SEMANTIC_DOMAIN_UPDATE", "Semantic domain update", f"The values look like {f['custom']['domain']['kind']}.", self.set(domain=Domain(**f["custom"]["domain"])))
        elif d is not None:
            rule = getattr(self, f"_{d.kind}", None)
            if rule is not None:
                rule(d, kind)

    def _found(self) -> dict[str, float]:
        exact = (self.options.exact_values or {}).get(self.path)
        return exact if exact is not None else self.f["values"] or {}

    def _enum(self, values: list[str]) -> None:
        if self.f.get("invalid_utf8_count"):
            self.say("ENUM_TYPE_INVALID_UTF8", "Invalid UTF8 string observed", f"{self.f['invalid_utf8_count']} values are not UTF-8.", self.set(domain=None, domain_ref=None))
            return
        found, known = self._found(), set(values)
        off = {v: c for v, c in found.items() if v not in known}
        total = sum(found.values())
        slack = 1 - (self.entry.min_domain_mass if self.entry.min_domain_mass is not None else 1)
        if off and (slack == 0 or sum(off.values()) / total > slack):
            def share(c: float) -> str:
                p = 100 * c / total if total else None
                return "?" if p is None else "<1%" if p < 1 else f"~{math.floor(p)}%"

            told = ", ".join(f"{v} ({share(c)})" for v, c in sorted(off.items(), key=lambda x: (-x[1], x[0])))
            self.say("ENUM_TYPE_UNEXPECTED_STRING_VALUES", "Unexpected string values", f"Examples contain values missing from the schema: {told}.", lambda: self._put_values([*values, *sorted(off)]))

    def _bool(self, d: Domain, kind: str) -> None:
        f = self.f
        if kind == "INT" and f.get("min") is not None:
            if f["min"] < 0:
                self.say("BOOL_TYPE_SMALL_INT", "Integer values less than 0", f"The lowest value is {f['min']:g}.", self.set(domain=Domain("int")))
            if f["max"] > 1:
                self.say("BOOL_TYPE_BIG_INT", "Integer values bigger than 1", f"The highest value is {f['max']:g}.", self.set(domain=Domain("int")))
        elif kind == "FLOAT" and f.get("min") is not None:
            between = any(c > 0 and (low < 0 or high > 1 or (low > 0 and low < 1) or (high > 0 and high < 1)) for low, high, c in f["histograms"].get("QUANTILES", []))
            if f["min"] not in (0, 1) or f["max"] not in (0, 1) or f["num_nan"] or between:
                self.say("BOOL_TYPE_UNEXPECTED_FLOAT", "Unexpected float values", "Some values are not 0 or 1.", self.set(domain=Domain("float")))
        elif kind == "STRING":
            off = [v for v in self._found() if v not in (d.true_value, d.false_value)]
            if off:
                self.say("BOOL_TYPE_UNEXPECTED_STRING", "Unexpected string values", f"Values besides true and false: {', '.join(sorted(off)[:10])}.", self.set(domain=None))

    def _range(self, d: Domain, least, most, small: str, big: str, word: str) -> None:
        if d.min is not None and least is not None and least < d.min:
            self.say(small, "Out-of-range values", f"Unexpectedly low {word}: {least:g} < {d.min:g}.", lambda: setattr(d, "min", least))
        if d.max is not None and most is not None and most > d.max:
            self.say(big, "Out-of-range values", f"Unexpectedly large {word}: {most:g} > {d.max:g}.", lambda: setattr(d, "max", most))

    def _int(self, d: Domain, kind: str) -> None:
        if kind == "INT":
            self._range(d, self.f.get("min"), self.f.get("max"), "INT_TYPE_SMALL_INT", "INT_TYPE_BIG_INT", "value")
        elif kind == "STRING":
            found = self._found()
            bad = [v for v in found if not is_int(v)]
            if bad:
                self.say("INT_TYPE_NOT_INT_STRING", "Expected integers", f"Not an integer: {bad[0]!r}.", self.set(domain=None))
            else:
                numbers = [int(v) for v in found]
                self._range(d, min(numbers, default=None), max(numbers, default=None), "INT_TYPE_SMALL_INT", "INT_TYPE_BIG_INT", "value")

    def _float(self, d: Domain, kind: str) -> None:
        f = self.f
        if kind == "STRING":
            bad = [v for v in self._found() if not is_float(v)]
            if bad:
                self.say("FLOAT_TYPE_STRING_NOT_FLOAT", "Expected floats", f"Not a float: {bad[0]!r}.", self.set(domain=None))
                return
            numbers = [float(v) for v in self._found()]
            least, most = min(numbers, default=None), max(numbers, default=None)
        else:
            least, most = f.get("min"), f.get("max")
        # floats are compared as 32-bit numbers, in which limits are kept
        limits = Domain("float", min=single(d.min), max=single(d.max))
        self._range(limits, single(least), single(most), "FLOAT_TYPE_SMALL_FLOAT", "FLOAT_TYPE_BIG_FLOAT", "value")
        if limits.min != single(d.min):
            d.min = limits.min
        if limits.max != single(d.max):
            d.max = limits.max
        if d.disallow_nan and f["num_nan"]:
            self.say("FLOAT_TYPE_HAS_NAN", "Float feature has NaN values", f"{f['num_nan']} values are NaN.", lambda: setattr(d, "disallow_nan", False))
        if d.disallow_inf and any(x is not None and math.isinf(x) for x in (least, most)):
            self.say("FLOAT_TYPE_HAS_INF", "Float feature has Inf values", "Some values are infinite.", lambda: setattr(d, "disallow_inf", False))

    def _image(self, d: Domain, kind: str) -> None:
        formats = self.f["custom"].get("image_formats") or {}
        total = sum(formats.values())
        if d.minimum_supported_image_fraction is not None and total and 1 - formats.get("UNKNOWN", 0) / total < d.minimum_supported_image_fraction:
            share = 1 - formats.get("UNKNOWN", 0) / total
            self.say("LOW_SUPPORTED_IMAGE_FRACTION", "Low supported image fraction", f"Fraction of known formats {share:.6f} < {d.minimum_supported_image_fraction}.", lambda: setattr(d, "minimum_supported_image_fraction", share))
        most = self.f.get("max_num_bytes")
        if d.max_image_byte_size is not None and most is not None and most > d.max_image_byte_size:
            self.say("MAX_IMAGE_BYTE_SIZE_EXCEEDED", "Num bytes exceeds the max byte size", f"The largest image has {most} bytes, over {d.max_image_byte_size}.", lambda: setattr(d, "max_image_byte_size", most))

    def _natural_language(self, d: Domain, kind: str) -> None:
        nl = self.f["custom"].get("nl")
        if nl is None:
            if d.coverage_min is not None or d.min_avg_token_length is not None or d.token_constraints:
                self.say("STATS_NOT_AVAILABLE", "Statistics not available", "Natural-language constraints need token statistics.")
            return
        if d.coverage_min is not None and nl["feature_coverage"] < d.coverage_min:
            self.say("FEATURE_COVERAGE_TOO_LOW", "Feature coverage too low", f"Coverage {nl['feature_coverage']:.6f} < {d.coverage_min}.", lambda: setattr(d, "coverage_min", nl["feature_coverage"]))
        if d.min_avg_token_length is not None and nl["avg_token_length"] < d.min_avg_token_length:
            self.say("FEATURE_COVERAGE_TOO_SHORT_AVG_TOKEN_LENGTH", "Average token too short", f"{nl['avg_token_length']:.6f} < {d.min_avg_token_length}.", lambda: setattr(d, "min_avg_token_length", nl["avg_token_length"]))
        for c in d.token_constraints:
            t = nl.get("tokens", {}).get(c["token"])
            if t is None:
                self.say("STATS_NOT_AVAILABLE", "Statistics not available", f"There are no statistics of token {c['token']}.")
                continue
            for limit, got, low, high in (("fraction", t["fraction_of_sequences"], "SEQUENCE_VALUE_TOO_SMALL_FRACTION", "SEQUENCE_VALUE_TOO_LARGE_FRACTION"), ("per_sequence", None, "SEQUENCE_VALUE_TOO_FEW_OCCURRENCES", "SEQUENCE_VALUE_TOO_MANY_OCCURRENCES")):
                least, most = (got, got) if got is not None else (t["per_sequence_min"], t["per_sequence_max"])
                if c.get(f"min_{limit}") is not None and least < c[f"min_{limit}"]:
                    self.say(low, "Too few", f"Token {c['token']}: {least} < {c[f'min_{limit}']}.", lambda c=c, limit=limit, least=least: c.update({f"min_{limit}": least}))
                if c.get(f"max_{limit}") is not None and most > c[f"max_{limit}"]:
                    self.say(high, "Too many", f"Token {c['token']}: {most} > {c[f'max_{limit}']}.", lambda c=c, limit=limit, most=most: c.update({f"max_{limit}": most}))

    def unique(self) -> None:
        e, n = self.entry, self.f["unique"]
        if e.unique_min is None and e.unique_max is None:
            return
        if n is None:
            self.say("FEATURE_TYPE_NO_UNIQUE", "No unique values", "Distinct values were not counted.", self.set(unique_min=None, unique_max=None))
            return
        if e.unique_min is not None and n < e.unique_min:
            self.say("FEATURE_TYPE_LOW_UNIQUE", "Low number of unique values", f"{n} < {e.unique_min}.", self.set(unique_min=n))
        if e.unique_max is not None and n > e.unique_max:
            self.say("FEATURE_TYPE_HIGH_UNIQUE", "High number of unique values", f"{n} > {e.unique_max}.", self.set(unique_max=n))

    def compare(self, kind: str, comparator: Comparator | None, control: dict[str, Any] | None, there: bool) -> list[dict[str, Any]]:
        """Drift or skew against another dataset's statistics of the feature."""
        if comparator is None or not there:
            return []
        if control is None:
            self.say("COMPARATOR_CONTROL_DATA_MISSING", f"{kind.capitalize()} control data missing", f"The {kind} control dataset has no such feature.", self.set(**{f"{kind}_comparator": None}))
            return []
        out, a, b = [], self.f["values"] or {}, control["values"] or {}
        measures = []
        if a and b:
            d = count_distances(a, b)
            measures.append(("infinity_norm", "COMPARATOR_L_INFTY_HIGH", d["l_infinity"], d["l_infinity_value"]))
            measures.append(("normalized_abs_difference", "COMPARATOR_NORMALIZED_ABSOLUTE_DIFFERENCE_HIGH", d["normalized_abs_difference"], None))
            measures.append(("jensen_shannon_divergence", "COMPARATOR_JENSEN_SHANNON_DIVERGENCE_HIGH", d["jensen_shannon"], None))
        elif self.f["histograms"].get("STANDARD") and control["histograms"].get("STANDARD"):
            jsd = histogram_jsd(self.f["histograms"]["STANDARD"], control["histograms"]["STANDARD"], self.f["num_nan"], control["num_nan"])
            measures.append(("jensen_shannon_divergence", "COMPARATOR_JENSEN_SHANNON_DIVERGENCE_HIGH", jsd, None))
        for name, reason, got, value in measures:
            limit = getattr(comparator, name)
            if limit is None:
                continue
            out.append({"path": self.path, "kind": kind, "measure": name, "value": got, "threshold": limit})
            if got > limit:
                of = f" The feature value with maximum difference is: {value}" if value is not None else ""
                self.say(reason, f"High {name.replace('_', ' ')} between current and {kind} control", f"The {name} is {got:.6f}, above the threshold {limit}.{of}", lambda name=name, got=got: setattr(comparator, name, got))
        return out


def _visible(stats: dict[str, Any] | None) -> dict[str, Any]:
    return stats["features"] if stats is not None else {}


def _use_weights(stats: dict[str, Any]) -> bool:
    return bool(stats.get("weighted_num_examples")) and all(f.get("weighted_num_non_missing") is not None for f in stats["features"].values())


def validate(stats: dict[str, Any], schema: Schema, environment: str | None = None, previous: dict[str, Any] | None = None, serving: dict[str, Any] | None = None, version: dict[str, Any] | None = None, options: Options | None = None, update: bool = False, max_string_domain_size: int = 100) -> Anomalies:
    """Anomalies of one slice's collected statistics. With ``update`` the given schema is changed so that they vanish."""
    o, stats = options or Options(), without_composites(stats)
    if not update:
        schema = schema.copy()  # an entry's own faults are mended before data are held against it
    if environment is not None and environment not in schema.default_environment and not any(environment in f.in_environment or environment in f.not_in_environment for f in schema.features.values()) and schema.default_environment:
        raise ValueError(f"environment {environment} is not in the schema")
    out = Anomalies()
    _dataset(stats, schema, previous, version, out, update)
    if not stats["num_examples"]:
        out.data_missing = True
        return out
    gone, weights = schema.deprecated_paths(), _use_weights(stats)

    def put(path: str, reasons: list[Reason], severity: str = ERROR) -> None:
        if not reasons:
            return
        for r in reasons:
            r.severity = o.severity_overrides.get(r.type, severity)
        out.features.setdefault(path, Anomaly(path, [])).reasons.extend(reasons)

    for path, f in stats["features"].items():
        if path in gone or any(serialize(parse(path)[:k]) in gone for k in range(1, len(parse(path)))):
            continue
        entry = schema.features.get(path)
        if entry is None:
            if o.features_needed is None or path in o.features_needed:
                put(path, [Reason("SCHEMA_NEW_COLUMN", "New column", "New column (column in data but not in schema)")], WARNING if o.new_features_are_warnings else ERROR)
                if update:
                    create(path, f, schema, max_string_domain_size)
            continue
        c = _Check(path, f, entry, schema, weights, o, True)
        c.itself()
        c.update = update
        if not entry.is_deprecated:
            needed = entry.presence is not None and ((entry.presence.min_count or 0) > 0 or (entry.presence.min_fraction or 0) > 0)
            if not f["num_non_missing"]:
                if needed and schema.in_environment(entry, environment):
                    c.say("FEATURE_TYPE_NOT_PRESENT", "Column is completely missing", "The feature is in no example.", c.set(deprecated=True))
            elif not schema.in_environment(entry, environment):
                c.say("SCHEMA_NEW_COLUMN", "New column", f"The feature is present in environment {environment}, to which it doesn't belong.", lambda e=entry: e.in_environment.append(environment))
            else:
                c.valency()
                c.shape()
                c.presence()
                if c.kind():
                    c.domain()
                c.unique()
                out.distances += c.compare("drift", entry.drift_comparator, _visible(previous).get(path), previous is not None)
                out.distances += c.compare("skew", entry.skew_comparator, _visible(serving).get(path), serving is not None)
                source = f["custom"].get("derived_source")
                if entry.derived_source != source and (entry.derived_source is not None or source is not None):
                    c.say("DERIVED_FEATURE_INVALID_SOURCE" if entry.derived_source is not None and source is not None else "DERIVED_FEATURE_BAD_LIFECYCLE", "Derived source differs", f"Schema: {entry.derived_source}; data: {source}.", c.set(derived_source=source))
        put(path, c.reasons)
    for path, entry in list(schema.features.items()):
        p = entry.presence
        required = not entry.is_deprecated and path not in gone and p is not None and ((p.min_count or 0) > 0 or (p.min_fraction or 0) > 0) and schema.in_environment(entry, environment)
        if required and path not in stats["features"]:
            put(path, [Reason("SCHEMA_MISSING_COLUMN", "Column dropped", "Column is completely missing")])
            if update:
                entry.deprecated = True
    _composites(stats, schema, put, update)
    if o.features_needed is not None:
        out.unneeded = sorted(p for p in o.features_needed if p not in stats["features"] and p not in schema.features)
    return out


def _composites(stats: dict[str, Any], schema: Schema, put, update: bool) -> None:
    live = {p for p, f in schema.features.items() if not f.is_deprecated}
    for s in schema.sparse_features:
        got, reasons = stats["sparse"].get(s.name), []
        if s.name in live:
            reasons.append(Reason("SPARSE_FEATURE_NAME_COLLISION", "Sparse feature name collision", f"{s.name} names a feature too."))
        if got is not None:
            if got["missing_value"]:
                reasons.append(Reason("SPARSE_FEATURE_MISSING_VALUE", "Missing value feature", f"{got['missing_value']} examples lack the value."))
            for i, n in zip(s.index_features, got["missing_index"]):
                if n:
                    reasons.append(Reason("SPARSE_FEATURE_MISSING_INDEX", "Missing index feature", f"{n} examples lack index {i}."))
            for i, low, high in zip(s.index_features, got["min_length_diff"], got["max_length_diff"]):
                if low or high:
                    reasons.append(Reason("SPARSE_FEATURE_LENGTH_MISMATCH", "Length mismatch between value and index feature", f"Index {i}: differences from {low} to {high}."))
        put(s.name, reasons)
        if update and reasons:
            s.lifecycle_stage = "DEPRECATED"
    for w in schema.weighted_features:
        got, reasons = stats["weighted"].get(w.name), []
        if w.name in live or any(w.name == s.name for s in schema.sparse_features):
            reasons.append(Reason("WEIGHTED_FEATURE_NAME_COLLISION", "Weighted feature name collision", f"{w.name} names a feature too."))
        if got is not None:
            for n, kind, word in ((got["missing_weight"], "WEIGHTED_FEATURE_MISSING_WEIGHT", "weight"), (got["missing_value"], "WEIGHTED_FEATURE_MISSING_VALUE", "value")):
                if n:
                    reasons.append(Reason(kind, f"Missing {word} feature", f"{n} examples lack the {word}."))
            if got["min_weight_length_diff"] or got["max_weight_length_diff"]:
                reasons.append(Reason("WEIGHTED_FEATURE_LENGTH_MISMATCH", "Length mismatch between value and weight feature", f"Differences from {got['min_weight_length_diff']} to {got['max_weight_length_diff']}."))
        put(w.name, reasons)
        if update and reasons:
            w.lifecycle_stage = "DEPRECATED"


def _dataset(stats, schema: Schema, previous, version, out: Anomalies, update: bool) -> None:
    c, n = schema.dataset_constraints, stats["num_examples"]
    if c is None:
        return
    say = lambda kind, long: out.dataset.append(Reason(kind, kind.replace("_", " ").capitalize(), long))
    for other, name in ((previous, "drift"), (version, "version")):
        if other is None:
            continue
        least, most, before = getattr(c, f"num_examples_{name}_min"), getattr(c, f"num_examples_{name}_max"), other["num_examples"]
        ratio = n / before if before else math.inf
        if least is not None and ratio < least:
            say("COMPARATOR_LOW_NUM_EXAMPLES", f"The ratio of examples to the {name} control is {ratio:.6f}, below {least}.")
            if update:
                setattr(c, f"num_examples_{name}_min", ratio)
        if most is not None and ratio > most:
            say("COMPARATOR_HIGH_NUM_EXAMPLES", f"The ratio of examples to the {name} control is {ratio:.6f}, above {most}.")
            if update:
                setattr(c, f"num_examples_{name}_max", ratio)
    if c.min_examples_count is not None and n < c.min_examples_count:
        say("DATASET_LOW_NUM_EXAMPLES", f"{n} examples, fewer than {c.min_examples_count}.")
        if update:
            c.min_examples_count = n
    if c.max_examples_count is not None and n > c.max_examples_count:  # checked on its own, also without a minimum
        say("DATASET_HIGH_NUM_EXAMPLES", f"{n} examples, more than {c.max_examples_count}.")
        if update:
            c.max_examples_count = n


def validate_slices(stats: dict[str, dict[str, Any]], schema: Schema, **kw) -> dict[str, Anomalies]:
    """Anomalies of each slice, feature names prefixed ``slice(NAME)::``."""
    out = {}
    for name, s in stats.items():
        a = validate(s, schema.copy(), **kw)
        a.features = {f"slice({name})::{p}": x for p, x in a.features.items()}
        out[name] = a
    return out


# Rules that need a whole dataset.
GLOBAL_ONLY = {
    "FEATURE_TYPE_LOW_FRACTION_PRESENT", "FEATURE_TYPE_LOW_NUMBER_PRESENT", "FEATURE_TYPE_NOT_PRESENT", "SCHEMA_TRAINING_SERVING_SKEW", "COMPARATOR_CONTROL_DATA_MISSING", "COMPARATOR_TREATMENT_DATA_MISSING",
    "COMPARATOR_L_INFTY_HIGH", "COMPARATOR_JENSEN_SHANNON_DIVERGENCE_HIGH", "COMPARATOR_LOW_NUM_EXAMPLES", "COMPARATOR_HIGH_NUM_EXAMPLES", "NO_DATA_IN_SPAN", "DATASET_LOW_NUM_EXAMPLES", "DATASET_HIGH_NUM_EXAMPLES",
}


def validate_instance(spark, row: dict, schema: Schema, environment: str | None = None) -> Anomalies:
    """A single example against the schema, without rules that need a dataset."""
    from ..plans.statistics import StatsOptions, generate_statistics

    kind = schema.to_struct_type()
    from pyspark.sql import types as T

    known = T.StructType([f for f in kind.fields if f.name in row])
    unknown = {k: v for k, v in row.items() if k not in known.fieldNames()}

    def fit(v, t):
        if isinstance(t, T.ArrayType):
            return v if v is None or isinstance(v, (list, tuple)) else [v]
        return v[0] if isinstance(v, (list, tuple)) and len(v) == 1 else v

    df = spark.createDataFrame([{k: fit(row[k], known[k].dataType) for k in known.fieldNames()}], known) if known.fields else spark.range(1).select()
    from pyspark.sql import functions as F

    for k, v in unknown.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    stats = generate_statistics(df, StatsOptions(histograms=False)).collect()["All Examples"]
    return validate(stats, schema.copy(), environment).without(GLOBAL_ONLY)


