"""The schema model: features, domains and constraints; inferred, edited by hand, kept as JSON."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from . import files
from .paths import parse

# Stages of a feature's life that take it out of validation.
DEPRECATED_STAGES = {"PLANNED", "ALPHA", "DEPRECATED", "DEBUG_ONLY", "DISABLED"}


@dataclass
class Presence:
    min_count: int | None = None
    min_fraction: float | None = None


@dataclass
class ValueCount:
    min: int | None = None
    max: int | None = None


@dataclass
class Domain:
    """``kind``: bool, int, float, string, struct, natural_language, image, mid, url or time; the other members belong to some kinds."""

    kind: str
    name: str | None = None
    values: list[str] | None = None
    min: float | None = None
    max: float | None = None
    true_value: str | None = None
    false_value: str | None = None
    is_categorical: bool = False
    disallow_nan: bool = False
    disallow_inf: bool = False
    format: str | None = None
    minimum_supported_image_fraction: float | None = None
    max_image_byte_size: int | None = None
    vocabulary: str | None = None
    coverage_min: float | None = None
    min_avg_token_length: float | None = None
    token_constraints: list[dict] = field(default_factory=list)


@dataclass
class Comparator:
    """Thresholds; any that is set is checked."""

    infinity_norm: float | None = None
    normalized_abs_difference: float | None = None
    jensen_shannon_divergence: float | None = None


@dataclass
class Feature:
    name: str
    type: str | None = None
    presence: Presence | None = None
    value_count: ValueCount | None = None
    value_counts: list[ValueCount] | None = None
    shape: list[int] | None = None
    domain: Domain | None = None
    domain_ref: str | None = None
    unique_min: int | None = None
    unique_max: int | None = None
    min_domain_mass: float | None = None
    in_environment: list[str] = field(default_factory=list)
    not_in_environment: list[str] = field(default_factory=list)
    lifecycle_stage: str | None = None
    deprecated: bool = False
    skew_comparator: Comparator | None = None
    drift_comparator: Comparator | None = None
    derived_source: str | None = None

    @property
    def is_deprecated(self) -> bool:
        return self.deprecated or self.lifecycle_stage in DEPRECATED_STAGES


@dataclass
class SparseFeature:
    name: str
    value_feature: str
    index_features: list[str]
    lifecycle_stage: str | None = None


@dataclass
class WeightedFeature:
    name: str
    feature: str
    weight_feature: str
    lifecycle_stage: str | None = None


@dataclass
class DatasetConstraints:
    min_examples_count: int | None = None
    max_examples_count: int | None = None
    num_examples_drift_min: float | None = None
    num_examples_drift_max: float | None = None
    num_examples_version_min: float | None = None
    num_examples_version_max: float | None = None


@dataclass
class Schema:
    """``features`` by path; a nested feature's path has its parent's in front."""

    features: dict[str, Feature] = field(default_factory=dict)
    string_domains: dict[str, list[str]] = field(default_factory=dict)
    default_environment: list[str] = field(default_factory=list)
    sparse_features: list[SparseFeature] = field(default_factory=list)
    weighted_features: list[WeightedFeature] = field(default_factory=list)
    dataset_constraints: DatasetConstraints | None = None

    def copy(self) -> Schema:
        return copy.deepcopy(self)

    def get_feature(self, path: str) -> Feature:
        if path not in self.features:
            raise ValueError(f"feature {path} is not in the schema")
        return self.features[path]

    def get_domain(self, path: str) -> Domain:
        f = self.get_feature(path)
        if f.domain_ref is not None:
            return Domain("string", name=f.domain_ref, values=self.string_domains[f.domain_ref])
        if f.domain is None:
            raise ValueError(f"feature {path} has no domain")
        return f.domain

    def set_domain(self, path: str, domain: Domain | str) -> None:
        f = self.get_feature(path)
        if isinstance(domain, str):
            if domain not in self.string_domains:
                raise ValueError(f"there is no string domain {domain}")
            f.domain, f.domain_ref = None, domain
        else:
            f.domain, f.domain_ref = domain, None

    def in_environment(self, f: Feature, environment: str | None) -> bool:
        if environment is None or environment in f.in_environment:
            return True
        return environment not in f.not_in_environment and environment in self.default_environment

    def deprecated_paths(self) -> set[str]:
        """Deprecated features and what lies below them."""
        own = [parse(p) for p, f in self.features.items() if f.is_deprecated]
        return {p for p in self.features if any(parse(p)[: len(d)] == d for d in own)}

    def categorical(self) -> list[str]:
        out = []
        for p, f in self.features.items():
            kind = f.domain.kind if f.domain else None
            if f.type == "BYTES" or kind in ("bool", "natural_language") or (f.domain is not None and f.domain.is_categorical):
                out.append(p)
        return out

    def multivalent(self) -> list[str]:
        return [p for p, f in self.features.items() if f.type != "STRUCT" and not (f.shape == [1] or (f.value_count is not None and f.value_count.max == 1))]

    def to_struct_type(self) -> T.StructType:
        """Spark's type for rows of this schema; a feature that may have more than one value is an array."""
        kinds = {"BYTES": T.StringType(), "INT": T.LongType(), "FLOAT": T.DoubleType()}

        def below(prefix: tuple[str, ...]) -> T.StructType:
            out = T.StructType()
            for p, f in self.features.items():
                steps = parse(p)
                if steps[:-1] != prefix:
                    continue
                kind = below(steps) if f.type == "STRUCT" else kinds.get(f.type, T.StringType())
                out.add(f.name, T.ArrayType(kind) if p in self.multivalent() else kind)
            return out

        return below(())

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Schema:
        return _build(Schema, json.loads(text))

    def write(self, spark: SparkSession, path: str) -> None:
        """One JSON file on any file system that Spark reads."""
        files.write(spark, path, self.to_json().encode())

    @staticmethod
    def load(spark: SparkSession, path: str) -> Schema:
        return Schema.from_json(files.read(spark, path).decode())


def dummy_schema(paths: list[str]) -> Schema:
    return Schema({p: Feature(parse(p)[-1]) for p in paths})


def _build(kind: Any, value: Any) -> Any:
    """A dataclass again from plain values, by its type hints."""
    args = [a for a in getattr(kind, "__args__", ()) if a is not type(None)]
    origin = getattr(kind, "__origin__", None)
    if value is None:
        return None
    if is_dataclass(kind):
        hints = get_type_hints(kind)
        return kind(**{f.name: _build(hints[f.name], value[f.name]) for f in fields(kind) if f.name in value})
    if origin is list:
        return [_build(args[0], v) for v in value]
    if origin is dict:
        return {k: _build(args[1], v) for k, v in value.items()}
    if args and origin is None:
        return _build(args[0], value)
    return value
