"""Schema inference from collected statistics, and updating. Inputs are one record for each path."""

from __future__ import annotations

from typing import Any

from ..functions.paths import parse, serialize
from ..functions.schema import Domain, Feature, Presence, Schema, ValueCount

# Words for true and false.
TRUE_WORDS = {"TRUE", "true", "SET", "set", "1", ""}
FALSE_WORDS = {"FALSE", "false", "CLEAR", "clear", "0"}
MAX_STRING_DOMAIN = 100
TYPES = {"STRING": "BYTES"}


def is_int(text: str) -> bool:
    try:
        return text == text.strip() and "_" not in text and -(2**63) <= int(text) < 2**63
    except ValueError:
        return False


def is_float(text: str) -> bool:
    try:
        float(text)
        return text == text.strip() and "_" not in text
    except ValueError:
        return False


def presence(f: dict[str, Any]) -> Presence:
    here = f["num_non_missing"]
    return Presence(0 if here < 1 else 1, 1.0 if here > 0 and f["num_missing"] == 0 else None)


def shape(f: dict[str, Any]) -> list[int] | None:
    """A fixed size on each level with nothing missing."""
    levels = f["levels"] or [f]
    if any(x["num_missing"] or not x["min_num_values"] or x["min_num_values"] != x["max_num_values"] for x in levels):
        return None
    return [x["min_num_values"] for x in levels]


def value_count(f: dict[str, Any]) -> tuple[ValueCount | None, list[ValueCount] | None]:
    def one(x: dict[str, Any]) -> ValueCount:
        low, high = x["min_num_values"] or 0, x["max_num_values"] or 0
        if low <= 0:
            return ValueCount()
        return ValueCount(low, high) if low == high else ValueCount(low)

    if f["levels"]:
        return None, [one(x) for x in f["levels"]]
    got = one(f)
    return (got if got.min is not None else None), None


def bool_domain(f: dict[str, Any]) -> Domain | None:
    if f["type"] == "INT":
        return Domain("bool") if f.get("min") is not None and f["min"] >= 0 and f["max"] == 1 else None
    found = list(f["values"] or {})
    true, false = [v for v in found if v in TRUE_WORDS], [v for v in found if v in FALSE_WORDS]
    if found and len(found) <= 2 and len(true) <= 1 and len(false) <= 1 and len(true) + len(false) == len(found):
        return Domain("bool", true_value=true[0] if true else None, false_value=false[0] if false else None)
    return None


def domain(path: str, f: dict[str, Any], schema: Schema, max_size: int) -> tuple[Domain | None, str | None]:
    """The first that fits: a proposed one, a known enumeration, bool, whole numbers as strings, a new enumeration."""
    if "domain" in f["custom"]:
        return Domain(**f["custom"]["domain"]), None
    if f.get("invalid_utf8_count") or f["type"] == "BYTES":
        return None, None
    b = bool_domain(f)
    if b is not None:
        return b, None
    if f["type"] != "STRING" or not f["values"]:
        return None, None
    if all(is_int(v) for v in f["values"]):
        return Domain("int"), None
    if f["unique"] is not None and 1 <= f["unique"] <= max_size:
        name, n = path, 2
        while name in schema.string_domains:
            name, n = f"{path}{n}", n + 1
        schema.string_domains[name] = sorted(f["values"])
        return None, name
    return None, None


def create(path: str, f: dict[str, Any], schema: Schema, max_size: int = MAX_STRING_DOMAIN, infer_shape: bool = False, enum: str | None = None) -> Feature:
    out = Feature(parse(path)[-1], TYPES.get(f["type"], f["type"]), presence(f))
    out.shape = shape(f) if infer_shape else None
    if out.shape is None:
        out.value_count, out.value_counts = value_count(f)
    if f["type"] != "STRUCT":
        if enum is not None:
            out.domain_ref = enum
        else:
            out.domain, out.domain_ref = domain(path, f, schema, max_size)
    schema.features[path] = out
    return out


def similar(a: set[str], b: set[str], least: float = 0.5, size: int = 10) -> bool:
    """Identical value sets, or both large with a Jaccard similarity above ``least``."""
    return a == b or (len(a) > size and len(b) > size and len(a & b) / len(a | b) > least)


def enum_groups(stats: dict[str, Any], max_size: int) -> dict[str, str]:
    """Enumeration name for paths whose values are similar: that of the shortest path."""
    sets = {p: set(f["values"]) for p, f in stats["features"].items() if f["type"] == "STRING" and f["values"] and f["unique"] is not None and f["unique"] <= max_size and "domain" not in f["custom"] and bool_domain(f) is None and not all(map(is_int, f["values"]))}
    out: dict[str, str] = {}
    for p in sorted(sets, key=lambda p: (len(p), p)):
        for leader in dict.fromkeys(out.values()):
            if similar(sets[leader], sets[p]):
                out[p] = leader
                break
        else:
            out[p] = p
    sizes = {}
    for leader in out.values():
        sizes[leader] = sizes.get(leader, 0) + 1
    return {p: leader for p, leader in out.items() if sizes[leader] > 1}


def without_composites(stats: dict[str, Any]) -> dict[str, Any]:
    """Collected statistics of one slice without paths that only generators describe."""
    return stats | {"features": {p: f for p, f in stats["features"].items() if f["type"] is not None}}


def infer_schema(stats: dict[str, Any], max_string_domain_size: int = MAX_STRING_DOMAIN, infer_feature_shape: bool = True, group_enums: bool = False, transformations: list | None = None) -> Schema:
    """A schema from collected statistics of one slice."""
    schema, stats = Schema(), without_composites(stats)
    groups = enum_groups(stats, max_string_domain_size) if group_enums else {}
    for p, leader in groups.items():
        schema.string_domains[leader] = sorted({*schema.string_domains.get(leader, []), *stats["features"][p]["values"]})
    for path, f in stats["features"].items():
        create(path, f, schema, max_string_domain_size, infer_feature_shape, groups.get(path))
    for t in transformations or []:
        schema = t(schema, stats)
    return schema


def update_schema(schema: Schema, stats: dict[str, Any], max_string_domain_size: int = MAX_STRING_DOMAIN) -> Schema:
    """The schema widened so that the statistics fit: new features, looser bounds, more values; required features that are gone become deprecated."""
    from .validation import validate

    out = schema.copy()
    validate(stats, out, update=True, max_string_domain_size=max_string_domain_size)
    return out


def candidate_float(f: dict[str, Any]) -> bool:
    """Whether all strings are numbers."""
    return f["type"] == "STRING" and bool(f["values"]) and all(map(is_float, f["values"]))


def parent(path: str) -> str | None:
    steps = parse(path)
    return serialize(steps[:-1]) if len(steps) > 1 else None
