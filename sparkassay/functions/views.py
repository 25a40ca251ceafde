"""Looking up collected statistics: by slice, path, name of a custom statistic, pair of crossed features, source of a derived feature. What is there twice raises."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from .paths import parse, serialize

ALL = "All Examples"


def _path(path: str | Iterable[str]) -> str:
    """A path given as text or as steps."""
    return path if isinstance(path, str) else serialize(tuple(path))


class FeatureView:
    """One feature's statistics."""

    def __init__(self, path: str, statistics: dict[str, Any]):
        self.path, self.statistics = path, statistics

    def custom(self, name: str) -> Any:
        """A custom statistic, or None; ValueError if the name stands twice."""
        held = self.statistics["custom"]
        if isinstance(held, dict):
            return held.get(name)
        found = [v for k, v in held if k == name]
        if len(found) > 1:
            raise ValueError(f"custom statistic {name} of {self.path} is there twice")
        return found[0] if found else None

    def _group(self, types: set[str], names: tuple[str, ...]) -> dict[str, Any] | None:
        if self.statistics["type"] not in types:
            return None
        return {n: self.statistics[n] for n in names if self.statistics.get(n) is not None}

    def common(self) -> dict[str, Any]:
        names = ("num_non_missing", "num_missing", "min_num_values", "max_num_values", "avg_num_values", "tot_num_values")
        return {n: self.statistics[n] for n in names}

    def numeric(self) -> dict[str, Any] | None:
        return self._group({"INT", "FLOAT"}, ("mean", "std_dev", "num_zeros", "num_nan", "min", "max", "median", "weighted_mean", "weighted_std_dev", "histograms"))

    def string(self) -> dict[str, Any] | None:
        return self._group({"STRING"}, ("unique", "avg_length", "invalid_utf8_count", "values"))

    def bytes(self) -> dict[str, Any] | None:
        return self._group({"BYTES"}, ("unique", "avg_num_bytes", "min_num_bytes", "max_num_bytes"))

    def struct(self) -> dict[str, Any] | None:
        return self.common() if self.statistics["type"] == "STRUCT" else None


class SliceView:
    """One slice's statistics."""

    def __init__(self, statistics: dict[str, Any]):
        self.statistics = statistics
        self.num_examples = statistics["num_examples"]

    def feature(self, path: str | Iterable[str]) -> FeatureView | None:
        f = self.statistics["features"].get(_path(path))
        return None if f is None else FeatureView(_path(path), f)

    def features(self) -> list[str]:
        return list(self.statistics["features"])

    def crosses(self) -> list[tuple[str, str]]:
        return list(self.statistics.get("cross", {}))

    def cross(self, x: str | Iterable[str], y: str | Iterable[str]) -> dict[str, Any] | None:
        """The statistics of a pair, in the order in which it was computed."""
        return self.statistics.get("cross", {}).get((_path(x), _path(y)))

    def derived(self, deriver: str, sources: Iterable[str]) -> FeatureView | None:
        """The feature that ``deriver`` made of ``sources``; ValueError if several are."""
        wanted = {"deriver": deriver, "sources": [_path(s) for s in sources]}
        found = [p for p, f in self.statistics["features"].items() if FeatureView(p, f).custom("derived_source") == wanted]
        if len(found) > 1:
            raise ValueError(f"ambiguous: {len(found)} features are derived by {deriver} of these sources")
        return self.feature(found[0]) if found else None

    def below(self, path: str | Iterable[str]) -> list[str]:
        """Features within a struct."""
        top = parse(_path(path))
        return [p for p in self.statistics["features"] if len(parse(p)) > len(top) and parse(p)[: len(top)] == top]


class StatisticsView:
    """All slices of collected statistics, or of several parts of them."""

    def __init__(self, *parts: dict[str, dict[str, Any]]):
        self.slices: dict[str, dict[str, Any]] = {}
        for part in parts:
            for name, s in part.items():
                if name in self.slices:
                    raise ValueError(f"slice {name} is there twice")
                self.slices[name] = s

    def names(self) -> list[str]:
        return list(self.slices)

    def get(self, name: str) -> SliceView | None:
        return SliceView(self.slices[name]) if name in self.slices else None

    def default(self) -> SliceView | None:
        """The slice of all examples, or the only one."""
        if len(self.slices) == 1:
            return SliceView(next(iter(self.slices.values())))
        return self.get(ALL)

    def default_or_raise(self) -> SliceView:
        got = self.default()
        if got is None:
            raise ValueError("there is no slice of all examples")
        return got
