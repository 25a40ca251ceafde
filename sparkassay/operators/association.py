"""Statistics between features: covariance and correlation, lift, mutual information, composite features, partition meta-statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import FLOAT, INT, STRING, features, numeric
from .basic import GROUP, WEIGHT
from .slicing import SLICE
from .values import text_of


#: Neighbours on each side that sorted points meet before those that aren't done meet all.
SWEEP = 64
#: Parts that the values of a slice are dealt to when each meets all values of another feature.
SALTS = 16


def _plain(df: DataFrame):
    return [f for f in features(df.schema) if f.steps[0] not in (SLICE, WEIGHT) and not f.repeated and f.nest < 2]


def single(f) -> Column:
    """A row's only numeric value; null if there is none, several, or NaN."""
    v = f.read if f.scalar else F.when(F.size(f.read) == 1, F.element_at(f.read, 1))
    v = numeric(v, f.leaf).cast("double")
    return F.when(~F.isnan(v), v)


def cross_plan(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(pairs that can be crossed, pairs that are skipped as a side is no numeric feature with single values)."""
    fs = {f.path for f in _plain(df) if f.type in (INT, FLOAT)}
    fit = lambda p: p[0] in fs and p[1] in fs and p[0] != p[1]
    return [p for p in pairs if fit(p)], [p for p in pairs if not fit(p)]


def cross(df: DataFrame, pairs: list[tuple[str, str]] | None = None, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """(slice, path_x, path_y, count, covariance, correlation) of numeric pairs, over rows with one value of each; all pairs in one aggregate. Correlation is null if a deviation is 0."""
    fs = {f.path: f for f in _plain(df) if f.type in (INT, FLOAT)}
    chosen = [tuple(p) for p in pairs if p[0] in fs and p[1] in fs] if pairs is not None else list(combinations(sorted(fs), 2))
    rows = df if rate >= 1 else df.sample(rate, seed)
    out = []
    for at in range(0, len(chosen), GROUP):
        part, aggs = chosen[at : at + GROUP], []
        for i, (a, b) in enumerate(part):
            x, y = single(fs[a]), single(fs[b])
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            aggs += [F.count(x).alias(f"n{i}"), F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"x{i}"), F.stddev_pop(y).alias(f"y{i}")]
        wide = rows.groupBy(SLICE).agg(*aggs)
        cells = [F.struct(F.lit(a).alias("path_x"), F.lit(b).alias("path_y"), F.col(f"n{i}").alias("count"), F.col(f"c{i}").alias("covariance"), F.when((F.col(f"x{i}") > 0) & (F.col(f"y{i}") > 0), F.col(f"c{i}") / (F.col(f"x{i}") * F.col(f"y{i}"))).alias("correlation")) for i, (a, b) in enumerate(part)]
        out.append(wide.select(SLICE, F.inline(F.array(*cells))))
    if not out:
        raise ValueError("no pair of numeric features")
    return reduce(DataFrame.unionByName, out).where("count > 0")


def _set_of(f, boundaries: list[float] | None = None) -> Column:
    """A row's distinct values as text; numbers by boundaries as bin names ``[lo,hi)``."""
    values = F.array(f.read) if f.scalar else f.values()
    if boundaries is None:
        return F.array_distinct(F.filter(F.transform(values, lambda x: text_of(x, f)), lambda x: x.isNotNull()))
    ends = [float("-inf"), *sorted(set(boundaries)), float("inf")]

    def bin_of(x: Column) -> Column:
        v = numeric(x, f.leaf).cast("double")
        out = F.lit(None).cast("string")
        for lo, hi in zip(ends, ends[1:]):
            out = F.when(~F.isnan(v) & (v >= lo) & ((v < hi) | (F.lit(hi) == float("inf"))), F.lit(f"[{lo:g},{hi:g})")).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(values, bin_of), lambda x: x.isNotNull()))


def lift(df: DataFrame, y: str, xs: list[str] | None = None, boundaries: list[float] | None = None, min_x_count: float = 0, top_k: int | None = None, bottom_k: int | None = None, weighted: bool = False) -> DataFrame:
    """(slice, path_x, path_y, y, x, lift, x_count, xy_count, y_count): (xy / x) / (y / N) for each y and each x, pairs that never meet included.

    x takes part if its count exceeds ``min_x_count``. ``top_k`` and ``bottom_k`` keep the ends for each y by (lift, x). Weighted
    counts are divided by the unweighted number of rows N.
    """
    fs = {f.path: f for f in _plain(df)}
    xs = xs if xs is not None else [p for p, f in fs.items() if p != y and f.type == STRING]
    w = F.col(WEIGHT) if weighted else F.lit(1.0)
    base = df.select(SLICE, w.alias("w"), _set_of(fs[y], boundaries).alias("ys"), *[_set_of(fs[x]).alias(f"x{i}") for i, x in enumerate(xs)])
    totals = base.groupBy(SLICE).agg(F.count("*").alias("n"))
    y_counts = base.select(SLICE, "w", F.explode("ys").alias("y")).groupBy(SLICE, "y").agg(F.sum("w").alias("y_count"))
    cells = F.flatten(F.array(*[_named(F.col(f"x{i}"), x) for i, x in enumerate(xs)]))
    long = base.select(SLICE, "w", "ys", F.inline(cells))
    x_counts = long.groupBy(SLICE, "path_x", "x").agg(F.sum("w").alias("x_count")).where(F.col("x_count") > min_x_count)
    xy = long.select(SLICE, "path_x", "x", "w", F.explode("ys").alias("y")).groupBy(SLICE, "path_x", "x", "y").agg(F.sum("w").alias("xy_count"))
    # every kept x with every y of its slice, as the operator is asked for pairs that never meet too; a slice is dealt to SALTS parts by x
    salted = y_counts.join(totals, SLICE).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = x_counts.withColumn("salt", F.pmod(F.xxhash64("path_x", "x"), F.lit(SALTS)).cast("int")).join(salted, [SLICE, "salt"]).drop("salt").join(xy, [SLICE, "path_x", "x", "y"], "left")
    met = F.coalesce("xy_count", F.lit(0.0))
    out = pairs.select(SLICE, "path_x", F.lit(y).alias("path_y"), "y", "x", ((met / F.col("x_count")) / (F.col("y_count") / F.col("n"))).alias("lift"), "x_count", met.alias("xy_count"), "y_count")
    if top_k is None and bottom_k is None:
        return out
    key = [SLICE, "path_x", "y"]
    parts = []
    if top_k:
        parts.append(out.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("lift"), F.desc("x")))).where(F.col("r") <= top_k).drop("r"))
    if bottom_k:
        parts.append(out.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("lift", "x"))).where(F.col("r") <= bottom_k).drop("r"))
    return reduce(DataFrame.unionByName, parts).dropDuplicates([*key, "x"])


def _named(values: Column, path: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(path).alias("path_x"), v.alias("x")))


# --- composite features


def _length(f) -> Column:
    return F.coalesce(f.sizes(), F.lit(0))


def _missing(fs, own) -> Column:
    """Rows where ``own`` is missing though not all are."""
    any_there = reduce(Column.__or__, [f.read.isNotNull() for f in fs])
    return F.count_if(own.read.isNull() & any_there)


def _length_diff(fs, left, right) -> list[Column]:
    any_there = reduce(Column.__or__, [f.read.isNotNull() for f in fs])
    d = F.when(any_there, _length(left) - _length(right))
    return [F.coalesce(F.min(d), F.lit(0)).cast("long"), F.coalesce(F.max(d), F.lit(0)).cast("long")]


def sparse(df: DataFrame, value: str, indexes: list[str]) -> DataFrame:
    """(slice, missing_value, missing_index array, min_length_diff array, max_length_diff array) of a sparse feature; differences are index length less value length."""
    fs = {f.path: f for f in features(df.schema)}
    v, ix = fs[value], [fs[i] for i in indexes]
    every = [v, *ix]
    diffs = [_length_diff(every, i, v) for i in ix]
    return df.groupBy(SLICE).agg(_missing(every, v).alias("missing_value"), F.array(*[_missing(every, i) for i in ix]).alias("missing_index"), F.array(*[d[0] for d in diffs]).alias("min_length_diff"), F.array(*[d[1] for d in diffs]).alias("max_length_diff"))


def weighted_feature(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(slice, missing_value, missing_weight, min_weight_length_diff, max_weight_length_diff) of a feature with weights of its own."""
    fs = {f.path: f for f in features(df.schema)}
    v, w = fs[value], fs[weight]
    low, high = _length_diff([v, w], w, v)
    return df.groupBy(SLICE).agg(_missing([v, w], v).alias("missing_value"), _missing([v, w], w).alias("missing_weight"), low.alias("min_weight_length_diff"), high.alias("max_weight_length_diff"))


# --- mutual information


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(slice, entropy) in bits of the joint distribution of columns, by counts."""
    counts = df.groupBy(SLICE, *columns).agg(F.count("*").alias("c"))
    return counts.groupBy(SLICE).agg((F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slice, mi) in bits of two discrete columns: H(x) + H(y) - H(x, y); all aggregates."""
    counts = df.groupBy(SLICE, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))

    def h(keys: list[str]) -> DataFrame:
        own = counts.groupBy(SLICE, *keys).agg(F.sum("c").alias("c"))
        return own.groupBy(SLICE).agg((F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")).alias("h_" + "".join(keys)))

    return h(["x"]).join(h(["y"]), SLICE).join(h(["x", "y"]), SLICE).select(SLICE, F.greatest(F.col("h_x") + F.col("h_y") - F.col("h_xy"), F.lit(0.0)).alias("mi"))


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


@lru_cache(maxsize=4)
def _digammas(n: int) -> np.ndarray:
    return digamma(np.arange(1, n + 1))


def _of_counts(counts: np.ndarray) -> np.ndarray:
    """Digamma of whole numbers, 0 taken as 1, from a table."""
    counts = np.maximum(counts, 1)
    return _digammas(1 << int(counts.max()).bit_length())[counts - 1]


def _distances(some: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Chebyshev distances of some points to all, column by column."""
    out = np.abs(some[:, None, 0] - points[None, :, 0])
    for c in range(1, points.shape[1]):
        np.maximum(out, np.abs(some[:, None, c] - points[None, :, c]), out=out)
    return out


def _insert(nearest: list[np.ndarray], d: np.ndarray) -> None:
    """Put distances into sorted lists of the nearest, one list a column; the largest drops out."""
    for b in nearest[:-1]:
        larger = np.maximum(b, d)
        np.minimum(b, d, out=b)
        d = larger
    np.minimum(nearest[-1], d, out=nearest[-1])


def _nearest(some: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Distance of some of the points to their k-th nearest other one, in blocks."""
    return np.concatenate([np.partition(_distances(some[at : at + 256], points), k, axis=1)[:, k] for at in range(0, len(some), 256)])


def _neighbour_distance(points: np.ndarray, k: int) -> np.ndarray:
    """Chebyshev distance to the k-th nearest other point.

    Of one or two columns, points are sorted by the wider one and meet those next to them, until for most the gap on both sides is no less
    than the distance found; only the others meet all points. So it is exact, and near to linear unless most values of that column are equal.
    """
    n = len(points)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros(n)
    if points.shape[1] > 2:
        return _nearest(points, points, k)
    wider = int(np.argmax(np.ptp(points, axis=0)))
    order = np.argsort(points[:, wider])
    points = points[order]
    main, other = np.ascontiguousarray(points[:, wider]), np.ascontiguousarray(points[:, 1 - wider]) if points.shape[1] > 1 else None
    nearest = [np.full(n, np.inf) for _ in range(k)]
    found, left = nearest[-1], np.ones(n, bool)
    for step in range(1, min(n, SWEEP)):
        gap = main[step:] - main[:-step]
        d = gap if other is None else np.maximum(gap, np.abs(other[step:] - other[:-step]))
        _insert([b[step:] for b in nearest], d)
        _insert([b[:-step] for b in nearest], d)
        if step >= k:
            left = np.zeros(n, bool)
            left[:-step] = gap < found[:-step]
            left[step:] |= gap < found[step:]
            if np.count_nonzero(left) * 16 <= n:
                break
    if left.any():
        found[left] = _nearest(points[left], points, k)
    out = np.empty(n)
    out[order] = found
    return out


def _within(points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many points, itself included, lie nearer than each point's radius; the radius shrinks a little, so that rounding never takes in its end."""
    r = radius * (1 - 1e-9)
    if points.shape[1] == 1:
        v = np.sort(points[:, 0])
        return np.searchsorted(v, points[:, 0] + r, "right") - np.searchsorted(v, points[:, 0] - r, "left")
    return np.concatenate([(_distances(points[at : at + 64], points) <= r[at : at + 64, None]).sum(1) for at in range(0, len(points), 64)])


def encode_categories(values: list[list], length: int) -> np.ndarray:
    """Lists of categories as counts of the ``length`` - 1 most frequent ones (of equal counts the smaller first) and, in the last place, of all others."""
    every, counts = np.unique([v for row in values for v in row], return_counts=True)
    size = min(length, len(every))
    order = np.lexsort((every, -counts))[: length - 1]
    place = {every[k]: i for i, k in enumerate(order)}
    out = np.zeros((len(values), size))
    for r, row in enumerate(values):
        for v in row:
            out[r, place.get(v, size - 1)] += 1
    return out


def encode_numbers(values: list[list[float]], length: int) -> np.ndarray:
    """Lists of numbers as a histogram each, of ``length`` - 1 bins of equal width over all values and one for the largest."""
    flat = np.array([v for row in values for v in row], float)
    ends = np.histogram_bin_edges(flat, bins=length - 1)
    return np.stack([np.bincount(np.digitize(row, ends) - 1, minlength=length)[:length] for row in values]).astype(float)


def column_partition(name: str, partitions: int) -> int:
    """The part of the columns that a feature belongs to, by its name."""
    return zlib.crc32(name.encode()) % partitions


def knn_information(x: np.ndarray, y: np.ndarray, x_discrete: bool, y_discrete: bool, k: int = 3, seed: int = 0) -> float:
    """Mutual information in bits of two samples: by counts if both are discrete, after Ross if one is, after Kraskov, Stoegbauer and Grassberger if none is. Continuous ones may have several columns."""
    n = len(x)
    if n < 2 or (x == x[0]).all() or (y == y[0]).all():
        return 0.0
    if x_discrete and y_discrete:
        _, a = np.unique(x, return_inverse=True)
        _, b = np.unique(y, return_inverse=True)
        h = lambda i: -sum(p * np.log2(p) for p in np.bincount(i)[np.bincount(i) > 0] / n)
        return max(0.0, h(a) + h(b) - h(np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]))
    rng = np.random.default_rng(seed)
    jitter = lambda v: (v := np.asarray(v, float).reshape(n, -1)) + rng.normal(0, 1e-10 * (np.std(v) + 1e-12), v.shape)
    if x_discrete or y_discrete:
        if y_discrete:
            x, y = y, x
        y, label = jitter(y), np.unique(x, return_inverse=True)[1]
        radius, own = np.zeros(n), np.bincount(label)[label]
        for c in np.flatnonzero(np.bincount(label) > 1):
            at = np.flatnonzero(label == c)
            radius[at] = _neighbour_distance(y[at], min(k, len(at) - 1))
        ok = own > 1
        if not ok.any():
            return 0.0
        m = _within(y[ok], radius[ok])
        kk = np.minimum(k, own[ok] - 1)
        return max(0.0, float(_of_counts(np.array([ok.sum()]))[0] + _of_counts(kk).mean() - _of_counts(own[ok]).mean() - _of_counts(m).mean()) / np.log(2))
    x, y = jitter(x), jitter(y)
    radius = _neighbour_distance(np.concatenate([x, y], 1), k)
    nx, ny = _within(x, radius), _within(y, radius)
    return max(0.0, float(_of_counts(np.array([k]))[0] + _of_counts(np.array([n]))[0] - _of_counts(nx).mean() - _of_counts(ny).mean()) / np.log(2))


def adjusted_information(df: DataFrame, label: str, columns: list[str], partitions: int = 1, cap: int = 5000, seed: int = 0, normalize: bool = False, k: int = 3, encoding: int = 512, column_partitions: int = 1) -> DataFrame:
    """(slice, path, adjusted_mutual_information): max(MI - MI after a shuffle, 0), the mean over random partitions of at most ``cap`` rows each.

    The cap is the estimator's sample size. Rows are chosen by a hash, and a task holds one partition's sample and a batch at a time; columns are
    dealt to ``column_partitions`` groups by name, each with the label. Lists are encoded as vectors of at most ``encoding`` numbers. A
    column without values, or a category that never repeats, tells nothing.
    """
    fs = {f.path: f for f in _plain(df)}
    chosen = [label, *columns]
    text = {c: fs[c].type == STRING or fs[c].boolean for c in chosen}
    lists = {c: not fs[c].scalar for c in chosen}
    discrete = {c: text[c] and not lists[c] for c in chosen}

    def cell(c: str) -> Column:
        f = fs[c]
        if not lists[c]:
            return text_of(f.read, f) if text[c] else single(f)
        one = (lambda x: text_of(x, f)) if text[c] else (lambda x: numeric(x, f.leaf).cast("double"))
        kept = F.filter(F.transform(f.values(), one), lambda x: x.isNotNull() if text[c] else x.isNotNull() & ~F.isnan(x))
        return F.when(F.size(kept) > 0, kept)

    cells = [cell(c).alias(f"v{i}") for i, c in enumerate(chosen)]
    h = F.xxhash64(F.lit(seed), *[F.col(f"v{i}") for i in range(len(chosen))], F.monotonically_increasing_id())
    rows = df.select(SLICE, *cells).withColumn("h", h).withColumn("part", F.pmod("h", F.lit(partitions)))
    order = Window.partitionBy(SLICE, "part").orderBy("h")
    sample = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).drop("r")

    def values(v: np.ndarray, c: str) -> np.ndarray:
        if lists[c]:
            return (encode_categories if text[c] else encode_numbers)([list(x) for x in v], encoding)
        return pd.factorize(v, sort=True)[0] if text[c] else v

    def estimate(held: dict[int, np.ndarray]) -> list[tuple[str, float]]:
        """Of one part, whose values are given by place in ``chosen``."""
        rng = np.random.default_rng(seed)
        there = {i: pd.notna(v) for i, v in held.items()}

        def ami(i: int, j: int) -> float:
            both = there[i] & there[j]
            x, y = held[i][both], held[j][both]
            if not len(x) or any(discrete[chosen[c]] and len(pd.unique(v)) == len(v) for c, v in ((i, x), (j, y))):
                return 0.0
            x, y = values(x, chosen[i]), values(y, chosen[j])
            dx, dy = discrete[chosen[i]], discrete[chosen[j]]
            real = knn_information(x, y, dx, dy, k, seed)
            return max(0.0, real - knn_information(rng.permutation(x), y, dx, dy, k, seed))

        top = ami(0, 0) if normalize else 1.0
        return [(chosen[i], ami(i, 0) / top if top > 0 else 0.0) for i in held if i]

    def estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come part by part, as the window has sorted them; a part that a batch cuts is carried on."""
        rest: pd.DataFrame | None = None

        def of(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
            cells = {int(c[1:]): pdf[c].to_numpy() for c in pdf.columns if c not in (SLICE, "part", "h")}
            found = [(pdf[SLICE].iat[a], *e) for a, b in zip(starts, ends) for e in estimate({i: v[a:b] for i, v in cells.items()})]
            return pd.DataFrame(found, columns=[SLICE, "path", "ami"])

        for pdf in batches:
            if not len(pdf):
                continue
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            part, key = pdf["part"].to_numpy(), pdf[SLICE].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1])
            if len(starts) > 1:
                yield of(pdf, starts[:-1], starts[1:])
            rest = pdf.iloc[starts[-1] :]
        if rest is not None:
            yield of(rest, np.array([0]), np.array([len(rest)]))

    groups: dict[int, list[str]] = {}
    for i, c in enumerate(chosen[1:], 1):
        groups.setdefault(column_partition(c, column_partitions), []).append(f"v{i}")
    parts = [sample.select(SLICE, "part", "h", "v0", *own).sortWithinPartitions(SLICE, "part", "h").mapInPandas(estimates, f"{SLICE} string, path string, ami double") for _, own in sorted(groups.items())]
    return reduce(DataFrame.unionByName, parts).groupBy(SLICE, "path").agg(F.avg("ami").alias("adjusted_mutual_information"))


def partitioned(stats: DataFrame, value: str, least: int = 1) -> DataFrame:
    """(slice, path, min, max, mean, median, std_dev, num_partitions) of a statistic computed in partitions; paths in fewer than ``least`` are left out."""
    return stats.groupBy(SLICE, "path").agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std_dev"), F.count(value).alias("num_partitions")).where(F.col("num_partitions") >= least)
