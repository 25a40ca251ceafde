"""Nearest neighbours and adjusted information: the same as by brute force, with less."""

import tracemalloc

import numpy as np
import pytest

from sparkassay.operators import association, basic


def brute(points, k):
    return np.sort(np.abs(points[:, None] - points[None]).max(2), axis=1)[:, k]


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_neighbours_by_brute_force(columns):
    rng = np.random.default_rng(3)
    for n in (2, 5, 300):
        for points in (rng.normal(size=(n, columns)), rng.integers(0, 2, (n, columns)).astype(float), rng.normal(size=(n, columns)) * np.array([1, 1e6, 1])[:columns]):
            k = min(3, n - 1)
            assert (association._neighbour_distance(points, k) == brute(points, k)).all()


def test_neighbours_do_not_meet_all_points():
    points = np.random.default_rng(3).normal(size=(5000, 2)) * np.array([1, 1e5])
    tracemalloc.start()
    association._neighbour_distance(points, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * points.nbytes / 2


def test_parts_that_batches_cut(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(a + b), str(c)) for a, b, c in zip(rng.normal(size=600), rng.normal(size=600), rng.integers(0, 3, 600))]
    df = basic.prepared(spark.createDataFrame(rows, "x double, y double, c string"))
    ask = lambda: {r.path: r.adjusted_mutual_information for r in association.adjusted_information(df, "y", ["x", "c"], partitions=9).collect()}
    whole = ask()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = ask()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == pytest.approx(whole) and whole["x"] > 0.2
