"""Connected components of an edge table: local union-find, then distributed contraction.

Edges point from the larger to the smaller end. Each round deals them by their larger end, contracts every partition by
union-find, and then shortens paths by looking up each root's own root; hubs are smaller ends and so never a key of the
first step, and Spark may split them in the second. It ends when every node has one edge and no root has any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node connected with each) without the roots, by vectorised hooking and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            break
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge and isn't its component's smallest; loops and repeated edges do no harm."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            p, q = (c.to_numpy() for c in batch.columns)
            x, y = contract(np.concatenate([x, p]), np.concatenate([y, q]))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["node", "root"])

    now = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root").mapInArrow(local, "node long, root long")
    while True:
        forest = shared.materialize(now.repartition("node").mapInArrow(local, "node long, root long"), "forest")
        up = forest.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        state = forest.join(up, "root", "left").agg(F.count("*").alias("rows"), F.countDistinct("node").alias("nodes"), F.count("__up").alias("moved")).first()
        if state.rows == state.nodes and not state.moved:
            return forest
        # a node with two roots ties them together in the next round; so do the old and the new root of a path
        now = forest.join(up, "root", "left").select("node", F.coalesce("__up", "root").alias("root")).unionByName(forest.where("false"))
