"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and joins on narrow edge rows, written to the
shared folder. Rounds grow with the logarithm of the longest path. A hub, which
in the end has its whole component around it, is reduced and looked up in salted
cells, so no component is gathered in one task or on the driver. Only a list of
integer edges that has been counted to be short is left to one task: every round
is two jobs of a dozen exchanges, whose plans and threads the driver holds
however few the edges are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.runtime import dropped, released, salted_lookup, written

#: Edges up to which one task finds the components (4 MB of ids); longer lists take the rounds.
ONE_TASK = 1 << 18


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = salted_lookup(_both(edges), "u", "v", {"m": (F.min("v"), F.min)})
    return near.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = salted_lookup(down, "u", "v", {"m": (F.min("v"), F.min)})
    return near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of a short list of integer edges ``(u, v)`` by union-find."""
    kinds = dict(edges.dtypes)
    kind = "bigint" if "bigint" in kinds.values() else kinds["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns] for b in batches]
        if not ends:
            return
        nodes, at = np.unique(np.concatenate([side for k in (0, 1) for side in (e[k] for e in ends)]), return_inverse=True)
        above = list(range(len(nodes)))  # never larger than itself, so the root is the smallest

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        half = len(at) // 2
        for x, y in zip(at[:half].tolist(), at[half:].tolist()):
            x, y = root(x), root(y)
            above[max(x, y)] = min(x, y)
        found = nodes[[root(x) for x in range(len(nodes))]]
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(pa.int64() if kind == "bigint" else pa.int32()) for c in (nodes, found)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(released(run), f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    ``component`` is the smallest node reachable. Self-loops give a component of
    one node; nulls are no nodes; repeated edges count once; no edges, no rows.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = written(clean, "cc-input")
    if {t for _, t in nodes.dtypes} <= {"int", "bigint"} and nodes.count() <= ONE_TASK:
        return _in_one_task(nodes)
    now = written(nodes.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        after = written(_small_star(_large_star(now)), "cc")
        new = _mark(after)
        dropped(now)
        now, done = after, new == mark
        mark = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    return ends.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
