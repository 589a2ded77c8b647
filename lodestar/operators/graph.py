"""Graph analytics on edge tables (src, dst, weight), read as undirected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators.relational import undirected
from lodestar.runtime import written


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut: int = 5) -> DataFrame:
    """``(node, rank)`` of the weighted undirected graph, ranks summing to one.

    Lineage is cut every ``cut`` rounds by a table in the shared folder; each
    round is one join and one partial aggregation over the edges.
    """
    both = undirected(edges.select("src", "dst", "weight"))
    share = both.join(both.groupBy("a").agg(F.sum("weight").alias("total")), "a").select("a", "b", (F.col("weight") / F.col("total")).alias("p"))
    share = written(share.repartition("a"), "pagerank-edges")
    nodes = share.select(F.col("a").alias("node")).distinct()
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(1, rounds + 1):
        sent = share.join(rank.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        rank = sent.select("node", ((1 - damping) / max(n, 1) + damping * F.col("got")).alias("rank"))
        if k % cut == 0 or k == rounds:
            rank = written(rank, "pagerank")
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.withColumn("rank", F.col("rank") / (total or 1.0))


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(seed, node, hops)`` of the nodes within ``depth`` hops of each row of ``seeds`` (seed)."""
    both = undirected(edges.select("src", "dst"))
    at = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    seen = frontier = at
    for k in range(1, depth + 1):
        step = frontier.join(both.withColumnRenamed("a", "node"), "node").select("seed", F.col("b").alias("node")).distinct()
        frontier = written(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(k)), "reach")
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(seed, node, hops, path)``: a shortest path to each node within ``depth`` hops, the first in text order."""
    both = undirected(edges.select("src", "dst")).withColumnRenamed("a", "node")
    seen = frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"), F.col("seed").cast("string").alias("path"))
    for k in range(1, depth + 1):
        step = frontier.join(both, "node").select("seed", F.col("b").alias("node"), F.concat_ws(">", "path", "b").alias("path"))
        step = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = written(step.select("seed", "node", F.lit(k).alias("hops"), "path"), "paths")
        seen = seen.unionByName(frontier)
    return seen


def activation(edges: DataFrame, seeds: DataFrame, decays: tuple[float, ...] = (0.7, 0.4, 0.2), threshold: float = 0.05, bonus: tuple[float, ...] = (1.0, 1.2, 1.5, 1.8, 2.0)) -> DataFrame:
    """``(node, activation)`` spread from ``seeds`` (seed), level by level.

    A node's level takes the strongest arrival times the bonus of its number of
    arrivals, at most one; below ``threshold`` it neither counts nor spreads.
    """
    both = undirected(edges.select("src", "dst")).withColumnRenamed("a", "node")
    table = F.array(*map(F.lit, bonus))
    seen = frontier = seeds.select(F.col("seed").alias("node"), F.lit(1.0).alias("activation"))
    for d in decays:
        hits = frontier.join(both, "node").groupBy(F.col("b").alias("node")).agg(F.max("activation").alias("m"), F.count("*").alias("n"))
        level = F.least(F.lit(1.0), F.col("m") * d * F.element_at(table, F.least(F.col("n"), F.lit(len(bonus))).cast("int")))
        frontier = written(hits.select("node", level.alias("activation")).filter(F.col("activation") >= threshold).join(seen.select("node"), "node", "left_anti"), "activation")
        seen = seen.unionByName(frontier)
    return seen.join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")


def reinforced(edges: DataFrame, seen: DataFrame, step: float = 0.1, cap: float = 10.0) -> DataFrame:
    """Edges with the weight raised by ``step`` for each repeat in ``seen`` (src, dst); new pairs start at one."""
    n = seen.filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    j = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(n, ["src", "dst"], "full")
    w = F.when(F.col("weight").isNull(), 1.0 + step * (F.col("n") - 1)).otherwise(F.col("weight") + step * F.coalesce("n", F.lit(0)))
    return j.select("src", "dst", F.least(F.lit(cap), w).alias("weight"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    return reduce(lambda e, c: e.join(nodes.select(F.col("node").alias(c)), c, "left_semi"), ("src", "dst"), edges)


def context(edges: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Records by the strength of their links to seed nodes and their neighbours: (record, score)."""
    both = undirected(edges.select("src", "dst", "weight"))
    near = both.join(seeds.select(F.col("seed").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.max("weight").alias("w"))
    level = near.unionByName(seeds.select(F.col("seed").alias("node"), F.lit(10).cast("long").alias("w"))).groupBy("node").agg(F.max("w").alias("w"))
    return links.join(level, "node").groupBy("record").agg(F.sum(F.col("w") * F.col("strength")).alias("score"))


def hops(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """One- and two-hop expansion over relations (from_id, to_id): (id, score, hop), first reach wins."""
    both = undirected(relations.select("from_id", "to_id"), "from_id", "to_id")
    one = both.join(seeds.select(F.col("seed").alias("a")), "a", "left_semi").select(F.col("b").alias("id"), F.lit(0.4).alias("score"), F.lit(1).alias("hop"))
    two = one.select(F.col("id").alias("a"), F.col("score").alias("s")).join(both, "a").select(F.col("b").alias("id"), (F.col("s") * 0.2).alias("score"), F.lit(2).alias("hop"))
    every = one.unionByName(two).join(seeds.select(F.col("seed").alias("id")), "id", "left_anti")
    return every.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("hop", F.desc("score")))).filter("rn = 1").drop("rn")
