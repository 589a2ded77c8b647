"""Rank fusion, budgets, chains, diversification, greedy cover."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.scores import decay

#: Smoothing constant of reciprocal rank fusion.
RRF = 60


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def fuse(tiers: DataFrame, weights: dict[str, float], k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of (tier, id, score) rows: (id, score, sources); tiers not listed weigh one."""
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("tier") == name, F.lit(float(w))).otherwise(weight)
    ranked = tiers.withColumn("rn", F.row_number().over(W.partitionBy("tier").orderBy(F.desc("score"), "id")))
    return ranked.groupBy("id").agg(F.sum(weight / (k + F.col("rn"))).alias("score"), F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("sources"))


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget) -> DataFrame:
    """Rows in order while the running cost of their group stays within ``budget``."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_running", F.sum(cost).over(w)).filter(F.col("_running") <= budget).drop("_running")


def final(records: DataFrame, base: str, as_of: int, half_life: float = 90.0) -> DataFrame:
    """``score`` = base x (decay + recall boost) x importance."""
    age = F.floor((as_of - F.col("confirmed")) / 86400)
    boost = F.least(F.col("recall_count") * 0.05, F.lit(0.3))
    weight = F.when(F.col("importance") == "critical", 1.5).when(F.col("importance") == "high", 1.2).when(F.col("importance") == "medium", 1.0).otherwise(0.8)
    return records.withColumn("score", F.col(base) * (decay(age, half_life) + boost) * weight)


def blended(norm: Column, logit: Column, share: float = 0.4) -> Column:
    """A reranker's sigmoid blended into a score, which it never lowers."""
    return F.greatest(norm, share / (1 + F.exp(-logit)) + (1 - share) * norm)


def chain_ends(rows: DataFrame, key: str, nxt: str, depth: int) -> DataFrame:
    """``(id, depth, root)``: the end of each row's pointer chain, at most ``depth`` steps, by pointer doubling.

    A cycle ends where the depth runs out.
    """
    step = rows.select(F.col(key).alias("id"), F.col(nxt).alias("to"))
    at = step.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    hop = step.filter("to is not null").select(F.col("id").alias("h"), F.col("to").alias("t"), F.lit(1).alias("d"))
    size = 1
    while size <= depth:
        moved = at.join(hop, at["root"] == hop["h"], "left")
        if depth & size:
            at = moved.select("id", F.coalesce("t", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"))
        twice = hop.alias("a").join(hop.alias("b"), F.col("a.t") == F.col("b.h"), "left")
        hop = twice.select(F.col("a.h").alias("h"), F.coalesce("b.t", "a.t").alias("t"), (F.col("a.d") + F.coalesce("b.d", F.lit(0))).alias("d"))
        size *= 2
    return at.select("id", F.col("depth").cast("int").alias("depth"), "root")


def mmr(rows: DataFrame, keys: list[str], key: str, vector: str, score: str, n: int, weight: float = 0.9, pool: int = 100) -> DataFrame:
    """Maximal marginal relevance in each group: ``(keys, rank, id)`` of ``n`` picks out of the ``pool`` best.

    Only the pool, a parameter of the operator, is gathered.
    """
    best = top(rows.select(*keys, key, vector, score), keys, [F.desc(score), F.col(key)], pool)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True], ignore_index=True)
        m = np.array(pdf[vector].tolist(), dtype=float)
        m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
        sim, left, out = m @ m.T, list(range(len(pdf))), []
        while left and len(out) < n:
            worth = [weight * pdf[score][i] - (1 - weight) * (max(sim[i, j] for j in out) if out else 0.0) for i in left]
            out.append(left.pop(int(np.argmax(worth))))
        return pd.DataFrame({**{k: [pdf[k][0]] * len(out) for k in keys}, "rank": range(1, len(out) + 1), "id": [int(pdf[key][i]) for i in out]})

    kinds = dict(rows.dtypes)
    return best.groupBy(*keys).applyInPandas(pick, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", rank int, id long")


def greedy_cover(links: DataFrame, record: str, item: str, wanted, n: int) -> DataFrame:
    """Greedy set cover of the ``wanted`` items by at most ``n`` records: ``(step, record, gain)``.

    Each step is one aggregation and brings one row to the driver; ties go to
    the smallest record. ``wanted`` is a stated list.
    """
    spark, left, out = links.sparkSession, sorted(set(wanted)), []
    for step in range(1, n + 1):
        if not left:
            break
        hits = links.filter(F.col(item).isin(left)).groupBy(record).agg(F.count_distinct(item).alias("gain"), F.collect_set(item).alias("items"))
        best = hits.orderBy(F.desc("gain"), record).first()
        if best is None:
            break
        out.append((step, best[record], best["gain"]))
        left = sorted(set(left) - set(best["items"]))
    return spark.createDataFrame(out, "step int, record long, gain long")


def greedy_clusters(rows: DataFrame, keys: list[str], key: str, items: str, least: float) -> DataFrame:
    """Each row, in order of ``key``, joins the first cluster whose union of items is similar enough: (keys, id, cluster).

    The result depends on the order, so a group is folded as one; its rows carry
    small sets. A cluster is named by its first member. Unions are rows of bits,
    compared at once with a set; a set that was seen before is compared only
    with the clusters that changed since.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        at, values = pd.factorize(np.concatenate(list(pdf[items])))
        ends = np.cumsum([0, *map(len, pdf[items])])
        width = max(1, -(-len(values) // 64))
        unions, sizes = np.zeros((width, 1024), np.uint64), np.zeros(1024, np.int64)
        names: list[int] = []
        changes: list[int] = []  # clusters in the order of their changes
        seen: dict[bytes, tuple[int, int]] = {}  # of a set: its last cluster, changes until then
        out = []

        def alike(lo: int, hi: int, own: np.ndarray, n: int) -> int | None:
            """The first cluster of a range that is similar enough."""
            while lo < hi:
                end = min(hi, lo + 16384)
                shared = np.zeros(end - lo, np.int64)
                for word, bits in zip(unions, own):
                    if bits:
                        shared += np.bitwise_count(word[lo:end] & bits)
                hit = shared >= least * (sizes[lo:end] + n - shared)
                if hit[first := int(hit.argmax())]:
                    return lo + first
                lo = end
            return None

        for row, name in enumerate(pdf[key]):
            own = np.zeros(width, np.uint64)
            mine = np.unique(at[ends[row] : ends[row + 1]])
            np.bitwise_or.at(own, mine // 64, np.uint64(1) << (mine % 64).astype(np.uint64))
            n, mark = len(mine), own.tobytes()
            last, since = seen.get(mark, (0, 0))
            if mark in seen:
                changed = sorted({c for c in changes[since:] if c < last}) if len(changes) - since < 4096 else range(last)
                found = next((c for c in changed if alike(c, c + 1, own, n) is not None), None)
                found = alike(last, len(names), own, n) if found is None else found
            else:
                found = alike(0, len(names), own, n)
            if found is None:
                found = len(names)
                names.append(int(name))
                if found == len(sizes):
                    unions, sizes = np.concatenate([unions, np.zeros_like(unions)], axis=1), np.concatenate([sizes, np.zeros_like(sizes)])
            union = unions[:, found] | own
            size = int(np.bitwise_count(union).sum())
            if size != sizes[found]:
                unions[:, found], sizes[found] = union, size
                changes.append(found)
            seen[mark] = found, len(changes)
            out.append(names[found])
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "id": pdf[key], "cluster": out})

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(fold, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", id long, cluster long")
