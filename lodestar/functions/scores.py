"""Scoring functions and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def recall_at(first: DataFrame, rank: str, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall at each cut and mean reciprocal rank from the first match's rank a query (null: no match)."""
    hit = lambda k: F.round(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}")
    return first.agg(*map(hit, cuts), F.round(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), 6).alias("mrr"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    b = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return b.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def masses(rows: DataFrame, group: str, score: str, certain: float = 0.9) -> DataFrame:
    """Each row's share of its group's non-negative scores times ``certain``; the rest is on the whole frame."""
    s = F.greatest(F.col(score), F.lit(0.0))
    total = F.sum(s).over(W.partitionBy(group))
    return rows.withColumn("mass", F.when(total > 0, s / total * certain).otherwise(0.0))


def decay(age_days: Column, half_life: float = 90.0) -> Column:
    """``max(0.01, 2^(-days / half_life))`` of whole days; one half where the age is missing."""
    return F.when(age_days.isNull(), 0.5).otherwise(F.greatest(F.lit(0.01), F.exp(-age_days * F.lit(0.6931471805599453 / half_life))))


def proximity(days: Column, reach: float = 180.0) -> Column:
    """One at distance zero, down to zero in a straight line at ``reach`` days."""
    return F.greatest(F.lit(0.0), 1 - days / reach)
