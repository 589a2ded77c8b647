"""Gaps and islands: boundaries, session numbers, session rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def boundaries(rows: DataFrame, keys: list[str], time: str, tie: str, gap: int) -> DataFrame:
    """``flag`` 1 where a row is its key's first or more than ``gap`` seconds after the one before."""
    w = W.partitionBy(*keys).orderBy(time, tie)
    before = F.lag(time).over(w)
    return rows.withColumn("flag", F.when(before.isNull() | (F.col(time) - before > gap), 1).otherwise(0))


def numbered(rows: DataFrame, keys: list[str], time: str, tie: str, gap: int) -> DataFrame:
    """``session`` numbers from one; the same partitioning and order serve flag and running sum, so one shuffle does."""
    w = W.partitionBy(*keys).orderBy(time, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    return boundaries(rows, keys, time, tie, gap).withColumn("session", F.sum("flag").over(w))


def sessions(rows: DataFrame, keys: list[str], time: str, tie: str, gap: int) -> DataFrame:
    return numbered(rows, keys, time, tie, gap).groupBy(*keys, "session").agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("stop"))
