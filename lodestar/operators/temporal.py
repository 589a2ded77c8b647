"""Temporal facts, interval algebra and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RELATIONS = ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "finished_by", "contains", "started_by", "overlapped_by", "met_by", "after")


def slowly_changing(facts: DataFrame, keys: list[str], value: str = "o", time: str = "valid_from", tie: str = "fact_id") -> DataFrame:
    """Validity ranges: repeats of the value that is open are no change; each change closes the one before."""
    w = W.partitionBy(*keys).orderBy(time, tie)
    changed = facts.withColumn("_before", F.lag(value).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    return changed.drop("_before").withColumn("valid_to", F.lead(time).over(w))


def as_of(ranges: DataFrame, t: int | None) -> DataFrame:
    """Rows valid at ``t`` (half-open ranges); without a time, the open ones."""
    if t is None:
        return ranges.filter("valid_to is null")
    return ranges.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str = "o") -> DataFrame:
    """Keys that were added, removed or changed between two states with one value a key."""
    j = before.select(*keys, F.col(value).alias("old")).join(after.select(*keys, F.col(value).alias("new")), keys, "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.withColumn("change", kind).filter("change is not null")


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The one of Allen's relations between half-open ranges [a0, a1) and [b0, b1) of positive length."""
    tests = (
        ("before", a1 < b0), ("after", b1 < a0), ("meets", a1 == b0), ("met_by", b1 == a0), ("equals", (a0 == b0) & (a1 == b1)), ("starts", (a0 == b0) & (a1 < b1)), ("started_by", (a0 == b0) & (a1 > b1)),
        ("finishes", (a1 == b1) & (a0 > b0)), ("finished_by", (a1 == b1) & (a0 < b0)), ("during", (a0 > b0) & (a1 < b1)), ("contains", (a0 < b0) & (a1 > b1)), ("overlaps", (a0 < b0) & (a1 < b1)),
    )
    out = F.lit("overlapped_by")
    for name, test in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def composition(spark) -> DataFrame:
    """Allen's composition table (r1, r2, r3s), found by trying all intervals with ends in 0..5.

    Three intervals have six ends, so every order of ends is tried.
    """
    ends = spark.range(6)
    iv = ends.select(F.col("id").alias("lo"), F.explode(F.sequence(F.col("id") + 1, F.lit(6))).alias("hi")).filter("hi < 6")
    a, b, c = (iv.select(F.col("lo").alias(f"{x}0"), F.col("hi").alias(f"{x}1")) for x in "abc")
    t = a.crossJoin(b).crossJoin(c)  # 15 intervals
    r = lambda x, y: allen(F.col(f"{x}0"), F.col(f"{x}1"), F.col(f"{y}0"), F.col(f"{y}1"))
    return t.groupBy(r("a", "b").alias("r1"), r("b", "c").alias("r2")).agg(F.array_join(F.array_sort(F.collect_set(r("a", "c"))), ",").alias("r3s"))


def whole_months(a: Column, b: Column) -> Column:
    """Whole months between two dates, whichever is first; the anniversary is clamped to the month's end."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    n = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    return n - F.when(F.add_months(lo, n) > hi, 1).otherwise(0)


def retention(records: DataFrame, now: int, archive_days: int, purge_days: int) -> DataFrame:
    """``zone``: active, archived (old, never recalled, not sure), purged (archived and older still)."""
    age = (now - F.col("confirmed")) / 86400
    archived = (F.col("status") == "archived") | ((age > archive_days) & (F.col("recall_count") == 0) & (F.col("confidence") < 0.8))
    return records.withColumn("zone", F.when(archived & (age > purge_days), "purged").when(archived, "archived").otherwise("active"))
