"""Platt scaling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_platt(rows: DataFrame, score: str, label: str, rounds: int = 30) -> DataFrame:
    """``(a, b)`` of ``1 / (1 + exp(a * s + b))`` by Newton steps on smoothed targets.

    Each step is one aggregation of seven sums; only those reach the driver. A
    fit that does not stay finite gives (-1, 0).
    """
    spark = rows.sparkSession
    n = rows.agg(F.sum(label).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = n["pos"] or 0, (n["n"] or 0) - (n["pos"] or 0)
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    t = F.when(F.col(label) == 1, hi).otherwise(lo)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(a * F.col(score) + b))
        w = p * (1 - p)
        s = F.col(score)
        r = rows.agg(F.sum(s * (t - p)), F.sum(t - p), F.sum(w * s * s) + 1e-12, F.sum(w * s), F.sum(w) + 1e-12).first()
        if r[1] is None:
            break
        det = r[2] * r[4] - r[3] ** 2
        da, db = -(r[4] * r[0] - r[3] * r[1]) / det, -(r[2] * r[1] - r[3] * r[0]) / det
        a, b = a + da, b + db
        if not math.isfinite(a + b):
            a, b = -1.0, 0.0
            break
        if abs(da) + abs(db) < 1e-10:
            break
    return spark.createDataFrame([(a, b)], "a double, b double")
