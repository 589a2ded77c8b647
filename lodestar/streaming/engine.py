"""Structured Streaming: queues, sessions and event-folded state.

Every stream is drained with ``availableNow`` into a table of the shared folder.
A batch is written under its batch id and replaces what an earlier attempt left,
so a restart neither loses nor repeats rows; offsets and state are in the
stream's checkpoint, in the same folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestar.runtime import shared_path


def source(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream; ``files`` limits a micro-batch."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if not any(c in path for c in "*?[{"):
        path = f"{folder}/[{name[0]}]{name[1:]}"  # a pattern may stand for a file, a plain path for a folder only
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def drained(stream: DataFrame, schema: str, mode: str = "append", step: Callable[[DataFrame], DataFrame] | None = None, latest: bool = False) -> DataFrame:
    """The stream's rows once all that is there has been processed.

    With ``latest`` (complete and update modes) only the last batch's rows count.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        (step(batch) if step else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    rows = spark.read.option("basePath", out).schema(f"{schema}, batch long").parquet(out)
    if latest:
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch")  # one row
    return rows.drop("batch")


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "40 days") -> DataFrame:
    """The first event of each key within the watermark; state is dropped behind it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, key: str, time: str = "ts", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Session windows of each key with their number of events."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def window_counts(events: DataFrame, key: str, time: str = "ts", size: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark(time, late).groupBy(key, F.window(time, size)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def competency(events: DataFrame) -> DataFrame:
    """Level and confidence of each user, folded over events in time order, each step clamped to 0..1."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, sure, n = state.get if state.exists else (0.5, 0.3, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            level = min(1.0, max(0.0, level + (0.05 if kind == "purchase" else -0.08 if kind == "error" else 0.0)))
            sure = min(1.0, sure + 0.02)
            n += 1
        state.update((level, sure, n))
        yield pd.DataFrame({"user_id": [key[0]], "level": [level], "confidence": [sure], "n": [n]})

    out = "user_id long, level double, confidence double, n long"
    return events.groupBy("user_id").applyInPandasWithState(fold, out, "level double, confidence double, n long", "update", GroupStateTimeout.NoTimeout)
