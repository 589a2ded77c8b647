"""Session-level helpers: the shared folder, written intermediate tables, checked broadcasts.

Nothing here keeps state on one machine: intermediates go to the folder that
``spark.checkpoint.dir`` names, which every executor can read, so a lost
executor costs a task retry and never a wrong or missing row.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key list that may be broadcast; longer lists are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Read from ``spark.checkpoint.dir``. Where it is unset, a local session gets
    a temporary folder; on a cluster that would lose data, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(_remove_local, path)
    return path.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls return the same."""
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path  # type: ignore[attr-defined]
    return out


def dropped(table: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing will read it again."""
    path = getattr(table, "_lodestar_path", None)
    if path:
        removed(table.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def released(run):
    """``run``, a function of Arrow batches for executors, so that a worker that waits for its next task gives back the memory of this one."""

    def give_back(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return give_back


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0, c1, ...``: names that an operator adds can't clash with them.

    ``toDF(*names)`` on the result of the work gives the caller's names back.
    """
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to hold few rows, else unchanged.

    Only for narrow tables (a few fixed-size columns) that are cheap to count.
    """
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of a task that groups or joins them, where their number is known.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many tasks as ``rows``, its number of rows, asks for.

    A task then holds the same number of rows whatever the size of the table;
    adaptive execution would merge tasks by the bytes they read, however many
    rows they make of them.
    """
    few = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 20_000))
    return df.repartition(max(-(-rows // TASK_ROWS), few, 1), *keys)


def salted_lookup(rows: DataFrame, key: str, salt_from: str, aggs: dict, salts: int = 32, keep: str | None = None) -> DataFrame:
    """Add to each row the aggregates of its ``key`` group, with no task holding a hot group.

    ``aggs`` maps a new column to ``(partial, final)``: ``partial``, an aggregate,
    is taken over the rows of one ``(key, salt)`` cell, and ``final``, a function
    from a column to an aggregate, over the cells of a key. The salt is a hash of
    ``salt_from``, so a group of any size spreads over ``salts`` tasks; rows are
    shuffled once, by cell, and a group's result is sent only to the cells that
    exist. With ``keep``, a condition on the aggregates, the rows of other groups go.
    """
    # never null, or the join filters nulls on one side only, and the two readings of the rows can't share a shuffle
    salt = F.coalesce(F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"), F.lit(0))
    salted = rows.withColumn("_salt", salt).repartition(key, "_salt")
    cells = salted.groupBy(key, "_salt").agg(*[p.alias(c) for c, (p, _) in aggs.items()])
    totals = cells.groupBy(key).agg(*[f(F.col(c)).alias(c) for c, (_, f) in aggs.items()], F.collect_list("_salt").alias("_salts"))
    if keep:
        totals = totals.filter(keep)
    table = totals.select(key, *aggs, F.explode("_salts").alias("_salt"))
    return salted.join(table, [key, "_salt"]).drop("_salt")
