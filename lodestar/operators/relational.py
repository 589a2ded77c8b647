"""Filters, projections, set operations and simple joins on record tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.runtime import spread, written

#: Order of importance, most important first.
IMPORTANCE = ("critical", "high", "medium", "low")
SENSITIVE = (
    r"(?i)(api[_-]?key|password|passwd|secret|token)\s*[:=]\s*\S+",
    r"AKIA[0-9A-Z]{16}",
    r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
)


def active(records: DataFrame) -> DataFrame:
    return records.filter(F.col("status") == "active")


def scoped(records: DataFrame, project: str | None = None, kinds: tuple[str, ...] = (), branch: str | None = None) -> DataFrame:
    """Conjunctive scope filters; a branch filter also admits records of no branch."""
    if project is not None:
        records = records.filter(F.col("project") == project)
    if kinds:
        records = records.filter(F.col("type").isin(*kinds))
    if branch is not None:
        records = records.filter((F.col("branch") == branch) | (F.col("branch") == ""))
    return records


def importance_rank(c: str = "importance") -> Column:
    out = F.lit(len(IMPORTANCE))
    for k, v in reversed(list(enumerate(IMPORTANCE))):
        out = F.when(F.col(c) == v, k).otherwise(out)
    return out


def detail(records: DataFrame, level: str) -> DataFrame:
    """``compact`` shows 80 characters, ``summary`` 150, ``full`` all; ``n_tokens`` is a quarter of the characters shown."""
    wide = {"compact": 80, "summary": 150}.get(level)
    shown = F.substring("content", 1, wide) if wide else F.col("content")
    return records.select("id", shown.alias("shown")).withColumn("n_tokens", F.floor(F.length("shown") / 4))


def has_tag(records: DataFrame, tag: str) -> DataFrame:
    """Records with a tag that contains ``tag``, ignoring case."""
    return records.filter(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def redact(text: Column, patterns: tuple[str, ...] = SENSITIVE, mask: str = "[REDACTED]") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, F.lit(mask))
    return text


def strip_private(text: Column) -> Column:
    """Without ``<private>`` sections."""
    return F.regexp_replace(text, r"(?is)<private>.*?</private>", F.lit(""))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; with a rank limit Spark prunes before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge, as (a, b) and the other columns."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), *rest).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"), *rest))


def co_occurrence(links: DataFrame, record: str, node: str, least: int) -> DataFrame:
    """Pairs of nodes that share at least ``least`` records (a < b), with the count ``n``.

    Nodes with less support than ``least`` are pruned before the self-join. Rows
    and pairs are counted first and spread over tasks of a bounded number of
    rows; a record of many nodes is not split.
    """
    n = links.select(record, node).filter(F.col(record).isNotNull() & F.col(node).isNotNull())
    n = written(spread(n, n.count(), record).distinct(), "co-occurrence")  # read three times
    rows = n.count()
    most = n.groupBy(record).agg(F.count("*").alias("_c")).agg(F.sum(F.expr("cast(_c as decimal(38,0)) * (_c - 1) / 2"))).first()[0]
    frequent = n.groupBy(node).agg(F.count("*").alias("_s")).filter(F.col("_s") >= least).select(node)
    n = spread(n.join(frequent, node), rows, record)
    pairs = n.withColumnRenamed(node, "a").join(n.withColumnRenamed(node, "b"), record).filter("a < b").select("a", "b")
    return spread(pairs, int(most or 0), "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


#: Different records up to which a node's records are a row of bits.
DENSE = 4096


def dense_co_occurrence(links: DataFrame, record: str, node: str, least: int, block: int = 2048) -> DataFrame:
    """``co_occurrence`` of integer nodes where few records hold many nodes each.

    A self-join would make a row for each pair and shared record. Here a node is
    a row of bits, one a record; rows are packed in blocks, and the product of
    two blocks counts what their nodes share, so only pairs of at least
    ``least`` leave a task. Work is quadratic in the nodes, memory is that of two
    blocks. If there are more than ``DENSE`` records, by count, they are joined.
    """
    spark = links.sparkSession
    n = links.select(record, node).filter(F.col(record).isNotNull() & F.col(node).isNotNull()).distinct()
    records = n.select(record).distinct()
    width = records.count()
    if width > DENSE:
        return co_occurrence(links, record, node, least)
    at = records.select(record, (F.row_number().over(W.orderBy(record)) - 1).alias("_at"))  # counted above
    rows = n.join(F.broadcast(at), record).groupBy(F.col(node).cast("long").alias("id")).agg(F.collect_list("_at").alias("at")).filter(F.size("at") >= least)
    rows = written(rows, "bit-rows")
    many = max(1, -(-rows.count() // block))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros((table.num_rows, width), np.uint8)
        lists = table["at"].combine_chunks()
        bits[np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)] = 1
        return pa.table({"blk": pa.array([key[0].as_py()], pa.int64()), "ids": [table["id"].to_numpy().astype("<i8").tobytes()], "m": [np.packbits(bits, axis=1).tobytes()]})

    blocks = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(many))).groupBy("blk").applyInArrow(pack, "blk long, ids binary, m binary")
    blocks = written(blocks.repartition(min(many, spark.sparkContext.defaultParallelism)), "bit-blocks")
    both = blocks.toDF("b1", "i1", "m1").hint("shuffle_replicate_nl").join(blocks.toDF("b2", "i2", "m2"), F.col("b1") <= F.col("b2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda ids, m: np.unpackbits(np.frombuffer(m, np.uint8).reshape(len(ids), -1), axis=1, count=width).astype(np.float32)
        for batch in batches:
            for i in range(batch.num_rows):
                b1, i1, m1, b2, i2, m2 = (c[i].as_py() for c in batch.columns)
                i1, i2 = np.frombuffer(i1, "<i8"), np.frombuffer(i2, "<i8")
                shared = whole(i1, m1) @ whole(i2, m2).T  # counts are exact in single precision
                x, y = np.nonzero(shared >= least)
                a, b, k = i1[x], i2[y], shared[x, y].astype(np.int64)
                keep = a < b if b1 == b2 else a != b
                a, b, k = a[keep], b[keep], k[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(k)], ["a", "b", "n"])

    kind = dict(links.dtypes)[node]
    return both.mapInArrow(compare, "a long, b long, n long").select(F.col("a").cast(kind), F.col("b").cast(kind), "n")


def overlap_join(ranges: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """Ranges (id, lo, hi) that overlap query ranges (qid, qlo, qhi), closed ends; pairs appear once.

    Both sides are cut in bins of ``width`` and joined by bin, so no side has to
    be broadcast; a pair counts in the first bin that both reach.
    """
    r = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    q = queries.withColumn("bin", F.explode(F.sequence(F.floor(F.col("qlo") / width), F.floor(F.col("qhi") / width))))
    both = r.join(q, "bin").filter((F.col("lo") <= F.col("qhi")) & (F.col("hi") >= F.col("qlo")))
    return both.filter(F.col("bin") == F.floor(F.greatest("lo", "qlo") / width)).drop("bin")
