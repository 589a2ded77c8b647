"""Logical inputs of the engine over the Parquet tables of a folder.

Each function declares the columns it needs, so scans are pruned and filters
reach Parquet. ``CTE`` has the same inputs as SQL, for the registered queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.runtime import spread

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC, in place of a wall clock
BASE = 1704067200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"datediff({ts}, DATE '1970-01-01') * 86400L + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts})")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records: id, content, project, type, tags, status, created, confirmed, recall_count, confidence, importance, branch."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), F.col("text").alias("content"), F.col("source").alias("project"), F.col("lang").alias("type"), F.array("lang", "source").alias("tags"),
        F.when(i % 11 == 0, "archived").otherwise("active").alias("status"), (F.lit(BASE) + i * 60).alias("created"), (F.lit(BASE) + i * 60 + (i % 5) * 86400).alias("confirmed"),
        (i % 7).alias("recall_count"), ((i % 10) / 10.0).alias("confidence"),
        F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (i % 4 + 1).cast("int")).alias("importance"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("b"), i % 3)).alias("branch"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``sec`` in whole seconds and the number ``k`` from the JSON properties."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", epoch("ts").alias("sec"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-to-node links: record = order, node = part, strength = quantity / 50; one row a pair."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("node"), "l_quantity")
    # hardly two rows have one pair, so they are not grouped before the shuffle; by record, which most readers group or join by
    return spread(li, li.count(), "record").groupBy("record", "node").agg((F.max("l_quantity") / 50).alias("strength"))


def graph(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Undirected weighted edges (src < dst): parts that share at least ``least`` orders.

    Orders hold a bounded number of lines, so pairs grow with the orders only.
    """
    n = links(spark, sf_dir).select("record", "node")
    pairs = n.join(n.withColumnRenamed("node", "dst"), "record").filter(F.col("node") < F.col("dst")).select(F.col("node").alias("src"), "dst")
    return spread(pairs, 2 * table(spark, sf_dir, "lineitem").count(), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed relations between consecutive orders of a customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("from_id"), F.lead("o_orderkey").over(w).alias("to_id")).filter("to_id is not null").withColumn("kind", F.when(F.col("from_id") % 3 == 0, "solves").otherwise("follows"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed facts (s, p, o, valid_from): each user's event types in time order."""
    return events(spark, sf_dir).select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("s"), F.lit("last_event").alias("p"), F.col("event_type").alias("o"), F.col("sec").alias("valid_from"))


CTE = {
    "knowledge": f"""knowledge AS (SELECT doc_id AS id, text AS content, source AS project, lang AS type, [lang, source] AS tags,
  CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status, {BASE} + doc_id * 60 AS created, {BASE} + doc_id * 60 + (doc_id % 5) * 86400 AS confirmed,
  doc_id % 7 AS recall_count, (doc_id % 10) / 10.0::DOUBLE AS confidence, (['critical', 'high', 'medium', 'low'])[doc_id % 4 + 1] AS importance,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'b' || (doc_id % 3) END AS branch FROM documents)""",
    "ev": "ev AS (SELECT event_id, user_id, event_type, value, epoch(date_trunc('second', ts))::BIGINT AS sec, json_extract_string(props, '$.k')::INT AS k FROM events)",
    "links": "links AS (SELECT l_orderkey AS record, l_partkey AS node, max(l_quantity) / 50 AS strength FROM lineitem GROUP BY ALL)",
    "graph": "graph AS (SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM links a JOIN links b ON a.record = b.record AND a.node < b.node GROUP BY ALL HAVING count(*) >= 2)",
    "relations": """relations AS (SELECT *, CASE WHEN from_id % 3 = 0 THEN 'solves' ELSE 'follows' END AS kind FROM (SELECT o_orderkey AS from_id,
  lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_id FROM orders) WHERE to_id IS NOT NULL)""",
    "facts": "facts AS (SELECT event_id AS fact_id, user_id AS s, 'last_event' AS p, event_type AS o, sec AS valid_from FROM ev)",
}


def sql(*names: str) -> str:
    """A WITH clause of the named inputs, to be continued with more of them or a SELECT."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"
