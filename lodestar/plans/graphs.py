"""Queries: graph analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import graph as G
from lodestar.operators import relational as R
from lodestar.operators.components import connected_components
from lodestar.plans.registry import query
from lodestar.sources import tables as T

_G = T.sql("links", "graph").rstrip() + ", both_ AS MATERIALIZED (SELECT src AS a, dst AS b, weight FROM graph UNION ALL SELECT dst, src, weight FROM graph)\n"


def _seeds(spark, sf):
    """The five nodes with the most neighbours."""
    g = R.undirected(T.graph(spark, sf).select("src", "dst"))
    return g.groupBy(F.col("a").alias("seed")).agg(F.count("*").alias("d")).orderBy(F.desc("d"), "seed").limit(5).select("seed")


_SEEDS = ", seeds AS MATERIALIZED (SELECT a AS seed FROM both_ GROUP BY a ORDER BY count(*) DESC, a LIMIT 5)"


def _pagerank_sql(rounds: int, last: str) -> str:
    steps = [_G.rstrip(), "p AS MATERIALIZED (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS p FROM both_)", "n AS MATERIALIZED (SELECT count(DISTINCT a) AS n FROM p)", "r0 AS MATERIALIZED (SELECT DISTINCT a AS node, 1.0::DOUBLE / n.n AS rank FROM p, n)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT b AS node, 0.15 / any_value(n.n) + 0.85 * sum(rank * p) AS rank FROM p JOIN r{k} ON node = a, n GROUP BY b)")
    return ",\n".join(steps) + "\n" + last.format(f"r{rounds}")


@query("G07_pagerank", _pagerank_sql(20, "SELECT node, round(rank / sum(rank) OVER (), 9) AS rank FROM {}"))
def pagerank(spark, sf):
    return G.pagerank(T.graph(spark, sf)).select("node", F.round("rank", 9).alias("rank"))


@query("G09_importance", _pagerank_sql(20, "SELECT node, round(rank / max(rank) OVER (), 4) AS importance FROM {}"))
def importance(spark, sf):
    r = G.pagerank(T.graph(spark, sf))
    return r.join(F.broadcast(r.agg(F.max("rank").alias("m")))).select("node", F.round(F.col("rank") / F.col("m"), 4).alias("importance"))  # one row


_CC = T.sql("links", "graph").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, e AS MATERIALIZED (SELECT src AS a, dst AS b FROM graph WHERE weight >= 3 UNION SELECT dst, src FROM graph WHERE weight >= 3),
r AS (SELECT a AS node, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node)
"""


@query("G08_components", _CC + "SELECT node, min(low) AS component FROM r GROUP BY node")
def components(spark, sf):
    return connected_components(T.graph(spark, sf, 3))


@query("G11_large_components", _CC + "SELECT component, count(*) AS n FROM (SELECT node, min(low) AS component FROM r GROUP BY node) GROUP BY component HAVING count(*) >= 3")
def large_components(spark, sf):
    return connected_components(T.graph(spark, sf, 3)).groupBy("component").agg(F.count("*").alias("n")).filter("n >= 3")


def _levels(depth: int) -> str:
    out = [_G.rstrip() + _SEEDS, "l0 AS MATERIALIZED (SELECT seed, seed AS node, 0 AS hops FROM seeds)", "s0 AS MATERIALIZED (SELECT * FROM l0)"]
    for k in range(1, depth + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT DISTINCT l.seed, b AS node, {k} AS hops FROM l{k - 1} l JOIN both_ ON a = l.node WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.seed = l.seed AND s.node = b))")
        out.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})")
    return ",\n".join(out)


@query("G02_neighbourhood", _levels(3) + "\nSELECT seed, node, hops FROM s3")
def neighbourhood(spark, sf):
    return G.reach(T.graph(spark, sf), _seeds(spark, sf), 3)


@query("G03_neighbours", _G.rstrip() + _SEEDS + " SELECT a AS node, b AS neighbour, weight FROM both_ WHERE a IN (SELECT seed FROM seeds)")
def neighbours(spark, sf):
    s = _seeds(spark, sf).select(F.col("seed").alias("a"))
    return R.undirected(T.graph(spark, sf)).join(s, "a", "left_semi").select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "weight")


def _path_sql(depth: int) -> str:
    out = [_G.rstrip() + _SEEDS, "l0 AS MATERIALIZED (SELECT seed, seed AS node, 0 AS hops, seed::VARCHAR AS path FROM seeds)", "s0 AS MATERIALIZED (SELECT * FROM l0)"]
    for k in range(1, depth + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT l.seed, b AS node, {k} AS hops, min(path || '>' || b) AS path FROM l{k - 1} l JOIN both_ ON a = l.node WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.seed = l.seed AND s.node = b) GROUP BY l.seed, b)")
        out.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})")
    return ",\n".join(out) + f"\nSELECT seed, node, hops, path FROM s{depth}"


@query("G04_shortest_paths", _path_sql(5))
def shortest(spark, sf):
    return G.paths(T.graph(spark, sf), _seeds(spark, sf), 5)


@query("G05_concept_neighbours", _G.rstrip() + _SEEDS + " SELECT b AS node, max(weight) AS weight FROM both_ WHERE a IN (SELECT seed FROM seeds) GROUP BY b")
def concept_neighbours(spark, sf):
    s = _seeds(spark, sf).select(F.col("seed").alias("a"))
    return R.undirected(T.graph(spark, sf)).join(s, "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.max("weight").alias("weight"))


@query("G06_subgraph", _G.rstrip() + " SELECT src, dst, weight FROM graph WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def subgraph(spark, sf):
    return G.subgraph(T.graph(spark, sf), T.table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("node")))


@query("G01_reinforced_edges", T.sql("links", "graph", "relations") + """, n AS (SELECT src, dst, count(*) AS n FROM (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R') GROUP BY ALL)
SELECT src, dst, round(least(10, CASE WHEN weight IS NULL THEN 1 + 0.1 * (n - 1) ELSE weight + 0.1 * coalesce(n, 0) END), 6)::DOUBLE AS weight FROM graph FULL JOIN n USING (src, dst)""")
def reinforced(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    a = li.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("src"))
    seen = a.join(li.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").filter("src < dst").select("src", "dst")
    return G.reinforced(T.graph(spark, sf), seen).select("src", "dst", F.round("weight", 6).alias("weight"))


def _coo(name, sql_weight, least, weight):
    @query(name, T.sql("links") + f"SELECT a.node AS a, b.node AS b, round({sql_weight}, 6)::DOUBLE AS weight FROM links a JOIN links b ON a.record = b.record AND a.node < b.node GROUP BY ALL HAVING count(*) >= {least}".replace("GROUP BY ALL", "GROUP BY a.node, b.node"))
    def run(spark, sf):
        return R.co_occurrence(T.links(spark, sf), "record", "node", least).select("a", "b", F.round(weight(F.col("n")), 6).alias("weight"))

    return run


_coo("G12_cooccurrence_reinforce", "least(0.5 + 0.1 * count(*), 5)", 3, lambda n: F.least(0.5 + 0.1 * n, F.lit(5.0)))
_coo("G13_cooccurrence_synthesis", "least(0.3 + 0.1 * count(*), 3)", 2, lambda n: F.least(0.3 + 0.1 * n, F.lit(3.0)))
_coo("G14_cooccurrence_migration", "least(0.2 * count(*), 3)", 2, lambda n: F.least(0.2 * n, F.lit(3.0)))


@query("G15_stale_nodes", T.sql("links", "graph") + "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT src FROM graph UNION SELECT dst FROM graph) AND p_size < 30")
def stale(spark, sf):
    g = T.graph(spark, sf)
    ends = g.select(F.col("src").alias("p_partkey")).union(g.select("dst")).distinct()
    return T.table(spark, sf, "part").filter("p_size < 30").select("p_partkey").join(ends, "p_partkey", "left_anti")


@query("G16_weak_edges", T.sql("links") + "SELECT record, node, strength FROM links WHERE strength < 0.1")
def weak(spark, sf):
    return T.links(spark, sf).filter("strength < 0.1")


@query("G17_weakened_edges", T.sql("links") + "SELECT record, node, round(strength * 0.5, 6) AS strength FROM links")
def weakened(spark, sf):
    return T.links(spark, sf).select("record", "node", F.round(F.col("strength") * 0.5, 6).alias("strength"))


@query("G18_hierarchy_edges", "SELECT n_name AS child, r_name AS parent, 'part_of' AS kind, 2.0::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def hierarchy(spark, sf):
    r = T.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent"))
    return T.table(spark, sf, "nation").join(r, "n_regionkey").select(F.col("n_name").alias("child"), "parent", F.lit("part_of").alias("kind"), F.lit(2.0).alias("weight"))


def _activation_sql(last: str) -> str:
    out = [_G.rstrip() + _SEEDS, "l0 AS MATERIALIZED (SELECT seed AS node, 1.0::DOUBLE AS activation FROM seeds)", "s0 AS MATERIALIZED (SELECT * FROM l0)"]
    for k, d in enumerate((0.7, 0.4, 0.2), 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT b AS node, least(1, max(activation) * {d} * ([1.0, 1.2, 1.5, 1.8, 2.0])[least(count(*), 5)]::DOUBLE) AS activation FROM l{k - 1} JOIN both_ ON a = node WHERE b NOT IN (SELECT node FROM s{k - 1}) GROUP BY b HAVING least(1, max(activation) * {d} * ([1.0, 1.2, 1.5, 1.8, 2.0])[least(count(*), 5)]::DOUBLE) >= 0.05)")
        out.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})")
    return ",\n".join(out) + "\n" + last


@query("G19_spreading_activation", _activation_sql("SELECT node, round(activation, 9) AS activation FROM s3 WHERE node NOT IN (SELECT seed FROM seeds)"))
def spreading(spark, sf):
    return G.activation(T.graph(spark, sf), _seeds(spark, sf)).select("node", F.round("activation", 9).alias("activation"))


@query("G21_associative_recall", _activation_sql("SELECT record, round(sum(activation * strength), 4) AS score FROM s3 JOIN links USING (node) WHERE node NOT IN (SELECT seed FROM seeds) GROUP BY record ORDER BY score DESC, record LIMIT 30"))
def associative(spark, sf):
    a = G.activation(T.graph(spark, sf), _seeds(spark, sf))
    s = T.links(spark, sf).join(a, "node").groupBy("record").agg(F.round(F.sum(F.col("activation") * F.col("strength")), 4).alias("score"))
    return s.orderBy(F.desc("score"), "record").limit(30)


@query("G20_seed_lookup", "SELECT p_partkey, CASE WHEN lower(p_name) = 'part 7' THEN 0 ELSE 1 END AS tier FROM part WHERE lower(p_name) LIKE 'part%' ORDER BY tier, p_partkey LIMIT 3")
def seed_lookup(spark, sf):
    p = T.table(spark, sf, "part").filter(F.startswith(F.lower("p_name"), F.lit("part")))
    return p.select("p_partkey", F.when(F.lower("p_name") == "part 7", 0).otherwise(1).alias("tier")).orderBy("tier", "p_partkey").limit(3)


@query("G23_context_expansion", _G.rstrip() + _SEEDS + """, lv AS (SELECT node, max(w) AS w FROM (SELECT b AS node, max(weight) AS w FROM both_ WHERE a IN (SELECT seed FROM seeds) GROUP BY b UNION ALL SELECT seed, 10 FROM seeds) GROUP BY node)
SELECT record, round(sum(w * strength), 6) AS score FROM links JOIN lv USING (node) GROUP BY record ORDER BY score DESC, record LIMIT 50""")
def context(spark, sf):
    c = G.context(T.graph(spark, sf), T.links(spark, sf), _seeds(spark, sf))
    return c.select("record", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "record").limit(50)


@query("G24_multi_hop", T.sql("relations") + """, s AS (SELECT o_orderkey AS seed FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), e AS (SELECT from_id AS a, to_id AS b FROM relations UNION ALL SELECT to_id, from_id FROM relations),
h1 AS (SELECT b AS id FROM e WHERE a IN (SELECT seed FROM s)), h2 AS (SELECT e.b AS id FROM h1 JOIN e ON e.a = h1.id)
SELECT id, CASE WHEN min(hop) = 1 THEN 0.4 ELSE 0.08 END::DOUBLE AS score, min(hop) AS hop FROM (SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2) WHERE id NOT IN (SELECT seed FROM s) GROUP BY id""")
def multi_hop(spark, sf):
    s = T.table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("seed"))
    return G.hops(T.relations(spark, sf), s).select("id", F.round("score", 6).alias("score"), "hop")


@query("G26_concept_extraction", "SELECT DISTINCT doc_id, tok AS concept FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS tok FROM documents) WHERE tok IN (SELECT lower(unnest(string_split(text, ' '))) FROM benchmark WHERE length(text) < 400)")
def concepts(spark, sf):
    words = lambda d, *k: d.select(*k, F.explode(F.split(F.lower("text"), " ")).alias("concept"))
    names = words(T.table(spark, sf, "benchmark").filter("length(text) < 400")).distinct()
    return words(T.table(spark, sf, "documents"), "doc_id").join(names, "concept", "left_semi").distinct()


@query("G28_typed_links", "SELECT 'nation' AS kind, c_custkey AS a, c_nationkey::BIGINT AS b FROM customer UNION ALL SELECT 'order', o_custkey, o_orderkey FROM orders UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def typed_links(spark, sf):
    t = lambda n, k, a, b: T.table(spark, sf, n).select(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).cast("long").alias("b"))
    return t("customer", "nation", "c_custkey", "c_nationkey").union(t("orders", "order", "o_custkey", "o_orderkey")).union(t("supplier", "supplier", "s_suppkey", "s_nationkey"))


@query("G29_entity_events", T.sql("ev") + "SELECT event_id, user_id FROM ev WHERE k = 3 AND event_type IN ('purchase', 'signup')")
def entity_events(spark, sf):
    return T.events(spark, sf).filter(F.expr("k = 3 and event_type in ('purchase', 'signup')")).select("event_id", "user_id")


@query("A15_graph_stats", _CC.rstrip() + " SELECT (SELECT count(DISTINCT a) FROM e) AS nodes, (SELECT count(*) FROM e)::DOUBLE / (SELECT count(DISTINCT a) FROM e) AS degree, (SELECT count(DISTINCT low) FROM (SELECT node, min(low) AS low FROM r GROUP BY node)) AS components")
def graph_stats(spark, sf):
    g = T.graph(spark, sf, 3)
    both = R.undirected(g.select("src", "dst"))
    c = connected_components(g).agg(F.count_distinct("component").alias("components"))
    return both.agg(F.count_distinct("a").alias("nodes"), F.coalesce(F.try_divide(F.count("*"), F.count_distinct("a")), F.lit(float("nan"))).alias("degree")).join(F.broadcast(c))  # one row


@query("J16_shared_representation", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN labels l ON l.doc_id = a.vec_id JOIN embeddings b ON b.label = a.label AND b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 10")
def shared_representation(spark, sf):
    v = T.table(spark, sf, "embeddings").select("vec_id", "label")
    l = T.table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    a = v.join(l, "vec_id").select(F.col("vec_id").alias("a"), "label", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 10)).alias("b"))
    return a.join(v.select(F.col("vec_id").alias("b"), "label"), ["b", "label"]).select("a", "b")
