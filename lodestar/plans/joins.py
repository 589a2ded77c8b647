"""Queries: equi, semi, anti, range, as-of, path and similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators import relational as R
from lodestar.operators import similarity as S
from lodestar.plans.registry import query
from lodestar.sources import tables as T

K = T.sql("knowledge")


@query("J01_index_base_join", "SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)")
def index_base(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "source").join(T.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("J02_vector_base_join", "SELECT v.vec_id, v.label, d.lang FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id WHERE d.lang = 'en'")
def vector_base(spark, sf):
    d = T.table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "lang")
    return T.table(spark, sf, "embeddings").select("vec_id", "label").join(d, "vec_id")


@query("J03_symmetric_relations", T.sql("relations") + "SELECT a, b, kind FROM (SELECT from_id AS a, to_id AS b, kind FROM relations UNION ALL SELECT to_id, from_id, kind FROM relations) JOIN orders ON o_orderkey = a WHERE o_orderstatus = 'P'")
def symmetric(spark, sf):
    o = T.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("a"))
    return R.undirected(T.relations(spark, sf), "from_id", "to_id").join(o, "a").select("a", "b", "kind")


@query("J04_co_occurrence", T.sql("links") + "SELECT a.node AS a, b.node AS b, count(*) AS n FROM links a JOIN links b ON a.record = b.record AND a.node < b.node GROUP BY ALL HAVING count(*) >= 3")
def co_occurrence(spark, sf):
    return R.co_occurrence(T.links(spark, sf), "record", "node", 3)


@query("J05_string_agg", T.sql("links") + "SELECT o_orderkey AS id, count(p_partkey) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM orders LEFT JOIN links ON record = o_orderkey LEFT JOIN part ON p_partkey = node GROUP BY o_orderkey")
def string_agg(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_partkey", "p_brand")
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"))
    j = o.join(T.links(spark, sf).select("record", "node"), "record", "left").join(p, "node", "left")
    brands = F.array_join(F.array_sort(F.collect_set("p_brand")), ",")
    return j.groupBy(F.col("record").alias("id")).agg(F.count("p_partkey").alias("n"), F.when(brands != "", brands).alias("brands"))


@query("J06_left_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def left_count(spark, sf):
    o = T.table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return T.table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("J07_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi(spark, sf):
    o = T.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return T.table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


@query("J08_anti_having", T.sql("ev") + "SELECT user_id, count(*) AS n FROM ev WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type = 'signup' AND k = 7) GROUP BY user_id HAVING count(*) >= 60")
def anti_having(spark, sf):
    e = T.events(spark, sf)
    done = e.filter("event_type = 'signup' and k = 7").select("user_id").distinct()
    return e.join(done, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 60")


@query("J09_orphan_nodes", T.sql("links", "graph") + "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT src FROM graph) AND p_partkey NOT IN (SELECT dst FROM graph)")
def orphans(spark, sf):
    g = T.graph(spark, sf)
    ends = g.select(F.col("src").alias("p_partkey")).union(g.select("dst")).distinct()
    return T.table(spark, sf, "part").select("p_partkey").join(ends, "p_partkey", "left_anti")


@query("J10_strongest_link", T.sql("links") + "SELECT node, max(strength) AS strength, min(record) FILTER (strength = m) AS record FROM (SELECT *, max(strength) OVER (PARTITION BY node) AS m FROM links) GROUP BY node")
def strongest(spark, sf):
    best = T.links(spark, sf).groupBy("node").agg(F.max(F.struct("strength", (-F.col("record")).alias("r"))).alias("b"))
    return best.select("node", "b.strength", (-F.col("b.r")).alias("record"))


_RANGES = """WITH r AS (SELECT l_orderkey AS id, min(epoch(l_shipdate))::BIGINT AS lo, max(epoch(l_shipdate))::BIGINT AS hi FROM lineitem GROUP BY l_orderkey),
q AS (SELECT o_orderkey AS qid, epoch(o_orderdate)::BIGINT AS qlo, epoch(o_orderdate)::BIGINT + 172800 AS qhi FROM orders WHERE o_orderstatus = 'P')
SELECT qid, id FROM r JOIN q ON lo <= qhi AND hi >= qlo"""


@query("J11_overlap_join", _RANGES)
def overlap(spark, sf):
    r = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(T.epoch("l_shipdate")).alias("lo"), F.max(T.epoch("l_shipdate")).alias("hi"))
    q = T.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("qid"), T.epoch("o_orderdate").alias("qlo"), (T.epoch("o_orderdate") + 172800).alias("qhi"))
    return R.overlap_join(r, q, 7 * 86400).select("qid", "id")


@query("J13_nearest_in_time", T.sql("ev") + """, n AS (SELECT a.event_id AS anchor, b.event_id, row_number() OVER (PARTITION BY a.event_id, b.sec > a.sec ORDER BY abs(b.sec - a.sec), b.event_id) AS rn
FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.event_type = 'error' AND a.k = 3) SELECT anchor, event_id FROM n WHERE rn <= 2""")
def nearest_in_time(spark, sf):
    e = T.events(spark, sf)
    a = e.filter("event_type = 'error' and k = 3").select(F.col("event_id").alias("anchor"), "user_id", F.col("sec").alias("t"))
    j = a.join(e.select("user_id", "event_id", "sec"), "user_id").filter("anchor != event_id").withColumn("after", F.col("sec") > F.col("t"))
    return R.top_per_group(j, ["anchor", "after"], [F.abs(F.col("sec") - F.col("t")), F.col("event_id")], 2).select("anchor", "event_id")


@query("J14_two_hop_paths", T.sql("links", "graph") + "SELECT DISTINCT e1.src AS a, e2.dst AS c FROM graph e1 JOIN graph e2 ON e1.dst = e2.src WHERE NOT EXISTS (SELECT 1 FROM graph e WHERE e.src = e1.src AND e.dst = e2.dst) ORDER BY a, c LIMIT 100")
def two_hop(spark, sf):
    g = T.graph(spark, sf).select("src", "dst")
    paths = g.join(g.select(F.col("src").alias("dst"), F.col("dst").alias("c")), "dst").select(F.col("src").alias("a"), "c").distinct()
    known = g.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    return paths.join(known, ["a", "c"], "left_anti").orderBy("a", "c").limit(100)


@query("J15_transitive_facts", T.sql("relations") + "SELECT DISTINCT a.from_id AS a, a.kind, b.to_id AS c, 0.6::DOUBLE AS confidence, sha256(a.from_id || '|' || a.kind || '|' || b.to_id) AS h FROM relations a JOIN relations b ON a.to_id = b.from_id AND a.kind = b.kind AND a.from_id <> b.to_id ORDER BY a, c LIMIT 100")
def transitive(spark, sf):
    r = T.relations(spark, sf)
    n = r.select(F.col("from_id").alias("to_id"), "kind", F.col("to_id").alias("c"))
    out = r.join(n, ["to_id", "kind"]).filter("from_id != c").select(F.col("from_id").alias("a"), "kind", "c").distinct()
    return out.withColumn("confidence", F.lit(0.6)).withColumn("h", F.sha2(F.concat_ws("|", "a", "kind", "c"), 256)).orderBy("a", "c").limit(100)


_SETS = """, s AS (SELECT l_orderkey AS id, l_partkey AS item FROM lineitem GROUP BY ALL), z AS (SELECT id, count(*) AS n FROM s GROUP BY id)
SELECT a.id AS a, b.id AS b, round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 6) AS sim FROM s a JOIN s b ON a.item = b.item AND a.id < b.id JOIN z za ON za.id = a.id JOIN z zb ON zb.id = b.id
GROUP BY a.id, b.id HAVING count(*) / (any_value(za.n) + any_value(zb.n) - count(*)) >= {}"""


@query("J17_jaccard_join", "WITH " + _SETS.format(0.75)[2:])
def jaccard(spark, sf):
    s = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))
    return S.jaccard_join(s, "id", "item", 0.75)


@query("J18_tag_jaccard", "WITH " + _SETS.format(0.3)[2:])
def tag_jaccard(spark, sf):
    s = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))
    return S.jaccard_join(s, "id", "item", 0.3)


@query("J19_jaccard_analogy", K + """, f AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents WHERE source <> 'src1'),
q AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark)
SELECT item_id, doc_id, round(len(list_intersect(q.w, f.w)) / len(list_distinct(list_concat(q.w, f.w))), 6) AS sim FROM q, f WHERE len(list_intersect(q.w, f.w)) > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(len(list_intersect(q.w, f.w)) / len(list_distinct(list_concat(q.w, f.w))), 6) DESC, doc_id) <= 10""")
def analogy(spark, sf):
    f = T.table(spark, sf, "documents").filter("source != 'src1'").select("doc_id", F.col("text").alias("t"))
    sim = S.jaccard_search(f, "doc_id", T.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("t")), "item_id", "t")
    return R.top_per_group(sim, ["item_id"], [F.desc("sim"), F.col("doc_id")], 10).filter("sim > 0").select("item_id", "doc_id", "sim")


@query("J22_entity_intersection", T.sql("links") + "SELECT record FROM links WHERE node IN (1, 2, 3, 4, 5, 6, 7, 8) GROUP BY record HAVING count(DISTINCT node) >= 2")
def intersection(spark, sf):
    return T.links(spark, sf).filter(F.col("node").isin(*range(1, 9))).groupBy("record").agg(F.count_distinct("node").alias("n")).filter("n >= 2").select("record")


@query("J23_triple_lookup", T.sql("ev") + "SELECT event_id, (CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END + CASE WHEN k = 3 THEN 1 ELSE 0 END) AS hits FROM ev WHERE user_id = 5 ORDER BY hits DESC, event_id LIMIT 20")
def triple_lookup(spark, sf):
    hits = F.when(F.col("event_type") == "purchase", 2).otherwise(0) + F.when(F.col("k") == 3, 1).otherwise(0)
    return T.events(spark, sf).filter("user_id = 5").select("event_id", hits.alias("hits")).orderBy(F.desc("hits"), "event_id").limit(20)


@query("J27_cross_project_concepts", "WITH s AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS c FROM lineitem) SELECT a.p AS a, b.p AS b, count(*) AS n, least(1 + 0.2 * count(*), 5)::DOUBLE AS weight FROM s a JOIN s b ON a.c = b.c AND a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 20")
def cross_project(spark, sf):
    s = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("p"), F.col("l_partkey").alias("c"))
    return R.co_occurrence(s, "c", "p", 20).withColumn("weight", F.least(1 + 0.2 * F.col("n"), F.lit(5.0)))


@query("J28_session_edges", T.sql("links") + """, s AS (SELECT record FROM links GROUP BY record HAVING count(*) BETWEEN 2 AND 30), p AS (
SELECT record, a.node AS a, b.node AS b, row_number() OVER (PARTITION BY record ORDER BY a.node, b.node) AS rn, n FROM links a JOIN links b USING (record) JOIN (SELECT record, count(*) AS n FROM links GROUP BY record) USING (record) WHERE a.node < b.node AND record IN (SELECT record FROM s))
SELECT a, b, count(*) AS n FROM p WHERE rn <= least(2 * n, 20) GROUP BY a, b HAVING count(*) >= 2""")
def session_edges(spark, sf):
    n = T.links(spark, sf).select("record", "node")
    sizes = n.groupBy("record").agg(F.count("*").alias("n")).filter("n between 2 and 30")
    p = n.withColumnRenamed("node", "a").join(n.withColumnRenamed("node", "b"), "record").filter("a < b").join(sizes, "record")
    p = p.withColumn("rn", F.row_number().over(W.partitionBy("record").orderBy("a", "b"))).filter(F.col("rn") <= F.least(2 * F.col("n"), F.lit(20)))
    return p.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 2")


@query("J29_orphan_discovery", """WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS tok FROM documents WHERE doc_id % 7 = 3), n AS (SELECT DISTINCT split_part(text, ' ', 1) AS tok, min(item_id) AS node FROM benchmark GROUP BY 1)
SELECT doc_id, min(node) AS node, 0.7::DOUBLE AS strength FROM w JOIN n USING (tok) GROUP BY doc_id""".replace("WHERE doc_id % 7 = 3", ""))
def orphan_links(spark, sf):
    w = T.table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("tok"))
    n = T.table(spark, sf, "benchmark").groupBy(F.split_part("text", F.lit(" "), F.lit(1)).alias("tok")).agg(F.min("item_id").alias("node"))
    return w.join(n, "tok").groupBy("doc_id").agg(F.min("node").alias("node")).withColumn("strength", F.lit(0.7))


@query("J30_tag_overlap", T.sql("ev") + "SELECT a.user_id AS a, b.user_id AS b, count(*) AS n FROM (SELECT DISTINCT user_id, event_type || k AS tag FROM ev) a JOIN (SELECT DISTINCT user_id, event_type || k AS tag FROM ev) b ON a.tag = b.tag AND a.user_id < b.user_id GROUP BY ALL HAVING count(*) >= 38")
def tag_overlap(spark, sf):
    t = T.events(spark, sf).select("user_id", F.concat("event_type", F.col("k").cast("string")).alias("tag"))
    return R.dense_co_occurrence(t, "tag", "user_id", 38)


_VEC = """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM v a JOIN v b ON a.id < b.id {} WHERE list_cosine_similarity(a.v, b.v) >= {}"""


@query("J21_cosine_pairs", _VEC.format("", 0.42))
def cosine_pairs(spark, sf):
    return S.cosine_join(T.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.42)


@query("J20_cosine_dedup_by_group", _VEC.format("AND a.label = b.label", 0.38))
def cosine_dedup(spark, sf):
    return S.cosine_join(T.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.38, group="label")


@query("J25_difflib_duplicates")
def difflib_duplicates(spark, sf):
    names = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_brand").alias("key"))
    return S.ratio_join(names, "id", "text", "key", 0.85)
