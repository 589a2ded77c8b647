"""Queries: ranks, running values, gaps and islands, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators import ranking
from lodestar.operators import sessions as S
from lodestar.plans.registry import query
from lodestar.sources import tables as T

K, E = T.sql("knowledge"), T.sql("ev")
DAY = 86400


_TIERS = """, t AS (SELECT 'value' AS tier, user_id AS id, max(value) AS score, 1.0::DOUBLE AS w FROM ev GROUP BY user_id UNION ALL SELECT 'count', user_id, count(*), 1.2 FROM ev WHERE event_type = 'click' GROUP BY user_id
UNION ALL SELECT 'recent', user_id, max(sec), 0.5 FROM ev WHERE event_type = 'error' GROUP BY user_id), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, id) AS rn FROM t)
SELECT id, round(sum(w / (60 + rn)), 9) AS score{} FROM r GROUP BY id"""


def _tiers(spark, sf):
    e = T.events(spark, sf)
    a = e.groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("score")).withColumn("tier", F.lit("value"))
    b = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").cast("double").alias("score")).withColumn("tier", F.lit("count"))
    c = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.max("sec").cast("double").alias("score")).withColumn("tier", F.lit("recent"))
    return a.unionByName(b).unionByName(c)


@query("W01_rank_fusion", E.rstrip() + _TIERS.format(""))
def fusion(spark, sf):
    return ranking.fuse(_tiers(spark, sf), {"value": 1.0, "count": 1.2, "recent": 0.5}).select("id", F.round("score", 9).alias("score"))


@query("W02_rank_fusion_unweighted", E.rstrip() + _TIERS.format("").replace("1.2 FROM", "1.0 FROM").replace("0.5 FROM", "1.0 FROM"))
def fusion_plain(spark, sf):
    return ranking.fuse(_tiers(spark, sf), {}).select("id", F.round("score", 9).alias("score"))


@query("W04_rank_fusion_sources", E.rstrip() + _TIERS.format(", string_agg(tier, ',' ORDER BY tier) AS sources"))
def fusion_sources(spark, sf):
    return ranking.fuse(_tiers(spark, sf), {"value": 1.0, "count": 1.2, "recent": 0.5}).select("id", F.round("score", 9).alias("score"), "sources")


@query("W05_session_ordinal", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders")
def ordinal(spark, sf):
    o = T.table(spark, sf, "orders").select("o_custkey", "o_orderkey", T.epoch("o_orderdate").alias("t"))
    w = W.partitionBy("o_custkey").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    return o.select("o_custkey", "o_orderkey", F.count("*").over(w).alias("n"))


_FLAGS = f"""SELECT user_id, event_id, sec, event_type, CASE WHEN lag(sec) OVER w IS NULL OR sec - lag(sec) OVER w > {12 * 3600} THEN 1 ELSE 0 END AS flag FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)"""


@query("W06_session_boundaries", E + f"SELECT user_id, event_id, flag FROM ({_FLAGS})")
def boundaries(spark, sf):
    return S.boundaries(T.events(spark, sf), ["user_id"], "sec", "event_id", 12 * 3600).select("user_id", "event_id", "flag")


@query("W07_session_segments", E + f"SELECT user_id, s AS session, count(*) AS n, min(sec) AS start, max(sec) AS stop FROM (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY sec, event_id)::BIGINT AS s FROM ({_FLAGS})) GROUP BY user_id, s")
def segments(spark, sf):
    return S.sessions(T.events(spark, sf), ["user_id"], "sec", "event_id", 12 * 3600)


@query("W08_phase_durations", E + "SELECT user_id, event_id, lead(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) - sec AS seconds FROM ev")
def durations(spark, sf):
    w = W.partitionBy("user_id").orderBy("sec", "event_id")
    return T.events(spark, sf).select("user_id", "event_id", (F.lead("sec").over(w) - F.col("sec")).alias("seconds"))


_ORDER = "list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type)"


@query("W09_transition_guard", E + f"SELECT user_id, event_id, coalesce(p - lag(p) OVER (PARTITION BY user_id ORDER BY sec, event_id) BETWEEN 0 AND 1, true) AS allowed FROM (SELECT *, {_ORDER} AS p FROM ev)")
def guard(spark, sf):
    p = F.array_position(F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error"))), F.col("event_type"))
    e = T.events(spark, sf).withColumn("p", p)
    step = F.col("p") - F.lag("p").over(W.partitionBy("user_id").orderBy("sec", "event_id"))
    return e.select("user_id", "event_id", F.coalesce(step.between(0, 1), F.lit(True)).alias("allowed"))


_CHAIN = """SELECT id, max(depth)::INT AS depth, max_by(root, depth) AS root FROM chain GROUP BY id"""


@query("W10_version_chain", "WITH RECURSIVE n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 OR n_nationkey = 24 THEN NULL ELSE n_nationkey + 1 END AS next FROM nation), chain AS (SELECT id, id AS root, 0 AS depth FROM n UNION ALL SELECT c.id, n.next, depth + 1 FROM chain c JOIN n ON n.id = c.root WHERE n.next IS NOT NULL AND depth < 20) " + _CHAIN)
def chain(spark, sf):
    i = F.col("n_nationkey")
    n = T.table(spark, sf, "nation").select(i.alias("id"), F.when((i % 5 == 4) | (i == 24), None).otherwise(i + 1).alias("next"))
    return ranking.chain_ends(n, "id", "next", 20)


@query("W11_fact_history", T.sql("ev", "facts") + "SELECT s, fact_id, o, lag(o) OVER (PARTITION BY s ORDER BY valid_from, fact_id) AS previous FROM facts")
def history(spark, sf):
    f = T.facts(spark, sf)
    return f.select("s", "fact_id", "o", F.lag("o").over(W.partitionBy("s").orderBy("valid_from", "fact_id")).alias("previous"))


@query("W12_token_budget", K + "SELECT project, id, tokens FROM (SELECT project, id, length(content) // 4 AS tokens, sum(length(content) // 4) OVER (PARTITION BY project ORDER BY confidence DESC, id) AS running FROM knowledge) WHERE running <= 5000")
def token_budget(spark, sf):
    k = T.knowledge(spark, sf).select("project", "id", "confidence", F.floor(F.length("content") / 4).alias("tokens"))
    return ranking.within_budget(k, ["project"], [F.desc("confidence"), F.col("id")], "tokens", 5000).select("project", "id", "tokens")


@query("W13_top_per_type", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5")
def top_per_type(spark, sf):
    p = T.table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return ranking.top(p, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).drop("rn")


_ORD = """, d AS (SELECT n AS id, row_number() OVER (ORDER BY deg DESC, n) - 1 AS i FROM (SELECT n, count(*) AS deg FROM (SELECT src AS n FROM graph UNION ALL SELECT dst FROM graph) GROUP BY n) ORDER BY deg DESC, n LIMIT 200)
SELECT a.i, b.i AS j, weight FROM graph JOIN d a ON a.id = src JOIN d b ON b.id = dst"""


@query("W14_matrix_ordinals", T.sql("links", "graph").rstrip() + _ORD)
def matrix(spark, sf):
    g = T.graph(spark, sf)
    deg = g.select(F.col("src").alias("id")).union(g.select("dst")).groupBy("id").agg(F.count("*").alias("deg")).orderBy(F.desc("deg"), "id").limit(200)
    d = deg.withColumn("i", (F.row_number().over(W.orderBy(F.desc("deg"), "id")) - 1).cast("long"))  # 200 rows
    return g.join(d.select(F.col("id").alias("src"), "i"), "src").join(d.select(F.col("id").alias("dst"), F.col("i").alias("j")), "dst").select("i", "j", "weight")


@query("W15_touch_counter", E + f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY sec, event_id) AS touches FROM (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS s FROM ({_FLAGS.replace(str(12 * 3600), str(DAY))}))")
def touches(spark, sf):
    s = S.numbered(T.events(spark, sf), ["user_id"], "sec", "event_id", DAY)
    return s.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id", "session").orderBy("sec", "event_id")).cast("long").alias("touches"))


_DECAY = f"greatest(0.01, exp(-floor(({T.AS_OF} - confirmed) / {DAY}) * ln(2) / 90))"


@query("T01_final_ranking", K + f"SELECT id, round(confidence * ({_DECAY} + least(recall_count * 0.05, 0.3)) * CASE importance WHEN 'critical' THEN 1.5 WHEN 'high' THEN 1.2 WHEN 'medium' THEN 1.0 ELSE 0.8 END, 9) AS score FROM knowledge WHERE status = 'active' ORDER BY score DESC, id LIMIT 50")
def final_ranking(spark, sf):
    return ranking.final(T.knowledge(spark, sf).filter("status = 'active'"), "confidence", T.AS_OF).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("T04_temporal_rerank", K + f"SELECT id, round(0.5 * least(confidence / 5, 1) + 0.5 * greatest(0, 1 - floor(abs({T.BASE} + 15 * {DAY} - confirmed) / {DAY}) / 180), 9) AS score FROM knowledge")
def temporal_rerank(spark, sf):
    from lodestar.functions.scores import proximity

    days = F.floor(F.abs(T.BASE + 15 * DAY - F.col("confirmed")) / DAY)
    return T.knowledge(spark, sf).select("id", F.round(0.5 * F.least(F.col("confidence") / 5, F.lit(1.0)) + 0.5 * proximity(days), 9).alias("score"))


@query("T05_rerank_blend", K + "SELECT id, round(greatest(confidence, 0.4 / (1 + exp(-(recall_count - 3))) + 0.6 * confidence), 9) AS score FROM knowledge")
def rerank_blend(spark, sf):
    return T.knowledge(spark, sf).select("id", F.round(ranking.blended(F.col("confidence"), F.col("recall_count") - 3), 9).alias("score"))


@query("A32_layer_digest", K + "SELECT id, n FROM (SELECT id, length(content) AS n, sum(length(content)) OVER (ORDER BY recall_count DESC, id) AS running FROM (SELECT * FROM knowledge ORDER BY recall_count DESC, id LIMIT 200)) WHERE running <= 40000")
def layer_digest(spark, sf):
    k = T.knowledge(spark, sf).select("id", "recall_count", F.length("content").cast("long").alias("n")).orderBy(F.desc("recall_count"), "id").limit(200)
    return ranking.within_budget(k, [], [F.desc("recall_count"), F.col("id")], "n", 40000).select("id", "n")


@query("A36_set_cover")
def set_cover(spark, sf):
    return ranking.greedy_cover(T.links(spark, sf), "record", "node", range(1, 40), 5)


@query("T03_mmr_diversify")
def mmr(spark, sf):
    v = T.table(spark, sf, "embeddings").withColumn("score", F.lit(1.0) / (F.col("vec_id") + 1))
    return ranking.mmr(v, ["label"], "vec_id", "embedding", "score", 5, 0.9)


@query("X21_context_bundle", K + "SELECT section, id FROM (SELECT type AS section, id, sum(length(content) // 4) OVER (PARTITION BY type ORDER BY confidence DESC, id) AS running FROM knowledge) WHERE running <= CASE section WHEN 'en' THEN 4000 WHEN 'de' THEN 2000 ELSE 1500 END")
def bundle(spark, sf):
    k = T.knowledge(spark, sf).select(F.col("type").alias("section"), "id", "confidence", F.floor(F.length("content") / 4).alias("tokens"))
    share = F.when(F.col("section") == "en", 4000).when(F.col("section") == "de", 2000).otherwise(1500)
    return ranking.within_budget(k, ["section"], [F.desc("confidence"), F.col("id")], "tokens", share).select("section", "id")
