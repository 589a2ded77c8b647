"""Queries: aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import scores
from lodestar.operators import relational as R
from lodestar.plans.registry import query
from lodestar.sources import tables as T

K, E = T.sql("knowledge"), T.sql("ev")
DAY = 86400


@query("A01_health_histogram", K + f"""SELECT project, count(*) AS n, count(*) FILTER (status = 'archived') AS archived, count(*) FILTER (confirmed < {T.BASE + 2 * DAY}) AS stale, count(*) FILTER (recall_count = 0) AS never,
round(greatest(0, 1 - 0.5 * count(*) FILTER (confirmed < {T.BASE + 2 * DAY}) / count(*) - 0.3 * count(*) FILTER (recall_count = 0) / count(*)), 6) AS health FROM knowledge GROUP BY project""")
def health(spark, sf):
    n, stale, never = F.count("*"), F.count_if(F.col("confirmed") < T.BASE + 2 * DAY), F.count_if(F.col("recall_count") == 0)
    return T.knowledge(spark, sf).groupBy("project").agg(
        n.alias("n"), F.count_if(F.col("status") == "archived").alias("archived"), stale.alias("stale"), never.alias("never"),
        F.round(F.greatest(F.lit(0.0), 1 - 0.5 * stale / n - 0.3 * never / n), 6).alias("health"),
    )


@query("A02_dashboard_counts", K + "SELECT status, type, project, count(*) AS n FROM knowledge GROUP BY GROUPING SETS ((status), (type), (project), ())")
def dashboard(spark, sf):
    k = T.knowledge(spark, sf)
    return k.groupingSets([[F.col("status")], [F.col("type")], [F.col("project")], []], "status", "type", "project").agg(F.count("*").alias("n"))


@query("A03_error_patterns", E + "SELECT user_id, k, count(*) AS n, list_sort(list(event_id))[1:10] AS ids FROM ev WHERE event_type = 'error' GROUP BY user_id, k HAVING count(*) >= 3")
def error_patterns(spark, sf):
    e = T.events(spark, sf).filter("event_type = 'error'")
    w = W.partitionBy("user_id", "k")
    e = e.withColumn("rn", F.row_number().over(w.orderBy("event_id"))).withColumn("n", F.count("*").over(w)).filter("n >= 3 and rn <= 10")
    return e.groupBy("user_id", "k").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("A04_pattern_report", E + f"""SELECT k, CASE WHEN value < 30 THEN 'low' WHEN value < 70 THEN 'medium' ELSE 'high' END AS severity, floor(({T.AS_OF} - sec) / {7 * DAY})::BIGINT AS week, count(*) AS n, min(sec) AS first, max(sec) AS last
FROM ev WHERE event_type = 'error' AND sec >= {T.AS_OF - 28 * DAY} GROUP BY ALL""")
def pattern_report(spark, sf):
    e = T.events(spark, sf).filter(f"event_type = 'error' and sec >= {T.AS_OF - 28 * DAY}")
    band = F.when(F.col("value") < 30, "low").when(F.col("value") < 70, "medium").otherwise("high")
    return e.groupBy("k", band.alias("severity"), F.floor((T.AS_OF - F.col("sec")) / (7 * DAY)).alias("week")).agg(F.count("*").alias("n"), F.min("sec").alias("first"), F.max("sec").alias("last"))


@query("A05_tag_frequency", K + "SELECT tag, count(*) AS n, max(created) AS last FROM (SELECT unnest(tags) AS tag, created FROM knowledge) WHERE tag LIKE 'src%' GROUP BY tag")
def tag_frequency(spark, sf):
    return T.knowledge(spark, sf).select(F.explode("tags").alias("tag"), "created").filter("tag like 'src%'").groupBy("tag").agg(F.count("*").alias("n"), F.max("created").alias("last"))


@query("A06_pattern_to_rule", E + "SELECT k, count(*) AS n, max_by(event_id, {'s': sec, 'e': event_id}) AS newest FROM ev WHERE event_type = 'error' AND k NOT IN (SELECT k FROM ev WHERE event_type = 'signup' AND value > 499) GROUP BY k HAVING count(*) >= 5")
def to_rule(spark, sf):
    e = T.events(spark, sf)
    ruled = e.filter("event_type = 'signup' and value > 499").select("k")
    return e.filter("event_type = 'error'").join(ruled, "k", "left_anti").groupBy("k").agg(F.count("*").alias("n"), F.max(F.struct("sec", "event_id"))["event_id"].alias("newest")).filter("n >= 5")


_RUNS = "count(*) FILTER (event_type IN ('purchase', 'error'))"


@query("A07_workflow_outcomes", E + "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS fail, floor(avg(value))::BIGINT AS avg_ms, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS rate FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def workflow(spark, sf):
    e = T.events(spark, sf).filter(F.col("event_type").isin("purchase", "error"))
    ok = F.count_if(F.col("event_type") == "purchase")
    g = e.groupBy("user_id").agg(F.count("*").alias("total"), ok.alias("ok"), F.count_if(F.col("event_type") == "error").alias("fail"), F.sum(F.col("value").cast("decimal(28,10)")).alias("s"), F.count("value").alias("n"), F.round(ok / F.count("*"), 6).alias("rate"))
    # exactly: a sum of doubles that ends below a whole mean would be floored to the number before
    mean = F.expr("cast((s - pmod(s, nullif(n, 0))) / nullif(n, 0) as bigint)")
    return g.select("user_id", "total", "ok", "fail", mean.alias("avg_ms"), "rate")


@query("A08_skill_status", E + "SELECT user_id, count(*) AS uses, CASE WHEN count(*) >= 10 AND count(*) FILTER (event_type = 'purchase') / count(*) >= 0.5 THEN 'mastered' WHEN count(*) >= 3 THEN 'active' ELSE 'new' END AS status FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def skills(spark, sf):
    e = T.events(spark, sf).filter(F.col("event_type").isin("purchase", "error")).groupBy("user_id").agg(F.count("*").alias("uses"), F.count_if(F.col("event_type") == "purchase").alias("ok"))
    status = F.when((F.col("uses") >= 10) & (F.col("ok") / F.col("uses") >= 0.5), "mastered").when(F.col("uses") >= 3, "active").otherwise("new")
    return e.select("user_id", "uses", status.alias("status"))


@query("A09_cross_project_patterns", "SELECT l_partkey, count(DISTINCT l_suppkey) AS projects, count(DISTINCT l_orderkey) AS records FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2 ORDER BY projects DESC, records DESC, l_partkey LIMIT 50")
def cross_project(spark, sf):
    g = T.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("projects"), F.count_distinct("l_orderkey").alias("records"))
    return g.filter("projects >= 2").orderBy(F.desc("projects"), F.desc("records"), "l_partkey").limit(50)


@query("A10_weekly_digest", E + f"SELECT 'type' AS kind, event_type AS name, count(*) AS n FROM ev WHERE sec >= {T.AS_OF - 7 * DAY} GROUP BY event_type UNION ALL (SELECT 'user', user_id::VARCHAR, count(*) AS n FROM ev WHERE sec >= {T.AS_OF - 7 * DAY} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5)")
def digest(spark, sf):
    e = T.events(spark, sf).filter(F.col("sec") >= T.AS_OF - 7 * DAY)
    users = e.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5)
    return e.groupBy(F.lit("type").alias("kind"), F.col("event_type").alias("name")).agg(F.count("*").alias("n")).union(users.select(F.lit("user"), F.col("user_id").cast("string"), "n"))


@query("A11_filter_savings", "SELECT lang, count(*) AS uses, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 1) AS mean FROM documents GROUP BY ROLLUP (lang)")
def savings(spark, sf):
    d = T.table(spark, sf, "documents").select("lang", "n_chars")
    return d.rollup("lang").agg(F.count("*").alias("uses"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 1).alias("mean"))


@query("A12_coverage", "SELECT round(100 * count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id), 1) AS pct FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark, sf):
    l = T.table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("hit"))
    return T.table(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").agg(F.round(100 * F.count_distinct("hit") / F.count_distinct("doc_id"), 1).alias("pct"))


@query("A13_queue_depth", E + "SELECT k, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM ev GROUP BY k")
def queue_depth(spark, sf):
    return T.events(spark, sf).groupBy("k").pivot("event_type", ["click", "error", "view"]).agg(F.count("event_id")).na.fill(0)


@query("A14_queue_percentiles", E + "SELECT user_id, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[least(floor(count(*) * 0.95)::INT + 1, count(*))] AS p95 FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) <= 100) GROUP BY user_id")
def queue_percentiles(spark, sf):
    last = R.top_per_group(T.events(spark, sf), ["user_id"], [F.desc("sec"), F.desc("event_id")], 100)
    v = last.groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"), F.count("*").cast("int").alias("n"))  # at most 100 a user
    pick = lambda p: F.element_at("v", F.least((F.floor(F.col("n") * p) + 1).cast("int"), F.col("n")))
    return v.select("user_id", pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query("A16_graph_counts", T.sql("links", "graph") + "SELECT weight, count(*) AS n, count(DISTINCT src) AS nodes, round(avg(weight), 3) AS mean FROM graph GROUP BY weight")
def graph_counts(spark, sf):
    return T.graph(spark, sf).groupBy("weight").agg(F.count("*").alias("n"), F.count_distinct("src").alias("nodes"), F.round(F.avg("weight"), 3).alias("mean"))


@query("A18_episode_outcomes", "SELECT o_orderstatus AS outcome, count(*) AS n, round(coalesce(avg(o_totalprice), 0), 3) AS impact FROM orders GROUP BY o_orderstatus")
def outcomes(spark, sf):
    return T.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 3).alias("impact"))


@query("A19_most_used", E + "SELECT event_type, count(*) AS n, max_by(user_id, {'v': value, 'u': user_id}) AS top_user FROM ev GROUP BY event_type")
def most_used(spark, sf):
    return T.events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.struct("value", "user_id"))["user_id"].alias("top_user"))


@query("A20_project_runs", "SELECT n_name, count(DISTINCT c_custkey) AS workflows, count(o_orderkey) AS runs FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def project_runs(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    o = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return n.join(c, "n_nationkey", "left").join(o, "c_custkey", "left").groupBy("n_name").agg(F.count_distinct("c_custkey").alias("workflows"), F.count("o_orderkey").alias("runs"))


@query("A21_summary_stats", E + "SELECT count(*) AS total, count(*) FILTER (k % 2 = 0) AS pending, count(*) FILTER (k % 2 <> 0) AS consumed FROM ev")
def summary_stats(spark, sf):
    return T.events(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.expr("k % 2 = 0")).alias("pending"), F.count_if(F.expr("k % 2 <> 0")).alias("consumed"))


@query("A22_activated_memory", T.sql("links") + "SELECT record, round(sum(CASE WHEN strength IS NULL OR strength = 0 THEN 1 ELSE strength END * (1.0 / (1 + node % 10))), 4) AS score FROM links GROUP BY record ORDER BY score DESC, record LIMIT 50")
def activated(spark, sf):
    s = F.when(F.col("strength").isNull() | (F.col("strength") == 0), 1.0).otherwise(F.col("strength"))
    g = T.links(spark, sf).groupBy("record").agg(F.round(F.sum(s * (1.0 / (1 + F.col("node") % 10))), 4).alias("score"))
    return g.orderBy(F.desc("score"), "record").limit(50)


@query("A23_max_strength", T.sql("links") + "SELECT node, max(strength) AS strength FROM links GROUP BY node")
def max_strength(spark, sf):
    return T.links(spark, sf).groupBy("node").agg(F.max("strength").alias("strength"))


@query("A24_conversation_signals", "SELECT conv_id, count(*) FILTER (text ILIKE '%that%') AS pos, count(*) FILTER (text ILIKE '%not%') AS neg, CASE WHEN count(*) FILTER (text ILIKE '%that%') + count(*) FILTER (text ILIKE '%not%') = 0 THEN 0.5 ELSE round(count(*) FILTER (text ILIKE '%that%') / (count(*) FILTER (text ILIKE '%that%') + count(*) FILTER (text ILIKE '%not%')), 6) END AS satisfaction FROM conversations WHERE role = 'user' GROUP BY conv_id")
def signals(spark, sf):
    c = T.table(spark, sf, "conversations").filter("role = 'user'")
    has = lambda w: F.count_if(F.contains(F.lower("text"), F.lit(w)))
    g = c.groupBy("conv_id").agg(has("that").alias("pos"), has("not").alias("neg"))
    return g.withColumn("satisfaction", F.when(F.expr("pos + neg = 0"), 0.5).otherwise(F.round(F.col("pos") / (F.col("pos") + F.col("neg")), 6)))


@query("A26_risk_score", E + "SELECT user_id, round(least(1, 1 - exp(-sum(value / 500 + CASE WHEN event_type = 'error' THEN 0.2 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.15 ELSE 0 END) / 3)), 6) AS risk FROM ev GROUP BY user_id")
def risk(spark, sf):
    sev = F.col("value") / 500 + F.when(F.col("event_type") == "error", 0.2).otherwise(0.0) + F.when(F.expr("k % 2 = 0"), 0.15).otherwise(0.0)
    return T.events(spark, sf).groupBy("user_id").agg(F.round(F.least(F.lit(1.0), 1 - F.exp(-F.sum(sev) / 3)), 6).alias("risk"))


@query("A27_percentiles", E + "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev GROUP BY event_type")
def percentiles(spark, sf):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return T.events(spark, sf).groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


_RANKS = """, r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev), g AS (SELECT user_id, min(rank) FILTER (k = 3) AS first FROM r GROUP BY user_id)
SELECT round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN first <= 10 THEN 1 ELSE 0 END), 6) AS r10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM g"""


@query("A28_recall_mrr", E.rstrip() + _RANKS)
def recall_mrr(spark, sf):
    r = T.events(spark, sf).withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    first = r.groupBy("user_id").agg(F.min(F.when(F.col("k") == 3, F.col("rank"))).alias("first"))
    return scores.recall_at(first, "first")


_ECE = """WITH p AS (SELECT doc_id, quality AS y, (doc_id * 37 % 100) / 100.0::DOUBLE AS p FROM labels), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM p GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM b"""


@query("A30_calibration_error", _ECE)
def ece(spark, sf):
    p = T.table(spark, sf, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("p"))
    return scores.calibration_error(p, "p", "y", 10)


@query("A31_competency_bands", E + "SELECT user_id, round(avg(value) / 500, 6) AS level, CASE WHEN avg(value) / 500 >= 0.8 THEN 'strong' WHEN avg(value) / 500 >= 0.5 THEN 'fair' ELSE 'weak' END AS band FROM ev GROUP BY user_id")
def bands(spark, sf):
    g = T.events(spark, sf).groupBy("user_id").agg((F.avg("value") / 500).alias("l"))
    return g.select("user_id", F.round("l", 6).alias("level"), F.when(F.col("l") >= 0.8, "strong").when(F.col("l") >= 0.5, "fair").otherwise("weak").alias("band"))


@query("A37_coverage_matrix", T.sql("links") + "SELECT record, list_sort(list(node)) AS nodes FROM links GROUP BY record HAVING count(*) >= 6")
def coverage_matrix(spark, sf):
    g = T.links(spark, sf).groupBy("record").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # an order's lines
    return g.filter(F.size("nodes") >= 6)


@query("A39_rank_masses", E + "SELECT user_id, event_id, round(CASE WHEN sum(greatest(value, 0)) OVER w > 0 THEN greatest(value, 0) / sum(greatest(value, 0)) OVER w * 0.9 ELSE 0 END, 9) AS mass FROM ev WINDOW w AS (PARTITION BY user_id)")
def masses(spark, sf):
    return scores.masses(T.events(spark, sf), "user_id", "value").select("user_id", "event_id", F.round("mass", 9).alias("mass"))


@query("A40_idle_active_projects", E + f"SELECT user_id, count(*) AS n, max(sec) AS last FROM ev GROUP BY user_id HAVING count(*) >= 60 AND max(sec) < {T.AS_OF - 2 * DAY}")
def idle_active(spark, sf):
    return T.events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.max("sec").alias("last")).filter(f"n >= 60 and last < {T.AS_OF - 2 * DAY}")


@query("A41_usage_profile", K + "SELECT tag, count(*) AS n FROM (SELECT lower(unnest(tags)) AS tag FROM knowledge) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def usage(spark, sf):
    return T.knowledge(spark, sf).select(F.explode(F.transform("tags", F.lower)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


_CTX = f"""SELECT user_id, round(0.4 * n_day / max(n_day) OVER () + 0.35 * n_recent / greatest(max(n_recent) OVER (), 1), 6) AS score FROM (SELECT user_id,
count(*) FILTER ((floor(sec / {DAY}) % 7)::INT = {(T.AS_OF // DAY) % 7}) AS n_day, count(*) FILTER (sec >= {T.AS_OF - 3 * DAY}) AS n_recent FROM ev GROUP BY user_id)"""


@query("A42_next_context", E + _CTX)
def next_context(spark, sf):
    same = F.pmod(F.floor(F.col("sec") / DAY), F.lit(7)) == (T.AS_OF // DAY) % 7
    g = T.events(spark, sf).groupBy("user_id").agg(F.count_if(same).alias("d"), F.count_if(F.col("sec") >= T.AS_OF - 3 * DAY).alias("r"))
    top = g.agg(F.max("d").alias("md"), F.greatest(F.max("r"), F.lit(1)).alias("mr"))
    return g.join(F.broadcast(top)).select("user_id", F.round(0.4 * F.col("d") / F.col("md") + 0.35 * F.col("r") / F.col("mr"), 6).alias("score"))  # one row of maxima


@query("A43_velocity", E + f"SELECT user_id, round(count(*) / 14, 6) AS velocity, CASE WHEN count(*) / 14 < 1 THEN 'at_risk' ELSE 'ok' END AS state FROM ev WHERE sec >= {T.AS_OF - 14 * DAY} GROUP BY user_id")
def velocity(spark, sf):
    g = T.events(spark, sf).filter(F.col("sec") >= T.AS_OF - 14 * DAY).groupBy("user_id").agg((F.count("*") / 14).alias("v"))
    return g.select("user_id", F.round("v", 6).alias("velocity"), F.when(F.col("v") < 1, "at_risk").otherwise("ok").alias("state"))


@query("A44_ratio_bands", E + "SELECT user_id, CASE WHEN r >= 0.7 THEN 'high' WHEN r >= 0.4 THEN 'good' WHEN r >= 0.2 THEN 'fair' WHEN r IS NULL THEN 'none' ELSE 'low' END AS band FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0) AS r FROM ev GROUP BY user_id)")
def ratio_bands(spark, sf):
    n = F.count_if(F.col("event_type").isin("purchase", "error"))
    g = T.events(spark, sf).groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") / F.nullif(n, F.lit(0))).alias("r"))
    r = F.col("r")
    return g.select("user_id", F.when(r >= 0.7, "high").when(r >= 0.4, "good").when(r >= 0.2, "fair").when(r.isNull(), "none").otherwise("low").alias("band"))


@query("A46_operation_counters", E + "SELECT event_type AS name, count(*) AS calls, round(sum(value), 4) AS total FROM ev GROUP BY event_type")
def counters(spark, sf):
    return T.events(spark, sf).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))


@query("A17_temporal_stats", T.sql("ev", "facts") + ", c AS (SELECT s, valid_from, fact_id, lead(valid_from) OVER (PARTITION BY s ORDER BY valid_from, fact_id) AS valid_to FROM facts) SELECT count(*) AS total, count(*) FILTER (valid_to IS NULL) AS current, count(valid_to) AS closed, count(DISTINCT s) AS subjects FROM c")
def temporal_stats(spark, sf):
    c = T.facts(spark, sf).withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("s").orderBy("valid_from", "fact_id")))
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count("valid_to").alias("closed"), F.count_distinct("s").alias("subjects"))


@query("A25_impact_estimate", E + "SELECT event_id, round(least(1, greatest(0, 0.5 * value / 500 + 0.3 * (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) - 0.2 * (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END))), 3) AS impact FROM ev")
def impact(spark, sf):
    raw = 0.5 * F.col("value") / 500 + 0.3 * F.when(F.col("event_type") == "purchase", 1).otherwise(0) - 0.2 * F.when(F.col("event_type") == "error", 1).otherwise(0)
    return T.events(spark, sf).select("event_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 3).alias("impact"))


@query("A33_error_texts", E + "SELECT k, count(*) AS n, string_agg(DISTINCT user_id::VARCHAR, ' ' ORDER BY user_id::VARCHAR) AS users FROM ev WHERE event_type = 'error' AND value > 20 GROUP BY k HAVING count(*) >= 3")
def error_texts(spark, sf):
    e = T.events(spark, sf).filter("event_type = 'error' and value > 20")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), " ").alias("users")).filter("n >= 3")


@query("A35_cache_by_space", "SELECT label AS space, count(*) AS n, sum(vec_id)::BIGINT AS hits FROM embeddings GROUP BY label")
def cache_by_space(spark, sf):
    return T.table(spark, sf, "embeddings").groupBy(F.col("label").alias("space")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("hits"))


@query("A45_regression_gate", E + "SELECT CASE WHEN avg(value) FILTER (k >= 5) - avg(value) FILTER (k < 5) >= -5 THEN 'PASS' ELSE 'FAIL' END AS gate FROM ev")
def gate(spark, sf):
    g = T.events(spark, sf).agg(F.avg(F.when(F.col("k") >= 5, F.col("value"))).alias("a"), F.avg(F.when(F.col("k") < 5, F.col("value"))).alias("b"))
    return g.select(F.when(F.col("a") - F.col("b") >= -5, "PASS").otherwise("FAIL").alias("gate"))
