"""Queries: scans, filters, projections, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.plans.registry import query
from lodestar.sources import tables as T

K = T.sql("knowledge")
_ACTIVE = K + "SELECT {} FROM knowledge WHERE status = 'active'"


@query("S01_active_scan", _ACTIVE.format("id, project, type"))
def active_scan(spark, sf):
    return R.active(T.knowledge(spark, sf)).select("id", "project", "type")


@query("S03_json_export", _ACTIVE.format("id, type, array_to_string(tags, ',') AS tags, '2.1' AS version"))
def json_export(spark, sf):
    return R.active(T.knowledge(spark, sf)).select("id", "type", F.array_join("tags", ",").alias("tags"), F.lit("2.1").alias("version"))


@query("S04_export_by_type", K + "SELECT type, count(*) AS n, min(created) AS first, max(created) AS last FROM knowledge WHERE status = 'active' GROUP BY type")
def export_by_type(spark, sf):
    return R.active(T.knowledge(spark, sf)).groupBy("type").agg(F.count("*").alias("n"), F.min("created").alias("first"), F.max("created").alias("last"))


_WIKI = """, ranked AS (SELECT project, id, CASE WHEN type = 'en' THEN 'decisions' WHEN type = 'de' THEN 'solutions' WHEN type = 'fr' THEN 'conventions' ELSE 'changes' END AS section,
  CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r, created FROM knowledge WHERE status = 'active')
SELECT project, section, id, row_number() OVER (PARTITION BY project, section ORDER BY r, created DESC, id) AS rn FROM ranked
QUALIFY rn <= 3"""


@query("S05_wiki_sections", K.rstrip() + _WIKI)
def wiki(spark, sf):
    k = R.active(T.knowledge(spark, sf)).select("project", "id", "type", "importance", "created")
    section = F.when(F.col("type") == "en", "decisions").when(F.col("type") == "de", "solutions").when(F.col("type") == "fr", "conventions").otherwise("changes")
    k = k.withColumn("section", section).withColumn("r", R.importance_rank())
    return R.top_per_group(k, ["project", "section"], [F.col("r"), F.desc("created"), F.col("id")], 3).select("project", "section", "id", "rn")


@query("S06_changed_since", K + f"SELECT id, project, type FROM knowledge WHERE created > {T.BASE + 50000} OR confirmed > {T.BASE + 200000}")
def changed_since(spark, sf):
    return T.knowledge(spark, sf).filter((F.col("created") > T.BASE + 50000) | (F.col("confirmed") > T.BASE + 200000)).select("id", "project", "type")


@query("S22_intent_dedup", """WITH i AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations WHERE role = 'user' AND text IS NOT NULL),
k AS (SELECT conv_id, h, min(turn) AS turn FROM i GROUP BY ALL)
SELECT conv_id, turn, h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM k""")
def intents(spark, sf):
    i = T.table(spark, sf, "conversations").filter("role = 'user' and text is not null").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    k = i.groupBy("conv_id", "h").agg(F.min("turn").alias("turn"))
    return k.withColumn("turn_index", (F.row_number().over(R.W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long"))


@query("S25_reembed_load", _ACTIVE.format("id, length(content) AS n_chars"))
def reembed(spark, sf):
    return R.active(T.knowledge(spark, sf)).select("id", F.length("content").cast("long").alias("n_chars"))


@query("P01_scope_filter", K + "SELECT id, project, type, branch FROM knowledge WHERE project = 'src1' AND type IN ('en', 'de') AND (branch = 'b1' OR branch = '')")
def scope(spark, sf):
    return R.scoped(T.knowledge(spark, sf), "src1", ("en", "de"), "b1").select("id", "project", "type", "branch")


@query("P02_detail_projection", K + "SELECT id, substr(content, 1, 80) AS shown, length(substr(content, 1, 80)) // 4 AS n_tokens FROM knowledge")
def details(spark, sf):
    return R.detail(T.knowledge(spark, sf), "compact")


_AUTO = """SELECT item_id, CASE WHEN contains(text, 'http') OR contains(text, '/') THEN 'full' WHEN n >= 10 THEN 'full' WHEN n <= 3 THEN 'compact' ELSE 'summary' END AS level
FROM (SELECT *, len(string_split(text, ' ')) AS n FROM benchmark)"""


@query("P03_auto_detail", _AUTO)
def auto_detail(spark, sf):
    n = F.size(F.split("text", " "))
    path = F.contains("text", F.lit("http")) | F.contains("text", F.lit("/"))
    return T.table(spark, sf, "benchmark").select("item_id", F.when(path | (n >= 10), "full").when(n <= 3, "compact").otherwise("summary").alias("level"))


@query("P04_tag_search", K + "SELECT id, created FROM knowledge WHERE len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0")
def tag_search(spark, sf):
    return R.has_tag(T.knowledge(spark, sf), "SRC1").select("id", "created")


@query("P05_enrichment_filter", K + "SELECT id FROM knowledge WHERE list_has_any(tags, ['en', 'fr']) AND importance = 'high'")
def enrichment(spark, sf):
    wanted = F.array(F.lit("en"), F.lit("fr"))
    return T.knowledge(spark, sf).filter(F.arrays_overlap("tags", wanted) & (F.col("importance") == "high")).select("id")


@query("P06_index_mode", K + "SELECT id, substr(content, 1, 80) AS title, confidence AS score, type, project, created FROM knowledge WHERE status = 'active' ORDER BY score DESC, id LIMIT 50")
def index_mode(spark, sf):
    k = R.active(T.knowledge(spark, sf))
    return k.select("id", F.substring("content", 1, 80).alias("title"), F.col("confidence").alias("score"), "type", "project", "created").orderBy(F.desc("score"), "id").limit(50)


@query("P07_decisions_only", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') IS NOT NULL")
def decisions(spark, sf):
    e = T.events(spark, sf)
    return e.filter((F.col("event_type") == "purchase") & F.col("k").isNotNull()).select("event_id", "k")


@query("P09_path_match", K + "SELECT id FROM knowledge WHERE type = 'en' AND (list_contains(tags, 'src3') OR contains(content, 'src3'))")
def path_match(spark, sf):
    k = T.knowledge(spark, sf).filter("type = 'en'")
    return k.filter(F.array_contains("tags", "src3") | F.contains("content", F.lit("src3"))).select("id")


@query("P10_severity_map", K + "SELECT id, CASE type WHEN 'en' THEN 'high' WHEN 'de' THEN 'medium' ELSE 'low' END AS severity FROM knowledge WHERE list_contains(tags, 'src2')")
def severity(spark, sf):
    m = F.create_map(*[F.lit(x) for x in ("en", "high", "de", "medium")])
    return T.knowledge(spark, sf).filter(F.array_contains("tags", "src2")).select("id", F.coalesce(F.element_at(m, F.col("type")), F.lit("low")).alias("severity"))


@query("P11_rule_scope", K + "SELECT id, recall_count, confidence FROM (SELECT * FROM knowledge WHERE project IN ('src0', 'src1', 'src2') ORDER BY recall_count DESC, confidence DESC, id LIMIT 20) WHERE branch = '' OR branch = 'b1'")
def rule_scope(spark, sf):
    k = T.knowledge(spark, sf).filter(F.col("project").isin("src0", "src1", "src2")).select("id", "recall_count", "confidence", "branch")
    top = k.orderBy(F.desc("recall_count"), F.desc("confidence"), "id").limit(20)
    return top.filter("branch = '' or branch = 'b1'").select("id", "recall_count", "confidence")


@query("P12_pagination", K + "SELECT id, created, (SELECT greatest(1, ceil(count(*) / 50)) FROM knowledge WHERE status = 'active')::BIGINT AS pages FROM knowledge WHERE status = 'active' ORDER BY created DESC LIMIT 50 OFFSET 50")
def pagination(spark, sf):
    k = R.active(T.knowledge(spark, sf)).select("id", "created")
    pages = k.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 50)).alias("pages"))
    return R.page(k, [F.desc("created")], 2, 50).crossJoin(F.broadcast(pages))  # one row of totals


@query("P13_intent_search", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 50")
def intent_search(spark, sf):
    c = T.table(spark, sf, "conversations").filter(F.contains(F.lower("text"), F.lit("the")) & (F.col("role") == "user"))
    return c.select("conv_id", "turn").orderBy(F.desc("conv_id"), F.desc("turn")).limit(50)


@query("P14_idle_projects", T.sql("ev") + f"SELECT user_id, max(sec) AS last_touched FROM ev GROUP BY user_id HAVING max(sec) < {T.AS_OF} - 1800 * 48")
def idle(spark, sf):
    return T.events(spark, sf).groupBy("user_id").agg(F.max("sec").alias("last_touched")).filter(F.col("last_touched") < T.AS_OF - 1800 * 48)


@query("P15_redaction", f"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{R.SENSITIVE[0]}', '[REDACTED]', 'g'), '{R.SENSITIVE[1]}', '[REDACTED]', 'g'), '{R.SENSITIVE[2].replace("{1,3}", "{1,3}")}', '[REDACTED]', 'g'), '{R.SENSITIVE[3]}', '[REDACTED]', 'g') AS clean FROM documents)
SELECT doc_id, length(clean) AS n_chars, clean <> text AS redacted, md5(clean) AS clean_md5 FROM r""")
def redaction(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "text", R.redact(F.col("text")).alias("clean"))
    return d.select("doc_id", F.length("clean").cast("long").alias("n_chars"), (F.col("clean") != F.col("text")).alias("redacted"), F.md5("clean").alias("clean_md5"))


_PRIVATE = "'note <private>' || c_name || '</private> kept <PRIVATE>x</PRIVATE>' || c_mktsegment"


@query("P16_private_sections", f"SELECT c_custkey, regexp_replace({_PRIVATE}, '(?is)<private>.*?</private>', '', 'g') AS clean, len(regexp_extract_all({_PRIVATE}, '(?is)<private>.*?</private>')) AS n FROM customer")
def private(spark, sf):
    text = F.concat(F.lit("note <private>"), F.col("c_name"), F.lit("</private> kept <PRIVATE>x</PRIVATE>"), F.col("c_mktsegment"))
    c = T.table(spark, sf, "customer").select("c_custkey", text.alias("t"))
    return c.select("c_custkey", R.strip_private(F.col("t")).alias("clean"), F.regexp_count("t", F.lit("(?is)<private>.*?</private>")).cast("long").alias("n"))


@query("P29_rare_tags", K + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM knowledge WHERE status = 'active') GROUP BY tag HAVING count(*) < 60")
def rare_tags(spark, sf):
    return R.active(T.knowledge(spark, sf)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).filter("n < 60")


@query("P30_deadlines", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS due FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-04' AND o_orderstatus <> 'F'")
def deadlines(spark, sf):
    o = T.table(spark, sf, "orders").filter("o_orderdate between TIMESTAMP_NTZ '1998-01-01 00:00:00' and TIMESTAMP_NTZ '1998-01-04 00:00:00' and o_orderstatus <> 'F'")
    return o.select("o_orderkey", T.epoch("o_orderdate").alias("due"))


_ROUTE = "CASE WHEN confidence >= 0.7 THEN 'ANSWER' WHEN confidence >= 0.5 THEN 'CAVEAT' WHEN confidence >= 0.2 AND id % 5 < 4 THEN 'SEARCH_MORE' ELSE 'IDK' END"


@query("P31_abstention_route", K + f"SELECT id, {_ROUTE} AS route FROM knowledge")
def route(spark, sf):
    c = F.col("confidence")
    r = F.when(c >= 0.7, "ANSWER").when(c >= 0.5, "CAVEAT").when((c >= 0.2) & (F.col("id") % 5 < 4), "SEARCH_MORE").otherwise("IDK")
    return T.knowledge(spark, sf).select("id", r.alias("route"))


@query("T02_decisions_by_importance", K + "SELECT id, importance, created FROM knowledge ORDER BY CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, created DESC, id LIMIT 30")
def by_importance(spark, sf):
    return T.knowledge(spark, sf).select("id", "importance", "created").orderBy(R.importance_rank(), F.desc("created"), "id").limit(30)


@query("T07_lru_vacuum", K + "SELECT id, confirmed FROM knowledge QUALIFY row_number() OVER (ORDER BY confirmed DESC, id DESC) <= 100")
def vacuum(spark, sf):
    return T.knowledge(spark, sf).select("id", "confirmed").orderBy(F.desc("confirmed"), F.desc("id")).limit(100)


@query("T08_latest_unconsumed", T.sql("ev") + "SELECT user_id, max_by(event_id, {'s': sec, 'e': event_id}) AS event_id FROM ev WHERE k % 2 = 0 GROUP BY user_id")
def unconsumed(spark, sf):
    return T.events(spark, sf).filter("k % 2 = 0").groupBy("user_id").agg(F.max(F.struct("sec", "event_id"))["event_id"].alias("event_id"))


@query("U01_unlinked_nodes", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL UNION SELECT ps FROM (SELECT l_suppkey AS ps FROM lineitem WHERE l_quantity > 49.5))")
def unlinked(spark, sf):
    li = T.table(spark, sf, "lineitem")
    ends = li.select(F.col("l_partkey").alias("p_partkey")).union(li.filter("l_quantity > 49.5").select("l_suppkey")).distinct()
    return T.table(spark, sf, "part").select("p_partkey").join(ends, "p_partkey", "left_anti")


@query("U02_both_directions", T.sql("links", "graph") + "SELECT a AS node, max(weight) AS best, count(*) AS degree FROM (SELECT src AS a, dst AS b, weight FROM graph UNION ALL SELECT dst, src, weight FROM graph) GROUP BY a")
def both_directions(spark, sf):
    return R.undirected(T.graph(spark, sf)).groupBy(F.col("a").alias("node")).agg(F.max("weight").alias("best"), F.count("*").alias("degree"))


@query("U03_constant_peers", T.sql("relations") + "SELECT from_id AS id, to_id AS peer, 0.5::DOUBLE AS weight FROM relations UNION ALL SELECT to_id, from_id, 0.5 FROM relations")
def constant_peers(spark, sf):
    return R.undirected(T.relations(spark, sf).select("from_id", "to_id"), "from_id", "to_id").select(F.col("a").alias("id"), F.col("b").alias("peer"), F.lit(0.5).alias("weight"))


@query("U04_common_reach", T.sql("ev") + "SELECT event_type, k FROM ev WHERE user_id = 1 INTERSECT SELECT event_type, k FROM ev WHERE user_id = 2")
def common_reach(spark, sf):
    e = T.events(spark, sf).select("user_id", "event_type", "k")
    return e.filter("user_id = 1").drop("user_id").intersect(e.filter("user_id = 2").drop("user_id"))


@query("U07_distinct_branches", K + "SELECT branch FROM knowledge UNION SELECT o_orderstatus FROM orders")
def branches(spark, sf):
    return T.knowledge(spark, sf).select("branch").union(T.table(spark, sf, "orders").select("o_orderstatus")).distinct()


@query("U08_delta_with_endpoints", T.sql("relations") + """, d AS (SELECT * FROM relations WHERE from_id > 14000)
SELECT to_id AS id, 'missing' AS state FROM d WHERE to_id NOT IN (SELECT from_id FROM d) UNION SELECT from_id, 'new' FROM d""".strip())
def delta(spark, sf):
    d = T.relations(spark, sf).filter("from_id > 14000")
    missing = d.select(F.col("to_id").alias("id")).join(d.select(F.col("from_id").alias("id")), "id", "left_anti")
    return missing.withColumn("state", F.lit("missing")).union(d.select("from_id", F.lit("new"))).distinct()


@query("U09_display_edges", K + """, e AS (SELECT id AS a, lead(id) OVER (PARTITION BY project ORDER BY created, id) AS b, 'same_project' AS kind FROM knowledge
UNION ALL SELECT id, lead(id) OVER (PARTITION BY type, importance ORDER BY created, id), 'shared_tag' FROM knowledge)
SELECT least(a, b) AS a, greatest(a, b) AS b, min(kind) AS kind FROM e WHERE b IS NOT NULL GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY least(a, b), greatest(a, b)"))
def display_edges(spark, sf):
    k = T.knowledge(spark, sf).select("id", "project", "type", "importance", "created")
    nxt = lambda *keys: F.lead("id").over(R.W.partitionBy(*keys).orderBy("created", "id"))
    e = k.select("id", nxt("project").alias("b"), F.lit("same_project").alias("kind")).union(k.select("id", nxt("type", "importance"), F.lit("shared_tag"))).filter("b is not null")
    return e.groupBy(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).agg(F.min("kind").alias("kind"))
