"""Queries: lexical, vector and hybrid retrieval."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F

from lodestar.operators import ranking
from lodestar.operators import retrieval as F_
from lodestar.plans.registry import query
from lodestar.sources import tables as T

_BM25 = r"""q AS MATERIALIZED (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM benchmark) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '\w+') AS ts FROM documents), n AS MATERIALIZED (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS MATERIALIZED (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS terms FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY item_id, doc_id)"""
_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0)"


def _bm25(spark, sf):
    return F_.bm25(T.table(spark, sf, "documents"), "doc_id", "text", T.table(spark, sf, "benchmark"), "item_id", "text")


def _vectors(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query("F01_keyword_tier", f"WITH {_BM25} SELECT item_id, doc_id, round(greatest(0.5, 2 * score / max(score) OVER (PARTITION BY item_id)), 6) AS score FROM (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 30)")
def keyword(spark, sf):
    b = _bm25(spark, sf).withColumn("r", F.round("score", 9))
    top = F_.best(b, "item_id", "doc_id", 30, "r")
    return top.select("item_id", "doc_id", F.round(F.greatest(F.lit(0.5), 2 * F.col("score") / F.max("score").over(F_.W.partitionBy("item_id"))), 6).alias("score"))


@query("F02_bm25", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM bm")
def bm25(spark, sf):
    return _bm25(spark, sf).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("F15_all_terms", f"WITH {_BM25} SELECT item_id, doc_id, terms FROM bm WHERE terms = (SELECT count(*) FROM q WHERE q.item_id = bm.item_id)")
def all_terms(spark, sf):
    q = T.table(spark, sf, "benchmark").select("item_id", F.size(F.array_distinct(F_.tokens(F.col("text")))).alias("n"))
    return _bm25(spark, sf).join(q, "item_id").filter("terms = n").select("item_id", "doc_id", "terms")


@query("F04_like_score", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'que')::INT) AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'tion') OR contains(lower(text), 'que')")
def like(spark, sf):
    words = F.array(*map(F.lit, ("the", "tion", "que")))
    hits = F.aggregate(words, F.lit(0), lambda s, w: s + F.contains(F.lower("text"), w).cast("int"))
    return T.table(spark, sf, "documents").select("doc_id", hits.alias("score")).filter("score > 0")


@query("F05_fuzzy_tier")
def fuzzy(spark, sf):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    k = T.knowledge(spark, sf).orderBy(F.desc("confirmed"), "id").limit(250).select("id", F.substring("content", 1, 200).alias("head"))
    k = k.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = T.table(spark, sf, "benchmark").select("item_id", F.substring("text", 1, 200).alias("q"))
    s = k.join(F.broadcast(q)).withColumn("score", ratio("q", "head") * 0.6)  # the 250 last confirmed, every stated query
    return s.filter("score > 0.05").select("item_id", "id", F.round("score", 6).alias("score"))


_HYBRID = f"""WITH {_BM25}, {_VEC.replace("WHERE vec_id % 100 = 0", "WHERE vec_id IN (SELECT item_id FROM benchmark)")},
t AS (SELECT item_id, doc_id AS id, 'fts' AS tier, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM bm UNION ALL
SELECT qid, id, 'semantic', row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(v, q), 9) DESC, id) FROM v, qv),
f AS (SELECT item_id, id, sum(CASE tier WHEN 'fts' THEN 1.0 ELSE 1.2 END / (60 + rn)) AS score FROM t WHERE rn <= 50 GROUP BY item_id, id),
k AS (SELECT doc_id AS id, {T.BASE} + doc_id * 60 + (doc_id % 5) * 86400 AS confirmed, doc_id % 7 AS recall_count, doc_id % 4 AS i FROM documents WHERE doc_id % 11 <> 0),
s AS (SELECT item_id, id, round(score * (greatest(0.01, exp(-floor(({T.AS_OF} - confirmed) / 86400) * ln(2) / 90)) + least(recall_count * 0.05, 0.3)) * ([1.5, 1.2, 1.0, 0.8])[i + 1]::DOUBLE, 9) AS score FROM f JOIN k USING (id))
SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"""


@query("F07_hybrid_search", _HYBRID)
def hybrid(spark, sf):
    e = T.table(spark, sf, "embeddings")
    items = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    q = e.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))  # one a stated query
    near = F_.nearest_blocks(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 50, 9).select(F.col("qid").alias("item_id"), "id", F.round("score", 9).alias("score"), "rank")
    lexical = _bm25(spark, sf).select("item_id", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    tiers = F_.best(lexical, "item_id", "id", 50).withColumn("w", F.lit(1.0)).unionByName(near.withColumn("w", F.lit(1.2)))
    fused = tiers.groupBy("item_id", "id").agg(F.sum(F.col("w") / (60 + F.col("rank"))).alias("fused"))
    k = T.knowledge(spark, sf).filter("status = 'active'").select("id", "confirmed", "recall_count", "importance")
    s = ranking.final(fused.join(k, "id"), "fused", T.AS_OF).select("item_id", "id", F.round("score", 9).alias("score"))
    return F_.best(s, "item_id", "id", 10).select("item_id", "id", "score", "rank")


@query("F14_tier_explain", f"WITH {_BM25}, {_VEC.replace('WHERE vec_id % 100 = 0', 'WHERE vec_id IN (SELECT item_id FROM benchmark)')} SELECT 'fts' AS tier, item_id, list(doc_id ORDER BY r) AS ids FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm) WHERE r <= 5 GROUP BY item_id UNION ALL SELECT 'semantic', qid, list(id ORDER BY r) FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(v, q), 9) DESC, id) AS r FROM v, qv) WHERE r <= 5 GROUP BY qid")
def explain(spark, sf):
    e = T.table(spark, sf, "embeddings")
    q = e.join(T.table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    near = F_.nearest_blocks(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 5, 9).select(F.lit("semantic").alias("tier"), F.col("qid").alias("item_id"), "id", F.round("score", 9).alias("score"), "rank")
    fts = _bm25(spark, sf).select(F.lit("fts").alias("tier"), "item_id", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    both = F_.best(fts, "item_id", "id", 5).unionByName(near)
    return both.groupBy("tier", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))


@query("F06_episode_retrieval", f"WITH {_BM25} SELECT item_id, source, max(round(score, 6)) AS score FROM bm JOIN documents USING (doc_id) GROUP BY item_id, source")
def episodes(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "source")
    return _bm25(spark, sf).join(d, "doc_id").groupBy("item_id", "source").agg(F.max(F.round("score", 6)).alias("score"))


@query("F11_query_variants", "SELECT item_id, unnest([text, lower(text), array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) > 4), ' ')]) AS variant FROM benchmark")
def variants(spark, sf):
    words = F.array_join(F.filter(F.split("text", " "), lambda w: F.length(w) > 4), " ")
    return T.table(spark, sf, "benchmark").select("item_id", F.explode(F.array("text", F.lower("text"), words)).alias("variant"))


@query("F12_entity_candidates", "SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS entity FROM benchmark")
def entities(spark, sf):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)))
    return T.table(spark, sf, "benchmark").select("item_id", F.explode(found).alias("entity"))


@query("V02_exact_cosine", f"WITH {_VEC} SELECT qid, id, round(list_cosine_similarity(v, q), 6) AS score FROM v, qv QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(v, q), 9) DESC, id) <= 10")
def exact(spark, sf):
    v, q = _vectors(spark, sf)
    return F_.nearest_blocks(v, q, 10, 9).select("qid", "id", F.round("score", 6).alias("score"))


_BITS = "list_sum(list_transform(range(1, 65), lambda i: ((v[i] > 0) <> (q[i] > 0))::INT))"


@query("V01_two_phase_search", f"WITH {_VEC}, h AS (SELECT qid, id, v, q, row_number() OVER (PARTITION BY qid ORDER BY {_BITS}, id) AS r FROM v, qv) SELECT qid, id, round(list_cosine_similarity(v, q), 6) AS score FROM h WHERE r <= 50 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(v, q) DESC, id) <= 5")
def two_phase(spark, sf):
    v, q = _vectors(spark, sf)
    return F_.two_phase(v, q, 50, 5).select("qid", "id", F.round("score", 6).alias("score"))


@query("V03_multi_representation", "WITH r AS (SELECT vec_id AS id, h, (embedding::DOUBLE[])[1 + 32 * h : 32 + 32 * h] AS v FROM embeddings, (VALUES (0), (1)) t(h)), s AS (SELECT q.id AS qid, r.id, r.h, row_number() OVER (PARTITION BY q.id, r.h ORDER BY round(list_cosine_similarity(r.v, q.v), 9) DESC, r.id) AS rn FROM r JOIN r q ON q.h = r.h AND q.id % 100 = 0) SELECT qid, id, round(sum(1.0 / (60 + rn)), 9) AS score FROM s WHERE rn <= 100 GROUP BY qid, id")
def multi(spark, sf):
    e = T.table(spark, sf, "embeddings")
    near = []
    for h in (0, 1):
        r = e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1 + 32 * h, 32).alias("v"))
        near.append(F_.nearest_blocks(r, r.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), 100, 9).select("qid", "id", "rank"))
    return near[0].union(near[1]).groupBy("qid", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))


@query("V04_binary_quantise", "SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: (embedding[i] > 0)::INT))::INT AS ones FROM embeddings")
def quantise(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", F_.sign_bits("embedding").alias("b"))
    return e.select("vec_id", F.aggregate("b", F.lit(0), lambda s, w: s + F.bit_count(w)).alias("ones"))


@query("V06_tag_normalisation", "SELECT p_partkey, list_distinct([lower(p_brand), lower(p_type)]) AS tags FROM part".replace("list_distinct([lower(p_brand), lower(p_type)])", "[lower(p_brand), lower(p_type)]"))
def tags(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", F.array_distinct(F.array(F.lower("p_brand"), F.lower("p_type"))).alias("tags"))


@query("V07_entity_best_match", f"WITH {_VEC}, s AS (SELECT a.vec_id AS id, b.vec_id AS match, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id) SELECT id, max_by(match, (sim * 1000000)::BIGINT * 1000000 - match) AS match, max(sim) AS sim FROM s WHERE sim >= 0.3 GROUP BY id")
def entity_match(spark, sf):
    from lodestar.operators.similarity import cosine_join

    p = cosine_join(T.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.2999995, group="label").filter("sim >= 0.3")
    return p.groupBy(F.col("b").alias("id")).agg(F.max(F.struct("sim", (-F.col("a")).alias("m"))).alias("x")).select("id", (-F.col("x.m")).alias("match"), "x.sim")


_NAME = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("V08_resolve_cascade", f"""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN c_name ELSE replace(c_name, '#', '--') END AS alias FROM customer)
SELECT a.c_custkey, c.c_custkey AS found, CASE WHEN c.c_custkey IS NULL THEN 'create' WHEN a.alias = c.c_name THEN 'exact' ELSE 'alias' END AS stage FROM a LEFT JOIN customer c ON {_NAME.format('a.alias')} = {_NAME.format('c.c_name')}""")
def resolve(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", "c_name")
    i = F.col("c_custkey")
    alias = F.when(i % 3 == 0, F.upper("c_name")).when(i % 3 == 1, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("--")))
    a = c.select("c_custkey", alias.alias("alias")).withColumn("n", F_.normal_name("alias"))
    k = c.select(i.alias("found"), "c_name", F_.normal_name("c_name").alias("n"))
    stage = F.when(F.col("found").isNull(), "create").when(F.col("alias") == F.col("c_name"), "exact").otherwise("alias")
    return a.join(k, "n", "left").select("c_custkey", "found", stage.alias("stage"))


@query("V09_surface_normalise", f"SELECT p_partkey, {_NAME.format('p_name')} AS name FROM part")
def surface(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", F_.normal_name("p_name").alias("name"))


@query("V10_merged_canonicals", f"SELECT {_NAME.format('p_type')} AS name, min(p_partkey) AS canonical, count(*) AS aliases FROM part GROUP BY 1")
def merged(spark, sf):
    return T.table(spark, sf, "part").groupBy(F_.normal_name("p_type").alias("name")).agg(F.min("p_partkey").alias("canonical"), F.count("*").alias("aliases"))


@query("V11_levenshtein_ratio", "SELECT a.n_name AS a, b.n_name AS b, round(CASE WHEN 2 * least(length(a.n_name), length(b.n_name)) < greatest(length(a.n_name), length(b.n_name)) THEN 0 ELSE 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) END, 6) AS ratio FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def levenshtein(spark, sf):
    n = T.table(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name")
    j = n.select("n_regionkey", F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_nationkey").alias("j"), F.col("n_name").alias("b")), "n_regionkey").filter("i < j")
    return j.select("a", "b", F.round(F_.levenshtein_ratio("a", "b"), 6).alias("ratio"))


@query("V13_workflow_prediction", T.sql("ev") + "SELECT user_id, round((count(*) FILTER (event_type = 'purchase') + 1) / (count(*) + 2), 6) AS p, round(least(0.95, count(*) / (count(*) + 5)), 6) AS confidence FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def prediction(spark, sf):
    n, ok = F.count("*"), F.count_if(F.col("event_type") == "purchase")
    return T.events(spark, sf).filter("event_type in ('purchase', 'error')").groupBy("user_id").agg(F.round((ok + 1) / (n + 2), 6).alias("p"), F.round(F.least(F.lit(0.95), n / (n + 5)), 6).alias("confidence"))


@query("C11_iterative_retrieval", f"WITH {_BM25}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM bm) SELECT item_id, doc_id, ((rn - 1) // 5 + 1)::INT AS round FROM r WHERE rn <= 20")
def iterative(spark, sf):
    b = _bm25(spark, sf).select("item_id", "doc_id", F.round("score", 9).alias("score"))
    return F_.best(b, "item_id", "doc_id", 20).select("item_id", "doc_id", (F.floor((F.col("rank") - 1) / 5) + 1).cast("int").alias("round"))


@query("C03_embedding_cache", "SELECT sha256(vec_id::VARCHAR || '|' || label) AS key, vec_id FROM embeddings")
def cache(spark, sf):
    return T.table(spark, sf, "embeddings").select(F.sha2(F.concat_ws("|", "vec_id", "label"), 256).alias("key"), "vec_id")


