"""Queries: streams and event-folded state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.plans.registry import query
from lodestar.sources import tables as T
from lodestar.streaming import engine as S

E = T.sql("ev")


def _events(spark, sf, files=None):
    path = f"{sf}/events.parquet"
    e = S.source(spark, path, spark.read.parquet(path).schema, files)
    return e.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")))


@query("Q01_idempotent_queue", "SELECT user_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events GROUP BY ALL")
def queue(spark, sf):
    e = _events(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    d = S.deduplicated(e, ["user_id", "event_type", "k"]).select("user_id", "event_type", "k")
    return S.drained(d, "user_id long, event_type string, k int")


@query("Q04_dead_letters", "SELECT event_id, CASE WHEN value > 400 AND json_extract_string(props, '$.k')::INT % 2 = 0 THEN 'failed' ELSE 'done' END AS status FROM events")
def dead_letters(spark, sf):
    def step(batch):
        bad = F.expr("value > 400 and cast(get_json_object(props, '$.k') as int) % 2 = 0")
        return batch.select("event_id", F.when(bad, "failed").otherwise("done").alias("status"))

    return S.drained(_events(spark, sf), "event_id long, status string", step=step)


@query("Q05_rate_limited_claim", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def claim(spark, sf):
    return S.drained(_events(spark, sf, 1).select("event_id"), "event_id long").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("Q12_session_windows", E + f"SELECT user_id, min(ts_us) AS start, count(*) AS n FROM (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS s FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) < {12 * 3600 * 1000000} THEN 0 ELSE 1 END AS flag FROM (SELECT event_id, user_id, epoch_us(ts) AS ts_us FROM events))) GROUP BY user_id, s")
def session_windows(spark, sf):
    e = _events(spark, sf)
    s = S.session_counts(e, "user_id").select("user_id", F.unix_micros("start").alias("start"), "n")
    return S.drained(s, "user_id long, start long, n long", mode="complete", latest=True)


@query("Q02_tumbling_counts", "SELECT event_type, (floor(epoch(ts) / 86400) * 86400)::BIGINT AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    e = _events(spark, sf)
    w = S.window_counts(e, "event_type").select("event_type", F.unix_seconds("start").alias("start"), "n")
    return S.drained(w, "event_type string, start long, n long", mode="complete", latest=True)


_FOLD = "list_reduce(list(CASE event_type WHEN 'purchase' THEN 0.05 WHEN 'error' THEN -0.08 ELSE 0.0 END::DOUBLE ORDER BY ts, event_id), lambda a, x: least(1.0, greatest(0.0, a + x))::DOUBLE, 0.5::DOUBLE)"


@query("Q14_competency_state", f"SELECT user_id, round({_FOLD}, 6) AS level, count(*) AS n FROM events GROUP BY user_id")
def competency(spark, sf):
    c = S.drained(S.competency(_events(spark, sf)), "user_id long, level double, confidence double, n long", mode="update")
    return c.groupBy("user_id").agg(F.max(F.struct("n", "level")).alias("x")).select("user_id", F.round("x.level", 6).alias("level"), "x.n")


@query("Q15_trend_label", E + "SELECT user_id, CASE WHEN count(*) < 55 THEN 'unknown' WHEN avg(value) >= 0.6 * 90 THEN 'rising' WHEN avg(value) >= 0.4 * 90 THEN 'steady' ELSE 'falling' END AS trend FROM ev GROUP BY user_id")
def trend(spark, sf):
    g = T.events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return g.select("user_id", F.when(F.col("n") < 55, "unknown").when(F.col("v") >= 0.6 * 90, "rising").when(F.col("v") >= 0.4 * 90, "steady").otherwise("falling").alias("trend"))


@query("Q16_insight_lifecycle", E + "SELECT user_id, votes, CASE WHEN votes <= 0 THEN 'archived' WHEN votes >= 5 THEN 'promoted' ELSE 'open' END AS state FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS votes FROM ev GROUP BY user_id)")
def insight(spark, sf):
    votes = F.count_if(F.col("event_type") == "purchase") - F.count_if(F.col("event_type") == "error")
    g = T.events(spark, sf).groupBy("user_id").agg(votes.alias("votes"))
    return g.withColumn("state", F.when(F.col("votes") <= 0, "archived").when(F.col("votes") >= 5, "promoted").otherwise("open"))


@query("Q17_rule_lifecycle", E + "SELECT k, count(*) AS fires, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS rate, CASE WHEN count(*) > 10 AND count(*) FILTER (event_type = 'purchase') / count(*) < 0.15 THEN 'suspended' ELSE 'active' END AS status FROM ev GROUP BY k")
def rule(spark, sf):
    g = T.events(spark, sf).groupBy("k").agg(F.count("*").alias("fires"), (F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("r"))
    return g.select("k", "fires", F.round("r", 6).alias("rate"), F.when(F.expr("fires > 10 and r < 0.15"), "suspended").otherwise("active").alias("status"))


@query("Q18_recall_log", E + "SELECT user_id, count(*) AS recalls, max(sec) AS last_recalled FROM ev WHERE event_type = 'view' GROUP BY user_id")
def recall_log(spark, sf):
    return T.events(spark, sf).filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("recalls"), F.max("sec").alias("last_recalled"))


@query("S17_change_feed", "SELECT event_id, event_type FROM events WHERE event_id > 5000")
def change_feed(spark, sf):
    feed = _events(spark, sf).filter("event_id > 5000").select("event_id", "event_type")
    return S.drained(feed, "event_id long, event_type string")


@query("S02_audit_log", "SELECT event_id, user_id, event_type FROM events")
def audit(spark, sf):
    from lodestar.runtime import shared_path

    path = shared_path(spark, "audit")
    T.events(spark, sf).select("event_id", "user_id", "event_type").write.mode("append").json(path)
    return spark.read.schema("event_id long, user_id long, event_type string").json(path)


@query("S13_transcripts", "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS user_turns, max(length(text)) AS longest FROM conversations GROUP BY conv_id")
def transcripts(spark, sf):
    c = T.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max(F.length("text")).cast("long").alias("longest"))


@query("S18_vector_space_scan", "SELECT vec_id FROM embeddings WHERE label = 1")
def space_scan(spark, sf):
    return T.table(spark, sf, "embeddings").filter("label = 1").select("vec_id")


@query("S20_schema_defaults", "SELECT doc_id, coalesce(quality, 1)::INT AS quality, coalesce(toxic, 0)::INT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def defaults(spark, sf):
    l = T.table(spark, sf, "labels")
    return T.table(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("S21_observation_insert", E + "SELECT event_id, 'u' || user_id || ' ' || event_type AS summary FROM ev WHERE event_type <> 'view'")
def observation(spark, sf):
    from lodestar.operators.relational import redact

    text = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"))
    return T.events(spark, sf).filter("event_type != 'view'").select("event_id", redact(text).alias("summary"))
