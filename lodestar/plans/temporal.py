"""Queries: temporal facts, intervals, decay and retention."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import scores
from lodestar.operators import relational as R
from lodestar.operators import temporal as D
from lodestar.plans.registry import query
from lodestar.sources import tables as T

K, E = T.sql("knowledge"), T.sql("ev")
DAY = 86400
T1, T2 = T.BASE + 10 * DAY, T.BASE + 20 * DAY
_SCD = T.sql("ev", "facts").rstrip() + """, ch AS (SELECT * FROM (SELECT *, lag(o) OVER (PARTITION BY s, p ORDER BY valid_from, fact_id) AS b FROM facts) WHERE b IS NULL OR b <> o),
scd AS (SELECT fact_id, s, p, o, valid_from, lead(valid_from) OVER (PARTITION BY s, p ORDER BY valid_from, fact_id) AS valid_to FROM ch)
"""


def _scd(spark, sf):
    return D.slowly_changing(T.facts(spark, sf), ["s", "p"])


@query("D01_slowly_changing", _SCD + "SELECT fact_id, s, p, o, valid_from, valid_to FROM scd")
def scd(spark, sf):
    return _scd(spark, sf)


@query("D02_invalidated", _SCD + f"SELECT fact_id, s, coalesce(valid_to, CASE WHEN o = 'error' THEN {T.AS_OF} END) AS valid_to FROM scd")
def invalidated(spark, sf):
    end = F.coalesce("valid_to", F.when(F.col("o") == "error", F.lit(T.AS_OF).cast("long")))
    return _scd(spark, sf).select("fact_id", "s", end.alias("valid_to"))


@query("D03_current_state", _SCD + "SELECT s, o FROM scd WHERE valid_to IS NULL")
def current(spark, sf):
    return D.as_of(_scd(spark, sf), None).select("s", "o")


@query("J12_as_of", _SCD + f"SELECT s, o, valid_from FROM scd WHERE valid_from <= {T1} AND (valid_to IS NULL OR valid_to > {T1})")
def at(spark, sf):
    return D.as_of(_scd(spark, sf), T1).select("s", "o", "valid_from")


@query("U05_state_diff", _SCD + f"""SELECT s, p, a.o AS old, b.o AS new, CASE WHEN a.o IS NULL THEN 'added' WHEN b.o IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM scd WHERE valid_from <= {T1} AND (valid_to IS NULL OR valid_to > {T1})) a FULL JOIN (SELECT * FROM scd WHERE valid_from <= {T2} AND (valid_to IS NULL OR valid_to > {T2})) b USING (s, p)
WHERE a.o IS DISTINCT FROM b.o""")
def diff(spark, sf):
    f = _scd(spark, sf)
    return D.difference(D.as_of(f, T1), D.as_of(f, T2), ["s", "p"]).select("s", "p", "old", "new", "change")


_ALLEN = """CASE WHEN {a1} < {b0} THEN 'before' WHEN {b1} < {a0} THEN 'after' WHEN {a1} = {b0} THEN 'meets' WHEN {b1} = {a0} THEN 'met_by' WHEN {a0} = {b0} AND {a1} = {b1} THEN 'equals' WHEN {a0} = {b0} AND {a1} < {b1} THEN 'starts'
WHEN {a0} = {b0} AND {a1} > {b1} THEN 'started_by' WHEN {a1} = {b1} AND {a0} > {b0} THEN 'finishes' WHEN {a1} = {b1} AND {a0} < {b0} THEN 'finished_by' WHEN {a0} > {b0} AND {a1} < {b1} THEN 'during'
WHEN {a0} < {b0} AND {a1} > {b1} THEN 'contains' WHEN {a0} < {b0} AND {a1} < {b1} THEN 'overlaps' ELSE 'overlapped_by' END"""


def _rel(a, b):
    return _ALLEN.format(a0=f"{a}0", a1=f"{a}1", b0=f"{b}0", b1=f"{b}1")


@query("D04_allen_relations", "WITH iv AS (SELECT o_custkey AS c, l_orderkey AS id, min(epoch(l_shipdate))::BIGINT AS a0, max(epoch(l_shipdate))::BIGINT + 86400 AS a1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), n AS (SELECT c, id, a0, a1, lead(a0) OVER w AS b0, lead(a1) OVER w AS b1 FROM iv WINDOW w AS (PARTITION BY c ORDER BY id)) SELECT id, " + _ALLEN.format(a0="a0", a1="a1", b0="b0", b1="b1") + " AS rel FROM n WHERE b0 IS NOT NULL")
def relations(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    iv = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(T.epoch("l_shipdate")).alias("a0"), (F.max(T.epoch("l_shipdate")) + DAY).alias("a1")).join(o, "id")
    w = W.partitionBy("c").orderBy("id")
    n = iv.select("id", "a0", "a1", F.lead("a0").over(w).alias("b0"), F.lead("a1").over(w).alias("b1")).filter("b0 is not null")
    return n.select("id", D.allen(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("rel"))


@query("D05_allen_composition", f"""WITH iv AS (SELECT x AS lo, y AS hi FROM range(6) a(x), range(6) b(y) WHERE x < y), t AS (SELECT a.lo AS a0, a.hi AS a1, b.lo AS b0, b.hi AS b1, c.lo AS c0, c.hi AS c1 FROM iv a, iv b, iv c),
r AS (SELECT {_rel('a', 'b')} AS r1, {_rel('b', 'c')} AS r2, {_rel('a', 'c')} AS r3 FROM t) SELECT r1, r2, string_agg(DISTINCT r3, ',' ORDER BY r3) AS r3s FROM r GROUP BY r1, r2""")
def composition(spark, sf):
    return D.composition(spark)


@query("D06_whole_months", "SELECT l_orderkey, l_linenumber, datesub('month', least(o_orderdate, l_shipdate)::DATE, greatest(o_orderdate, l_shipdate)::DATE)::INT AS months FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def months(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("a"))
    j = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("b")).join(o, "l_orderkey")
    return j.select("l_orderkey", "l_linenumber", D.whole_months(F.col("a"), F.col("b")).cast("int").alias("months"))


@query("D07_whole_years", "SELECT o_orderkey, datesub('year', o_orderdate::DATE, DATE '2002-03-15')::INT AS years FROM orders")
def years(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    return o.select("o_orderkey", F.floor(D.whole_months(F.col("a"), F.expr("DATE '2002-03-15'")) / 12).cast("int").alias("years"))


@query("D08_days_weeks", E + f"SELECT event_id, floor(abs({T.AS_OF} - sec) / {DAY})::BIGINT AS days, floor(abs({T.AS_OF} - sec) / {7 * DAY})::BIGINT AS weeks FROM ev")
def days(spark, sf):
    gap = F.abs(T.AS_OF - F.col("sec"))
    return T.events(spark, sf).select("event_id", F.floor(gap / DAY).alias("days"), F.floor(gap / (7 * DAY)).alias("weeks"))


_HUMAN = "CASE WHEN g >= 604800 THEN (g // 604800) || ' weeks ' || (g % 604800 // 86400) || ' days' WHEN g >= 86400 THEN (g // 86400) || ' days ' || (g % 86400 // 3600) || ' hours' ELSE (g // 3600) || ' hours ' || (g % 3600 // 60) || ' minutes' END"


@query("D09_humanised", E + f"SELECT event_id, {_HUMAN} AS age FROM (SELECT event_id, {T.AS_OF} - sec AS g FROM ev)")
def humanised(spark, sf):
    g = F.lit(T.AS_OF) - F.col("sec")
    unit = lambda big, small, a, b: F.concat(F.floor(g / big).cast("string"), F.lit(f" {a} "), F.floor(F.pmod(g, F.lit(big)) / small).cast("string"), F.lit(f" {b}"))
    age = F.when(g >= 604800, unit(604800, 86400, "weeks", "days")).when(g >= 86400, unit(86400, 3600, "days", "hours")).otherwise(unit(3600, 60, "hours", "minutes"))
    return T.events(spark, sf).select("event_id", age.alias("age"))


@query("D11_dates_in_text", r"SELECT doc_id, len(regexp_extract_all(text, '\b(?:19|20)\d\d-[01]\d-[0-3]\d\b')) AS iso, len(regexp_extract_all(text, '\b(?:19|20)\d\d\b')) AS years FROM documents")
def dates(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return T.table(spark, sf, "documents").select("doc_id", n(r"\b(?:19|20)\d\d-[01]\d-[0-3]\d\b").alias("iso"), n(r"\b(?:19|20)\d\d\b").alias("years"))


@query("D13_date_index", "SELECT l_orderkey AS id, min(epoch(l_shipdate))::BIGINT AS lo, max(epoch(l_shipdate))::BIGINT AS hi FROM lineitem GROUP BY l_orderkey")
def date_index(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(T.epoch("l_shipdate")).alias("lo"), F.max(T.epoch("l_shipdate")).alias("hi"))


@query("D14_date_proximity", E + f"SELECT event_id, round(greatest(0, 1 - abs({T1} - sec) / {DAY} / 180), 9) AS proximity FROM ev")
def proximity(spark, sf):
    return T.events(spark, sf).select("event_id", F.round(scores.proximity(F.abs(T1 - F.col("sec")) / DAY), 9).alias("proximity"))


@query("D15_decay", K + f"SELECT id, round(greatest(0.01, exp(-floor(({T.AS_OF} - confirmed) / {DAY}) * ln(2) / 90)), 9) AS decay FROM knowledge")
def decay(spark, sf):
    return T.knowledge(spark, sf).select("id", F.round(scores.decay(F.floor((T.AS_OF - F.col("confirmed")) / DAY)), 9).alias("decay"))


_SMART = f"CASE WHEN importance = 'critical' THEN confidence ELSE greatest(0, confidence * pow(2, -floor(({T.AS_OF} - confirmed) / {DAY}) / 90) * (0.5 + 0.5 * confidence) + least(recall_count * 0.02, 0.1)) * CASE WHEN branch = '' THEN 0.8 ELSE 1 END END"


@query("D16_intelligent_decay", K + f"SELECT id, round({_SMART}, 9) AS strength, CASE WHEN {_SMART} < 0.1 THEN 'forget' WHEN {_SMART} < 0.15 THEN 'archive' ELSE 'keep' END AS verdict FROM knowledge")
def intelligent(spark, sf):
    age, c = F.floor((T.AS_OF - F.col("confirmed")) / DAY), F.col("confidence")
    faded = F.greatest(F.lit(0.0), c * F.pow(F.lit(2.0), -age / 90) * (0.5 + 0.5 * c) + F.least(F.col("recall_count") * 0.02, F.lit(0.1))) * F.when(F.col("branch") == "", 0.8).otherwise(1.0)
    s = F.when(F.col("importance") == "critical", c).otherwise(faded)
    return T.knowledge(spark, sf).select("id", F.round(s, 9).alias("strength"), F.when(s < 0.1, "forget").when(s < 0.15, "archive").otherwise("keep").alias("verdict"))


@query("D17_confidence_decay", K + f"SELECT id, round(CASE WHEN {T.AS_OF} - confirmed > {26 * DAY} THEN greatest(0.1, confidence * 0.9) ELSE confidence END, 9) AS confidence FROM knowledge")
def confidence(spark, sf):
    c = F.when(T.AS_OF - F.col("confirmed") > 26 * DAY, F.greatest(F.lit(0.1), F.col("confidence") * 0.9)).otherwise(F.col("confidence"))
    return T.knowledge(spark, sf).select("id", F.round(c, 9).alias("confidence"))


@query("D18_retention_zones", K + f"SELECT id, CASE WHEN a AND age > 29 THEN 'purged' WHEN a THEN 'archived' ELSE 'active' END AS zone FROM (SELECT *, status = 'archived' OR (age > 27 AND recall_count = 0 AND confidence < 0.8) AS a FROM (SELECT *, ({T.AS_OF} - confirmed) / {DAY} AS age FROM knowledge))")
def zones(spark, sf):
    return D.retention(T.knowledge(spark, sf), T.AS_OF, 27, 29).select("id", "zone")


@query("D19_observation_ttl", E + f"SELECT event_id FROM ev WHERE sec >= {T.AS_OF - 15 * DAY}")
def ttl(spark, sf):
    return T.events(spark, sf).filter(F.col("sec") >= T.AS_OF - 15 * DAY).select("event_id")


@query("D20_recent_episodes", E + f"SELECT user_id, count(*) AS n FROM ev WHERE sec >= {T.AS_OF - 7 * DAY} GROUP BY user_id")
def recent(spark, sf):
    return T.events(spark, sf).filter(F.col("sec") >= T.AS_OF - 7 * DAY).groupBy("user_id").agg(F.count("*").alias("n"))


@query("D21_similar_episodes", E + ", l AS (SELECT *, (event_type = 'error')::INT + (k = 3)::INT AS overlap FROM ev ORDER BY sec DESC, event_id DESC LIMIT 250) SELECT event_id, overlap FROM l ORDER BY overlap DESC, sec, event_id LIMIT 50")
def similar(spark, sf):
    overlap = (F.col("event_type") == "error").cast("int") + (F.col("k") == 3).cast("int")
    newest = T.events(spark, sf).withColumn("overlap", overlap).orderBy(F.desc("sec"), F.desc("event_id")).limit(250)
    return newest.orderBy(F.desc("overlap"), "sec", "event_id").limit(50).select("event_id", "overlap")


@query("A29_scenario_rollup", E + "SELECT k AS suite, count(*) AS n, count(*) FILTER (event_type <> 'error') AS passed, round(quantile_cont(value, 0.5), 6) AS p50 FROM ev GROUP BY k")
def rollup(spark, sf):
    return T.events(spark, sf).groupBy(F.col("k").alias("suite")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("passed"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"))


@query("A38_evidence_combination", E + """, m AS (SELECT user_id, least(0.9, avg(value) FILTER (event_type = 'click') / 500) AS a, least(0.9, avg(value) FILTER (event_type = 'view') / 500) AS b FROM ev GROUP BY user_id)
SELECT user_id, round((a * b + a * (1 - b) + b * (1 - a)), 9) AS mass, round((1 - a) * (1 - b), 9) AS unknown FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def evidence(spark, sf):
    mean = lambda t: F.least(F.lit(0.9), F.avg(F.when(F.col("event_type") == t, F.col("value"))) / 500)
    m = T.events(spark, sf).groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).filter("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    return m.select("user_id", F.round(a * b + a * (1 - b) + b * (1 - a), 9).alias("mass"), F.round((1 - a) * (1 - b), 9).alias("unknown"))


@query("U06_orphan_cleanup", T.sql("links") + "SELECT p_partkey FROM part LEFT JOIN (SELECT node, count(*) AS n FROM links GROUP BY node) ON node = p_partkey WHERE coalesce(n, 0) <= 20 AND p_size <= 10")
def orphan_cleanup(spark, sf):
    n = T.links(spark, sf).groupBy(F.col("node").alias("p_partkey")).agg(F.count("*").alias("n"))
    return T.table(spark, sf, "part").filter("p_size <= 10").select("p_partkey").join(n, "p_partkey", "left").filter("coalesce(n, 0) <= 20").select("p_partkey")


@query("A34_auto_patterns", E + f"SELECT event_type, k, count(*) AS n FROM ev WHERE sec >= {T.AS_OF - 10 * DAY} GROUP BY event_type, k HAVING count(*) >= 3")
def auto_patterns(spark, sf):
    return T.events(spark, sf).filter(F.col("sec") >= T.AS_OF - 10 * DAY).groupBy("event_type", "k").agg(F.count("*").alias("n")).filter("n >= 3")
