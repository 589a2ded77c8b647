"""Queries: text functions, classifiers, chunkers, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import calibration
from lodestar.functions import text as X
from lodestar.operators import retrieval
from lodestar.plans.registry import query
from lodestar.sources import tables as T

K = T.sql("knowledge")


def _docs(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "text")


@query("S11_html_text")
def html_text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", X.strip_html("html").alias("text"))


@query("P17_line_filter", r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[*%&$]{3}'))[1:20], chr(10))) AS h FROM documents WHERE NOT contains(text, 'http')")
def line_filter(spark, sf):
    d = _docs(spark, sf).filter(~F.contains("text", F.lit("http")))
    return d.select("doc_id", F.md5(X.kept_lines("text", "[*%&$]{3}", 20)).alias("h"))


@query("P18_filter_stats", "SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, round(greatest(0, 100.0 * (length(text) - length(array_to_string(string_split(text, chr(10))[1:3], chr(10)))) / length(text)), 1)::DOUBLE AS pct FROM documents")
def filter_stats(spark, sf):
    lines = F.split("text", "\n")
    kept = F.array_join(F.slice(lines, 1, 3), "\n")
    cut = F.when(F.length("text") == 0, float("nan")).otherwise(F.try_divide(100.0 * (F.length("text") - F.length(kept)), F.length("text")))  # no part of an empty text
    return _docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("chars"), F.size(lines).cast("long").alias("lines"), F.round(F.greatest(F.lit(0.0), cut), 1).alias("pct"))


@query("P19_filter_detect", "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '!!')) >= 3 THEN 'shout' WHEN len(regexp_extract_all(text, '[*%&$]{3}')) >= 3 THEN 'noisy' WHEN len(regexp_extract_all(text, ' \\| ')) >= 3 THEN 'table' ELSE 'none' END AS kind FROM documents".replace("\\\\", "\\"))
def filter_detect(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return _docs(spark, sf).select("doc_id", F.when(n("!!") >= 3, "shout").when(n("[*%&$]{3}") >= 3, "noisy").when(n(r" \| ") >= 3, "table").otherwise("none").alias("kind"))


@query("P20_intent_gate", "SELECT item_id, (contains(text, '?') AND contains(text, ',')) OR len(regexp_extract_all(lower(text), '\\b(the|that|what|which)\\b')) >= 2 AS gate FROM benchmark".replace("\\\\", "\\"))
def gate(spark, sf):
    marks = F.contains("text", F.lit("?")) & F.contains("text", F.lit(","))
    return T.table(spark, sf, "benchmark").select("item_id", (marks | (F.regexp_count(F.lower("text"), F.lit(r"\b(the|that|what|which)\b")) >= 2)).alias("gate"))


@query("P21_temporal_gate", "SELECT item_id, contains(lower(text), 'day') OR contains(lower(text), 'date') OR regexp_matches(text, '(19|20)[0-9]{2}') AS gate FROM benchmark")
def temporal_gate(spark, sf):
    t = F.lower("text")
    return T.table(spark, sf, "benchmark").select("item_id", (F.contains(t, F.lit("day")) | F.contains(t, F.lit("date")) | F.rlike("text", F.lit("(19|20)[0-9]{2}"))).alias("gate"))


_N = "len(regexp_extract_all(text, '[A-Z][a-z]+'))"


@query("P22_query_router", f"SELECT item_id, CASE WHEN s >= 0.6 THEN 'relational' WHEN s >= 0.3 THEN 'hybrid' ELSE 'semantic' END AS route FROM (SELECT item_id, least(1, CASE WHEN regexp_matches(lower(text), 'wh[aeio]') THEN 0.35 ELSE 0 END + CASE WHEN {_N} >= 2 THEN 0.35 WHEN {_N} = 1 THEN 0.10 ELSE 0 END) AS s FROM benchmark)")
def router(spark, sf):
    n = F.regexp_count("text", F.lit("[A-Z][a-z]+"))
    s = F.least(F.lit(1.0), F.when(F.rlike(F.lower("text"), F.lit("wh[aeio]")), 0.35).otherwise(0.0) + F.when(n >= 2, 0.35).when(n == 1, 0.10).otherwise(0.0))
    return T.table(spark, sf, "benchmark").select("item_id", F.when(s >= 0.6, "relational").when(s >= 0.3, "hybrid").otherwise("semantic").alias("route"))


@query("P23_query_analysis", "SELECT item_id, CASE WHEN contains(lower(text), 'err') THEN 'debug' WHEN contains(lower(text), 'what') THEN 'factual' WHEN contains(lower(text), 'the') THEN 'architecture' ELSE 'search' END AS kind FROM benchmark")
def analysis(spark, sf):
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    return T.table(spark, sf, "benchmark").select("item_id", F.when(has("err"), "debug").when(has("what"), "factual").when(has("the"), "architecture").otherwise("search").alias("kind"))


@query("P24_task_level", "SELECT item_id, CASE WHEN n < 15 THEN 1 WHEN n <= 30 THEN 2 WHEN n <= 60 THEN 3 ELSE 4 END AS level FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark)")
def task_level(spark, sf):
    n = F.size(F.split("text", " "))
    return T.table(spark, sf, "benchmark").select("item_id", F.when(n < 15, 1).when(n <= 30, 2).when(n <= 60, 3).otherwise(4).alias("level"))


_CASES = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in X.CLASSES if not p.startswith(r"Traceback"))


@query("P25_content_class", f"SELECT doc_id, CASE WHEN contains(text, 'Traceback (most recent call last)') OR regexp_matches(text, '(?m)^\\s+at [\\w.$]+\\(') THEN 'stacktrace' {_CASES} ELSE 'text' END AS kind FROM documents")
def content_class(spark, sf):
    return _docs(spark, sf).select("doc_id", X.content_class().alias("kind"))


@query("P26_embedding_space", "SELECT lang, source, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'code' WHEN 'fr' THEN 'log' ELSE 'config' END AS space, count(*) AS n FROM documents GROUP BY ALL")
def space(spark, sf):
    m = F.create_map(*map(F.lit, ("en", "text", "de", "code", "fr", "log")))
    return T.table(spark, sf, "documents").groupBy("lang", "source", F.coalesce(F.element_at(m, F.col("lang")), F.lit("config")).alias("space")).agg(F.count("*").alias("n"))


@query("P27_script_language", "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[éèêçàùœ]')) > 0.03 * length(text) THEN 'fr' ELSE 'en' END AS guess FROM documents")
def script_language(spark, sf):
    return _docs(spark, sf).select("doc_id", F.when(F.regexp_count("text", F.lit("[éèêçàùœ]")) > 0.03 * F.length("text"), "fr").otherwise("en").alias("guess"))


_SC = {"code": r"[{}();]", "config": r"[=:]", "doc": r"[.!?]"}
_CNT = {k: f"len(regexp_extract_all(text, '{p}'))" for k, p in _SC.items()}


@query("P28_document_kind", f"SELECT doc_id, CASE WHEN greatest(2 * c, f, d) = 0 THEN 'other' WHEN 2 * c >= f AND 2 * c >= d THEN 'code' WHEN f >= d THEN 'config' ELSE 'doc' END AS kind FROM (SELECT doc_id, {_CNT['code']} AS c, {_CNT['config']} AS f, {_CNT['doc']} AS d FROM documents)")
def document_kind(spark, sf):
    c, f, d = (F.regexp_count("text", F.lit(p)) for p in _SC.values())
    kind = F.when(F.greatest(2 * c, f, d) == 0, "other").when((2 * c >= f) & (2 * c >= d), "code").when(f >= d, "config").otherwise("doc")
    return _docs(spark, sf).select("doc_id", kind.alias("kind"))


@query("P08_parsed_context", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def parsed(spark, sf):
    return T.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("X07_token_estimate", "SELECT doc_id, length(text) // 4 AS n FROM documents")
def estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", X.token_estimate().alias("n"))


@query("X08_content_hash", r"SELECT doc_id, sha256(text) AS raw, sha256(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS normal FROM documents")
def content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("raw"), X.normal_hash().alias("normal"))


@query("X09_outbox_hash", "SELECT doc_id, sha1(lang || '|' || source || '|' || text) AS h FROM documents")
def outbox_hash(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", F.sha1(F.concat_ws("|", "lang", "source", "text")).alias("h"))


@query("X11_word_jaccard", "SELECT l.doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS sim FROM (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS a FROM documents) l JOIN (SELECT doc_id - 1 AS doc_id, list_distinct(string_split(lower(text), ' ')) AS b FROM documents) r USING (doc_id)")
def word_jaccard(spark, sf):
    words = F.array_distinct(F.split(F.lower("text"), " "))
    d = _docs(spark, sf)
    j = d.select("doc_id", words.alias("a")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), words.alias("b")), "doc_id")
    return j.select("doc_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("sim"))


@query("X13_transform_validator", r"SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s]+')) AS urls, len(regexp_extract_all(text, '`[^`]+`')) AS code, len(regexp_extract_all(text, '(?m)^#{1,6} ')) AS headings FROM documents")
def validator(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return _docs(spark, sf).select("doc_id", n(r"https?://[^\s]+").alias("urls"), n("`[^`]+`").alias("code"), n("(?m)^#{1,6} ").alias("headings"))


@query("X14_keywords", r"""WITH tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\w+')) AS w FROM documents) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w)
SELECT doc_id, w AS term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln((SELECT count(*) FROM documents) / df), 9) DESC, w) AS rank FROM tf JOIN df USING (w) QUALIFY rank <= 5""")
def keywords(spark, sf):
    d = _docs(spark, sf)
    tf = retrieval.term_counts(d, "doc_id", "text")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = d.agg(F.count("*").alias("n"))
    s = tf.join(df, "term").join(F.broadcast(n)).withColumn("s", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 9))  # one row
    return s.withColumn("rank", F.row_number().over(retrieval.W.partitionBy("doc_id").orderBy(F.desc("s"), "term"))).filter("rank <= 5").select("doc_id", "term", "rank")


@query("X15_platt_apply", "SELECT doc_id, round(1 / (1 + exp(-4 * (doc_id * 37 % 100) / 100.0 + 2)), 9)::DOUBLE AS p FROM labels")
def platt_apply(spark, sf):
    return T.table(spark, sf, "labels").select("doc_id", F.round(X.platt((F.col("doc_id") * 37 % 100) / 100.0, -4.0, 2.0), 9).alias("p"))


@query("X16_platt_fit")
def platt_fit(spark, sf):
    rows = T.table(spark, sf, "labels").select(((F.col("doc_id") * 37 % 100) / 100.0).alias("score"), F.col("quality").alias("label"))
    return calibration.fit_platt(rows, "score", "label")


@query("X17_answer_routing", K + "SELECT id, CASE WHEN confidence >= CASE type WHEN 'en' THEN 0.8 ELSE 0.6 END THEN 'ANSWER' WHEN confidence >= 0.5 THEN 'CAVEAT' WHEN confidence >= 0.3 THEN 'HYBRID' WHEN confidence >= 0.1 THEN 'SEARCH_MORE' ELSE 'IDK' END AS route FROM knowledge")
def answer_routing(spark, sf):
    c = F.col("confidence")
    need = F.when(F.col("type") == "en", 0.8).otherwise(0.6)
    return T.knowledge(spark, sf).select("id", F.when(c >= need, "ANSWER").when(c >= 0.5, "CAVEAT").when(c >= 0.3, "HYBRID").when(c >= 0.1, "SEARCH_MORE").otherwise("IDK").alias("route"))


@query("X20_entity_codes", "SELECT p_partkey, replace(replace(p_type, 'STANDARD', '@1'), 'ECONOMY', '@2') AS short FROM part")
def entity_codes(spark, sf):
    short = F.replace(F.replace("p_type", F.lit("STANDARD"), F.lit("@1")), F.lit("ECONOMY"), F.lit("@2"))
    return T.table(spark, sf, "part").select("p_partkey", short.alias("short"))


def _chunks(name, kind, size):
    @query(name)
    def run(spark, sf):
        c = X.chunk_rows(_docs(spark, sf), "doc_id", "text", kind, size)
        return c.select("doc_id", "n", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))

    return run


_chunks("X01_text_chunks", "text", 1500)
_chunks("X02_markdown_chunks", "markdown", 1500)
_chunks("X04_code_chunks", "code", 1500)
_chunks("X05_log_chunks", "log", 1500)
_chunks("X06_sentence_chunks", "sentence", 600)
