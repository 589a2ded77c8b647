"""Small inputs on which earlier forms of the operators failed."""

import datetime
import math
import random
import time

import duckdb
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import ranking, retrieval
from lodestar.operators import relational as R
from lodestar.operators import similarity as S
from lodestar.plans import registry
from lodestar.runtime import spread


def test_ratio_join_of_repeated_texts_compares_texts_once(spark):
    n = 20_000
    texts = spark.range(n).selectExpr("id", "if(id % 2 = 0, 'blue ring', 'blue rings') as t", "'g' as g")
    began = time.perf_counter()
    out = S.ratio_join(texts, "id", "t", "g", 0.85)
    assert out.count() == n * (n - 1) // 2
    assert time.perf_counter() - began < 60


def test_dense_co_occurrence_is_the_join(spark):
    rng = random.Random(3)
    rows = [(f"t{t}", u) for u in range(-40, 260) for t in rng.sample(range(60), rng.randint(0, 50))] + [(None, 1), ("t1", None), ("t1", 5)]
    links = spark.createDataFrame(rows, "tag string, user long")
    for least in (1, 20):
        ours = R.dense_co_occurrence(links, "tag", "user", least, block=64)
        theirs = R.co_occurrence(links.dropna(), "tag", "user", least)
        assert ours.schema.simpleString() == theirs.schema.simpleString()
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect())) != []


def test_hot_tags_make_no_row_a_pair(spark):
    links = spark.range(30_000).selectExpr("id as user", "explode(sequence(0, 63)) as tag").filter("pmod(xxhash64(user, tag), 2) = 0 or user < 3")
    began = time.perf_counter()
    assert R.dense_co_occurrence(links, "tag", "user", 64).count() == 3
    assert R.dense_co_occurrence(links, "tag", "user", 30).filter("n < 30 or a >= b").count() == 0
    assert time.perf_counter() - began < 60


def both(spark, sf, name):
    """Rows of a query and of its SQL, by column name and in order."""
    con = duckdb.connect()
    for f in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    df = registry.queries()[name](spark, str(sf))
    theirs = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in theirs.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[k] for k in at) for r in theirs.fetchall())


def test_graph_stats_of_no_edges(spark, tmp_path):
    spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 3, 1.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    ((n, degree, c),), ((n2, degree2, c2),) = both(spark, tmp_path, "A15_graph_stats")
    assert (n, c) == (n2, c2) == (0, 0) and math.isnan(degree) and math.isnan(degree2)


def test_greedy_clusters_are_the_plain_fold(spark):
    rng = random.Random(5)
    sets = [rng.sample(range(90), rng.choice((0, 1, 3, 8, 14))) for _ in range(120)]
    rows = [(u, rng.choice("xy"), s) for u, s in enumerate(rng.choices(sets, k=900) + [rng.sample(range(9), rng.randint(2, 5)) for _ in range(600)])]
    for least in (0.3, 0.5):
        want = []
        for g in "xy":
            unions = []
            for u, _, s in (r for r in rows if r[1] == g):
                at = next((c for c in unions if len(c[1] & set(s)) >= least * len(c[1] | set(s))), None)
                if at is None:
                    unions.append(at := (u, set()))
                at[1].update(s)
                want.append((g, u, at[0]))
        df = spark.createDataFrame(rows, "u long, g string, s array<int>")
        assert sorted(map(tuple, ranking.greedy_clusters(df, ["g"], "u", "s", least).collect())) == sorted(want)


def test_greedy_clusters_of_many_different_sets(spark):
    rows = spark.range(12_000).selectExpr("id as u", "'g' as g", "array_distinct(transform(sequence(1, 14), i -> pmod(xxhash64(id, i), 1000))) as s")
    began = time.perf_counter()
    assert ranking.greedy_clusters(rows, ["g"], "u", "s", 0.5).select("cluster").distinct().count() > 11_000
    assert time.perf_counter() - began < 30


def test_whole_mean_is_not_floored_below(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    value = [6.68, 3.26, 0.41, 17.65]  # 28 / 4; in doubles less, in any order
    rows = [(u, day, 7, "error", v, '{"k": 1}') for u, v in enumerate(value)] + [(9, day, 8, "purchase", -0.5, '{"k": 1}'), (10, day, 9, "error", None, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = {r["user_id"]: r["avg_ms"] for r in registry.queries()["A07_workflow_outcomes"](spark, str(tmp_path)).collect()}
    assert found == {7: 7, 8: -1, 9: None}


def test_verdict_of_a_cosine_just_below_its_threshold(spark, tmp_path):
    c = 0.4199997
    rows = [(1, [1.0, 0.0], 0), (2, [c, math.sqrt(1 - c * c)], 0), (3, [0.43, math.sqrt(1 - 0.43**2)], 0), (4, [-1.0, 0.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    ours, theirs = both(spark, tmp_path, "C07_contradiction_detector")
    assert ours == theirs == [(1, 2, "flag"), (1, 3, "supersede"), (2, 3, "supersede")]


def test_fact_of_a_late_record_follows_the_sql(spark, tmp_path):
    lines = [(1, 10, 25.0), (300_001, 10, 26.0), (5, 11, 7.0), (9, 11, 8.0), (900_000, 12, 50.0), (2, 12, 45.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "Brand#11", 1) for k in (10, 11, 12)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    ours, theirs = both(spark, tmp_path, "F09_fact_lookup")
    assert ours == theirs == [(10, 1, 0.52), (11, 9, 0.16), (12, 900_000, 1.0)]


def test_filter_stats_of_an_empty_text(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, "a\nb\nc\nd"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ours, theirs = both(spark, tmp_path, "P18_filter_stats")
    assert [repr(r) for r in ours] == [repr(r) for r in theirs]


def test_nearest_blocks_are_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    some = [[rng.choice((-1.0, 0.5, 1.0, rng.random())) for _ in range(6)] for _ in range(60)]
    rows = [(i, rng.choice(some)) for i in range(400)] + [(400, None), (401, [0.0] * 6), (402, [1.0, 2.0])]
    asked = [(i, v) for i, v in rows if i % 20 == 0 and v]

    def cosine(v, q):
        norm = math.sqrt(sum(x * x for x in v) * sum(x * x for x in q)) if v and len(v) == len(q) else 0
        return sum(x * y for x, y in zip(v, q)) / norm if norm else None

    df, q = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(asked, "qid long, q array<double>")
    for most in (10_000, 1):
        monkeypatch.setattr(retrieval, "QUERIES", most)
        for n in (7, 402):
            want = set()
            for i, u in asked:
                s = sorted(rows, key=lambda r: (-round(c, 9) if (c := cosine(r[1], u)) is not None else 2, r[0]))
                want |= {(i, r[0], k + 1) for k, r in enumerate(s[:n])}
            got = retrieval.nearest_blocks(df, q, n, 9, block=64, asked_at_once=8).select("qid", "id", "rank")
            assert {tuple(r) for r in got.collect()} == want
        want = set()
        for i, u in asked:
            d = lambda v: sum((x > 0) != (y > 0) for x, y in zip(v, u)) if v and len(v) == len(u) else 99
            want |= {(i, r[0]) for r in sorted(rows, key=lambda r: (d(r[1]), r[0]))[:9]}
        got = retrieval.nearest_blocks(df, q, 9, by_signs=True, block=64, asked_at_once=8).select("qid", "id")
        assert {tuple(r) for r in got.collect()} == want


def test_searches_sort_no_row_a_pair(spark):
    v = spark.range(30_000).selectExpr("id", "transform(sequence(1, 64), i -> cast(xxhash64(id, i) as float)) as v")
    q = v.filter("id < 3000").selectExpr("id as qid", "v as q")
    began = time.perf_counter()
    assert retrieval.two_phase(v, q, 50, 5).filter("rank = 1 and qid = id").count() == 3000
    assert retrieval.nearest(v, q, 5).filter("rank = 1 and qid = id").count() == 3000
    assert time.perf_counter() - began < 60


def test_duplicate_probe_shuffles_no_text(spark, tmp_path):
    texts = ["the blue ring is here", "xblue ringy", "blue", "BLUE RING", "a blue ring, twice: blue ring", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "blue ring"), (2, "ring"), (3, "blue"), (4, "!"), (5, ""), (6, "is here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ours, theirs = both(spark, tmp_path, "J26_duplicate_probe")
    assert sorted(ours) == sorted(theirs) != []
    plan = registry.queries()["J26_duplicate_probe"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_tasks_of_links_and_pairs_grow_in_number_not_in_rows(spark):
    assert spread(spark.range(10), 10, "id").rdd.getNumPartitions() == 1
    assert spread(spark.range(10), 10_000_000, "id").rdd.getNumPartitions() == 40
    links = spark.range(200_000).selectExpr("id div 40 as r", "pmod(xxhash64(id), 90000) as n")
    out = R.co_occurrence(links, "r", "n", 2)  # 3.9 million pairs
    assert out.rdd.getNumPartitions() >= 15
    assert out.filter("n < 2 or a >= b").count() == 0 < out.count()


def test_bm25_shuffles_no_row_a_hit(spark, tmp_path):
    texts = ["the blue ring", "The RING ring ring", None, "", "what is blue?", "none here", "the blue ring"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "blue ring blue"), (2, "ring the"), (3, "!"), (4, "zzz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ours, theirs = both(spark, tmp_path, "F02_bm25")
    assert ours == theirs and len(ours) == 7
    plan = registry.queries()["F02_bm25"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert retrieval.bm25(docs, "doc_id", "text", docs.filter("doc_id = 2").toDF("item_id", "t"), "item_id", "t").count() == 0


def test_chunk_rows_are_the_exploded_chunks(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["# Head\n\n", "one.", "two!", "```x```", "long" * 9, "\n"], k=rng.randint(0, 80))) for _ in range(700)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for kind, size in (("markdown", 60), ("sentence", 40)):
        ours = X.chunk_rows(docs, "doc_id", "text", kind, size)
        theirs = docs.select("doc_id", F.posexplode(X.chunked(kind, size)("text")).alias("n", "chunk"))
        assert ours.dtypes == theirs.dtypes
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))
    plan = registry.queries()["X02_markdown_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # which holds a whole batch with all its chunks


def test_jaccard_join_of_small_and_large_sets(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample(range(30), rng.choice((1, 1, 2, 3, 4, 5, 6)))) for i in range(150)}
    sets |= {i: set(rng.sample(range(60), rng.choice((10, 15, 16, 17, 25, 40)))) for i in range(150, 220)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] + [(1, x) for x in sets[1]], "id long, item long")
    for least in (0.1, 0.3, 0.5, 0.75):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in S.jaccard_join(df, "id", "item", least).collect()} == want



def test_contradictions_of_repeated_names(spark, tmp_path):
    parts = spark.range(20_000).selectExpr("id as p_partkey", "if(id % 2 = 0, 'blue ring', 'hot gear') as p_name", "'SMALL' as p_type", "'b' as p_brand")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    began = time.perf_counter()
    out = registry.queries()["J24_contradictions"](spark, str(tmp_path))
    assert out.count() == 10_000 * 10_000
    assert time.perf_counter() - began < 60


def test_keywords_shuffle_no_row_a_token(spark, tmp_path):
    texts = ["the blue ring ring", "The RING", None, "", "what is blue? is it", "none here_1 x1", "the blue ring ring"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ours, theirs = both(spark, tmp_path, "X14_keywords")
    assert ours == theirs != []
    plan = registry.queries()["X14_keywords"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan.split("MapInArrow", 1)[1]
