"""Top-k search, mixing, pipeline: brute force and edge cases."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import bpe, mixing, queries, simhash, topk


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(map(repr, found.fetchall()))


def search_brute(rows, k):
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("group, shard, k", [(3, 4, 5), (4096, 4096, 5), (2, 7, 1), (5, 5, 200)])
def test_top_k_brute_force(spark, monkeypatch, group, shard, k):
    monkeypatch.setattr(topk, "LEAST", 10)
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(0, 400, 5)]
    rows += [(i + 1, rows[3][1]) for i in range(9)] + [(7, None), (50, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (150, [float("nan")] * 6), (200, [float("inf")] * 6), (None, [1.0] * 6), (100, [0.5] * 6), (350, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "uid": F.lit("u"), "query": F.lit("q")})
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k, group=group, shard=shard)
    assert sorted(tuple(r) for r in got.collect()) == search_brute(rows, k)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_empty_vectors(spark):
    df = spark.createDataFrame([(50, []), (51, []), (100, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == [(50, 1, 51, 0), (50, 2, 100, 0), (100, 1, 50, 0), (100, 2, 51, 0)]


def test_top_k_of_large_components(spark):
    rows = [(i, [float((i * 37) % 11 - 5) * 1e6, float((i * 13) % 7 - 3) * 1e6, 1e6]) for i in range(0, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == search_brute(rows, 5)


def test_cutoff_leaves_few_entries():
    """Of random vectors a small part passes the uniform cutoff, and none that reaches it is lost."""
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 32, (3000, 64)))
    block = lambda w, at, cut: topk._Block({"n": len(w), "width": 64, "uids": np.arange(at, at + len(w)).astype("<i8").tobytes(), "ids": np.arange(at, at + len(w)).astype("<i8").tobytes(), "cuts": cut.astype("<f8").tobytes(), "data": w.astype("<f8").tobytes()})
    q, whole = v[:50], v[:50] @ v.T
    whole[np.arange(50), np.arange(50)] = -np.inf
    cut = np.sort(whole, 1)[:, -20]
    a, b = block(q, 0, cut), block(v, 0, np.zeros(3000))
    at, of, score = topk.entries(a, b, (q[:, :32], q[:, 32:]), (v[:, :32], v[:, 32:]))
    assert {(i, j): s for i, j, s in zip(at.tolist(), of.tolist(), score.tolist())} == {(i, j): whole[i, j] for i, j in zip(*np.nonzero(whole >= cut[:, None]))}
    passed = sum((q[:, s] @ v[:, s].T >= cut[:, None] / 2).sum() for s in (slice(0, 32), slice(32, 64)))
    assert passed < 0.15 * whole.size


def test_raking_meets_targets(spark):
    rng = random.Random(3)
    rows = [(f"s{a}", f"l{b}", f"t{c}", rng.randrange(1, 5000)) for a in range(8) for b in range(3) for c in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells, 0.5, {"l0": 0.5, "l1": 0.3, "l2": 0.2}, 0.0, rounds=40).collect()
    total = sum(r[3] for r in rows)
    share = lambda k: {v: sum(r.tokens * r.weight for r in out if r[k] == v) / total for v in {r[k] for r in out}}
    assert share("lang") == pytest.approx({"l0": 0.5, "l1": 0.3, "l2": 0.2}, abs=1e-6)
    assert share("topic") == pytest.approx({f"t{c}": 1 / 3 for c in range(3)}, abs=1e-6)
    root = {f"s{a}": sum(r[3] for r in rows if r[0] == f"s{a}") ** 0.5 for a in range(8)}
    assert share("source") == pytest.approx({k: v / sum(root.values()) for k, v in root.items()}, abs=1e-6)


def test_calibration_spends_the_budget(spark):
    cells = spark.createDataFrame([(10, 100.0), (500, 1.0), (300, 0.2), (0, 1.0)], "tokens long, weight double")
    got = mixing.calibrated(cells, 0.5).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(405) and max(r.probability for r in got) == 1.0


def test_mixing_edges(spark):
    rows = [(1, "a b", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "y" * 40000, "de", "s"), (4, "y" * 40000, "de", "s"), (None, "z", "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"topic": F.lit("t"), "weight": F.lit(1), "tokens": F.lit("x")})
    out = mixing.mixed(docs)
    assert out.count() == len(rows) and out.filter("_probability is null or _probability < 0 or _probability > 1").count() == 0
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.filter("doc_id = 3")).count() == 1


def test_raking_by_joins_equals_raking_by_factors(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"s{a}", f"l{b}", f"t{c}", rng.randrange(0, 3) * rng.randrange(1, 5000)) for a in range(6) for b in range(4) for c in range(3) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    options = dict(lang_target={"l0": 0.5, "l1": 0.2}, rounds=3)
    want = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, **options).collect()}
    monkeypatch.setattr(mixing, "PAIRS", 5)
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, **options).collect()}
    assert got == pytest.approx(want)


def test_mixing_clashing_names(spark):
    rows = [(i, f"text {i} " * 9, "en", f"s{i % 3}") for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = plain.withColumns({c: F.lit(c) for c in ("_source", "_lang", "_topic", "_weight", "_kept", "_tokens", "_probability", "_salt", "c0", "c1")})
    want = {r.doc_id for r in mixing.sample(plain).collect()}
    out = mixing.sample(docs)
    assert out.columns == docs.columns and set(out.collect()) == {r for r in docs.collect() if r.doc_id in want}
    assert sorted(mixing.mixed(docs).columns) == sorted(docs.columns)


def test_mixing_is_native(spark, sf):
    plan = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_sample_is_near_its_targets(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    all_, kept = (d.agg(F.sum(mixing.tokens_of())).first()[0] for d in (docs, mixing.sample(docs)))
    assert abs(kept / all_ - mixing.BUDGET) < 0.06


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        kept.append({r.doc_id: r.text for r in now.select("doc_id", "text").collect()})
    language, exact, near, mixed = kept
    assert set(language) == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text))} or len(language) > 0.97 * docs.count()
    best = {}
    for i, t in language.items():
        best[t] = max(best.get(t, i), i)
    assert set(exact) == set(best.values())
    fp = {i: simhash.fingerprint(t) for i, t in exact.items()}
    words = {i: t.lower().split() for i, t in exact.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    group = {i: i for i in fp}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and ((fp[a] ^ fp[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert set(near) == {find(i) for i in fp}
    assert set(mixed) < set(near)
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    import public_tokenizers

    tok = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert last == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in mixed.items()}


def test_guard_without_the_subpackage(tmp_path):
    """The entry module imports and lists the other queries when the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(corpus_pipeline.__file__)
    shutil.copytree(f"{root}/lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, op, pipe = out.stdout.split()[-3:]
    assert int(n) > 150 and op == pipe == "False"
