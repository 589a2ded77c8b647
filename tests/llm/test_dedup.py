"""Exact dedup, SimHash near-dedup: brute force, edge cases."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import exact_dedup, shingles, simhash
from lodestar.operators.components import connected_components

TEXTS = ["same text here now", "same text here now", "same text here now", "", None, "other", "Other", " ", "x" * 20000, "é ñ\n中文 \U0001f600", "same text here now"]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"digest": F.lit("mine"), "fp": F.lit(1), "uid": F.lit(2), "kept": F.lit(3), "_salt": F.lit(4)}) if extra else df


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        ids = [x for x in g if x is not None]
        out.append((i, max(ids) if ids else None, len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups(spark, extra):
    rows = [*enumerate(TEXTS), (5, "other"), (None, "other"), (None, None)]
    got = exact_dedup.exact_groups(frame(spark, rows, extra)).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == exact_brute(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    got = exact_dedup.exact_groups(frame(spark, rows))
    assert {(r.keep_id, r.group_size) for r in got.filter("group_size > 1").collect()} == {(2999, 2000)}


def test_drop_copies_keeps_columns_and_twins(spark):
    rows = [*enumerate(TEXTS), (5, "other"), (5, "other"), (None, "n"), (None, "n")]
    out = exact_dedup.drop_copies(frame(spark, rows, True))
    assert out.columns == ["doc_id", "text", "digest", "fp", "uid", "kept", "_salt"]
    got = sorted(repr((r.doc_id, r.text or "")) for r in out.collect())
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert got == sorted(repr((None if i < 0 else i, t)) for t, i in best.items())


def test_index_persists(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = exact_dedup.exact_groups(frame(spark, [(1, "a"), (2, "a"), (3, "b")]), index=index)
    assert {r.doc_id for r in first.filter("kept").collect()} == {2, 3}
    index.close()
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = exact_dedup.exact_groups(frame(spark, [(9, "a"), (10, "c"), (11, "c")]), index=again)
    assert {(r.doc_id, r.keep_id, r.kept) for r in second.collect()} == {(9, 2, False), (10, 11, False), (11, 11, True)}
    assert again.table().count() == 3
    third = exact_dedup.exact_groups(frame(spark, [(1, "a"), (20, "d")]), index=again)
    text = third._jdf.queryExecution().executedPlan().toString()
    assert again.name in text and "SortMergeJoin" in text  # what stays is read from the index
    assert {(r.doc_id, r.keep_id, r.kept) for r in third.collect()} == {(1, 2, False), (20, 20, True)}
    assert again.table().count() == 4
    gone = exact_dedup.drop_copies(frame(spark, [(1, "a"), (30, "e"), (31, "e"), (30, "e")]), index=again)
    assert [r.doc_id for r in gone.collect()] == [31]
    plan = again.unseen(exact_dedup.digests(frame(spark, [(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    again.close()


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_meet_the_index(spark, monkeypatch, batches):
    """Later batches find texts of earlier ones in the index; the result is that of one batch."""
    seen, append = [], exact_dedup.DigestIndex.append
    monkeypatch.setattr(exact_dedup.DigestIndex, "append", lambda self, batch: (append(self, batch), seen.append(self.table().count()))[0])
    rows = [(i, f"t{i % 7}") for i in range(60)] + [(None, "t1"), (None, "null only")]
    got = exact_dedup.exact_groups(frame(spark, rows), batches=batches).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == exact_brute(rows)
    assert sum(r.kept for r in got) == 8
    assert len(seen) == batches and seen[-1] == 8 and (batches == 1 or seen[0] >= 7)


def test_clashing_names(spark):
    rows = [(1, "a b", "x", "y", "z", 1), (2, "a b", "p", "q", "r", 2), (3, "c", "s", "t", "u", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _digest string, _key string, _twin int").withColumns({"c0": F.lit("c0"), "c1": F.lit("c1"), "_salt": F.lit(4)})
    for out, stays in ((exact_dedup.drop_copies(docs), {2, 3}), (simhash.drop_near_copies(docs), {1, 3})):
        assert out.columns == docs.columns
        assert {r for r in out.collect()} == {r for r in docs.collect() if r.doc_id in stays}


def fp_brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [*TEXTS, "a", "a b", "A b C", "É é A b c", "one two three four one two three four", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fp_brute(text)


def test_golay_keys_find_all_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    for bits in (1, 2):
        b = a.copy()
        for _ in range(bits):
            b ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
        keys = set(zip(*(x.tolist() for x in simhash.golay_keys(a))))
        assert {r for r, k in zip(*(x.tolist() for x in simhash.golay_keys(b))) if (r, k) in keys} == set(range(4000))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("bucket, bits", [(2, 2), (8, 2), (64, 2), (2, 1), (64, 1), (2, 0)])
def test_links_and_components_brute_force(spark, bucket, bits):
    rng = random.Random(bucket)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                x ^= 1 << rng.randrange(64)
            if rng.random() < 0.2:
                x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = simhash.links(df, bits, bucket)
    pairs = {tuple(sorted((r.src % 2**64, r.dst % 2**64))) for r in got.collect()}
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= bits}
    assert pairs <= want and (bucket < 64 and bits == 2 or pairs == want)
    comp = {r.node % 2**64: r.component for r in connected_components(got).collect()}
    group = {x: x for x in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in want:
        group[find(a)] = find(b)
    linked = {x for p in want for x in p}
    assert set(comp) == linked
    assert all((find(a) == find(b)) == (comp[a] == comp[b]) for a, b in itertools.combinations(sorted(linked), 2))


def test_near_groups_edges(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base.upper()), (9, base.replace(" ", "\n ")), (4, None), (2, ""), (8, " \t"), (11, "quite another text of words"), (None, base), (7, base)]
    got = simhash.near_groups(frame(spark, rows, True)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {3: 5, 2: 3, 11: 1}
    assert all(sum(r.kept for r in v) == 1 for v in by.values())
    assert all(len(r.fingerprint) == 16 for r in got) and {r.fingerprint for r in by[2]} == {"0" * 16}
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_drop_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base.upper()), (7, base), (3, base.upper()), (4, None), (2, ""), (11, "quite another text of words"), (11, "quite different words for the same id")]
    out = simhash.drop_near_copies(frame(spark, rows, True))
    assert out.columns == ["doc_id", "text", "digest", "fp", "uid", "kept", "_salt"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 11, 11]


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("crowded", [False, True])
def test_pipeline_near_copies_brute_force(spark, monkeypatch, crowded):
    """Near copies around five-word Jaccard 0.8, most of them beyond two bits, among texts that share a long passage."""
    if crowded:  # an order that says nothing: buckets are large, links the same
        monkeypatch.setattr(shingles, "FREQUENT", 0)
    rng, rows = random.Random(3), []
    shared = [f"s{k}" for k in range(40)]
    for g in range(30):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([4, 9, 40, 120, 300]))] + shared * (g % 2)
        for edits in (0, 1, 1, 2, 3, 5) * (1 + 4 * (g == 7)):
            now = list(base)
            for _ in range(edits):
                now[rng.randrange(len(now))] = f"e{rng.randrange(900)}"
            rows.append((len(rows), " ".join(now)))
    rows = [(i, t) for i, t in rows if t not in {u for j, u in rows if j < i}]
    fp = {i: simhash.fingerprint(t) for i, t in rows}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(x, y) >= 0.8}
    far = {p for p in want if (fp[p[0]] ^ fp[p[1]]).bit_count() > 2}
    assert len(far) > 30
    got = {frozenset((r.src % 2**64, r.dst % 2**64)) for r in shingles.similar(frame(spark, rows)).collect()}
    assert got <= {frozenset((fp[a], fp[b])) for a, b in want}
    group = {i: i for i, _ in rows}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in want | {p for p in itertools.combinations(group, 2) if (fp[p[0]] ^ fp[p[1]]).bit_count() <= 2}:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, frame(spark, rows), "").collect()}
    assert kept == {find(i) for i in group}


def test_candidates_meet_by_sketches(spark, monkeypatch):
    """Texts that share a rare passage and little else are candidates, but no set of theirs is moved; a sketch never parts two sets that reach 0.8."""
    rng, rows, sizes = random.Random(5), [], {}
    for g in range(20):
        passage = [f"p{g}x{k}" for k in range(12)]
        rows += [(len(rows) + k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(200)])) for k in range(5)]
    rows += [(100, rows[0][1] + " end")]

    def counted(df, name, codec="zstd"):
        out = written(df, name, codec)
        sizes.setdefault(name, []).append(out.count())
        return out

    written = shingles.written
    monkeypatch.setattr(shingles, "written", counted)
    assert shingles.similar(frame(spark, rows)).count() == 1
    assert sum(sizes["shingle-pairs"]) == 1 and sum(sizes["shingle-sets"]) == 2
    for n in (1, 40, 3000):
        base = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        for lost in range(0, n // 9 + 1, max(1, n // 40)):
            other = np.concatenate([base[lost:], np.array([rng.getrandbits(64) for _ in range(lost)], np.uint64)])
            x, y = shingles.sketch(base).view(np.uint8), shingles.sketch(other).view(np.uint8)
            assert np.unpackbits(x ^ y).sum() <= 2 * lost


def test_long_candidates_meet_by_longer_sketches(spark, monkeypatch):
    """Long texts that share a rare passage and little else: sketches of 1,024 bits leave all their pairs, the longer ones none."""
    monkeypatch.setattr(shingles, "FREQUENT", 0)  # else the passage, met more than once, comes last
    rng, rows, sizes = random.Random(6), [], {}
    for g in range(3):
        passage = [f"p{g}x{k}" for k in range(12)]
        rows += [(len(rows) + k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(4000 + 300 * k)])) for k in range(4)]
    copy = rows[1][1].split()
    copy[2000:2600] = copy[1000:1100]  # fewer words, another length of sketch than the text of which it is a near copy
    rows += [(100, " ".join(copy))]
    assert jaccard(rows[1][1], rows[-1][1]) >= 0.8
    assert len({len(shingles.fine(shingles.shingles(rows[k][1]))) for k in (1, -1)}) == 2

    def counted(df, name, codec="zstd"):
        out = written(df, name, codec)
        sizes.setdefault(name, []).append(out.count())
        return out

    written = shingles.written
    monkeypatch.setattr(shingles, "written", counted)
    assert shingles.similar(frame(spark, rows)).count() == 1
    assert sum(sizes["shingle-pairs"]) == 1 and sum(sizes["shingle-sets"]) == 2 and sum(sizes["shingle-candidates"]) > 5


def test_longer_sketches_fold():
    """Half over half, a longer sketch is that of half the length, and none tells more apart than there is."""
    rng = random.Random(7)
    for n in (1025, 2048, 2049, 5000):
        own = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        long = shingles.fine(own)
        assert n <= 64 * len(long) < 2 * n
        assert (long[: len(long) // 2] ^ long[len(long) // 2 :]).tolist() == shingles.sketch(own, len(long) // 2).tolist()
        other = np.concatenate([own[n // 9 :], np.array([rng.getrandbits(64) for _ in range(n // 9)], np.uint64)])
        assert np.unpackbits((long ^ shingles.fine(other)).view(np.uint8)).sum() <= 2 * (n // 9)
    assert len(shingles.fine(own[:1024])) == 0


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_shingles(spark, monkeypatch, hot):
    """Shingles of many postings are taken in salted cells, with the same leaders, open buckets and components."""
    monkeypatch.setattr(shingles, "FREQUENT", 0)
    rng, rows = random.Random(8), []
    shared = [f"s{k}" for k in range(40)]
    for g in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([9, 40, 120]))] + shared * (g % 2)
        for edits in (0, 1, 1, 2, 3, 5):
            now = list(base)
            for _ in range(edits):
                now[rng.randrange(len(now))] = f"e{rng.randrange(900)}"
            rows.append((len(rows), " ".join(now)))
    texts = frame(spark, rows).select("text", F.xxhash64("text").alias("uid"))
    firsts = shingles._firsts(texts, shingles.frequent(texts))
    posts, none = shingles._postings(firsts)
    monkeypatch.setattr(shingles, "HOT", hot)
    again, some = shingles._postings(firsts)
    held = posts.groupBy("key").count().filter(F.col("count") > hot)
    assert none is None and sorted(some.collect()) == sorted(held.select("key").collect()) and held.count() > 20
    assert posts.join(some, "key", "left_anti").count() > 20 or hot == 1
    flat = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert flat(shingles._led(posts, None)) == flat(shingles._led(again, some))
    labels = lambda df: df.withColumn("component", F.pmod("uid", F.lit(5)))
    opened = flat(shingles._opened(labels(posts), None))
    assert len(opened) > 50 and opened == flat(shingles._opened(labels(again), some))


def test_salted_lookup_shuffles_rows_once(spark, tmp_path):
    """Both readings of the rows, for the groups and for the look-up, take one shuffle."""
    from lodestar.runtime import salted_lookup

    spark.range(1000).selectExpr("id % 7 key", "id fp").write.parquet(str(tmp_path / "rows"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that shows its reuse before it runs
    try:
        out = salted_lookup(spark.read.parquet(str(tmp_path / "rows")), "key", "fp", {"n": (F.count("fp"), F.sum)}, keep="n > 142")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan
        assert sorted({(r.key, r.n) for r in out.collect()}) == [(k, 143) for k in range(6)] and out.count() == 858
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
