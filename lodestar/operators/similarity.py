"""Similarity joins: word sets, vectors and edit-like ratios."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.runtime import spread, written

#: Items of a set up to which its pairs of items are listed.
SMALL = 16


def jaccard_join(sets: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """Pairs (a < b) of keys whose item sets have a Jaccard similarity of at least ``least``, exactly.

    Prefix filtering: items are ordered from rare to frequent, and two sets that
    are similar enough share one of their first ``n - ceil(least * n) + 1``
    items, so only those are joined; the candidates are then verified on the
    whole sets. Frequent items seldom are in a prefix, so no item is hot. Small
    sets that have to share two items are joined on two, which hardly any other
    sets share.
    """
    rows = sets.count()
    s = spread(sets.select(F.col(key).alias("id"), F.col(item).alias("item")), rows, "id").distinct()
    freq = s.groupBy("item").agg(F.count("*").alias("f"))
    ranked = spread(s.join(freq, "item"), rows, "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "item"))), lambda x: x["item"]).alias("w"))
    ranked = written(ranked.select("id", F.size("w").alias("n"), "w"), "jaccard-sets", "lz4")
    need = lambda n: F.ceil(F.lit(least) * F.col(n) - 1e-9)  # noqa: E731  items that any partner has to share
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    sides = lambda d, *c: (d.toDF("a", "na", *c), d.toDF("b", "nb", *c))

    prefix = ranked.select("id", "n", F.explode(F.slice("w", 1, (F.col("n") - need("n") + 1).cast("int"))).alias("item"))
    found = []
    # one item is enough for a pair of sets that have at most one more than 1 / least items together
    lone = prefix.filter(F.lit(least) * F.col("n") <= 1 + 1e-9)
    a, b = sides(spread(lone, rows, "item"), "item")
    found.append(a.join(b, "item").filter(fits & (F.lit(least) * (F.col("na") + F.col("nb") - 1) <= 1 + 1e-9)).select("a", "b"))
    # all other pairs of small sets share two, and two of the first n - need + 2 are the first two that they share
    small = ranked.filter(f"n between 2 and {SMALL}")
    head = F.slice("w", 1, (F.col("n") - F.greatest(need("n"), F.lit(2)) + 2).cast("int"))
    two = F.flatten(F.transform(head, lambda x, i: F.transform(F.slice(head, i + 2, SMALL), lambda y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")))))
    two = small.select("id", "n", F.explode(two).alias("t")).select("id", "n", "t.x", "t.y")
    a, b = sides(spread(two, 8 * rows, "x", "y"), "x", "y")
    found.append(a.join(b, ["x", "y"]).filter(fits).select("a", "b"))
    # large sets by single items of their prefixes, with sets of any size
    large = spread(prefix.filter(f"n > {SMALL}"), rows, "item")
    other = spread(prefix.filter(F.col("n") >= least * SMALL), rows, "item")
    a, b = large.toDF("a", "na", "item"), other.toDF("b", "nb", "item")
    either = a.join(b, "item").filter((F.col("a") != F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")))
    found.append(either.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    pairs = found[0].union(found[1]).union(found[2]).distinct()
    whole = ranked.select("id", "w")
    both = pairs.join(whole.withColumnsRenamed({"id": "a", "w": "wa"}), "a").join(whole.withColumnsRenamed({"id": "b", "w": "wb"}), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    sim = common / (F.size("wa") + F.size("wb") - common)
    return both.select("a", "b", sim.alias("s")).filter(F.col("s") >= least).select("a", "b", F.round("s", 6).alias("sim"))


def jaccard_search(records: DataFrame, key: str, queries: DataFrame, query_key: str, text: str) -> DataFrame:
    """Word-set Jaccard of each query with every record that shares a word: (query_key, key, sim).

    Common words are counted through an inverted index. The record side keeps
    only words that some query has, before anything is shuffled.
    """
    words = lambda d, k: d.select(k, F.explode(F.array_distinct(F.split(F.lower(text), " "))).alias("w"))
    size = lambda d, k, n: d.select(k, F.size(F.array_distinct(F.split(F.lower(text), " "))).alias(n))
    hits = words(records, key).join(words(queries, query_key), "w").groupBy(query_key, key).agg(F.count("*").alias("n"))
    both = hits.join(size(records, key, "nr"), key).join(size(queries, query_key, "nq"), query_key)
    return both.select(query_key, key, F.round(F.col("n") / (F.col("nr") + F.col("nq") - F.col("n")), 6).alias("sim"))


def cosine_join(vectors: DataFrame, key: str, vector: str, least: float, group: str | None = None, most: float = 2.0, block: int = 2048, digits: int | None = 6) -> DataFrame:
    """Pairs (a < b) whose cosine lies in ``[least, most]``, exactly; zero and null vectors pair with none.

    ``sim`` is rounded to ``digits``, or whole without them: rounded, it can't be held against a threshold.

    Vectors are packed in blocks and blocks are paired, so each task multiplies
    two bounded matrices. The work is quadratic, as exactness asks for; for
    approximate joins use keys of ``functions.vector.sign_words``.
    """
    g = F.col(group).cast("string") if group else F.lit("")
    v = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(g, F.lit("")).alias("g"))
    v = v.withColumn("blk", F.floor((F.row_number().over(W.partitionBy("g", F.pmod("id", F.lit(16))).orderBy("id")) - 1) / block) * 16 + F.pmod("id", F.lit(16)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["v"].tolist(), dtype="<f8")
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "blk": [int(pdf["blk"].iloc[0])], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "m": [m.tobytes()], "d": [m.shape[1]]})

    blocks = v.groupBy("g", "blk").applyInPandas(pack, "g string, blk long, ids binary, m binary, d int")
    left = blocks.select("g", F.col("blk").alias("b1"), F.col("ids").alias("i1"), F.col("m").alias("m1"), "d")
    right = blocks.select("g", F.col("blk").alias("b2"), F.col("ids").alias("i2"), F.col("m").alias("m2"))
    both = left.join(right, "g").filter("b1 <= b2").select("b1", "b2", "i1", "m1", "i2", "m2", "d")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[c], "<i8") for c in ("i1", "i2")]
                ms = [np.frombuffer(r[c], "<f8").reshape(-1, r["d"]) for c in ("m1", "m2")]
                with np.errstate(all="ignore"):
                    ms = [m / np.sqrt((m * m).sum(1, keepdims=True)) for m in ms]
                sim = ms[0] @ ms[1].T
                x, y = np.nonzero((sim >= least) & (sim <= most))
                a, b, s = ids[0][x], ids[1][y], sim[x, y]
                keep = (a < b) if r["b1"] == r["b2"] else (a != b)
                a, b, s = a[keep], b[keep], s[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s if digits is None else np.round(s, digits))], ["a", "b", "sim"])

    return both.mapInArrow(compare, "a long, b long, sim double")


def ratio_join(records: DataFrame, key: str, text: str, group: str, least: float, block: int = 256, ids: int = 512) -> DataFrame:
    """Pairs of one group whose Ratcliff-Obershelp ratio is at least ``least``, exactly.

    Ratios are computed once for each two different texts of a group, in the
    orders in which their records come, and spread over the records after. Texts
    are packed in blocks and the blocks of a group are paired, so each task holds
    two bounded blocks; so are the ids of a text. A ratio is computed only if the
    lengths and the characters in common, which bound it, allow ``least``. The
    work is quadratic in the different texts of a group, as exactness asks for,
    and the rows are as many as there are pairs. Null texts and groups pair with
    none.
    """
    t = records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), F.col(group).alias("g")).filter("t is not null and g is not null")
    lane = F.pmod(F.xxhash64("t"), F.lit(16))
    texts = t.groupBy("g", "t").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    texts = texts.withColumn("lane", lane).withColumn("rn", F.row_number().over(W.partitionBy("g", "lane").orderBy("t")) - 1)
    texts = texts.select("g", "t", "n", "lo", "hi", (F.col("rn") * 16 + F.col("lane")).alias("k"), (F.floor(F.col("rn") / block) * 16 + F.col("lane")).alias("blk"))
    texts = written(texts, "ratio-texts")  # read twice
    blocks = texts.groupBy("g", "blk").agg(F.collect_list(F.struct("k", "t", "lo", "hi")).alias("r"))
    both = blocks.toDF("g", "b1", "r1").join(blocks.toDF("g", "b2", "r2"), "g").filter("b1 <= b2").select("g", (F.col("b1") == F.col("b2")).alias("own"), "r1", "r2")
    # few blocks hold many pairs: without this, coalesced partitions leave them to a few tasks
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = difflib.SequenceMatcher()
        for batch in batches:
            for i in range(batch.num_rows):
                own, left, right = (c[i].as_py() for c in batch.columns[1:])
                found = []
                for first, second in [(left, right)] if own else [(left, right), (right, left)]:  # the ratio depends on the order
                    for y in second:
                        m.set_seq2(y["t"])  # what the second text costs is paid once
                        for x in first:
                            if x["lo"] < y["hi"]:  # some record of x comes before one of y
                                m.set_seq1(x["t"])
                                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (s := m.ratio()) >= least:
                                    found.append((x["k"], y["k"], s))
                group = batch.column(0).take(pa.array([i] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([group, *(pa.array([f[c] for f in found], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.float64())))], ["g", "x", "y", "ratio"])

    alike = both.mapInArrow(compare, f"g {dict(texts.dtypes)['g']}, x long, y long, ratio double").withColumn("ratio", F.round("ratio", 6))
    cell = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ids))
    lists = t.join(texts.select("g", "t", "n", "k"), ["g", "t"]).groupBy("g", "k", cell.alias("cell")).agg(F.collect_list("id").alias("ids"))
    pairs = alike.join(lists.select("g", F.col("k").alias("x"), F.col("ids").alias("as")), ["g", "x"]).join(lists.select("g", F.col("k").alias("y"), F.col("ids").alias("bs")), ["g", "y"])
    pairs = pairs.select("as", "bs", "ratio").repartition(parts)  # a row holds up to the square of a list's pairs
    return pairs.select(F.explode("as").alias("a"), "bs", "ratio").select("a", F.explode("bs").alias("b"), "ratio").filter("a < b")
