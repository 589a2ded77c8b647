"""Texts with a Jaccard similarity of at least 0.8 on their sets of five-word shingles, exactly.

Shingles are taken as their 64-bit hashes. Two sets of ``n`` and ``m`` shingles
reach 0.8 if they share at least ``4 (n + m) / 9``; so in any order that holds
for all texts, the first shingle they share leaves that many less one behind it
in both. Only a fifth of a text's shingles can be such a first one. The order is
by how often a shingle was met in all texts, then by hash: it decides how many
candidates there are and never which links are found. Shingles that only one
text has among its first ones go before anything else is done.

Candidates are first held against each other by sketches of 1,024 bits, and texts
with more shingles by sketches of a bit a shingle too (all pairs of long texts
would pass the short ones); neither ever rules out a pair that reaches 0.8. Whole
sets are only moved for pairs that are left. Which texts those are is told by a
bit array of fixed size, so no text is shuffled, however many there are.

Groups of a shingle are found by one shuffle of the postings. Only shingles that
more than ``HOT`` postings have, which are counted, are taken in salted cells.

A family of near copies isn't paired with itself. First each text is compared
with the leader of each of its shingles' buckets, which is linear, and components
are taken over the pairs that reach 0.8. Then the buckets that hold more than one
component are opened, and there the texts outside the largest component are
compared with all of other components. A pair that reaches 0.8 is thus linked or
was in one component before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.components import connected_components
from lodestar.runtime import dropped, released, salted_lookup, small_or_shuffled, written

WORDS = 5
#: Shingles that a task counts at a time, and the most frequent ones that are told apart from the rest in the order.
COUNTED, FREQUENT = 1 << 22, 200_000
#: Longs of a sketch, and bits (8 MB) by which ids are told before any row is moved.
LANES, KNOWN = 16, 1 << 26
#: Postings of a shingle up to which one task takes them all.
HOT = 1 << 16
_LANES = [f"s{k}" for k in range(LANES)]


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the different five-word shingles; fewer words make one, no words none. Words are op2's."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in found], dtype=np.uint64))


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that many texts have, from one pass over all of them.

    A task counts up to ``COUNTED`` shingles at a time and gives those met more
    than once; the sums over all tasks are ranked.
    """

    def run(batches):
        held, size = [], 0

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1])], ["key", "n"])

        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py()).view(np.int64))
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    met = texts.select("text").mapInArrow(released(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = met.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    keys, n = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(own: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a text's shingles, rarest first, one of which is the first that it shares with any text that reaches 0.8."""
    n = len(own)
    if not n:
        return own
    often = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        often = np.where(keys[at] == own, counts[at], 0)
    return own[np.lexsort((own, often))][: n - (4 * n + 4) // 5 + 1]


def sketch(own: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """A set of shingles as ``64 * lanes`` bits, each the parity of the shingles that fall on it.

    A shingle that only one of two sets has turns one bit over, so two sketches
    differ in no more bits than their sets in shingles.
    """
    odd = np.bincount((own % np.uint64(64 * lanes)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fine(own: np.ndarray) -> np.ndarray:
    """A longer sketch of a set that has more shingles than ``sketch`` bits: a bit a shingle, rounded up to a power of two; else empty.

    The two halves of one, put over each other, are the sketch of half its length.
    """
    return sketch(own, 1 << (-(-len(own) // 64) - 1).bit_length()) if len(own) > 64 * LANES else np.zeros(0, np.int64)


def known(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size, on the driver, with the bits of all ``ids`` (one column of longs) set; others may be set too."""
    at = ids.toDF("id").select((F.pmod("id", F.lit(KNOWN)) + 1).alias("at"))
    placed = at.select(F.bitmap_bucket_number("at").alias("part"), F.bitmap_bit_position("at").alias("bit")).repartition("part")
    out = np.zeros(KNOWN // 8, np.uint8)
    for r in placed.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ``ids`` may be among those that ``bits`` was made of."""
    at = np.mod(ids, KNOWN)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _firsts(texts: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(uid, n, keys, fine, s0, s1, ...)``, one row a text: the number of its shingles, the first of them in order, and its sketches."""
    shared = texts.sparkSession.sparkContext.broadcast(often)  # at most FREQUENT pairs

    def run(batches):
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            own = [shingles(t.as_py()) for t in b.column(1)]
            cut = [prefix(x, *shared.value).view(np.int64) for x in own]
            marks = np.array([sketch(x) for x in own], np.int64).reshape(len(own), LANES)
            sizes = pa.array([len(x) for x in own], pa.int32())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (cut, [fine(x) for x in own])]
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, *lists, *map(pa.array, marks.T.copy())], ["uid", "n", "keys", "fine", *_LANES])

    lanes = ", ".join(f"{c} long" for c in _LANES)
    out = written(texts.select("uid", "text").mapInArrow(released(run), f"uid long, n int, keys array<long>, fine array<long>, {lanes}"), "shingle-firsts")
    shared.destroy()  # the driver keeps a broadcast otherwise, in its heap and in its Python
    return out


def _postings(firsts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(key, uid, n, pos)`` of the first shingles that more than one row has among its first ones (and of a few others), and the keys of more than ``HOT`` rows, if any."""
    again = written(firsts.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1"), "shingle-again")
    bits = firsts.sparkSession.sparkContext.broadcast(known(again.select("key")))
    hot = written(again.filter(F.col("count") > HOT).select("key"), "shingle-hot")

    def run(batches):
        for b in batches:
            keys = b.column(2)
            long = pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False)
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            stay = _has(bits.value, flat)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)
            columns = [flat, *(np.repeat(b.column(k).to_numpy(zero_copy_only=False), long) for k in (0, 1)), pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in columns], ["key", "uid", "n", "pos"])

    out = written(firsts.select("uid", "n", "keys").mapInArrow(released(run), "key long, uid long, n int, pos int"), "shingle-postings")
    bits.destroy()
    dropped(again)
    if hot.isEmpty():
        dropped(hot)
        return out, None
    return out, hot


def _parted(rows: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that a task can take whole, and those of ``hot`` ones."""
    if hot is None:
        return rows, None
    few = F.broadcast(hot)  # at most one in HOT postings
    return rows.join(few, "key", "left_anti"), rows.join(few, "key", "left_semi")


def _led(posts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Postings with the least one of their key, ``lead``, where a key has several."""
    least = F.min(F.struct("uid", "n", "pos"))
    rest, large = _parted(posts, hot)
    of_key = Window.partitionBy("key")
    out = rest.withColumns({"lead": least.over(of_key), "size": F.count("*").over(of_key)}).filter("size > 1")
    if large is not None:
        out = out.unionByName(salted_lookup(large, "key", "uid", {"lead": (least, F.min), "size": (F.count("*"), F.sum)}, keep="size > 1"))
    return out.drop("size")


def _opened(labelled: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Postings of the keys that several components have, and whether theirs is another than the key's largest: ``outside``."""
    rest, large = _parted(labelled, hot)
    # all by one shuffle: what is parted by key is parted by key and component too
    of_key, of_part = Window.partitionBy("key"), Window.partitionBy("key", "component")
    both = rest.withColumns({"low": F.min("component").over(of_key), "high": F.max("component").over(of_key)}).filter("low < high")
    most = both.withColumn("count", F.count("*").over(of_part)).withColumn("largest", F.max(F.struct("count", "component")).over(of_key))
    out = most.withColumn("outside", F.col("component") != F.col("largest.component")).drop("low", "high", "count", "largest")
    if large is not None:
        large = salted_lookup(large, "key", "uid", {"low": (F.min("component"), F.min), "high": (F.max("component"), F.max)}, keep="low < high").drop("low", "high")
        sizes = large.groupBy("key", "component").count()
        largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
        told = sizes.join(largest, "key").select("key", "component", (F.col("component") != F.col("largest")).alias("outside"))
        out = out.unionByName(large.join(told, ["key", "component"]))
    return out


def _possible(na, pa_, nb, pb):
    """The shared shingle and what is behind it in both texts can make up 0.8."""
    return 9 * F.least(na - pa_, nb - pb) >= 4 * (na + nb)


def _attached(pairs: DataFrame, rows: DataFrame, salts: int = 16) -> DataFrame:
    """``pairs`` with the columns of both ends' rows of ``rows``, named for the end; an end of many pairs is spread over cells."""
    out = salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(salts)).cast("int"))
    for end in ("a", "b"):
        named = rows.select(F.col("uid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != "uid"])
        # of the bare pairs, so that the plan doesn't hold the first end's look-up twice
        out = out.join(salted.select(end, "salt").distinct().join(named, end), [end, "salt"])
    return out.drop("salt")


def _hopeful(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` that their sketches leave: two sets that reach 0.8 differ in at most a ninth of their sizes' sum."""
    bits = firsts.sparkSession.sparkContext.broadcast(known(pairs.select("a").union(pairs.select("b"))))

    def asked(batches):
        for b in batches:
            yield b.filter(pa.array(_has(bits.value, b.column(0).to_numpy(zero_copy_only=False))))

    rows = firsts.select("uid", "n", "fine", *_LANES)
    marks = written(rows.mapInArrow(released(asked), rows.schema), "shingle-marks")
    bits.destroy()
    short, long = (marks.select("uid", *c).dropDuplicates(["uid"]) for c in (["n", *_LANES], ["fine"]))
    both = _attached(pairs, short)
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _LANES), F.lit(0))
    left = both.filter((9 * F.least("n_a", "n_b") >= 4 * (F.col("n_a") + F.col("n_b"))) & (9 * apart <= F.col("n_a") + F.col("n_b")))
    left = written(left.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n")), "shingle-left")
    both = _attached(left, long)
    # sizes are within a quarter, so one of the longer sketches has at most twice the length; without one, nothing is apart
    size = F.least(F.size("fine_a"), F.size("fine_b"))
    halved = lambda c: F.when(F.size(c) > size, F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(halved("fine_a"), halved("fine_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    out = written(both.filter(9 * apart <= F.col("n")).select("a", "b"), "shingle-pairs")
    dropped(left)
    dropped(marks)
    return out


def _reached(pairs: DataFrame, firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose whole sets reach 0.8, with their fingerprints: (a, b, src, dst)."""
    from lodestar.llm.simhash import fingerprint

    candidates = written(pairs, "shingle-candidates")
    pairs = _hopeful(candidates, firsts)
    dropped(candidates)
    bits = texts.sparkSession.sparkContext.broadcast(known(pairs.select("a").union(pairs.select("b"))))

    def whole(batches):
        met: set[int] = set()
        for b in (part.slice(at, 512) for part in batches for at in range(0, part.num_rows, 512)):
            uids = b.column(0).to_numpy(zero_copy_only=False)
            found = {u: k for k, u in enumerate(uids.tolist()) if u not in met} if len(uids) else {}
            asked = [k for u, k in found.items() if _has(bits.value, np.int64(u))]
            if asked:
                met.update(uids[asked].tolist())
                text = [b.column(1)[k].as_py() for k in asked]
                fp = np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64)
                own = [shingles(t).view(np.int64) for t in text]
                yield pa.RecordBatch.from_arrays([pa.array(uids[asked]), pa.array(fp), pa.array(own, pa.list_(pa.int64()))], ["uid", "fp", "own"])

    # only texts of some pair, which are told without moving any; a task gives a repeated text once
    some = written(texts.select("uid", "text").mapInArrow(released(whole), "uid long, fp long, own array<long>"), "shingle-sets")
    bits.destroy()
    once = some.dropDuplicates(["uid"])
    both = _attached(pairs, once)
    near = both.filter(9 * F.size(F.array_intersect("own_a", "own_b")) >= 4 * (F.size("own_a") + F.size("own_b")))
    out = written(near.select("a", "b", F.col("fp_a").alias("src"), F.col("fp_b").alias("dst")), "shingle-links")
    dropped(pairs)
    dropped(some)
    return out


def similar(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(src, dst)``: op2's fingerprints of texts that reach 0.8 and differ in them.

    Components over these links and equal fingerprints are those over all pairs
    that reach 0.8. A text is known by a 64-bit hash. Null texts and those
    without a word have no link; repeated texts count once; no rows, no links.
    """
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null").withColumn("uid", F.xxhash64("text"))
    firsts = _firsts(texts, frequent(texts))
    posts, hot = _postings(firsts)
    near = _led(posts, hot).filter((F.col("uid") != F.col("lead.uid")) & _possible(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
    first = _reached(near.select(F.col("lead.uid").alias("a"), F.col("uid").alias("b")).distinct(), firsts, texts)

    found = written(connected_components(first, "a", "b").withColumnRenamed("node", "uid"), "shingle-components")
    labelled = posts.join(small_or_shuffled(found), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    opened = written(_opened(labelled, hot), "shingle-open")
    end = lambda df, k: df.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("uid", "n", "pos", "component")])
    cross = end(opened.filter("outside"), 1).join(end(opened, 2), "key").filter((F.col("component1") != F.col("component2")) & _possible(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2")))
    second = _reached(cross.select(F.least("uid1", "uid2").alias("a"), F.greatest("uid1", "uid2").alias("b")).distinct(), firsts, texts)
    out = written(first.union(second).select("src", "dst").filter("src != dst").distinct(), "similar")
    for done in (firsts, posts, found, opened, first, second, *[hot] * (hot is not None)):
        dropped(done)
    return out
