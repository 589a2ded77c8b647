"""SimHash near-dedup: fingerprints, Golay-code fuzzy keys, verified links, components.

A 64-bit fingerprint is cut in three segments of 22, 21 and 21 bits. If two
fingerprints differ in at most two bits, one segment is free of errors
(pigeonhole), and the next one has at most two. The perfect binary Golay code
of 23 bits decodes every word to the one codeword within distance three; the
indices of the codewords that a segment and its one-bit neighbours decode to
are one or six, and two segments at distance two or less always share one of
them (the word half way is a neighbour of both). So the keys
``(clean segment, its value, codeword index of the next)`` find every pair, and
each candidate is verified on the whole fingerprint.

Equal fingerprints are merged before keys are made. A bucket with more than
``BUCKET`` different fingerprints is not paired: its members are keyed by each
word within one bit, which two fingerprints share exactly if they differ in at
most two bits, and linked to the least member under each key; that is linear
and keeps every component whole. (Within one bit, each is linked to those of its
65 words that are members themselves.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import shingles
from lodestar.llm.exact_dedup import digest, without_rows
from lodestar.operators.components import connected_components
from lodestar.runtime import dropped, salted_lookup, written

#: Different fingerprints up to which a bucket is compared pair by pair.
BUCKET = 64
#: Bit offset and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LANES = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], dtype=np.int64)
_CHUNK = 1 << 18
#: Generator polynomial of the Golay code of 23 bits.
_G = 0b101011100011


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of
    ``shingle`` words, repeats included, joined by one space, are hashed by XXH64.
    Fewer words make one shingle; no words or null give zero. A bit is set if
    more than half of the hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, xx = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return xx(joined, seed)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])[:n]
    ends = np.concatenate([spaces, [len(joined)]])[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([xx(joined[s:e], seed) for s, e in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())], dtype="<u8")
        lanes = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(lanes[:, k], minlength=256) @ _LANES
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keyed: bool = False) -> DataFrame:
    """``(doc_id, uid, fp)`` of every row, written once; ``fp`` is the fingerprint as a signed long.

    With ``keyed`` the text's ``digest`` comes along.
    """
    kept = ["doc_id", "uid"] + ["digest"] * keyed

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(fp)], [*kept, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"), *[digest(text_col).alias("digest")] * keyed)
    return written(rows.mapInArrow(run, "doc_id long, uid long, " + "digest binary, " * keyed + "fp long"), "fingerprints")


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (_G << (bit - 11)), out)
    return out


def _tables() -> np.ndarray:
    """By syndrome, the up to six bit patterns that lead from a word to its codewords (-1: none)."""
    errors = [0] + [1 << i for i in range(23)]
    errors += [1 << i | 1 << j for i in range(23) for j in range(i)]
    errors += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    e = np.array(errors, dtype=np.int64)
    leader = np.zeros(2048, np.int64)
    leader[_syndrome(e)] = e
    out = np.full((2048, 6), -1, np.int64)
    flips = np.array([0] + [1 << i for i in range(23)], dtype=np.int64)
    steps = _syndrome(flips)
    for s in range(2048):
        found = np.unique(flips ^ leader[s ^ steps])
        out[s, : len(found)] = found
    return out


_TO_CODE = _tables()


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, index)``: the 12-bit indices of the codewords near each 23-bit word."""
    w = words.astype(np.int64)
    to = _TO_CODE[_syndrome(w)]
    row, col = np.nonzero(to >= 0)
    return row, (w[row] ^ to[row, col]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` for unsigned fingerprints; any two within two bits share a key."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << wide) - 1)).astype(np.int64) for at, wide in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, index = golay_indices(parts[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 34) | (parts[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def links(fps: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``(src, dst)`` between different fingerprints of column ``fp`` (distinct) that differ in at most two bits.

    Pairs in small buckets are all there; of larger ones enough to join the same components (for two bits; for fewer all pairs).
    """
    if not 0 <= bits <= 2:
        raise ValueError("the keys find pairs within two bits")

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    keys = fps.select("fp").mapInArrow(run, "key long, fp long")
    # the count reads fp too, so that it and the look-up share one shuffle
    sized = written(salted_lookup(keys, "key", "fp", {"n": (F.count("fp"), F.sum)}, keep="n > 1"), "golay-buckets")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits
    groups = sized.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    small = groups.select("fps", F.explode("fps").alias("src")).select("src", F.explode("fps").alias("dst")).filter((F.col("src") < F.col("dst")) & near)
    hot = sized.filter(F.col("n") > bucket).select("fp").distinct()
    balls = hot.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])).alias("e"))
    balls = balls.select("fp", F.col("fp").bitwiseXOR(F.col("e")).alias("ball"))
    if bits == 2:  # all under one word are within two bits of each other
        least = balls.groupBy("ball").agg(F.min("fp").alias("dst"))
    else:  # all pairs: a fingerprint has at most 64 others within one bit
        least = hot.select(F.col("fp").alias("ball"), F.col("fp").alias("dst"))
    large = balls.join(least, "ball").select(F.col("fp").alias("src"), "dst").filter((F.col("src") != F.col("dst")) & near)
    return small.union(large).distinct()


def components(rows: DataFrame, bits: int = 2, more: DataFrame | None = None) -> DataFrame:
    """Add ``component_id`` (smallest doc_id reachable over links) and ``keep_uid`` to ``(doc_id, uid, fp)`` rows.

    ``more`` has further links ``(src, dst)`` between fingerprints.
    The row that stays is the one with the smallest ``(doc_id, uid)``; null ids come last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    per_fp = written(rows.groupBy("fp").agg(first.alias("first")), "distinct-fp")
    near = links(per_fp, bits)
    found = written(connected_components(near if more is None else near.union(more)), "fp-components")
    rooted = per_fp.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = rooted.groupBy("component").agg(F.min("first").alias("root"))
    labels = rooted.join(linked, "component").select("fp", F.col("root.doc_id").alias("component_id"), F.col("root.uid").alias("keep_uid"))
    # per_fp has one row a fingerprint; a hot fingerprint's rows are spread by salt
    cells = rows.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(32)).cast("int"))
    salts = cells.select("fp", "_salt").distinct().groupBy("fp").agg(F.collect_list("_salt").alias("salts"))
    spread = labels.join(salts, "fp").select("fp", "component_id", "keep_uid", F.explode("salts").alias("_salt"))
    return cells.join(spread, ["fp", "_salt"]).drop("_salt")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, kept.

    Texts whose fingerprints differ in at most ``bits`` bits (0 to 2) are linked
    and components are taken over links. One row of each component has ``kept``.
    Null and empty texts have fingerprint zero and are linked like any other.
    """
    rows = fingerprints(docs, id_col, text_col, shingle)
    out = components(rows, bits)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), "component_id", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, jaccard: bool = False) -> DataFrame:
    """``docs`` with one row of each near-duplicate component (smallest id), all columns kept, whatever their names.

    With ``jaccard`` texts whose five-word shingles have a Jaccard similarity of
    0.8 are linked too. Nulls, empty texts and repeated rows are as in ``near_groups``.
    """
    rows = fingerprints(docs, id_col, text_col, shingle, keyed=True)
    more = shingles.similar(docs, text_col) if jaccard else None
    marked = written(components(rows, bits, more), "near-groups")
    dropped(rows)
    keeps = marked.filter("uid = keep_uid").select(F.col("doc_id").alias("i"), F.col("digest").alias("g"))
    lost = marked.filter("uid != keep_uid").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_digest") == F.col("g"))
    lost = written(lost.join(keeps.withColumn("_twin", F.lit(True)), same, "left").select("_id", "_digest", F.coalesce("_twin", F.lit(False)).alias("_twin")), "near-copies")
    dropped(marked)
    return without_rows(docs, lost, id_col, text_col)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs)
