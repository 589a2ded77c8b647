"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their beginnings of four, five and six bytes (so a
compound is known by its stem), and in scripts without spaces between words all
runs of two and three characters; each is hashed to one of ``BUCKETS`` buckets and
counts once. The machine's score is ``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` over
the buckets present: the pair term learns what two terms mean together, such as
an insult next to a group's name, which additive weights miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestar.llm.langid import held_out
from lodestar.runtime import dropped, written

#: Hash buckets, buckets that the machine keeps, factors of each.
BUCKETS, ACTIVE, FACTORS = 1 << 20, 4096, 8
#: Most labelled rows of each class that training reads (the documented bound).
PER_CLASS = 8000
#: Words whose terms a worker remembers, and the longest of them; longer ones are hashed anew.
CACHE_WORDS, CACHE_BYTES = 400_000, 256
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTERS = re.compile(r"[^\W\d_]+")
#: Thai, Lao, Burmese and Khmer letters, kana, Han: scripts that don't part words by spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words(text: str | None) -> set[bytes]:
    """Different lower-case words of a whole text; ASCII that is no letter separates them."""
    return set((text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split())


def term_buckets(word: bytes) -> list[int]:
    """Buckets of all terms of a run: its words, split at whatever is no letter, their beginnings, and characters' n-grams."""
    parts = [word] if word.isascii() else [p.encode() for p in _LETTERS.findall(word.decode("utf-8", "replace"))]
    terms = []
    for p in parts:
        terms += [b"w:" + p] + [b"%d:%s" % (n, p[:n]) for n in (4, 5, 6) if len(p) > n]
        if not p.isascii() and _UNSPACED.search(text := p.decode()):
            terms += {b"g:" + text[k : k + n].encode() for n in (2, 3) for k in range(len(text) - n + 1)}
    return [crc32(t) % BUCKETS for t in terms]


class Machine:
    """A fitted machine: active buckets, their weights and factors."""

    def __init__(self, buckets: list[int], bias: float = 0.0, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.place = {b: k for k, b in enumerate(buckets)}
        self.bias = bias
        self.w = np.zeros(len(buckets) + 1, np.float64)  # the last is padding
        self.v = rng.normal(0, 0.02, (len(buckets) + 1, FACTORS))
        self.v[-1] = 0
        self._cache: dict[bytes, tuple[int, ...]] = {}

    def features(self, text: str | None) -> list[int]:
        """Sorted places of the active buckets present in a whole text."""
        found: set[int] = set()
        cache = self._cache
        for w in words(text):
            hit = cache.get(w)
            if hit is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                hit = tuple({self.place[b] for b in term_buckets(w) if b in self.place})
                if len(w) <= CACHE_BYTES:
                    cache[w] = hit
            if hit:
                found.update(hit)
        return sorted(found)

    def raw(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        sizes = np.array([len(r) for r in rows])
        if sizes.sum():
            flat = np.concatenate([np.array(r, np.int64) for r in rows if len(r)])
            starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])[:-1]
            v = self.v[flat]
            s = np.add.reduceat(v, starts)
            pair = 0.5 * ((s**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
            out[sizes > 0] += np.add.reduceat(self.w[flat], starts) + pair
        return out

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))

    def fit(self, rows: list[list[int]], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, l2: float = 2e-4, seed: int = 11) -> Machine:
        """Adagrad on weighted logistic loss."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        pad = len(self.w) - 1
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                own = order[at : at + batch]
                wide = max(1, max(len(rows[i]) for i in own))
                x = np.full((len(own), wide), pad)
                for k, i in enumerate(own):
                    x[k, : len(rows[i])] = rows[i]
                v = self.v[x]
                s = v.sum(1)
                z = self.bias + self.w[x].sum(1) + 0.5 * ((s**2).sum(1) - (v**2).sum((1, 2)))
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) * weight[own] / len(own)
                used = np.unique(x)
                dw = np.bincount(x.ravel(), np.repeat(d, wide), len(self.w))[used] + l2 * self.w[used]
                dv = np.zeros_like(self.v)
                np.add.at(dv, x, d[:, None, None] * (s[:, None, :] - v))
                dv = dv[used] + l2 * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                gb += d.sum() ** 2
                self.bias -= rate * d.sum() / np.sqrt(gb)
                self.w[pad] = 0
                self.v[pad] = 0
        return self


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """``(y, text)`` of at most ``per_class`` rows a class, and how many labelled ids each class has."""
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    few = [known.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(per_class) for y in sorted(sizes)]
    if not few:
        return docs.select(F.lit(0).alias("y"), F.col(text_col).alias("text")).limit(0), sizes
    chosen = few[0] if len(few) == 1 else few[0].union(few[1])
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")  # at most 2 * per_class ids
    return joined.select("y", "text"), sizes


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = PER_CLASS, active: int = ACTIVE) -> Machine:
    """A machine fitted on at most ``per_class`` labelled rows a class that are not held out.

    The sample is those with the smallest hashes of the id, weighted back to the
    classes' true shares. Buckets that differ most between the classes (by
    chi-square over the sample) stay active. An id that is labelled twice takes
    the larger label; null labels teach nothing; without labels every score is
    one half.
    """
    chosen, sizes = _sample(docs, labels, id_col, text_col, label, per_class)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = sorted({k for w in words(t.as_py()) for k in term_buckets(w)})
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([found], pa.list_(pa.int32()))], ["y", "buckets"])

    rows = written(chosen.mapInArrow(terms, "y int, buckets array<int>"), "toxic-sample")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        dropped(rows)
        return Machine([], 0.0 if pos == neg else (20.0 if pos else -20.0))
    seen = rows.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter("a + b >= 2")
    n = float(pos + neg)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = n * F.pow(a * (neg - b) - b * (pos - a), F.lit(2)) / (F.lit(float(pos) * neg) * (a + b) * (n - a - b + 1e-9))
    kept = [r["bucket"] for r in seen.orderBy(chi.desc(), "bucket").limit(active).select("bucket").collect()]
    machine = Machine(kept)
    place = machine.place

    def active_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[k] for k in r if k in place) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "places"])

    got = rows.mapInArrow(active_only, "y int, places array<int>").collect()
    dropped(rows)
    got = sorted((r["y"], r["places"]) for r in got)
    y = np.array([r[0] for r in got], np.float64)
    whole = sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y == 1, whole / (pos / n), (1 - whole) / (neg / n))
    machine.bias = float(np.log(whole / (1 - whole)))
    return machine.fit([r[1] for r in got], y, weight)


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from one half on) added, replacing columns so named.

    The whole text is scored; null and empty texts get the machine's bias.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # under 1 MB whatever the data
    plain = docs.drop("score", "predicted")
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    at, names = plain.columns.index(text_col), [*plain.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.value.score([model.value.features(t.as_py()) for t in b.column(at)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names)

    return plain.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), machine).drop("text")
