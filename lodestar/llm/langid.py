"""Language ID by a byte convolutional network trained in numpy.

Text is lower-cased, ASCII that is no letter becomes a space, and its UTF-8 bytes are cut into windows of ``WINDOW`` bytes that cover the
whole text. A window goes through filters of two, three and four bytes, a
rectifier, max pooling over positions and a softmax layer. A text's score is
the mean of its windows' log-probabilities, weighted by length.

A filter over bytes is a sum of table look-ups, and a pair of neighbouring
bytes is one look-up in a table of 65,536 rows; so is each half of a filter of
four bytes, and a filter of three is a pair and a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestar.runtime import dropped, numbered, small_or_shuffled, written

#: Bytes in a window, filters of each width, and the widths.
WINDOW, FILTERS, WIDTHS = 512, 10, (2, 3, 4)
#: Most labelled rows of each language that training reads, windows of each row, and rows of all languages (the documented bounds of the sample).
PER_LANG, TRAIN_WINDOWS, TRAIN_ROWS = 400, 3, 40_000
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ASCII = re.compile(r"[a-zA-Z]")


def has_letter(text: str) -> bool:
    return _ASCII.search(text) is not None or any(map(str.isalpha, text))


def text_bytes(text: str) -> np.ndarray:
    """The bytes that the network sees: lower case, ASCII that is no letter as spaces."""
    return np.frombuffer(text.lower().encode("utf-8", "replace").translate(_TO_SPACE), np.uint8)


def windows(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """All of ``data`` as rows of ``size`` bytes; a short last window is padded with spaces."""
    n = max(1, -(-len(data) // size))
    out = np.full(n * size, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, size)


class ByteCNN:
    """Parameters, training and scoring of the network."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, max(1, len(langs)))).astype(np.float32)
        self.base = np.zeros(max(1, len(langs)), np.float32)
        self.tables: list[np.ndarray] | None = None

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam on cross-entropy; gradients pass through the pooled positions only."""
        params = [*self.conv, self.bias, self.out, self.base]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                pooled, where = [], []
                for k, w in enumerate(WIDTHS):
                    n = xb.shape[1] - w + 1
                    act = sum(self.conv[k][j][xb[:, j : j + n]] for j in range(w))
                    best = act.argmax(1)
                    where.append(best)
                    pooled.append(np.take_along_axis(act, best[:, None, :], 1)[:, 0] + self.bias[k])
                h = np.concatenate(pooled, 1)
                r = np.maximum(h, 0)
                z = r @ self.out + self.base
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), yb] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (h > 0)
                grads = [np.zeros_like(c) for c in self.conv]
                g_bias = back.sum(0).reshape(self.bias.shape)
                f = np.broadcast_to(np.arange(FILTERS), (len(rows), FILTERS))
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        byte = np.take_along_axis(xb, where[k] + j, 1)
                        np.add.at(grads[k][j], (byte, f), g)
                step += 1
                for q, (param, grad) in enumerate(zip(params, [*grads, g_bias, r.T @ p + 1e-4 * self.out, p.sum(0)])):
                    m[q] = 0.9 * m[q] + 0.1 * grad
                    v[q] = 0.999 * v[q] + 0.001 * grad * grad
                    param -= rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
        return self

    def compiled(self) -> ByteCNN:
        """With pair tables made, for scoring."""
        c2, c3, c4 = self.conv
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        first = np.concatenate([pair(c2[0], c2[1]), pair(c3[0], c3[1]), pair(c4[0], c4[1])], 1)
        self.tables = [np.ascontiguousarray(first), np.ascontiguousarray(pair(c4[2], c4[3])), np.ascontiguousarray(c3[2])]
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window (rows of equal length)."""
        if self.tables is None:
            self.compiled()
        first, second, third = self.tables
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 64):
            xb = x[at : at + 64].astype(np.int32)
            code = xb[:, :-1] << 8 | xb[:, 1:]
            act = first[code]
            act[:, :-1, FILTERS : 2 * FILTERS] += third[xb[:, 2:]]
            act[:, :-2, 2 * FILTERS :] += second[code[:, 2:]]
            act[:, -1, FILTERS:] = -np.inf
            act[:, -2, 2 * FILTERS :] = -np.inf
            h = np.maximum(act.max(1) + self.bias.reshape(-1), 0)
            z = h @ self.out + self.base
            z -= z.max(1, keepdims=True)
            out[at : at + 64] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each whole text; ``und`` and 0 for null or a text without a letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        parts, owner, weight, held = [], [], [], 0
        total = np.zeros((len(texts), len(self.langs)), np.float64)
        mass = np.zeros(len(texts))

        def flush() -> None:
            nonlocal parts, owner, weight, held
            if parts:
                logs = self.log_probs(np.concatenate(parts)) * np.array(weight, np.float32)[:, None]
                np.add.at(total, owner, logs)
                np.add.at(mass, owner, weight)
            parts, owner, weight, held = [], [], [], 0

        for k, t in enumerate(texts):
            if t is None or not has_letter(t):
                continue
            data = text_bytes(t)
            for at in range(0, max(1, len(data)), 1 << 20):
                w = windows(data[at : at + (1 << 20)])
                size = [WINDOW] * len(w)
                size[-1] = max(1, len(data[at : at + (1 << 20)]) - WINDOW * (len(w) - 1))
                parts.append(w)
                owner += [k] * len(w)
                weight += size
                held += len(w)
                if held >= 2048:
                    flush()
        flush()
        for k in np.flatnonzero(mass).tolist():
            p = total[k] / mass[k]
            p = np.exp(p - p.max())
            best = int(p.argmax())
            out[k] = (self.langs[best], float(p[best] / p.sum()))
        return out


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids whose crc32 (of the id as text) leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sampled(data: np.ndarray, most: int = TRAIN_WINDOWS) -> np.ndarray:
    """Up to ``most`` windows evenly spread over all of a text's bytes, whatever its script; full ones where there are any."""
    w = windows(data)
    full = max(1, len(data) // WINDOW)
    return w[np.unique(np.linspace(0, full - 1, min(most, full)).round().astype(int))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, rows: int = TRAIN_ROWS) -> ByteCNN:
    """A network fitted on at most ``per_lang`` rows of each language that are not held out, and ``rows`` in all.

    Every language takes part: with more than ``rows / per_lang`` of them each
    has fewer rows, one at least. The sample is rows with the smallest hashes of
    the id. Of each text ``TRAIN_WINDOWS`` windows, evenly spread, train. Null
    languages and texts without a letter teach nothing; no rows give a network
    that answers ``und``.
    """
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("out"))
    own = own.filter("lang is not null and text is not null and not out")
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, min(per_lang, rows // max(1, sizes.count())))
    # about half as many again pass by hash alone, so that a window ranks few rows of any language
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = own.join(small_or_shuffled(sizes), "lang").filter(unit < F.lit(1.5 * each + 40) / F.col("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sampled(text_bytes(t)).tobytes() if has_letter(t) else b"" for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["lang", "id", "bytes"])

    taught = written(some.select("lang", "id", "text").mapInArrow(cut, "lang string, id string, bytes binary"), "lang-sample")
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "bytes")
    best = taught.filter("length(bytes) > 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each)
    got: dict[str, list] = {}
    for r in best.select("lang", "bytes").orderBy("lang", "r").toLocalIterator():  # at most ``rows`` of TRAIN_WINDOWS windows each
        got.setdefault(r["lang"], []).append(np.frombuffer(bytes(r["bytes"]), np.uint8).reshape(-1, WINDOW))
    dropped(taught)
    net, xs, ys, rng = ByteCNN(sorted(got)), [], [], np.random.default_rng(3)
    for y, lang in enumerate(net.langs):
        for w in got[lang]:
            short = w.copy()  # texts of a few words are to be told apart too
            for row, size in zip(short, rng.integers(8, WINDOW, len(w))):
                row[size:] = 32
            xs += [w, short]
            ys += [y] * 2 * len(w)
    if xs:
        net.train(np.concatenate(xs), np.array(ys))
    return net.compiled()


def predict(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced).

    A null text or one without a letter is ``und`` with score 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # under 10 MB whatever the data
    plain = docs.drop("lang_pred", "score")
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at, names = plain.columns.index(text_col), [*plain.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                found = model.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names)

    return plain.mapInArrow(run, schema)


def keep_known(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows that language ID rejects: ``und``, or a score under ``least``.

    Columns stay as they are, whatever their names (a caller's ``score`` or
    ``lang_pred`` too). Null, empty and letterless texts go; repeated rows are
    judged each; no rows in, no rows out.
    """
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    told = predict(numbered(docs), train(docs, id_col, text_col, lang_col), text_col=own[text_col])
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score").toDF(*docs.columns)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), net).drop("text")
