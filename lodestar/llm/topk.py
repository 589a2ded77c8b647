"""Exact top-k inner-product search by the three-phase uniform threshold.

A vector's components are cut in two segments; a score is the sum of its two
partial scores, and each segment is a list of partial scores to be searched.

1. Every task takes the best ``k`` partial scores of the first segment for each
   query and completes those few. The ``k``-th best whole score over all tasks,
   ``t``, is one that the answer reaches.
2. ``t`` goes to all tasks. A vector that scores ``t`` has a segment of at least
   ``t / 2``, so each segment gives the entries from that cutoff on. Segments
   whose norms can't reach it are skipped without a product.
3. Only those entries get their other partial score, which makes them exact, and
   what reaches ``t`` is ranked.

Vectors lie in shards and queries in groups, both of bounded size. Each pair of
shard and group is a task of its own, so one job a phase does all queries, and
products are taken tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.runtime import dropped, written

#: Vectors of a shard and queries of a group, on average and of up to 64 components (longer ones: fewer), and most of either in a tile of products.
SHARD, GROUP, TILE = 65_536, 16_384, 1024
#: Vectors that make a shard of their own worth while.
LEAST = 1024
#: Products of components up to this sum are exact in doubles.
_EXACT = float(1 << 53)


def quantized(vector: str = "embedding", scale: float = 256.0):
    """``floor(scale * x)`` of each component as double; null where the vector takes no part."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & ~bad, v)


_BLOCK = "part int, n int, width int, uids binary, ids binary, cuts binary, data binary"


def packed(rows: DataFrame, block: int = TILE) -> DataFrame:
    """Rows of (part, uid, vec_id, cut, v), those of a part side by side, as blocks of one part; shorter vectors are filled with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), b.num_rows]
            for at, end in ((x, min(x + block, e)) for s, e in zip(edges, edges[1:]) for x in range(s, e, block)):
                part = b.slice(at, end - at)
                vectors = part.column(4).to_pylist()
                wide = max(map(len, vectors))
                data = np.zeros((len(vectors), wide))
                for k, v in enumerate(vectors):
                    data[k, : len(v)] = v
                small = _whole(data) if np.abs(data).max(initial=0) < 32768 else None  # as two bytes a component where they fit
                blob = [part.column(c).to_numpy(zero_copy_only=False).astype(t).tobytes() for c, t in ((1, "<i8"), (2, "<i8"), (3, "<f8"))]
                blob.append(small if small is not None else data.astype("<f8").tobytes())
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (int(parts[at]), len(vectors), wide)], *[pa.array([x], pa.binary()) for x in blob]], ["part", "n", "width", "uids", "ids", "cuts", "data"])

    return rows.select("part", "uid", "vec_id", "cut", "v").mapInArrow(run, _BLOCK)


def _whole(data: np.ndarray) -> bytes | None:
    small = data.astype("<i2")
    return small.tobytes() if (small == data).all() else None


class _Block:
    """A block's ids, cutoffs, vectors and the norms of their segments."""

    def __init__(self, row: dict):
        n, wide = row["n"], row["width"]
        self.uids, self.ids, self.cuts = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["cuts"], "<f8")
        kind = "<i2" if len(row["data"]) == 2 * n * wide else "<f8"
        self.v = np.frombuffer(row["data"], kind).reshape(n, wide).astype(np.float64)

    def widened(self, wide: int) -> np.ndarray:
        return np.pad(self.v, ((0, 0), (0, wide - self.v.shape[1])))


def _blocks(table: pa.Table) -> list[_Block]:
    return [_Block(r) for r in table.to_pylist()]


def _tiles(left: pa.Table, right: pa.Table):
    """(queries' block, vectors' block, segments of both) for each pair of tiles of a shard and a group."""
    queries, vectors = _blocks(right), _blocks(left)
    for q in queries:
        for c in vectors:
            wide = max(q.v.shape[1], c.v.shape[1])
            x, y = q.widened(wide), c.widened(wide)
            if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, wide) >= _EXACT:
                x, y = x.astype(np.int64), y.astype(np.int64)
            half = (wide + 1) // 2
            yield q, c, (x[:, :half], x[:, half:]), (y[:, :half], y[:, half:])


def _pairwise(x: np.ndarray, y: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Products of row ``at[k]`` of ``x`` and row ``of[k]`` of ``y``, a bounded number at a time."""
    step = 1 << 16
    parts = [np.einsum("ij,ij->i", x[at[s : s + step]], y[of[s : s + step]]) for s in range(0, len(at), step)]
    return np.concatenate(parts) if parts else np.zeros(0, x.dtype)


def listed(k: int):
    """Phase one: for each query of a group, whole scores of the ``k`` vectors of a shard that lead the first segment's list."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for q, c, x, y in _tiles(left, right):
            p = x[0] @ y[0].T
            p = np.where(q.uids[:, None] == c.uids[None, :], -np.inf, p)
            take = np.argpartition(-p, k - 1, axis=1)[:, :k] if k < p.shape[1] else np.broadcast_to(np.arange(p.shape[1]), p.shape)
            lead = np.take_along_axis(p, take, 1)
            at, of = np.repeat(np.arange(len(q.uids)), take.shape[1]), take.ravel()
            whole = np.where(lead.ravel() == -np.inf, -np.inf, lead.ravel() + _pairwise(x[1], y[1], at, of)).reshape(lead.shape)
            if x[0].dtype == np.int64:
                whole -= np.abs(np.where(whole == -np.inf, 0, whole)) * 1e-15  # a double may have rounded it up
            if id(q) in best:
                lead, whole = np.concatenate([best[id(q)][1], lead], 1), np.concatenate([best[id(q)][2], whole], 1)
                top = np.argsort(-lead, axis=1)[:, :k]
                lead, whole = np.take_along_axis(lead, top, 1), np.take_along_axis(whole, top, 1)
            best[id(q)] = (q.uids, lead, whole)
        uids = [np.repeat(u, w.shape[1]) for u, _, w in best.values()]
        score = [w.ravel() for _, _, w in best.values()]
        uids, score = (np.concatenate(z) if z else np.zeros(0) for z in (uids, score))
        real = score > -np.inf
        return pa.table({"q": pa.array(uids[real], pa.int64()), "score": pa.array(score[real], pa.float64())})

    return run


def entries(q: _Block, c: _Block, x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases two and three on one tile: (query, vector, whole score) of what reaches the queries' cutoffs."""
    low, found = q.cuts / 2, []
    for s in (0, 1):
        reach = np.sqrt((x[s].astype(np.float64) ** 2).sum(1)) * np.sqrt((y[s].astype(np.float64) ** 2).sum(1)).max(initial=0)
        live = np.flatnonzero(reach * (1 + 1e-9) + 1e-6 >= low)  # no product of the others can reach the cutoff
        if len(live):
            p = x[s][live] @ y[s].T
            at, of = np.nonzero(p >= low[live][:, None])
            found.append(np.stack([live[at], of]))
    at, of = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
    other = q.uids[at] != c.uids[of]
    at, of = at[other], of[other]
    score = _pairwise(x[0], y[0], at, of) + _pairwise(x[1], y[1], at, of)
    good = score >= q.cuts[at]
    return at[good], of[good], score[good]


def resolved(k: int):
    """Phases two and three for a shard and a group; of a query's entries the ``k`` best are enough."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        held = 0

        def cut() -> None:
            uid, qid, vec, score = map(np.concatenate, out)
            order = np.lexsort((vec, -score, uid))
            rank = np.arange(len(order)) - np.searchsorted(uid[order], uid[order])
            stay = order[rank < k]
            out[:] = [[z[stay]] for z in (uid, qid, vec, score)]

        for q, c, x, y in _tiles(left, right):
            at, of, score = entries(q, c, x, y)
            for z, new in zip(out, (q.uids[at], q.ids[at], c.ids[of], score.astype(np.int64))):
                z.append(new)
            held += len(at)
            if held > 1 << 20:
                cut()
                held = 0
        cut()
        return pa.table({n: pa.array(z[0], pa.int64()) for n, z in zip(("q", "query_id", "vec_id", "score"), out)})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", group: int = GROUP, shard: int = SHARD, scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest scores, ties to the smaller vec_id.

    ``is_query`` is a condition on ``vectors``; every row but the query's own is
    a candidate. Vectors that are null or hold null or non-finite components and
    rows without an id take no part; with fewer candidates all are returned; a
    vector that is shorter than another counts as filled with zeros, an empty
    one as zeros only; rows that repeat an id are rows of their own; no queries
    or no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantized(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).filter("vec_id is not null and v is not null")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, asked, longest = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0)), F.max(F.size("v"))).first()
    if not asked:
        dropped(rows)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shard, group = (max(1, min(most, 64 * most // max(1, longest))) for most in (shard, group))  # so that longer vectors take no more memory
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, groups = max(-(-n // shard), min(wide, -(-n // LEAST))), -(-asked // group)
    part = lambda of, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(of)).cast("int").alias("part")
    placed = lambda df: df.repartition(min(wide, max(shards, groups)), "part").sortWithinPartitions("part", "uid")
    store = written(packed(placed(rows.select(part(shards, 1), "uid", "vec_id", F.lit(0.0).alias("cut"), "v"))).withColumnRenamed("part", "s"), "vector-shards")
    queries = rows.filter("query").select(part(groups, 2), "uid", "vec_id", "v")

    def paired(asking: DataFrame):
        """Each shard with each group: the queries, of bounded size a group, go to every shard once, and so the reverse."""
        left = store.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = packed(placed(asking)).withColumnRenamed("part", "g").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return left.groupBy("s", "g").cogroup(right.groupBy("s", "g"))

    lists = paired(queries.withColumn("cut", F.lit(0.0))).applyInArrow(listed(k), "q long, score double")
    kth = lists.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") == k).select(F.col("q").alias("uid"), F.col("score").alias("cut"))
    asking = queries.join(kth, "uid", "left").withColumn("cut", F.coalesce("cut", F.lit(float("-inf"))))  # with fewer candidates than k all are taken
    asking = written(asking, "top-k-cutoffs")
    found = paired(asking).applyInArrow(resolved(k), "q long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    out = written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k")
    for done in (rows, store, asking):
        dropped(done)
    return out


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
