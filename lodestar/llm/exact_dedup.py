"""Exact dedup through a persistent digest index, bucketed and sorted by hash.

``DigestIndex`` is a Parquet table ``(digest, keep_id, keep_uid, batch)`` stored
in buckets of the digest and sorted inside each bucket. Documents come in
batches; each is reduced to one row a digest, anti-joined with the index by
sort-merge (the index side is read in place, without a shuffle), and what is
left is appended. What stays is then read from the index, again by sort-merge.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.runtime import dropped, numbered, removed, shared_path, small_or_shuffled, written


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of the text's UTF-8 bytes as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, at ``path``.

    Any session can open the same path: the table is declared again over the
    files that are there. ``buckets`` is fixed when the path is first written.
    ``batch`` names the call that added a digest, ``keep_uid`` its row there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_uid BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (with a column ``digest``) whose digest is not in the index."""
        return batch.join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Add the unseen digests of ``batch`` (digest, keep_id, keep_uid, batch; one row a digest)."""
        new = written(self.unseen(batch.select("digest", "keep_id", "keep_uid", "batch")), "digest-new")  # a table can't be read and appended to at once
        new.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        dropped(new)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


#: Batches that documents are taken in, those with the largest ids first, so that a later batch meets an index that holds the rows to keep.
BATCHES = 2
#: Cells that the rows of a digest are spread over, and the most buckets of an index made here.
SALTS, BUCKETS = 32, 50_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, uid, digest)`` of every row, written once; ``uid`` tells repeated rows apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), digest(text_col).alias("digest"))
    return written(rows, "digests")


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """Rows (doc_id, uid, digest, keep_id, keep_uid, kept, group_size), decided by what the index holds at the end.

    ``keep_uid`` is null where an earlier call's document stays. Without
    ``index`` a new one is made. Rows of a digest are reduced in salted cells
    before the shuffle and the decision goes back to each cell, so no task holds
    a hot group; the index has one row a digest.
    """
    spark, own = docs.sparkSession, index is None
    if own:
        index = DigestIndex(spark, shared_path(spark, "digest-index"), buckets=min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows, call = digests(docs, id_col, text_col), uuid.uuid4().hex
    cuts = (rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []) if batches > 1 else []
    part = F.lit(len(cuts))
    for k, cut in enumerate(sorted(cuts)):
        part = F.when(F.col("doc_id") > cut, F.greatest(F.lit(0), F.lit(len(cuts) - 1 - k))).otherwise(part)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).withColumn("part", part)
    cells = written(salted.groupBy("digest", "salt", "part").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("n")), "digest-cells")
    for k in range(len(cuts) + 1):
        best = cells.filter(F.col("part") == k).groupBy("digest").agg(F.max("best").alias("best"))
        index.append(best.select("digest", F.col("best.doc_id").cast("long").alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.lit(call).alias("batch")))
    groups = cells.groupBy("digest").agg(F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))  # at most SALTS
    found = groups.join(index.table().hint("merge"), "digest")
    told = found.select("digest", F.explode("salts").alias("salt"), "keep_id", F.when(F.col("batch") == call, F.col("keep_uid")).alias("keep_uid"), "group_size")
    out = salted.drop("part").join(told, ["digest", "salt"]).select("doc_id", "uid", "digest", "keep_id", "keep_uid", F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(False)).alias("kept"), "group_size")
    if own:  # its files are gone once the decisions are written
        out = written(out, "digest-groups")
        index.close()
        removed(spark, index.path)
        dropped(rows)
        dropped(cells)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null text equals empty
    text. A null doc_id is smaller than any other. Of rows equal in text and
    doc_id one stays. No rows in, no rows out; other columns, whatever their
    names, are ignored. With ``index``, digests it holds already are dropped
    (``kept`` false, ``keep_id`` the indexed one) and the others are appended;
    ``group_size`` counts rows of ``docs``.
    """
    out = indexed(docs, id_col, text_col, index, batches)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_rows(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``lost`` names by ``_id`` and ``_digest``, all columns kept, whatever their names.

    ``_twin`` marks a lost row whose id and text equal those of the row that
    stays; such rows, which no key tells apart, are reduced to one. The list is
    narrow: broadcast if counted to be short, joined by shuffle otherwise.
    """
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    keyed = numbered(docs).withColumn("_key", digest(own[text_col]))
    match = keyed[own[id_col]].eqNullSafe(F.col("_id")) & (keyed["_key"] == F.col("_digest"))
    twins = lost.filter("_twin").select("_id", "_digest").distinct()
    go = lost.filter("not _twin").select("_id", "_digest").distinct()
    if not twins.limit(1).count():
        return keyed.join(small_or_shuffled(go), match, "left_anti").drop("_key").toDF(*docs.columns)
    twins = small_or_shuffled(twins)
    go = small_or_shuffled(go.join(twins.select(F.col("_id").alias("i"), F.col("_digest").alias("g")), F.col("_id").eqNullSafe(F.col("i")) & (F.col("_digest") == F.col("g")), "left_anti"))
    out = keyed.join(go, match, "left_anti")
    return out.join(twins, match, "left_anti").unionByName(out.join(twins, match, "left_semi").dropDuplicates([own[id_col], "_key"])).drop("_key").toDF(*docs.columns)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """``docs`` without exact copies, through a digest index: of equal texts the row with the largest id stays.

    All columns are kept, whatever their names. With ``index``, texts that it
    holds from before go too. Nulls, ties and repeated rows are as in ``exact_groups``.
    """
    rows = indexed(docs, id_col, text_col, index, batches)
    twin = F.col("keep_id").eqNullSafe(F.col("doc_id")) & F.col("keep_uid").isNotNull()
    lost = written(rows.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), twin.alias("_twin")), "copies")
    dropped(rows)
    return without_rows(docs, lost, id_col, text_col)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs)


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
