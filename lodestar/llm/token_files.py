"""Token-id output: files of bit-plane-shuffled, compressed id blocks with a chunk index.

File layout (little-endian)::

    b"LDSTRTK1"
    chunk, chunk, ...        each: up to ``BLOCK_IDS`` ids as byte planes
    footer                   zstandard: document ids, null flags, lengths, chunk index
    uint64 footer size, b"LDSTRTK1"

A chunk is the ids' block transposed to four byte planes, the lowest bytes
first; each plane is compressed by zstandard on its own, and a plane of zeros
(the two upper ones, for vocabularies under 65,536) takes no bytes. The chunk
index has each chunk's offset, number of ids and plane sizes, so a reader can
seek to any id. Documents lie in ascending order of doc_id, over all files.

Files are written by tasks under names of their own and listed in a manifest
that Spark commits; a file of a failed or repeated attempt is in no manifest.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import _CHARS, WHITE, tokenizer
from lodestar.runtime import shared_path, written

MAGIC = b"LDSTRTK1"
#: Ids in a chunk.
BLOCK_IDS = 1 << 16
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_000_000
_RUNS = re.compile(f"[^{WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_encoders: dict[str, RunEncoder] = {}


class _Known(dict):
    """Ids by run; a run that is new is encoded when it is first asked for."""

    def __init__(self, owner: RunEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.owner.learn(run)
        return ids


class RunEncoder:
    """Encodes texts run by run (without white space), remembering a bounded number of runs.

    For tokenizers that drop white space: a text's ids are those of its runs.
    Runs of Latin letters with punctuation behind are put together from their
    lower-case letters and the punctuation, which the library's BPE model
    encodes apart; other runs go through its whole pipeline.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        self.tok, self.limit, self.chars = tokenizer(path), cache // 2, 0
        self.model = self.tok.model
        self.young, self.old = _Known(self), {}

    def learn(self, run: str) -> bytes:
        self.chars += len(run)
        known = self.old.get(run)
        if known is not None:
            return known
        m = _LETTERS.fullmatch(run)
        if m is None:
            ids = self.tok.encode(run, add_special_tokens=False).ids
        else:
            letters, mark = m.groups()
            stem = letters.lower()
            if stem != run:
                return self.young[stem] + self.young[mark] if mark else self.young[stem]
            ids = [t.id for t in self.model.tokenize("".join([_CHARS[b] for b in stem.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        runs = text.split() if _ODD.search(text) is None else _RUNS.findall(text)
        out = b"".join(map(self.young.__getitem__, runs))
        if len(self.young) > self.limit or self.chars > 32 * self.limit:
            self.old, self.young, self.chars = dict(self.young), _Known(self), 0
        return out


def encoder(path: str) -> RunEncoder:
    """One encoder a worker process and tokenizer, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def planes(ids: np.ndarray) -> list[bytes]:
    """The four byte planes of a block of ids, each compressed; empty for zeros."""
    flat = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    out = []
    for k in range(4):
        plane = np.ascontiguousarray(flat[:, k])
        out.append(zstandard.ZstdCompressor(level=3).compress(plane.tobytes()) if plane.any() else b"")
    return out


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, part in enumerate(parts):
        if part:
            out[:, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part, max_output_size=max(n, 1)), np.uint8)
    return out.view("<u4").ravel()


class Writer:
    """Writes one token file to an open stream, holding at most one chunk."""

    def __init__(self, stream, block: int = BLOCK_IDS):
        self.stream, self.block, self.at = stream, block, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.docs: list[tuple[int, int, int]] = []
        self.chunks: list[tuple[int, ...]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.total += len(ids)
        while len(ids):
            take = ids[: self.block - self.n_held]
            self.held.append(take)
            self.n_held += len(take)
            ids = ids[len(take) :]
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        parts = planes(np.concatenate(self.held))
        self.chunks.append((self.at, self.n_held, *map(len, parts)))
        for p in parts:
            self.stream.write(p)
        self.at += sum(map(len, parts))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        docs = np.array(self.docs, "<i8").reshape(-1, 3).T.copy()
        index = np.array(self.chunks, "<i8").reshape(-1, 6)
        footer = zstandard.ZstdCompressor(level=3).compress(struct.pack("<QQ", docs.shape[1], len(index)) + docs.tobytes() + index.tobytes())
        self.stream.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Reads a token file: ``documents()`` in order, ``ids(start, n)`` by position."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell()
        stream.seek(end - 16)
        size, magic = struct.unpack("<Q8s", stream.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file, or cut short")
        stream.seek(end - 16 - size)
        raw = zstandard.ZstdDecompressor().decompress(stream.read(size))
        n_docs, n_chunks = struct.unpack_from("<QQ", raw)
        self.doc_ids, self.nulls, self.lengths = np.frombuffer(raw, "<i8", 3 * n_docs, 16).reshape(3, n_docs)
        self.index = np.frombuffer(raw, "<i8", 6 * n_chunks, 16 + 24 * n_docs).reshape(n_chunks, 6)
        self.firsts = np.concatenate([[0], np.cumsum(self.index[:, 1])])
        self._kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def chunk(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            at, n, *sizes = self.index[k].tolist()
            self.stream.seek(at)
            self._kept = (k, from_planes([self.stream.read(s) for s in sizes], n))
        return self._kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        out, k = [], int(np.searchsorted(self.firsts, start, "right")) - 1
        while n:
            part = self.chunk(k)[start - self.firsts[k] :][:n]
            out.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        at = 0
        for i, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            yield None if null else i, self.ids(at, n)
            at += n


def _open(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` with the tokenizer file ``path`` and write token files in ``folder``.

    Returns the manifest (range_no, file, n_docs, n_ids), committed as a table;
    files in order of ``range_no`` hold documents in ascending doc_id. ``end_id``
    closes each document. Null text counts as empty; null ids come first; rows
    that repeat an id all stay, side by side; no rows give no files.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = [k / (4 * parts) for k in range(1, 4 * parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, 40 * parts)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(path), zstandard.ZstdCompressor(level=1)
        for b in batches:
            blobs = []
            for t in b.column(1):
                ids = np.frombuffer(enc.encode(t.as_py() or "") + end, "<u4")
                blobs.append(squeeze.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes()))
            ranges = [0 if i is None else int(np.searchsorted(bounds, i)) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), b.column(0), pa.array(blobs, pa.binary())], ["range_no", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        now, writer, stream, name = None, None, None, ""

        def done() -> pa.RecordBatch:
            writer.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.total], pa.int64())], ["range_no", "file", "n_docs", "n_ids"])

        for b in batches:
            for k, i, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != now:
                    if writer is not None:
                        yield done()
                    now, name = k, f"part-{k:06d}-{uuid.uuid4().hex}.ldtk"
                    stream = files.open_output_stream(f"{root}/{name}")
                    writer = Writer(stream)
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
                writer.add(i, raw.reshape(4, -1).T.copy().view("<u4").ravel())
        if writer is not None:
            yield done()

    coded = rows.mapInArrow(encode, "range_no int, doc_id long, ids binary")
    placed = coded.repartition(parts, "range_no").sortWithinPartitions("range_no", "doc_id")
    return written(placed.mapInArrow(write, "range_no int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Documents of the listed files: doc_id, start, n_tokens, then ``ids`` or with ``digest`` their ``ids_crc32``.

    ``start`` counts the ids of all documents before. The manifest has one row a
    file, a number that the writer's partitions bound, so its sums are taken on
    the driver.
    """
    spark = manifest.sparkSession
    before, starts = 0, []
    for r in manifest.select("range_no", "file", "n_ids").orderBy("range_no").toLocalIterator():
        starts.append((r["file"], before))
        before += r["n_ids"]
    listed = spark.createDataFrame(starts, "file string, before long") if starts else spark.createDataFrame([], "file string, before long")
    last = "ids_crc32 long" if digest else "ids array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_input_file(f"{root}/{name}") as stream:
                    rows: list[tuple] = []
                    for i, ids in Reader(stream).documents():
                        rows.append((i, at, len(ids), crc32(ids.tobytes()) if digest else ids.astype(np.int32)))
                        at += len(ids)
                        if len(rows) == 512:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "start", "n_tokens", last.split()[0]])

    return listed.repartition(max(1, min(len(starts), 4096))).mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, "token-files")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(manifest, folder, digest=True)
