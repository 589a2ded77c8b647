"""BPE encoding and decoding through a distinct-word table.

Documents are cut into *units*: one optional space and a run without white
space, or white space between such runs. Unit boundaries are always boundaries
of the byte-level pre-tokenizer, so a text's ids are its units' ids in order.

1. ``split``: documents are gathered in blocks of bounded size; a block stores
   the positions of its words as codes into its own list of distinct words,
   which is ordered by hash bucket and word.
2. ``word_ids``: the blocks' words are shuffled by bucket; every distinct word of
   the corpus is encoded once, and its ids go back to the blocks that have it,
   in the order of their lists.
3. ``assemble``: a block's codes are joined with its words' ids; ids are joined
   with the vocabulary's id-to-piece table to decode.

A word that is in every document costs one entry a block, so no key is hot. Words
and ids travel in packed, compressed rows, since one row a word would make the
shuffle larger than the text; codes, the largest part, are stored in buckets of
the block's name and joined where they lie, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.runtime import removed, shared_path, written

#: Characters of text after which a block is closed (a longer document has a block of its own).
BLOCK_CHARS = 24_000_000
#: Most buckets that words are hashed to (a block has a row in each, so they mustn't grow with the input) and that blocks are stored in.
WORD_BUCKETS, BLOCK_BUCKETS = 2048, 50_000
#: White space of Unicode, as the pre-tokenizer's regular expression has it (Python's ``\\s`` has four more).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_LETTERS = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def tokenizer(path: str):
    """The tokenizer in the JSON file ``path`` with truncation and padding off."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


_CHARS = byte_chars()
_BYTES = {c: b for b, c in enumerate(_CHARS)}
_encoders: dict[str, Words] = {}


class Words:
    """Encodes units and gives the byte piece of each id, for one byte-level tokenizer."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*self.tok.get_vocab().values(), -1]) + 1
        self.pieces = [b""] * size
        for text, i in self.tok.get_vocab().items():
            self.pieces[i] = bytes(_BYTES[c] for c in text) if all(c in _BYTES for c in text) else text.encode()
        self.width = "<u2" if size <= 1 << 16 else "<u4"

    def units(self, text: str) -> list[str]:
        """The units of a text in order; a special token's literal is a unit of its own."""
        if self.around is None or not any(s in text for s in self.special):
            return _UNIT.findall(text)
        out: list[str] = []
        for part in self.around.split(text):
            out += [part] if part in self.special else _UNIT.findall(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each unit. Plain letters go to the library's BPE model directly, the rest through its whole pipeline."""
        out: list[list[int] | None] = []
        model, slow = self.tok.model, []
        for k, w in enumerate(words):
            m = _LETTERS.fullmatch(w)
            if m:
                space, letters, mark = m.groups()
                ids = [t.id for t in model.tokenize("".join(_CHARS[b] for b in (space + letters).encode()))]
                out.append(ids + [t.id for t in model.tokenize(mark)] if mark else ids)
            else:
                out.append(None)
                slow.append(k)
        for k, e in zip(slow, self.tok.encode_batch_fast([words[k] for k in slow], add_special_tokens=False)):
            out[k] = e.ids
        return out  # type: ignore[return-value]


def words_of(path: str) -> Words:
    """One ``Words`` a worker process and tokenizer, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Words(path)
    return _encoders[path]


def _pack(*arrays: bytes) -> bytes:
    """Byte strings one after another behind their lengths, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(arrays) + 1}Q", len(arrays), *map(len, arrays)) + b"".join(arrays))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<Q", raw)
    out, at = [], 8 * (n + 1)
    for size in struct.unpack_from(f"<{n}Q", raw, 8):
        out.append(raw[at : at + size])
        at += size
    return out


_BLOCK = "block string, bucket int, blob binary, kind string"


def split(docs: DataFrame, path: str, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of two kinds: ``codes``, one a block, and ``words``, one a block and bucket of the words' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, at = words_of(path), TaskContext.get().partitionId(), 0

        def fresh():
            seen: defaultdict[str, int] = defaultdict(count().__next__)
            return seen, [], [], [], 0

        def close(seen, ids, sizes, codes) -> pa.RecordBatch:
            name = f"{part}-{at}"
            text = [w.encode("utf-8", "surrogatepass") for w in seen]
            seen.clear()
            own: list[list[int]] = [[] for _ in range(buckets)]
            for k, t in enumerate(text):
                own[crc32(t) % buckets].append(k)
            code, at_code = np.empty(len(text), np.uint32), 0
            for found in own:
                found.sort(key=text.__getitem__)
                code[found] = np.arange(at_code, at_code + len(found), dtype=np.uint32)
                at_code += len(found)
            flat = code[np.concatenate(codes)] if text else np.zeros(0, np.uint32)
            codes.clear()
            planes = np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            doc_ids = np.array([i or 0 for i in ids], "<i8").tobytes()
            nulls = np.array([i is None for i in ids], np.uint8).tobytes()
            rows = [(name, -1, _pack(doc_ids, nulls, np.array(sizes, "<u8").tobytes(), planes), "codes")]
            for b, found in enumerate(own):
                if found:
                    held = [text[k] for k in found]
                    rows.append((name, b, _pack(np.array(list(map(len, held)), "<u4").tobytes(), b"".join(held)), "words"))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.string()))], ["block", "bucket", "blob", "kind"])

        seen, ids, sizes, codes, filled = fresh()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                found = words.units(text)
                ids.append(i)
                sizes.append(len(found))
                codes.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
                filled += len(text)
                if filled >= block_chars:
                    yield close(seen, ids, sizes, codes)
                    at += 1
                    seen, ids, sizes, codes, filled = fresh()
        if ids:
            yield close(seen, ids, sizes, codes)

    return docs.mapInArrow(run, _BLOCK)


def word_ids(words: DataFrame, path: str, buckets: int) -> DataFrame:
    """The distinct-word table, joined back: per block and bucket the ids of its words, in order.

    All copies of a word meet in one bucket, where each different one is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: Words | None = None
        for bucket, rows in _runs(batches):
            encoder = encoder or words_of(path)
            table: dict[bytes, bytes] = {}
            for block, blob in rows:
                sizes, text = _unpack(blob)
                own = _cut(text, sizes)
                fresh = [w for w in own if w not in table]
                for w, i in zip(fresh, encoder.encode([w.decode("utf-8", "surrogatepass") for w in fresh])):
                    table[w] = np.array(i, encoder.width).tobytes()
                ids = [table[w] for w in own]
                packed = _pack(np.array(list(map(len, ids)), "<u4").tobytes(), b"".join(ids))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], ["block", "bucket", "blob"])

    placed = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return placed.select("bucket", "block", "blob").mapInArrow(run, "block string, bucket int, blob binary")


def _cut(text: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
    return [text[s:e] for s, e in zip([0, *ends], ends)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[str, bytes]]]]:
    """Runs of equal bucket in sorted (bucket, block, blob) rows."""
    flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for bucket, rows in groupby(flat, key=lambda r: r[0]):
        yield bucket, ((block, blob) for _, block, blob in rows)


def assemble(codes: DataFrame, ids: DataFrame, path: str, outputs: tuple[str, ...]) -> DataFrame:
    """Join each block's codes with its words' ids and give one row a document.

    ``outputs``: any of n_tokens, ids, ids_sha256, decoded, decoded_sha256.
    """
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
    schema = "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in outputs)
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}

    def emit(encoder: Words, doc_ids, nulls, sizes, flat, lengths, tokens) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pieces = encoder.pieces
        word_pieces = None
        if "decoded" in outputs or "decoded_sha256" in outputs:
            split_at = starts.tolist()
            found = list(map(pieces.__getitem__, tokens.tolist()))
            word_pieces = [b"".join(found[s:e]) for s, e in zip(split_at, split_at[1:])]
            del found
        at, out = 0, []
        for i, null, n in zip(doc_ids.tolist(), nulls.tolist(), sizes.tolist()):
            mine = flat[at : at + n]
            at += n
            size = lengths[mine]
            total = int(size.sum())
            if total:
                first = np.cumsum(size) - size
                where = np.repeat(starts[mine] - first, size) + np.arange(total)
                own = tokens[where]
            else:
                own = tokens[:0]
            row = {"n_tokens": total, "ids": own.astype(np.int32)}
            if "ids_sha256" in outputs:
                row["ids_sha256"] = hashlib.sha256(own.astype("<u4").tobytes()).hexdigest()
            if word_pieces is not None:
                text = b"".join(map(word_pieces.__getitem__, mine.tolist())).decode("utf-8", "replace")
                row |= {"decoded": text, "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}
            out.append([None if null else i, *[row[c] for c in outputs]])
            if len(out) == 512:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[types[c] for c in outputs]))], ["doc_id", *outputs])

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        encoder = words_of(path)
        parts = [_unpack(blob) for _, blob in sorted(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist()))]
        sizes = np.concatenate([np.frombuffer(s, "<u4") for s, _ in parts] or [np.zeros(0, "<u4")]).astype(np.int64) // np.dtype(encoder.width).itemsize
        tokens = np.frombuffer(b"".join(t for _, t in parts), encoder.width)
        doc_ids, nulls, counts, planes = _unpack(left.column("blob")[0].as_py())
        flat = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        return pa.Table.from_batches(emit(encoder, np.frombuffer(doc_ids, "<i8"), np.frombuffer(nulls, np.uint8), np.frombuffer(counts, "<u8").astype(np.int64), flat, sizes, tokens))

    # a block is one row of codes and one row of ids a bucket: of bounded size
    return codes.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(whole, schema)


def encode_decode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``outputs``.

    Ids are those of the tokenizer in the JSON file ``path`` (byte-level BPE,
    on every executor) without added special tokens; their literals in a text
    are encoded as the special id. ``decoded`` has every id's piece, special
    ones included. Null text counts as empty (no ids, empty string); a null id
    stays null; repeated rows are encoded each; no rows in, no rows out; other
    columns are ignored.
    """
    spark = docs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, stored = min(wide, WORD_BUCKETS), min(wide, BLOCK_BUCKETS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    store = split(rows, path, buckets, block_chars).write.partitionBy("kind").bucketBy(stored, "block").sortBy("block")
    place = shared_path(spark, "bpe-blocks")
    store.option("path", place).option("compression", "uncompressed").saveAsTable(name)
    try:
        words = spark.table(name).filter("kind = 'words'").select("bucket", "block", "blob")
        codes = spark.table(name).filter("kind = 'codes'").select("block", "blob")
        return written(assemble(codes, word_ids(words, path, buckets), path, outputs), "bpe-out")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, place)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))
