"""BPE and token files against the tokenizers library."""

import hashlib
import io
import random
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import bpe, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
BYTES, WORDS = bpe.Words(BYTE), token_files.RunEncoder(WORD, 64)
ALPHABET = [" ", "  ", "\n", "\t", "\r\n", "　", " ", "\x1c", "\x85", "\xa0", "'s", "'ll", "'", "a", "Z", "é", "ß", "ñ", "İ", "1", "٣", ".", ",", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "中", "́", "\U0001f600", "_", "ª", "\x00", "word", "Hello", "%%%"]
TEXT = st.lists(st.sampled_from(ALPHABET) | st.text(max_size=4), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_units_encode_like_the_library(t):
    units = BYTES.units(t)
    assert "".join(units) == t
    want = BYTES.tok.encode(t, add_special_tokens=False).ids
    assert [i for w in BYTES.encode(units) for i in w] == want
    assert b"".join(BYTES.pieces[i] for i in want).decode("utf-8", "replace") == BYTES.tok.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_runs_encode_like_the_library(t):
    assert np.frombuffer(WORDS.encode(t), "<u4").tolist() == WORDS.tok.encode(t, add_special_tokens=False).ids


def rows():
    rng = random.Random(9)
    out = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30)))) for i in range(200)]
    return [*out, (3, None), (None, "no id"), (500, ""), (501, "long " * 30000), (501, "twice"), (501, "twice")]


@pytest.mark.parametrize("block", [50, 24_000_000])
def test_encode_decode(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit("x"), "block": F.lit(1), "kind": F.lit("y")})
    got = bpe.encode_decode(df, BYTE, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"), block_chars=block).collect()
    want = []
    for i, t in data:
        ids = BYTES.tok.encode(t or "", add_special_tokens=False).ids
        text = BYTES.tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_encode_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_token_files(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit("x"), "range_no": F.lit(1)})
    manifest = token_files.write_token_files(df, WORD, str(tmp_path / "f"))
    got = token_files.read_token_files(manifest, str(tmp_path / "f")).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in got) == sorted(repr((i, WORDS.tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in data)
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    digest = token_files.read_token_files(manifest, str(tmp_path / "f"), digest=True).collect()
    assert sorted((r.start, r.ids_crc32) for r in digest) == sorted((r.start, crc32(np.array(r.ids, "<u4").tobytes())) for r in got)


def test_token_files_empty(spark, tmp_path):
    manifest = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), WORD, str(tmp_path / "f"))
    assert token_files.read_token_files(manifest, str(tmp_path / "f")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.integers(1, 17))
def test_file_format_round_trip(docs, block):
    stream = io.BytesIO()
    w = token_files.Writer(stream, block)
    for k, d in enumerate(docs):
        w.add(None if k == 3 else k, np.array(d, "<u4"))
    w.close()
    r = token_files.Reader(stream)
    assert [(i, x.tolist()) for i, x in r.documents()] == [(None if k == 3 else k, d) for k, d in enumerate(docs)]
    flat = [x for d in docs for x in d]
    for s in range(0, len(flat), 5):
        assert r.ids(s, min(7, len(flat) - s)).tolist() == flat[s : s + 7]


def test_file_cut_short():
    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(b"x" * 40))
