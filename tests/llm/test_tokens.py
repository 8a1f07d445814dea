import os
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from screenloom.llm import binary_ids, tokens

TEXTS = [
    None, "", " ", "\n", "   \n\n  x", "hello world", "don't we'll 'tis it's", "a<|endoftext|>b", "x  <|endoftext|> y<|endoftext|>",
    "é ü   z", "日本語テキスト 123", "😀 😀😀 !!?", "١٢٣ ½ Ⅷ", "tab\tsep\r\nline", "a" * 5000, "word " * 3000, "\u0085a b　c",
    "<|endoftext|>", "<|endoftext", "-" * 300 + " x", "\U00011f02\U0001e030 new", " 's 's's",
]
SCHEMA = "doc_id long, text string, piece string, n long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path(tokens.TOKENIZER))


def rows():
    return [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 2), (5, "other text", "", 0), (None, "no id", None, None)]


def test_counts_equal_the_library(spark, library):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(tokens.count_tokens(docs, limit=10).collect(), key=str)
    want = []
    for i, t, *_ in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 10))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_with_every_piece_in_the_tail(spark, library, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD", 0)
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokens.count_tokens(docs).collect()}
    for i, t, *_ in rows():
        assert got[(i, len((t or "").encode()))] == len(library.encode(t or "", add_special_tokens=False).ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert tokens.count_tokens(docs).count() == 0
    assert binary_ids.encode_documents(docs).count() == 0


def test_files_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(binary_ids, "FILE_IDS", 1500)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = binary_ids.encode_documents(docs).orderBy("start").collect()
    start = 0
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    for r, (i, t, *_) in zip(got, sorted(rows(), key=key), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@given(st.lists(st.integers(0, 4999), max_size=300), st.integers(1, 9))
def test_packing_round_trip(ids, block):
    bits = 13
    ids = np.array(ids, np.uint32)
    cut = len(ids) // 2
    f = binary_ids.IdFile(binary_ids.to_file([7, None], np.array([cut, len(ids) - cut]), ids, bits, block))
    assert f.doc_ids == [7, None]
    assert (f.span(0, f.n_ids) == ids).all() and (f.document(1) == ids[cut:]).all()


def test_whole_table_against_the_library(spark, sf, library):
    from screenloom.llm.queries import op6_token_counts

    docs = {r.doc_id: r.text for r in spark.read.parquet(os.path.join(sf, "documents.parquet")).collect()}
    for r in op6_token_counts(spark, sf).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)


def test_rows_without_id_are_many_ranges(spark, tmp_path):
    """A third of all rows without id, a third under one: still many files, in order of id."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i + 10, f"text {i} of many words", "x", i) for i in range(600)]
    rows += [(None, "the same text", "x", 0)] * 300
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = binary_ids.write_ids(docs, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in manifest}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = [binary_ids.IdFile((tmp_path / r.file).read_bytes()) for r in sorted(manifest, key=lambda r: (r.part, r.seq))]
    assert max(len(f.doc_ids) for f in files) < len(rows) / 2
    ids = [d for f in files for d in f.doc_ids]
    assert ids == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in binary_ids.encode_documents(docs).collect()) == sorted(
        (d is not None, d or 0, int(n)) for f in files for d, n in zip(f.doc_ids, f.starts[1:] - f.starts[:-1], strict=True)
    )
