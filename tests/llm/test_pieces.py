import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenloom.llm import pieces

HARD = [
    None, "", " ", "   ", "\n", "a", " a  b\n\tc ", "▁x", "é😀\u0000", "ﬁ①　z", "hello world", "the " * 500, "a" * 3000, "ab" * 999, "aaab" * 500,
    "<s></s><unk><0x0A>", "日本語のテキスト", " " * 40 + "x" + " " * 17, "don't  stop\r\n\r\n", "ththe" * 300, "​zero width", "x\n\n\n  y",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.of(pieces.model_path())


def same(v, library, text):
    ids = np.frombuffer(v.encode(text), np.uint32)
    assert ids.tolist() == library.encode(text), text[:80]
    assert v.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("text", [t for t in HARD if t is not None])
def test_hard_texts_equal_the_library(vocabulary, library, text):
    same(vocabulary, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_library(text):
    import sentencepiece

    same(pieces.Vocabulary.of(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aehinorst ▁d\n", max_size=300), st.integers(1, 50))
def test_a_text_in_parts_equals_the_library(text, size):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    path, out = pieces.Path(pieces.Vocabulary.of(pieces.model_path())), b""
    full = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    for a in range(0, len(full), size):
        out += path.push(full[a : a + size])
    assert np.frombuffer(out + path.finish(), np.uint32).tolist() == library.encode(text)


def test_the_window_stays_bounded(vocabulary):
    path, text, most = pieces.Path(vocabulary), "erthationhesttinging" * 2000, 0
    for c in text:
        path.push(c)
        most = max(most, len(path.last))
    assert most <= pieces.LOOK * 3


def test_rows(spark, library):
    rows = [(i, t, [1], 3) for i, t in enumerate(HARD)] + [(2, " ", [1], 3), (None, "no id", None, None)]
    got = pieces.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_pieces long")).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pieces.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_the_library(spark, sf, library):
    from screenloom.llm.queries import op4_sentencepiece

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_sentencepiece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(library.encode(docs[r.doc_id]), "<u4").tobytes())
