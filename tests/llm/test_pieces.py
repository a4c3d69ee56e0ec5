"""SentencePiece ids by distinct chunks against the library."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import pieces
from shelfline.llm.encoding import vocabulary_path
from shelfline.llm.pieces import chunks_of, encode_pieces, piece_model, piece_report

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL))


HARD = ["", " ", "  ", "a ", " a", "a  b   c ", "▁x▁▁y", "<s>hi</s> <0x41>", "tab\tand\nline", "日本語 テキスト 😀", "é" * 50, "a\u0000b"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ▁\né日<>"), max_size=12) | st.text(max_size=30) | st.sampled_from(HARD), max_size=6))
def test_chunks_give_the_ids_of_texts(texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL))
    chunks, sizes = chunks_of(pa.array(texts, pa.string()))
    ids, n = piece_model(MODEL).segment(chunks.to_pylist())
    at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
    want = [lib.encode(t) for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert piece_model(MODEL).texts_of(ids, at).to_pylist() == [lib.decode(w) for w in want]


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        out.append((i, len(ids), *sha))
    return sorted(out, key=repr)


def test_odd_rows(spark, odd, odd_rows, nothing, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(pieces, "ROW_BYTES", 500)
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(HARD)], "doc_id BIGINT, text STRING")
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + k, t) for k, t in enumerate(HARD)]
    got = piece_report(odd.select("doc_id", "text").unionByName(extra))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(library, rows)
    assert piece_report(nothing).count() == 0


def test_real_texts(spark, real, library):
    got = sorted(map(tuple, piece_report(real).collect()), key=repr)
    assert got == expected(library, [(r.doc_id, r.text) for r in real.collect()])


def test_string_ids_and_names_in_use(spark, library):
    rows = [("a", "one two", "b", 1), (None, "three", "c", 2), ("a", None, "d", 3)]
    df = spark.createDataFrame(rows, "key STRING, body STRING, block STRING, doc_ids INT")
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in encode_pieces(df, text="body", doc_id="key").collect()}
    assert got == {(k, tuple(library.encode(t or "")), t or "") for k, t, _, _ in rows}


def test_a_table_that_changes_between_readings_fails(spark):
    block = pieces._Block([pa.array(["a", "b"])], [np.array([2])], [pa.array([1])])
    other = pieces._Block([pa.array(["a", "c"])], [np.array([2])], [pa.array([1])])
    assert block.name != other.name
