"""Exact encoding against the library, and the way back."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stocklens.llm import piece_bpe
from stocklens.llm.piece_bpe import PieceModel, decode_ids, encode_documents, model_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = PieceModel(model_bytes(PATH))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(text):
    ids = MODEL.encode(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeinst  ▁\t\n.,»«”’²0123"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=12))
def test_any_ids(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "▁x", "<s>hi</s><unk><0x41>", "a" + " " * 1000 + "b", "x" * 5000, "ab" * 3000,
                                  "日本語のテキスト" * 300, "\U0001f600\u0000z", "é" * 50, "   ", "\n\n\n \n"])
def test_special_texts(text):
    check(text)


def test_backtracking_equals_merging():
    rng = random.Random(2)
    for _ in range(2000):
        text = "▁" + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14)))
        assert MODEL.pieces(text) == MODEL.merged(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT", 5)
    model = PieceModel(model_bytes(PATH))
    for text in ["one two three four five six seven eight nine ten"] * 2:
        assert model.encode(text).tolist() == LIBRARY.encode(text)
    assert len(model.words) <= 5 and len(model.pairs) <= 5


def test_documents(spark, docs, rows, odd, empty):
    for df in (docs, odd):
        texts = {(r["doc_id"], r["text"]) for r in df.collect()}
        got = encode_documents(df, PATH).collect()
        want = [(i, LIBRARY.encode(t or "")) for i, t in texts]
        assert sorted(set((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got), key=str) == sorted(
            {(i, tuple(x), LIBRARY.decode(x)) for i, x in want}, key=str)
        assert len(got) == df.count()
    back = decode_ids(encode_documents(docs, PATH).select("doc_id", "ids"), PATH)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in rows}
    assert encode_documents(empty, PATH).collect() == []


def test_a_word_is_remembered_once():
    model = PieceModel(model_bytes(PATH))
    text = "one two, three's one two x-y ‘four’  five (two)  six"
    assert model.encode(text).tolist() == LIBRARY.encode(text)
    assert {"one", "two", "three"} <= set(model.words)
    assert not {p[1:] for p in model.parts if p[0] == "▁"} & set(model.words)


def test_rows_of_a_batch_are_given_back_in_parts():
    batch = pa.RecordBatch.from_pylist([{"k": k} for k in range(1000)])
    sizes = [x.num_rows for x in piece_bpe._small(iter([batch, batch.slice(0, 0), batch.slice(0, 3)]))]
    assert sizes == [256, 256, 256, 232, 3]
