"""Exact encoding against the tokenizer library, and the way back."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stocklens.llm.byte_bpe import RankModel, decode_bytes, differing_signs, encode_bytes, read_ranks, sentencepiece_model, signs
from stocklens.llm.piece_bpe import model_bytes

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = model_bytes(PATH)
MODEL = RankModel(RANKS, sentencepiece_model(read_ranks(RANKS)), PATTERN, differing_signs())
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def check(text):
    ids = MODEL.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert MODEL.decode(ids) == text.encode() == LIBRARY.decode_bytes(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeinst  ▁\t\n.,'«»’²0123"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    check(text)


def test_characters_that_the_libraries_class_differently():
    some = random.Random(3)
    newer = [chr(x) for x in sorted(differing_signs())]
    pool = [*some.sample(newer, min(60, len(newer))), *" \n\t\x1c\x85'std19aé中жʔ﷐௦", "the", "'re", "  "]
    for _ in range(3000):
        check("".join(some.choice(pool) for _ in range(some.randrange(30))))


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "<|endoftext|>", "a" + " " * 1000 + "b", "x" * 5000, "日本語のテキスト" * 300,
                                  "\U0001f600\u0000z", "é" * 50, "　\xa0 ", "\n\n\n \n", "it's we'LL they'd"])
def test_special_texts(text):
    check(text)


def test_every_entry_is_reached_by_merging():
    for data, rank in list(MODEL.ranks.items())[::7]:
        assert MODEL.pieces.encode(signs(data), out_type=int) == [rank]


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        read_ranks(b"YQ== 0\nYg== 2\n")


def test_documents(rows, docs):
    got = {r["doc_id"]: r for r in encode_bytes(docs, PATH, PATTERN).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        assert got[r["doc_id"]]["ids"] == LIBRARY.encode_ordinary(text)
        assert bytes(got[r["doc_id"]]["decoded"]) == text.encode()


def test_odd_rows_and_the_way_back(odd, empty):
    encoded = encode_bytes(odd, PATH, PATTERN)
    want = sorted((str(r["doc_id"]), LIBRARY.encode_ordinary(r["text"] or "")) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect()) == want
    back = decode_bytes(encoded.drop("decoded"), PATH, PATTERN)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back.collect()) == sorted(
        (str(r["doc_id"]), (r["text"] or "").encode()) for r in odd.collect())
    assert encode_bytes(empty, PATH, PATTERN).count() == 0


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 2, b"")], "doc_id long, text string, id string, ids int, decoded binary")
    r = encode_bytes(rows, PATH, PATTERN).first()
    assert r["doc_id"] == 1 and r["ids"] == LIBRARY.encode_ordinary("a b") and bytes(r["decoded"]) == b"a b"
