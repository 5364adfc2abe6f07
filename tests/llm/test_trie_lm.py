"""Trie language model against counting with dictionaries."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from stocklens.llm import elias_fano, queries, trie_lm
from stocklens.llm.hashed_words import hashed_words
from tests.llm.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def fold(i, n=10):
    return crc32(("" if i is None else str(i)).encode()) % n


def brute(rows, order, cut):
    """Scores by the formulas of the module, from plain counts."""
    train = [tokens(r["text"]) for r in rows if fold(r["doc_id"]) != 0]
    count = [Counter(tuple(t[i:i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, order + 1)]
    for k in range(2, order + 1):
        count[k - 1] = {g: c for g, c in count[k - 1].items() if c >= cut.get(k, 1)}
    n, v, s = sum(count[0].values()), len(count[0]), trie_lm.SMOOTHING

    def p(gram):
        if len(gram) == 1:
            return (count[0].get(gram, 0) + 0.1) / (n + 0.1 * (v + 1))
        context = count[len(gram) - 2].get(gram[:-1], 0)
        if not context:
            return p(gram[1:])
        return (count[len(gram) - 1].get(gram, 0) + s * p(gram[1:])) / (context + s)

    out = []
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10(p((w,))) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1):i + 1]))) for i in range(len(t)))
        out.append((r["doc_id"], fold(r["doc_id"]) == 0, len(t), sum((w,) in count[0] for w in t), n, base, score))
    return out


@pytest.mark.parametrize("order,cut,shards", [(1, {}, 10**9), (2, {}, 5000), (3, {}, 5000), (3, {3: 2}, 20000)])
def test_equals_dictionaries(spark, docs, rows, order, cut, shards, monkeypatch, tmp_path):
    monkeypatch.setattr(trie_lm, "SHARD_TOKENS", shards)
    monkeypatch.setattr(trie_lm, "CHUNK_TOKENS", 7000)
    got = sorted(map(tuple, trie_lm.score_documents(docs, order=order, min_counts=cut, folder=str(tmp_path / "t")).collect()))
    want = sorted(brute(rows, order, cut))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= w[2] * 1.01 / trie_lm.QUANT  # a probability and a weight, half a step each


def test_odd_rows_and_empty_table(odd, empty):
    got = sorted(map(tuple, trie_lm.score_documents(odd).collect()), key=str)
    want = sorted(brute(odd.collect(), 3, {}), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[6] == pytest.approx(w[6], abs=g[2] / 1000) for g, w in zip(got, want))
    assert trie_lm.score_documents(empty).collect() == []


def test_probabilities_sum_to_one(spark, tmp_path):
    texts = ["a b a c", "a b b", "c a b a", "b"] * 3
    words = ["a", "b", "c"]
    train = [(i, t) for i, t in zip((i for i in range(1, 999) if fold(i)), texts)]
    held = [(i, f"a b {w}") for i, w in zip((i for i in range(1, 999) if not fold(i)), [*words, "unseen"])]
    plain = (max(i for i, _ in held) + 10000, "a b")
    df = spark.createDataFrame(train + held + [plain], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in trie_lm.score_documents(df, folder=str(tmp_path / "t")).collect()}
    assert set(rows) == {i for i, _ in train + held + [plain]}
    got = brute([{"doc_id": i, "text": t} for i, t in train + held + [plain]], 3, {})
    assert all(rows[i]["score"] == pytest.approx(score, abs=0.01) for i, *_, score in got)


def test_query_counts_all_trigrams(spark, rows):
    got = sorted(map(tuple, queries.op4_trie_lm(spark, SF).collect()))
    for g, w in zip(got, sorted(brute(rows, 3, {})), strict=True):
        assert g[0] == w[0] and abs(g[6] - w[6]) <= w[2] * 1.01 / trie_lm.QUANT


def test_all_trigrams_sum_to_one_over_the_vocabulary(spark, monkeypatch, tmp_path):
    """The token behind a text is set to each word, the end, and a word never seen."""
    texts = ["a b c", "a b d", "a b e", "c d", "a b"]
    known, total = trie_lm.build_trie(spark.createDataFrame(list(enumerate(texts)), "id long, text string"),
                                      str(tmp_path / "t"), min_counts={})
    hash_of = {w: next(iter(hashed_words(pa.array([w]))))[1][0] for w in ["a", "b", "c", "d", "e", "unseen"]}
    run = trie_lm._score(known, total, 3, ["id", "n_tokens", "n_known", "base_score", "score"])

    def score(text, then):
        monkeypatch.setattr(trie_lm, "END", then)
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
        return next(run(iter([batch]))).column(4)[0].as_py()

    end, context = trie_lm.END, score("a", hash_of["b"])
    sums = sum(10 ** (score("a b", w) - context) for w in [*hash_of.values(), end])
    assert sums == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 10**12), (300, 300), (5000, 10**6), (5000, 2**40), (4096, 7)])
def test_elias_fano(n, top, tmp_path):
    rng = np.random.default_rng(n + top % 97)
    values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
    elias_fano.write_sections(str(tmp_path / "x"), elias_fano.pack(values, "v"))
    seq = elias_fano.EliasFano(elias_fano.map_sections(str(tmp_path / "x")), "v")
    places = np.sort(rng.integers(0, n, 50)) if n else np.empty(0, int)
    assert (seq.at(places) == values[places]).all()
    asked = np.sort(np.concatenate([rng.integers(0, top + 2, 200).astype(np.uint64), values[::7]]))
    place, equal = seq.successor(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (equal == np.isin(asked, values)).all()


def test_a_look_up_decodes_nothing(monkeypatch):
    """What a look-up costs must not grow with the distance between those asked for."""
    values = np.unique(np.random.default_rng(3).integers(0, 2**34, 200_000)).astype(np.uint64)
    seq = elias_fano.EliasFano(elias_fano.pack(values, "v"), "v")
    monkeypatch.setattr(elias_fano.EliasFano, "decode", None)
    places = np.arange(0, len(values), 997)
    assert (seq.at(places) == values[places]).all()
    asked = np.sort(np.concatenate([values[places], values[places] + np.uint64(1)]))
    place, equal = seq.successor(asked)
    assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


@pytest.mark.parametrize("far", [[], [2**41], [2**41, 2**42, 2**42 + 1], [2**62]])
@pytest.mark.parametrize("near", [1, 63, 64, 65, 3000])
def test_elias_fano_with_leaps(near, far):
    """Blocks that rise by more than a low part holds, side by side with others."""
    rng = np.random.default_rng(near)
    low = np.sort(rng.integers(0, 9 * near, near))
    values = np.concatenate([low, *[np.sort(x + rng.integers(0, 500, 90)) for x in far]]).astype(np.uint64)
    values.sort()
    seq = elias_fano.EliasFano(elias_fano.pack(values, "v"), "v")
    assert (seq.at(np.arange(len(values))) == values).all()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), values[values > 0] - np.uint64(1), [np.uint64(2**63 - 1)]]))
    place, equal = seq.successor(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (equal == np.isin(asked, values)).all()
