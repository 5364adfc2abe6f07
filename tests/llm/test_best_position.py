"""Ranked search against scores of all documents in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stocklens.llm import best_position
from stocklens.llm.best_position import Shard, rank_documents, words
from stocklens.llm.queries import op11_best_position

SF = "/root/testdata/sf0.001"
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.lower() for w in TERM.findall((text or "").encode())]


def brute(documents, queries, k=10):
    """Rows (query, rank, doc_id, score) of lists of (id, text)."""
    counted = [(i, Counter(t)) for i, t in ((i, terms(text)) for i, text in documents) if t]
    total = sum(sum(c.values()) for _, c in counted)
    n_docs, df, out = len(counted), Counter(w for _, c in counted for w in c), []
    for item, text in queries:
        scored = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                    for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def found(df):
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=str)


def tables(spark, documents, queries):
    return (spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"))


def test_words():
    assert words("It's A-1 Straße\x7f_x ÄB") == terms("It's A-1 Straße\x7f_x ÄB") == [
        b"it", b"s", b"a", "1".encode(), "straße".encode(), "x Äb".encode()]
    assert words(None) == words(" \n.,") == []


def test_query(spark, rows):
    queries = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in rows], queries)
    assert found(op11_best_position(spark, SF)) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_small_shards(spark, monkeypatch, seed):
    """Few words and many equal documents: ties at the k-th place must go by id across shards and reads."""
    monkeypatch.setattr(best_position, "FIRST_READ", 1)
    some = random.Random(seed)
    documents = [(i, " ".join(some.choice("abcdefg") for _ in range(some.choice([0, 1, 2, 2, 3, 8])))) for i in range(400)]
    some.shuffle(documents)
    queries = [(i, " ".join(some.choice("abcdefgz") for _ in range(some.randrange(6)))) for i in range(30)]
    docs, items = tables(spark, documents, queries)
    for k in (1, 10):
        assert found(rank_documents(docs.repartition(5), items, k)) == sorted(brute(documents, queries, k), key=str)


def test_queries_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(best_position, "BLOCK_WORDS", 3)
    documents = [(i, w) for i, w in enumerate(["a b c", "b c d", "c d e f", "x", "a a a"])]
    queries = [(1, "a b"), (2, "c d e f x"), (3, None), (4, "a"), (4, "a"), (None, "d")]
    docs, items = tables(spark, documents, queries)
    assert found(rank_documents(docs, items)) == sorted(brute(documents, queries), key=str)


def test_reading_stops_before_the_lists_end():
    """One rare word and one in all documents: the rare list is short, and the long one is not read through."""
    some = np.random.default_rng(0)
    n = 20_000
    doc = np.concatenate([np.arange(n), np.arange(0, n, 1000)])
    word = np.concatenate([np.zeros(n, int), np.ones(n // 1000, int)])
    impact = np.concatenate([some.integers(1, 1000, n), np.full(n // 1000, 5000)])
    shard = Shard(doc, word, impact, n, 2)
    docs, scores, read = shard.best([(0, 1), (1, 1)], 10)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, impact)
    want = np.lexsort((np.arange(n), -total))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert read < 500


def test_odd_rows(spark, odd, empty):
    documents = [(r["doc_id"], r["text"]) for r in odd.collect()]
    queries = [(1, "A b"), (2, "wörter LONG x"), (3, "日本語 und"), (None, "c d e"), (5, ""), (6, "x" * 50_000)]
    items = spark.createDataFrame([(i, t, 1, "r") for i, t in queries], "item_id long, text string, rank int, id string")
    got = rank_documents(odd, items)
    assert sorted(map(str, found(got))) == sorted(map(str, brute(documents, queries)))
    assert rank_documents(empty, items).count() == 0
    assert rank_documents(odd, items.filter("false")).count() == 0
    assert rank_documents(odd, items.filter("item_id = 5")).columns == ["item_id", "rank", "doc_id", "score"]
    assert rank_documents(odd.filter("text is null"), items).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 1, "x", 2)], "doc_id long, text string, n int, id int, words string, score int")
    items = spark.createDataFrame([(7, "b", 1)], "item_id long, text string, query int")
    assert [tuple(r)[:3] for r in rank_documents(docs, items).collect()] == [(7, 1, 1)]
