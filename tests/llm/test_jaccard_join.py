"""Jaccard join against comparing all pairs."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stocklens.llm import hashed_words, jaccard_join
from stocklens.llm.jaccard_join import SKETCH, _possible, bits_apart, overlaps, parities, similar_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k=4, percent=85):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


def got(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, similar_components(df, **settings).collect()), key=str)


def family(rng, n, words, edits, start=0):
    """Texts that differ from one text in a few words, and from each other in more."""
    base = [f"w{rng.randrange(50)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(1000)}"
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize("group,block,hot", [(512, 128, 16), (4, 3, 3)])
def test_equals_all_pairs(spark, monkeypatch, group, block, hot):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", hot)
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = family(rng, 40, 120, 9) + family(rng, 30, 60, 4, 100) + family(rng, 25, 12, 2, 200)
    rows += [(300 + i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(3, 80)))) for i in range(30)]
    rows += [(400 + i, "same text in many copies of it") for i in range(50)] + [(500 + i, "Short TEXT") for i in range(3)]
    rows += [(600, ""), (601, None), (602, " \n"), (603, "one"), (604, "ONE"), (605, "one two"), (606, "a b c d"), (607, "A b c d e")]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("group,block", [(512, 128), (4, 3)])
def test_links_of_a_set_that_no_smaller_id_reaches(spark, monkeypatch, group, block):
    """The middle text is linked with both others, which are not similar to one another, in all orders of ids."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = []
    for k, order in enumerate([*itertools.permutations((88, 120, 103))] * 8):
        rows += [(3 * k + i, " ".join(f"f{k}w{j}" for j in range(n))) for i, n in enumerate(order)]
    found = got(spark, rows)
    assert found == brute(rows)
    assert {component for _, _, component in found} == set(range(0, len(rows), 3))


def test_other_settings(spark):
    rng = random.Random(3)
    rows = family(rng, 30, 40, 6)
    assert got(spark, rows, words=5, percent=80) == brute(rows, 5, 80)
    assert got(spark, rows, words=1, percent=50) == brute(rows, 1, 50)


def test_fixture(spark, docs, rows):
    plain = [(r["doc_id"], r["text"]) for r in rows]
    assert sorted(map(tuple, similar_components(docs).collect()), key=str) == brute(plain)


def test_odd_rows_and_empty_table(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, similar_components(odd).collect()), key=str) == brute(rows)
    assert similar_components(empty).collect() == []
    twice = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (0, "a b c d e f"), (0, "m n o p")]
    assert got(spark, twice) == brute(twice)


def test_answers_derived_from_similar_sets():
    rng = np.random.default_rng(5)
    base = rng.permutation(400)
    sets = [np.unique(np.where(rng.random(300) < 0.05, rng.integers(0, 400, 300), base[:300])) for _ in range(20)]
    sets += [np.unique(rng.integers(0, 400, size)) for size in (1, 50, 399)] + [np.arange(1000, 1010)]
    for i, common in overlaps(sets):
        assert common.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


def test_parities_never_tell_more_than_the_sets_differ(spark):
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    sizes = [int(n) for n in (0, *rng.integers(1, 2000, 12), 1024, 1025, 9000, 9500, 16_000, 30_000)]
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in sizes]
    near = sets[-1][rng.permutation(len(sets[-1]))[300:]]  # shares nearly all of its elements with the set before it
    sets.append(np.sort(near))
    flat, lengths = parities(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert len(flat) == lengths.sum() and lengths.min() == SKETCH and (lengths & (lengths - 1) == 0).all()
    sketches = [[int(v) for v in x.view(np.int64)] for x in np.split(flat, np.cumsum(lengths)[:-1])]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sketches)], "i int, s array<long>")
    pairs = table.alias("x").join(table.alias("y"), F.expr("x.i < y.i")).select(
        F.col("x.i").alias("a"), F.col("y.i").alias("b"), bits_apart(F.col("x.s"), F.col("y.s")).alias("bits")).collect()
    assert len(pairs) == len(sets) * (len(sets) - 1) // 2
    for r in pairs:
        differ = len(np.setxor1d(sets[r["a"]], sets[r["b"]]))
        assert r["bits"] <= differ and (r["bits"] - differ) % 2 == 0
        if len(sets[r["a"]]) > 5000 and len(sets[r["b"]]) < 2 * len(sets[r["a"]]):
            assert r["bits"] > 0.3 * differ  # long sets are told apart as well


def test_sets_that_meet_by_chance_are_not_moved():
    """Of a group only sets that may be linked with another one go on, long and short ones side by side."""
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (300, 310, 5, 4000, 4200, 9000, 1020, 40)]
    linked = [(x, np.sort(x[len(x) // 20:])) for x in (sets[0], sets[3], sets[6])]  # one of them has a shorter sketch
    linked.append((np.sort(np.append(linked[2][0], rng.integers(0, 1 << 63, 30, dtype=np.uint64))), sets[2]))
    sets = sets + [y for _, y in linked[:3]] + [linked[3][0]]
    sizes = np.array([len(x) for x in sets])
    flat, lengths = parities(np.concatenate(sets), sizes)
    sketches = [x.view(np.int64).tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
    place = [0] * len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array(place), pa.array(place), pa.array(range(len(sets))), pa.array(sizes), pa.array(sketches)],
                                       ["home", "part", "id", "n", "sketch"])
    found = {i for out in _possible(85)(iter([batch])) for i in out.column(2).to_pylist()}
    assert found == {i for i, j in itertools.permutations(range(len(sets)), 2)
                     if len(np.intersect1d(sets[i], sets[j])) * 100 >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert {0, 3, 6, 8, 9, 10, 11} == found


def test_words_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = pa.array([None if k % 7 == 0 else " ".join(f"W{rng.randrange(99)}" for _ in range(rng.randrange(60))) for k in range(80)])
    whole = [[x.tolist() for x in run[1:]] for run in hashed_words.hashed_words(texts)]
    monkeypatch.setattr(hashed_words, "PIECE_BYTES", 150)
    assert [[x.tolist() for x in run[1:]] for run in hashed_words.hashed_words(texts)] == whole
