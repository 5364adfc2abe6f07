"""Removal of repeated strings against a count of all strings."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from stocklens.llm import suffix_dedup
from stocklens.llm.suffix_dedup import remove_repeats, repeated_starts, segments, suffix_array


def brute(rows, window):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(d[k:k + window] for _, d in data for k in range(len(d) - window + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - window + 1):
            if times[d[k:k + window]] > 1:
                gone[k + 1:k + window + 1] = True
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((i, len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, window):
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), sha256(r["kept"]).hexdigest())
                   for r in remove_repeats(df, window).collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_repeats(seed):
    rng = random.Random(seed)
    signs = [b"a", b"ab", b"abc", bytes(range(256)), b"xy\xff", b"\x00\x01"][seed]
    for n in (1, 2, 7, 60, 400):
        text = bytes(rng.choice(signs) for _ in range(n))
        assert suffix_array(text, n) == sorted(range(n), key=lambda i: text[i:])
        parts = [bytes(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(12)]
        times = Counter(p[k:k + 4] for p in parts for k in range(len(p) - 3))
        assert [x.tolist() for x in repeated_starts(parts, 4)] == [[k for k in range(len(p) - 3) if times[p[k:k + 4]] > 1] for p in parts]
    assert suffix_array(b"", 5) == []


def test_equal_strings_have_equal_anchors():
    rng = random.Random(1)
    text = b"".join(rng.choice([b"abc", b"ab", b"xyz", b"q"]) for _ in range(500))
    data, seen = np.frombuffer(text, np.uint8), {}
    first, last, place, hashes = segments(data, 20)
    assert first[0] == 0 and last[-1] == len(text) - 20 and (first[1:] == last[:-1] + 1).all()
    for a, b, p, h in zip(first, last, place, hashes):
        for k in range(a, b + 1):
            assert seen.setdefault(text[k:k + 20], (p - k, h)) == (p - k, h)


@pytest.mark.parametrize("window,crowd,size", [(12, 2000, 2**18), (12, 3, 100), (30, 2000, 500)])
def test_equals_counting(spark, monkeypatch, window, crowd, size):
    monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", crowd)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", size)
    rng = random.Random(window + crowd)
    word = lambda: rng.choice(["alpha", "be", "gämma", "日本", "x", "delta12"])
    passage = " ".join(word() for _ in range(12))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40))) + passage * rng.randrange(2) + "".join(
        chr(rng.randrange(97, 123)) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100, "ab" * 40), (101, "a" * 50), (102, "a" * window), (103, "a" * (window + 1)), (104, ""), (105, None), (None, "short")]
    rows += [(200 + i, "the same long text in a few copies, " * 2) for i in range(9)] + [(200, "the same long text in a few copies, " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, window) == brute(rows, window)


def test_fixture(docs, rows):
    assert got(docs, 400) == brute([(r["doc_id"], r["text"]) for r in rows], 400)


def test_odd_rows_and_empty_table(odd, empty):
    assert got(odd, 50) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], 50)
    assert remove_repeats(empty).collect() == []
