"""Exact copies against grouping in Python."""

from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stocklens.llm.exact_dedup import drop_copies, exact_copies

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        text = (t or "").translate(LOWER)
        ids = [x for x in groups[text] if x is not None]
        stays = (max if keep == "max" else min)(ids) if ids else None
        out.append((i, stays, len(groups[text]), i == stays, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def weak(text):
    return F.substring(F.md5(text.cast("binary")), 1, 1).cast("binary")


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("content_hash", [None, weak])
def test_equals_grouping(docs, rows, odd, keep, content_hash):
    settings = {"content_hash": content_hash} if content_hash else {}
    for df, plain in ((docs, rows), (odd, odd.collect())):
        got = sorted(map(tuple, exact_copies(df, keep=keep, **settings).collect()), key=str)
        assert got == brute([(r["doc_id"], r["text"]) for r in plain], keep)


def test_only_a_to_z_is_lowered(spark):
    df = spark.createDataFrame([(1, "ÀB"), (2, "àb"), (3, "Àb"), (4, "KELVIN K"), (5, "kelvin k")], "doc_id long, text string")
    kept = {r["doc_id"]: r["keep_id"] for r in exact_copies(df).collect()}
    assert kept == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_drop_copies(docs, rows, odd, empty):
    kept = drop_copies(odd, keep="max")
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted({
        (5, "A B c d e"), (4, " \t\n "), (3, ""), (6, "wörter und 日本語 mix"), (7, "long " * 20_000), (8, "x" * 50_000)}, key=str)
    assert {r["doc_id"] for r in drop_copies(docs).collect()} == {i for i, stays, *_ in brute([(r["doc_id"], r["text"]) for r in rows], "min") if i == stays}
    assert drop_copies(empty).collect() == [] and exact_copies(empty).collect() == []


def test_no_python(docs):
    plan = exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
