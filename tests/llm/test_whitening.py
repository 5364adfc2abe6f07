"""Whitening against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from stocklens.llm.queries import op12_whitening
from stocklens.llm.whitening import LIMIT, fit, whiten, whole_entries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors):
    """Entries, exact covariances, deviations and eigenvalues of the vectors that remain."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max((len(v) for _, v in good), default=0)
    good = [(i, v) for i, v in good if len(v) == longest]
    n, s = len(good), [sum(v[d] for _, v in good) for d in range(longest)]
    cov = [[sum((Fraction(v[a]) - Fraction(s[a], n)) * (Fraction(v[b]) - Fraction(s[b], n)) for _, v in good) / n
            for b in range(longest)] for a in range(longest)]
    deviation = sorted((str(i), sum((n * v[d] - s[d]) ** 2 for d in range(longest))) for i, v in good)
    return good, n, s, np.array([[float(x) for x in row] for row in cov]), deviation


def compare(spark, vectors, components=32):
    good, n, s, cov, deviation = brute(vectors)
    rows = whiten(spark.createDataFrame(vectors, SCHEMA).repartition(3), components=components).collect()
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in rows) == deviation
    values = np.sort(np.linalg.eigvalsh(cov))[::-1][:components]
    assert all(r["n"] == n for r in rows)
    np.testing.assert_allclose(rows[0]["explained"], (values / np.trace(cov))[:len(rows[0]["explained"])], rtol=1e-9)
    white = np.array([r["whitened"] for r in rows])
    k = white.shape[1]
    np.testing.assert_allclose(white.T @ white / n - np.outer(white.mean(0), white.mean(0)), np.eye(k), atol=1e-8)
    assert rows[0]["identity_error"] < 1e-8
    # each component is an eigenvector: the covariance of entries and whitened values is e * vector / sqrt(e)
    by_id = {str(r["vec_id"]): r["whitened"] for r in rows}
    x = np.array([[float(Fraction(v[d]) - Fraction(s[d], n)) for d in range(len(s))] for _, v in good])
    y = np.array([by_id[str(i)] for i, _ in good])
    vectors_found = x.T @ y / n / np.sqrt(values[:k])
    np.testing.assert_allclose(np.linalg.norm(vectors_found, axis=0), 1, rtol=1e-9)
    np.testing.assert_allclose(cov @ vectors_found, vectors_found * values[:k], atol=1e-9 * values[0])
    return rows


def test_random_vectors(spark):
    r = np.random.default_rng(0)
    mixed = r.normal(size=(300, 5)) @ r.normal(size=(5, 5)) * 3
    rows = compare(spark, [(i, v.tolist()) for i, v in enumerate(mixed)])
    assert len(rows[0]["whitened"]) == 5


def test_fewer_components(spark):
    r = np.random.default_rng(1)
    assert len(compare(spark, [(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 6)))], 3)[0]["whitened"]) == 3


def test_odd_vectors(spark):
    r = np.random.default_rng(2)
    good = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(40, 3)))]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]),
           (104, [1.0, 2.0]), (105, []), (106, [0.0, -0.0, 5e-324])]
    rows = compare(spark, good + odd)
    assert len(rows) == 41
    assert whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0]), (1, [3.0, 3.0])], SCHEMA)).count() == 3


def test_components_without_variance(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(100, 2))
    rows = whiten(spark.createDataFrame([(i, [*v.tolist(), float(v[0]), 7.0]) for i, v in enumerate(a)], SCHEMA)).collect()
    assert {len(x["whitened"]) for x in rows} == {2} and rows[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, vectors):
    got = whiten(spark.createDataFrame(vectors, SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "whitened", "deviation", "n", "explained", "identity_error"]


def test_large_entries(spark):
    """Centred values beyond 32 bits are squared exactly; beyond the limit there is an error."""
    r = np.random.default_rng(4)
    compare(spark, [(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 3)) * 2 ** 36)])
    with pytest.raises(ValueError):
        fit(whole_entries(spark.createDataFrame([(1, [0.0]), (2, [float(2 ** LIMIT)])], SCHEMA), "vec_id", "embedding"))


def test_repeated_rows_and_clashing_names(spark):
    r = np.random.default_rng(5)
    vectors = [(i % 7, v.tolist(), "a", 1.0, 2) for i, v in enumerate(r.normal(size=(30, 2)))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, id string, x double, n int")
    rows = whiten(df.unionAll(df)).collect()
    assert len(rows) == 60 and rows[0]["n"] == 60


def test_query(spark):
    rows = op12_whitening(spark, SF).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good, n, s, cov, deviation = brute(vectors)
    k = min(32, len(s))
    assert len(rows) == k * n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert {r["component"] for r in rows} == set(range(1, k + 1))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in rows if r["component"] == 1) == deviation
    for r in rows[:200]:
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-8 and r["n"] == n
