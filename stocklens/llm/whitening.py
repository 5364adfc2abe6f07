"""Whitening of embeddings by exact covariances, from variances alone (polarisation).

Entries are whole numbers. For every dimension, and for the sum of every two dimensions, the squares of
the centred values are added up exactly; half of what the square of a sum has more than the two
squares is the covariance of the two dimensions. The matrix is put together and decomposed by the
driver, its size depends on the number of dimensions only. Everything else runs in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A vector's entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
# Centred values are n * x - S. A square is added up in three parts of LIMB bits each, which stay below 2^63
# over ROWS rows while centred values stay below 2^LIMIT.
LIMB, ROWS, LIMIT = 27, 256, 53


@dataclass(frozen=True)
class Whitening:
    """What whitening needs to know of the fit list: its size, sums, eigenvectors (as columns) and eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def whole_entries(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, size, x``: whole entries of the vectors that have no null or non-finite entry."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    # filters may be evaluated in any order, so the whole entries are defined for every number
    whole = F.transform("v", lambda e: F.when(finite(e), F.floor(e * SCALE).cast("bigint") + OFFSET))
    return rows.filter(F.col("v").isNotNull() & F.forall("v", finite)).select("id", F.size("v").alias("size"), whole.alias("x"))


def column_sums(entries: DataFrame) -> tuple[int, list[int], int]:
    """Number of the longest vectors, their sum by dimension, and a bound of ``abs(n * x - S)``."""
    found = entries.select("size", F.posexplode("x").alias("dim", "e")).groupBy("size", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("e").cast("decimal(20,0)")).alias("s"),
        F.min("e").alias("low"), F.max("e").alias("high"))
    longest = found.agg(F.max("size")).first()[0]
    rows = found.filter(F.col("size") == F.lit(longest)).orderBy("dim").collect() if longest else []
    if not rows:
        return 0, [], 0
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    bound = max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(rows, sums))
    if bound >> LIMIT:
        raise ValueError(f"entries spread too far: n * x - S reaches {bound}, the limit is 2^{LIMIT}")
    return n, sums, bound


def _centred(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and ``n * x - S`` of up to ROWS rows."""
    base = sums // n
    rest = (sums - n * base).astype(np.int64)
    base = base.astype(np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column(1).flatten().to_numpy().reshape(part.num_rows, len(sums))
            yield part.column(0), n * (x - base) - rest


def _squares(w: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of squares as three whole numbers, to be weighed with 2^(2 LIMB), 2^(LIMB + 1) and 1."""
    high, low = w >> LIMB, w & ((1 << LIMB) - 1)
    return (high * high).sum(axis), (high * low).sum(axis), (low * low).sum(axis)


def _whole(parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The exact sums as Python numbers."""
    a, b, c = (x.astype(object) for x in parts)
    return a * (1 << 2 * LIMB) + b * (1 << LIMB + 1) + c


def squared_sums(entries: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``i, j, q``: sum over all rows of the squared centred values of dimension i (i = j), or of the sum of two (i < j).

    A task gives one row for each pair, however many vectors it reads.
    """
    dims, s = len(sums), np.array(sums, object)
    first = np.concatenate([np.full(dims - i, i) for i in range(dims)])
    second = np.concatenate([np.arange(i, dims) for i in range(dims)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for _, w in _centred(batches, n, s):
            for i in range(dims):
                pairs = w[:, i:] + w[:, i:i + 1]
                pairs[:, 0] = w[:, i]
                total[i] = total[i] + _whole(_squares(pairs, 0))
        if not isinstance(total[0], int):
            q = pa.array([str(v) for part in total for v in part])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), q], ["i", "j", "q"])

    parts = entries.mapInArrow(run, "i int, j int, q string")
    return parts.groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q"))


def covariances(squares: dict[tuple[int, int], int], dims: int, n: int) -> np.ndarray:
    """The covariance matrix of x, divisor n, each entry rounded once from its exact value."""
    v = np.empty((dims, dims))
    for i in range(dims):
        v[i, i] = squares[i, i] / n ** 3
        for j in range(i + 1, dims):
            # (a + b)^2 - a^2 - b^2 = 2 a b
            v[i, j] = v[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n ** 3)
    return v


def fit(entries: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the vectors of the largest length; None if there is no variance at all."""
    n, sums, bound = column_sums(entries)
    if not bound:
        return None
    dims = len(sums)
    squares = {(r["i"], r["j"]): int(r["q"]) for r in squared_sums(_of_length(entries, dims), n, sums).collect()}
    v = covariances(squares, dims, n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > values[0] * dims * np.finfo(float).eps).sum())
    k = min(components, real)
    return Whitening(n, np.array(sums, object), np.ascontiguousarray(vectors[:, :k]), values[:k], values[:k] / np.trace(v))


def _of_length(entries: DataFrame, dims: int) -> DataFrame:
    return entries.filter(F.col("size") == dims).select("id", "x")


def projected(entries: DataFrame, known: Whitening) -> DataFrame:
    """``id, whitened, deviation`` of each vector; the squares of the deviation are added exactly."""
    basis = known.vectors / np.sqrt(known.values)
    n, sums, k = known.n, known.sums, len(known.values)
    kind = entries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in _centred(batches, n, sums):
            y = (w / n) @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, k), pa.int32()), pa.array(y.ravel()))
            far = pa.array([str(v) for v in _whole(_squares(w, 1))])
            yield pa.RecordBatch.from_arrays([ids, lists, far], ["id", "whitened", "deviation"])

    rows = _of_length(entries, len(sums)).mapInArrow(run, f"id {kind}, whitened array<double>, deviation string")
    return rows.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(entries: DataFrame, known: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity."""
    k, basis = len(known.values), known.vectors / np.sqrt(known.values)
    n, sums = known.n, known.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(k + k * k), False
        for _, w in _centred(batches, n, sums):
            y = (w / n) @ basis
            total += np.concatenate([y.sum(0), (y.T @ y).ravel()])
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "part"])

    sums_of = _of_length(entries, len(sums)).mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("s"))
    total = np.zeros(k + k * k)
    for r in sums_of.collect():
        total[r["at"]] = r["s"] / n
    mean = total[:k]  # the vectors are centred already; what is left is rounding
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_col, whitened array<double>, deviation decimal(38,0), n, explained array<double>, identity_error``, a row for each vector.

    Vectors that are null or hold null or non-finite entries are left out, and so are vectors shorter than the
    longest, whose last entries are missing. Components without variance (a rank below the number of dimensions,
    constant entries, one vector only) can't be scaled to 1 and do not come out; with none left, and for an empty
    table, the result is empty. Repeated rows count as often as they occur, a null id stays null, ties of
    eigenvalues come in any order, and other columns, whatever their names, are not read. A component has the same sign for all rows.
    Entries so far apart that ``n * x - S`` reaches 2^53 raise an error, since their squares are no longer exact. What is
    collected are sums for each dimension, pair of dimensions and pair of components.
    """
    entries = whole_entries(vectors, id_col, vector_col)
    known = fit(entries, components)
    if known is None:
        kind = entries.schema["id"].dataType.simpleString()
        empty = entries.sparkSession.createDataFrame(
            [], f"id {kind}, whitened array<double>, deviation decimal(38,0), n bigint, explained array<double>, identity_error double")
        return empty.withColumnRenamed("id", id_col)
    return projected(entries, known).select(
        F.col("id").alias(id_col), "whitened", "deviation", F.lit(known.n).cast("bigint").alias("n"),
        F.array(*[F.lit(float(v)) for v in known.explained]).alias("explained"),
        F.lit(identity_error(entries, known)).alias("identity_error"))
