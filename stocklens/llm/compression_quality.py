"""Quality by compression: which of two dictionaries shortens a text more.

One zstandard dictionary is cut from good training texts, one from bad ones. A text is compressed in
blocks with each; the difference of the sizes per byte is the evidence, and a logistic curve fitted on
other training texts turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.labelled import held_out, labelled_sample, logistic
from stocklens.llm.text import whole
from stocklens.llm.worker_memory import released, remembers

ROWS_PER_CLASS = 6000  # bound of the training sample
DICTIONARY_BYTES, PIECE_BYTES = 512 * 1024, 512
BLOCK_BYTES, LEVEL = 4096, 3
# Bytes of typical good text that are thought added to each document, so a few words decide little.
PRIOR_BYTES = 200


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    typical: float  # difference per byte of good text
    slope: float
    intercept: float

    def evidence(self, n: np.ndarray, size_good: np.ndarray, size_bad: np.ndarray) -> np.ndarray:
        """Normalised difference of the compressed sizes."""
        return (size_bad - size_good + self.typical * PRIOR_BYTES) / (n + PRIOR_BYTES)

    def score(self, n, size_good, size_bad) -> np.ndarray:
        x = self.slope * self.evidence(np.asarray(n, float), np.asarray(size_good, float), np.asarray(size_bad, float))
        return 1 / (1 + np.exp(-np.clip(x + self.intercept, -30, 30)))


def dictionary(pieces: list[bytes]) -> bytes:
    """Pieces of training text one after the other, up to the size of a dictionary."""
    return b"".join(pieces)[:DICTIONARY_BYTES]


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


remembers("compression_quality", _compressor.cache_clear)


def compressed_sizes(text: str, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """Bytes of the whole text and of its blocks compressed with either dictionary."""
    data = text.encode()
    blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return (len(data), *(sum(len(c.compress(b)) for b in blocks) for c in (_compressor(good), _compressor(bad))))


def sizes_of(good: bytes, bad: bytes):
    """A column function: text -> struct ``n, size_good, size_bad``."""

    @F.pandas_udf("n long, size_good long, size_bad long")
    def sizes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(run, "compression_quality")(parts)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([compressed_sizes(t or "", good, bad) for t in texts],
                               columns=["n", "size_good", "size_bad"], dtype="int64")

    return sizes


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS,
          id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """Dictionaries from three quarters of a bounded sample of training documents, the curve from the rest.

    A document gives a dictionary one piece, from a place that its id decides.
    """
    sample = labelled_sample(docs, labels, label_col, rows_per_class, id_col, text_col)
    place = F.floor(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 20)) / float(1 << 20) * F.greatest(
        F.char_length("text") - PIECE_BYTES, F.lit(0))).cast("int") + 1
    pieces = sample.filter("part > 0").select("label", "id", F.substring("text", place, F.lit(PIECE_BYTES)).alias("piece")).filter(
        "piece <> ''").orderBy(F.xxhash64("id", F.lit(3)), "id").collect()
    good, bad = (dictionary([r["piece"].encode() for r in pieces if r["label"] == k]) for k in (1, 0))
    sizes = sample.filter("part = 0").select("label", sizes_of(good, bad)("text").alias("s")).select("label", "s.*").toPandas()
    n, g, b, y = (sizes[c].to_numpy(float) for c in ("n", "size_good", "size_bad", "label"))
    clean = (y == 1) & (n > 0)
    typical = float(np.median((b - g)[clean] / n[clean])) if clean.any() else 0.0
    x = CompressionModel(good, bad, typical, 0.0, 0.0).evidence(n, g, b)
    return CompressionModel(good, bad, typical, *logistic(x, y))


def score_column(model: CompressionModel, text: Column) -> Column:
    """Probability of label 1 for a column of texts without nulls."""
    s = sizes_of(model.good, model.bad)(text)
    evidence = (s["size_bad"] - s["size_good"] + model.typical * PRIOR_BYTES) / (s["n"] + PRIOR_BYTES)
    x = F.greatest(F.least(evidence * model.slope + model.intercept, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(-x))


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.5,
                  rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row; score: probability of label 1.

    Learns from labelled rows that are not held out, at most ``rows_per_class`` of each class; the score
    depends on the text alone. Null text counts as empty; the empty text has the score of typical good
    text. Null ids count as the empty id and repeated rows are scored alike. With no labels of a class the score
    is the share of the other. An empty table gives an empty result.
    """
    model = train(docs, labels, label_col, rows_per_class, id_col, text_col)
    return docs.select(
        F.col(id_col), held_out(id_col).alias("held_out"), score_column(model, whole(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.5,
              rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns as they were; see ``score_quality``."""
    model = train(docs, labels, label_col, rows_per_class, id_col, text_col)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    score = score_column(model, whole(names[docs.columns.index(text_col)]))
    return docs.toDF(*names).withColumn("_score", score).filter(F.col("_score") >= threshold).select(*names).toDF(*docs.columns)
