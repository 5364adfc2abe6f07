"""Bounded samples of labelled documents for training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.text import crc_fold, whole
from stocklens.session import materialise

FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str):
    """Whether a document is kept out of training (crc32 of its id as text, modulo 3, is 1)."""
    return crc_fold(id_col, FOLDS) == HELD_OUT


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, text, label, part`` of at most ``rows_per_class`` training documents of each class, as a written table.

    The documents are those with the smallest hashes of their ids, so the choice does not depend on order
    or partitions. ``part`` (0 to 3) deals them into four. Labels other than 0 and 1, null ids and held-out
    ids are left out. Only the chosen ids, a bounded list, are broadcast.
    """
    chosen = None
    for value in (0, 1):
        part = labels.filter((F.col(label_col) == value) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(
            F.col(id_col).alias("id"), F.lit(value).alias("label")).distinct().orderBy(
            F.xxhash64("id"), "id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return materialise(texts.join(F.broadcast(chosen), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int")))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x) by Newton's method, with targets drawn in a little from 0 and 1.

    With one class alone the slope is 0 and the intercept gives that class's share.
    """
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0 or x.std() == 0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return 0.0, float(np.log(share / (1 - share)))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = x.mean(), x.std()
    z, a, b = (x - mean) / scale, 0.0, float(np.log(n1 / n0))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, t - p
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * z).sum(), g.sum()])
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
    return float(a / scale), float(b - a * mean / scale)
