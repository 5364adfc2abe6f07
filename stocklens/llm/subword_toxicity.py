"""Toxicity by bags of subwords.

A word is the mean of the embeddings of its character n-grams, a window of the text the mean of its
words, and a linear softmax tells toxic windows from others. Embeddings and softmax are trained together
in numpy. Misspelt words share most n-grams with those seen in training. A document is as toxic as its
most toxic window, so whole texts of any length are judged without thinning out a few words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.labelled import held_out, labelled_sample, logistic
from stocklens.llm.text import whole

ROWS_PER_CLASS = 1500  # bound of the training sample
WINDOWS_PER_ROW = 48  # windows of a training row that a round of training uses, besides toxic ones
WINDOW = 8  # words
GRAMS = (3, 4, 5)
BUCKETS, DIMENSIONS = 1 << 17, 8
WORD = re.compile(r"[^\W_]+")
KEPT = 300_000  # words whose values a Python worker remembers


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, with signs for its borders."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1) if n < len(marked)]
    return [crc32(g.encode()) % BUCKETS for g in grams]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class ToxicityModel:
    """Per n-gram: its embedding put through the softmax, as one number; then the curve for documents."""

    values: np.ndarray
    bias: float
    slope: float
    intercept: float


class Scorer:
    """Scores of texts; word values are remembered, at most KEPT."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            value = float(self.model.values[subwords(word)].mean())
            if len(word) <= 40:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word] = value
        return value

    def peak(self, text: str) -> float:
        """Log-odds of the most toxic window; a shorter text is one window, filled up with neutral words."""
        known = self.known
        values = np.array([known[w] if w in known else self.word(w) for w in words_of(text)], float)
        again = np.zeros(len(values), bool)  # a word counts once in a window; equal values are equal words
        for k in range(1, min(WINDOW, len(values))):
            again[k:] |= values[k:] == values[:-k]
        values[again] = 0
        if len(values) <= WINDOW:
            return float(values.sum() / WINDOW + self.model.bias)
        sums = np.cumsum(np.concatenate(([0.0], values)))
        return float((sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW + self.model.bias)


class _Bags:
    """Windows as sets of words, words as lists of n-gram buckets."""

    def __init__(self, windows: list[list[str]]):
        place: dict[str, int] = {}
        words = [[place.setdefault(w, len(place)) for w in dict.fromkeys(window)] for window in windows]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.array([w for window in words for w in window], np.int64)
        grams = [subwords(w) for w in place]
        self.gram_sizes = np.array([len(g) for g in grams], np.int64)
        self.gram_starts = np.cumsum(self.gram_sizes) - self.gram_sizes
        self.grams = np.array([x for g in grams for x in g], np.int64)

    @staticmethod
    def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of several runs, one after the other."""
        ends = np.cumsum(sizes)
        return np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)

    def take(self, rows: np.ndarray):
        """Words that the windows use; their places and windows, word by word; and the n-grams of the words."""
        sizes = self.sizes[rows]
        used, place = np.unique(self.words[self._spans(self.starts[rows], sizes)], return_inverse=True)
        gram_sizes = self.gram_sizes[used]
        return place, np.repeat(np.arange(len(rows)), sizes), self.grams[self._spans(self.gram_starts[used], gram_sizes)], gram_sizes

    def scores(self, value: np.ndarray, bias: float) -> np.ndarray:
        """Log-odds of all windows from a value for each n-gram; none are empty."""
        by_word = np.add.reduceat(value[self.grams], self.gram_starts) / self.gram_sizes
        return np.add.reduceat(by_word[self.words], self.starts) / WINDOW + bias


def fit_windows(windows: list[list[str]], rows: np.ndarray, toxic: np.ndarray, seed: int = 0, rounds: int = 4,
                steps: int = 250, rate: float = 0.5, batch: int = 768) -> tuple[np.ndarray, float]:
    """Embeddings and softmax, trained together by AdaGrad: a value for each n-gram and the bias.

    ``rows`` gives the document of each window (none empty), ``toxic`` its document's label. Most windows of
    a toxic document are harmless: after the first round only those count as toxic that the model holds
    for toxic, and the highest one. Of each document a round takes some windows by lot and, after the
    first, those that score highest, which are the ones hard to tell.
    """
    rng = np.random.default_rng(seed)
    bias, soft = np.zeros(2, np.float32), np.zeros((DIMENSIONS, 2), np.float32)
    embed = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    if not len(windows):
        return embed @ (soft[:, 1] - soft[:, 0]), 0.0
    bags = _Bags(windows)
    soft[:, 1] = (rng.random(DIMENSIONS) - 0.5).astype(np.float32)
    sums = [np.full(x.shape, 1e-6, np.float32) for x in (embed[:, :1], soft, bias)]
    target, scores = toxic.astype(int), np.zeros(len(windows))
    for turn in range(rounds):
        chosen = _rank_in_row(rows, rng.random(len(rows))) < WINDOWS_PER_ROW // 2
        if turn:
            chosen |= _rank_in_row(rows, -scores) < WINDOWS_PER_ROW // 2
        chosen = np.flatnonzero(chosen | (toxic & (target == 1)) if turn else chosen)
        share = min(max(target[chosen].mean(), 1e-3), 1 - 1e-3)
        weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        step = 0
        while step < steps:
            order = rng.permutation(chosen)
            for at in range(0, len(order), batch)[:steps - step]:
                step += 1
                now = order[at:at + batch]
                place, owner, ids, sizes = bags.take(now)
                starts = np.cumsum(sizes) - sizes
                words = np.add.reduceat(embed[ids], starts) / sizes[:, None]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                hidden = np.add.reduceat(words[place], first) / WINDOW
                logits = hidden @ soft + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(now)), target[now]] -= 1
                p *= weight[now][:, None] / len(now)
                to_hidden = (p @ soft.T / WINDOW).astype(np.float32)
                for x, s, g in ((soft, sums[1], hidden.T @ p), (bias, sums[2], p.sum(0))):
                    s += g * g
                    x -= rate * g / np.sqrt(s)
                to_words = np.stack([np.bincount(place, to_hidden[owner, k], len(sizes)) for k in range(DIMENSIONS)], 1)
                to_grams = np.repeat((to_words / sizes[:, None]).astype(np.float32), sizes, 0)
                touched, spot = np.unique(ids, return_inverse=True)
                change = np.stack([np.bincount(spot, to_grams[:, k], len(touched)) for k in range(DIMENSIONS)], 1).astype(np.float32)
                sums[0][touched, 0] += (change * change).mean(1)
                embed[touched] -= rate * change / np.sqrt(sums[0][touched])
        value = embed @ (soft[:, 1] - soft[:, 0])
        scores = bags.scores(value, bias[1] - bias[0])
        target = (toxic & ((scores > 0) | (_rank_in_row(rows, -scores) == 0))).astype(int)
    return value, float(bias[1] - bias[0])


def _rank_in_row(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Place of each window among those of its document, in the order of ``by``."""
    order = np.lexsort((by, rows))
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    sizes = np.diff(np.append(first, len(rows)))
    out = np.empty(len(rows), np.int64)
    out[order] = np.arange(len(rows)) - np.repeat(first, sizes)
    return out


def train_texts(texts: list[str], toxic: list[int], parts: list[int], seed: int = 0) -> ToxicityModel:
    """Windows from most of the texts (part 1 and up); the curve from log-odds of windows to documents from part 0."""
    windows, rows, labels = [], [], []
    for row, (text, label, part) in enumerate(zip(texts, toxic, parts)):
        words = words_of(text) if part else []
        for start in range(0, len(words), WINDOW // 2):
            windows.append(words[start:start + WINDOW])
            rows.append(row)
            labels.append(bool(label))
    values, bias = fit_windows(windows, np.array(rows, int), np.array(labels, bool), seed)
    model = ToxicityModel(values, bias, 1.0, 0.0)
    scorer = Scorer(model)
    other = [i for i, part in enumerate(parts) if not part]
    slope, intercept = logistic(np.array([scorer.peak(texts[i]) for i in other]), np.array([toxic[i] for i in other], int)) \
        if other else (1.0, 0.0)
    return ToxicityModel(values.astype(np.float32), bias, slope, intercept)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS,
          max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from a bounded sample of training rows. Of a sampled text longer than ``max_chars`` an inner
    part of that length is used, which bounds what the driver holds; scoring always reads whole texts."""
    sample = labelled_sample(docs, labels, label_col, rows_per_class, id_col, text_col)
    place = F.floor(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 20)) / float(1 << 20) * F.greatest(
        F.char_length("text") - max_chars, F.lit(0))).cast("int") + 1
    rows = sample.select("id", F.substring("text", place, F.lit(max_chars)).alias("text"), "label", "part").orderBy(
        F.xxhash64("id"), "id", "label").collect()
    return train_texts([r["text"] for r in rows], [r["label"] for r in rows], [r["part"] for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.7,
                   rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row; score: probability that the text is toxic.

    Learns from labelled rows that are not held out, at most ``rows_per_class`` of each class; the score
    depends on the text alone. Null text counts as empty; a text without words gets the score of neutral
    words. Null ids count as the empty id and repeated rows are scored alike. With no labels of a class the
    score is the share of the other. An empty table gives an empty result.
    """
    model = train(docs, labels, label_col, rows_per_class, id_col=id_col, text_col=text_col)

    @F.pandas_udf("double")
    def peak(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in parts:
            yield pd.Series([scorer.peak(t) for t in texts], dtype="float64")

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), peak(whole(text_col)).alias("_peak"))
    x = F.greatest(F.least(F.col("_peak") * model.slope + model.intercept, F.lit(30.0)), F.lit(-30.0))
    return rows.select(id_col, "held_out", (1 / (1 + F.exp(-x))).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
