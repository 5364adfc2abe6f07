"""Both classifiers: held-out accuracy, folds, and odd inputs."""

from zlib import crc32

import numpy as np
import pytest

from stocklens.llm.compression_quality import compressed_sizes, keep_good, score_quality
from stocklens.llm.labelled import labelled_sample, logistic
from stocklens.llm.subword_toxicity import Scorer, score_toxicity, train_texts

BIG = "/root/testdata/sf0.1"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    return np.mean([(s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()])


@pytest.mark.parametrize("score,label,least", [(score_quality, "quality", 0.95), (score_toxicity, "toxic", 0.9)])
def test_held_out(spark, score, label, least):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, labels)
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    table = got.join(labels, "doc_id").toPandas()
    assert (table["held_out"] == [crc32(str(i).encode()) % 3 == 1 for i in table["doc_id"]]).all()
    assert (table["predicted"] == (table["score"] >= (0.5 if label == "quality" else 0.7))).all()
    test = table[table["held_out"]]
    assert auc(test[label], test["score"]) > least
    clean = test[test[label] == (1 if label == "quality" else 0)]
    assert (clean["predicted"] == (1 if label == "quality" else 0)).mean() > 0.96


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_odd_rows(spark, score, odd, empty):
    name = "quality" if score is score_quality else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, None), (None, 1)], f"doc_id long, {name} int")
    got = score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    one = spark.createDataFrame([(i, 1) for i in range(20)], f"doc_id long, {name} int")
    assert len({round(r["score"], 9) for r in score(odd, one).collect()}) == 1
    assert len(score(odd, one.filter("false")).collect()) == odd.count()
    assert score(empty, labels).collect() == []
    if score is score_quality:
        assert keep_good(odd, labels).columns == odd.columns


def test_labels_ids_and_sources_do_not_matter(spark, docs, rows):
    """Held-out labels and other columns of the documents change nothing."""
    labels = spark.createDataFrame([(r["doc_id"], r["doc_id"] % 2) for r in rows], "doc_id long, quality int")
    turned = spark.createDataFrame([(r["doc_id"], (r["doc_id"] + (crc32(str(r["doc_id"]).encode()) % 3 == 1)) % 2) for r in rows],
                                   "doc_id long, quality int")
    blank = docs.select("doc_id", "text")
    assert score_quality(docs, labels).orderBy("doc_id").collect() == score_quality(blank, turned).orderBy("doc_id").collect()


def test_sample_is_bounded(spark, docs):
    labels = spark.read.parquet(BIG.replace("0.1", "0.001") + "/labels.parquet")
    rows = labelled_sample(docs, labels, "quality", 5).collect()
    assert 0 < len(rows) <= 10 and not any(crc32(str(r["id"]).encode()) % 3 == 1 for r in rows)


def test_misspelt_words_share_ngrams():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts, toxic = [], []
    for k in range(160):
        words = list(rng.choice(plain, 60))
        if k % 2:
            words[rng.integers(60)] = rng.choice(["worthless", "worthlesss", "wortless"])
        texts.append(" ".join(words))
        toxic.append(k % 2)
    scorer = Scorer(train_texts(texts, toxic, [1 + k % 3 if k % 8 > 1 else 0 for k in range(160)]))
    bad, misspelt, good = (scorer.peak(f"{' '.join(plain[:7])} {w}") for w in ("worthless", "w0rthless", plain[9]))
    assert bad > misspelt > good


def test_sizes_cover_whole_texts():
    long = "all new words " * 3000
    assert compressed_sizes(long, b"", b"")[0] == len(long)
    assert compressed_sizes("", b"x" * 100, b"y" * 100) == (0, 0, 0)


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    slope, intercept = logistic(x, y)
    assert slope == pytest.approx(2, abs=0.3) and intercept == pytest.approx(-1, abs=0.2)
    assert logistic(x, np.ones(4000))[0] == 0
