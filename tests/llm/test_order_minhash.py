"""Order MinHash: edited texts and neighbours by hand, properties of the fingerprints."""

import random

import pytest
from pyspark.sql import functions as F

from stocklens.llm import order_minhash
from stocklens.llm.order_minhash import fingerprint, fingerprint_documents, likeness, with_signature


def edited(rows):
    """Texts with the last half replaced by the start of the next document."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(k + 1) % len(rows)][1]
        out.append((i, len(t), t[:len(t) - half] + after[:half], after))
    return out


@pytest.mark.parametrize("block", [2000, 1])
def test_edited_texts(docs, rows, odd, block):
    for df, plain in ((docs, rows), (odd, odd.collect())):
        got = fingerprint_documents(df, block_rows=block).collect()
        want = [x[:3] for x in edited([(r["doc_id"], r["text"]) for r in plain])]
        assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in got), key=str) == sorted(want, key=str)


def test_empty_table_and_single_row(spark, empty):
    assert fingerprint_documents(empty).collect() == []
    one = spark.createDataFrame([(5, "abcdef ghij")], "doc_id long, text string")
    r = fingerprint_documents(one).first()
    assert r["edited"] == "abcdef" + "abcde" and r["near_next"] == 1.0


def pairs(spark, texts):
    df = with_signature(spark.createDataFrame(texts, "a string, b string"), "a", "x")
    return [r[0] for r in with_signature(df, "b", "y").select(likeness(F.col("x"), F.col("y"))).collect()]


def test_likeness(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    base = " ".join(words)
    some = list(words)
    for k in range(0, 400, 40):
        some[k] = "changed"
    half = words[:200] + [f"v{k}" for k in range(200)]
    turned = words[200:] + words[:200]
    other = " ".join(f"z{k}" for k in range(400))
    mixed = list(words)
    rng.shuffle(mixed)
    same, near, part, moved, none, shuffled, twice, empty, blank = pairs(spark, [
        (base, base), (base, " ".join(some)), (base, " ".join(half)), (base, " ".join(turned)), (base, other), (base, " ".join(mixed)),
        (base, base + " " + base), ("", ""), ("", base)])
    assert same == 1 and none == 0 and empty == 1 and blank == 0 and shuffled < 0.1
    assert 1 > near > part > none and near > 0.3 and part > 0.03
    assert near > moved  # the same k-mers in another order are less alike


def test_repeated_words_count(spark):
    few, many = pairs(spark, [("ha " * 40, "ha " * 41), ("ha " * 40, "ha " * 400)])
    assert few > many and few > 0.5


def test_equal_texts_have_equal_fingerprints(docs):
    found = fingerprint_documents(docs).withColumn("f", fingerprint("signature")).join(docs.select("doc_id", "text"), "doc_id")
    per_text = found.groupBy("text").agg(F.countDistinct("f").alias("n")).agg(F.max("n")).first()[0]
    assert per_text == 1
    row = found.filter("n_chars > 400").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert row["e"] > row["n"] + 0.05


def test_short_and_unspaced_texts(spark):
    assert pairs(spark, [("a", "a"), ("a", "b"), ("日本語のテキストです", "日本語のテキストだ"), ("x" * 3000, "x" * 3000)]) == [
        1.0, 0.0, pytest.approx(0.6, abs=0.35), 1.0]


def test_likeness_does_not_break_at_any_length(spark):
    """A text against its copy without the last word, at every number of words; near 1 from a dozen words on."""
    words = [f"word{k}" for k in range(40)]
    got = pairs(spark, [(" ".join(words[:n]), " ".join(words[:n - 1])) for n in range(5, 41)])
    assert all(x >= 0.6 for x in got) and all(x >= 0.85 for x in got[8:])


def test_mixed_scripts(spark):
    """Half unspaced text: more or less of it changes the likeness by its share only."""
    ideographs = "日本語のテキストはこのように続きます"
    spaced = " ".join(f"word{k}" for k in range(12))
    got = pairs(spark, [(spaced + ideographs[:n], spaced + ideographs[:n + 2]) for n in range(0, 16)])
    assert all(x >= 0.7 for x in got)
    long = "a1B2" * 500
    half, blanks, none = pairs(spark, [(long, long[:1000] + "Z" * 1000), ("   ", "   "), ("   ", "")])
    assert 0.05 < half < 0.5 and blanks == 1 and none == 0


def plain_signature(features, k=order_minhash.K, pick=order_minhash.PICK):
    """Selected k-mers by bucket, in text order, from (bucket, hash, place) of every numbered k-mer."""
    out = {}
    for bucket, short, place in sorted(features):
        out.setdefault(bucket, []).append((place, short))
    return {b: [s for _, s in sorted(x[:pick])] for b, x in out.items()}


def test_signature_against_plain_python(spark):
    """The same k-mers, numbers, buckets, selection and order in plain Python, with Spark's hash of single values only."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    hash_of = lambda rows, kind, n: [r[0] for r in spark.createDataFrame(rows, ", ".join(f"c{i} {kind}" for i in range(n))).select(
        F.xxhash64(*[F.col(f"c{i}") for i in range(n)])).collect()]
    got = [r[0] for r in with_signature(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "s").select("s").collect()]
    for text, signature in zip(texts, got):
        units = hash_of([(w,) for w in text.split()], "string", 1)
        if len(units) < order_minhash.K:
            continue
        kmers = hash_of([tuple(units[i:i + order_minhash.K]) for i in range(len(units) - order_minhash.K + 1)], "long", order_minhash.K)
        seen, numbered = {}, []
        for h in kmers:
            numbered.append((h >> 32, seen.get(h >> 32, 0)))
            seen[h >> 32] = numbered[-1][1] + 1
        features = [r[0] for r in spark.createDataFrame(numbered, "h long, n int").select(F.xxhash64("h", "n")).collect()]
        chosen = plain_signature([(f % order_minhash.BUCKETS, f >> 8 & order_minhash._FEATURE, i) for i, f in enumerate(features)])
        tuples = spark.createDataFrame([(b, x) for b, x in sorted(chosen.items())], "b long, x array<long>")
        want = [(r["b"] << 32) | ((r["v"] >> 32) & 0xFFFFFFFF) for r in tuples.select("b", F.xxhash64("x").alias("v")).collect()]
        assert sorted(signature) == sorted(want)


def test_no_python(docs):
    plan = fingerprint_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
