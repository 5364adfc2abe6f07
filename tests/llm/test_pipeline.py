"""The pipeline against the same steps done in plain Python."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import sentencepiece

import corpus_pipeline
from stocklens.llm.compression_quality import score_quality
from tests.llm.conftest import SF
from tests.llm.test_jaccard_join import LOWER
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_mixing import brute as mix


def test_pipeline(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in score_quality(docs, labels).collect() if r["predicted"]}
    kept = [r for r in rows if r["doc_id"] in good]
    last = {(r["text"] or "").translate(LOWER): r["doc_id"] for r in sorted(kept, key=lambda r: r["doc_id"])}
    kept = [r for r in kept if last[(r["text"] or "").translate(LOWER)] == r["doc_id"]]
    first = {i for i, _, c in components([(r["doc_id"], r["text"]) for r in kept], 5, 80) if i == c}
    kept = [r for r in kept if r["doc_id"] in first]
    copies = {i: n for i, _, _, _, n in mix([(r["doc_id"], r["text"], r["source"]) for r in kept])}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in kept:
        ids = model.encode(r["text"] or "")
        if copies[r["doc_id"]]:
            want[r["doc_id"], tuple(ids), sha256(model.decode(ids).encode()).hexdigest()] += copies[r["doc_id"]]
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(want) > 50


def test_stages_keep_columns_and_take_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            out.collect()
        assert len(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == docs.count()
