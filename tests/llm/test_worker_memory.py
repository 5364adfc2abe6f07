"""What stages of the pipeline leave in a Python worker for the next one."""

import public_tokenizers
import pyarrow as pa

from stocklens.llm import compression_quality, jaccard_join, piece_bpe, worker_memory
from stocklens.llm.worker_memory import released

MODEL = piece_bpe.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def same(batches):
    yield from batches


def test_a_task_forgets_what_other_stages_keep():
    piece_bpe._model(MODEL)
    compression_quality._compressor(b"some text of a dictionary")
    assert list(released(same, "piece_bpe")(iter([1, 2]))) == [1, 2]
    assert piece_bpe._model.cache_info().currsize == 1
    assert compression_quality._compressor.cache_info().currsize == 0
    list(released(same)(iter([])))
    assert piece_bpe._model.cache_info().currsize == 0


def test_memory_is_given_back_after_the_last_batch_and_after_a_failure(monkeypatch):
    calls = []
    monkeypatch.setattr(worker_memory, "give_back", lambda: calls.append(1))
    assert [x.num_rows for x in released(same)(iter([pa.RecordBatch.from_pydict({"a": [1]})]))] == [1]

    def fails(batches):
        yield from batches
        raise ValueError

    try:
        list(released(fails)(iter([1])))
    except ValueError:
        pass
    assert calls == [1, 1]


def test_workers_of_the_pipeline_forget_the_stage_before(spark, docs):
    """In a worker that has encoded, a task of near dedup runs without the model."""
    piece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).count()

    def sizes(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [piece_bpe._model.cache_info().currsize]})

    assert {r["n"] for r in docs.select("doc_id").repartition(8).mapInArrow(jaccard_join.released(sizes), "n long").collect()} == {0}
