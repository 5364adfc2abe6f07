"""Ranked lexical search by the Best Position Algorithm over impact lists.

For each word of the queries there is a list of documents by falling impact, cut into shards of
documents. In a shard, each list is read on from its best position: the last one up to which all
positions have been seen, be it by reading or because a document was looked up there directly. Every
document met is looked up in all lists of the query at once, which gives its whole score and marks
its positions. Documents not met stand behind the best position of every list, so the impacts found there
add up to a bound of their scores; a query is done when that bound is strictly below its k-th score.
The best k of all shards are the best k of all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stocklens.session import materialise

# Fixed by the contract of the ranking: K1 scale, length share in percent, scale of weights and saturation.
LENGTH, TF, SATURATION, SCALE, WEIGHT = 75, 1000, 8, 1_000_000_000, 1000
# Documents and list entries of a shard; a shard ends with the Arrow batch that reaches one of them.
SHARD_DOCS, SHARD_ENTRIES = 65_536, 1_500_000
# Different words of the queries that are answered in one go, which bounds what is sent to the tasks.
BLOCK_WORDS = 200_000
# Positions read from a list at first; doubled each time.
FIRST_READ, LONGEST_READ = 16, 4_096

# Letters, digits and all bytes beyond ASCII make up words, A-Z in lower case; all else parts them.
_INSIDE = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _INSIDE else 0x20 for b in range(256)).lower()


def words(text: str | None) -> list[bytes]:
    """The words of a text, in order; none for null."""
    return (text or "").encode().translate(_TABLE).split()


class Shard:
    """Impact lists of some documents: by falling impact for reading, by document for direct access."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, impact: np.ndarray, docs: int, vocabulary: int):
        order = np.lexsort((doc, -impact, word))
        self.docs, self.doc, self.impact = docs, doc[order], impact[order]
        self.starts = np.searchsorted(word[order], np.arange(vocabulary + 1))
        key = word[order].astype(np.int64) * docs + self.doc
        place = np.argsort(key)
        self.keys, self.place = key[place], place

    def look_up(self, word: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents the word's list holds, and the places of those."""
        wanted = word * self.docs + docs
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        held = self.keys[at] == wanted
        return held, self.place[at[held]]

    def best(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the best k (word, times) sums above 0, and the number of positions read.

        Of equal scores the smaller document number comes first.
        """
        lists = [(w, times, int(self.starts[w]), int(self.starts[w + 1])) for w, times in query]
        lists = [x for x in lists if x[2] < x[3]]
        at = [start for _, _, start, _ in lists]  # the place behind the best position
        seen = [np.zeros(end - start + 1, bool) for _, _, start, end in lists]  # one more, never seen
        met, found, scores, size, read = np.zeros(self.docs, bool), [], [], FIRST_READ, 0
        top = np.empty(0, np.int64)
        while True:
            bound = sum(times * int(self.impact[p]) for (_, times, _, end), p in zip(lists, at) if p < end)
            if bound == 0 or (len(top) == k and int(top.min()) > bound):
                break
            parts = [self.doc[p:min(p + size, end)] for (_, _, _, end), p in zip(lists, at)]
            read += sum(map(len, parts))
            new = np.unique(np.concatenate(parts))
            new = new[~met[new]]
            met[new] = True
            score = np.zeros(len(new), np.int64)
            for i, (word, times, start, end) in enumerate(lists):
                held, places = self.look_up(word, new)
                score[held] += times * self.impact[places]
                seen[i][places - start] = True
                at[i] += int(np.argmin(seen[i][at[i] - start:]))
            found.append(new)
            scores.append(score)
            top = np.concatenate([top, score])
            top = np.partition(top, len(top) - k)[len(top) - k:] if len(top) > k else top
            size = min(2 * size, LONGEST_READ)
        docs, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found, scores))
        order = np.lexsort((docs, -score))[:k]
        order = order[score[order] > 0]
        return docs[order], score[order], read


def weight(n_docs: int, df: int) -> int:
    """Weight of a word that ``df`` of ``n_docs`` documents hold."""
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def count_words(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, words, tfs`` of each document with a word: all its words counted, those of ``number`` by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, held, tfs, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1).to_pylist()):
                every = words(text)
                if not every:
                    continue
                counts = Counter(map(number.get, every))
                counts.pop(None, None)
                ids.append(row)
                sizes.append(len(every))
                held += counts.keys()
                tfs += counts.values()
                ends.append(len(held))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(held, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                ["id", "n", "words", "tfs"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n bigint, words array<int>, tfs array<bigint>")


def impacts(tf: np.ndarray, n: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Impact of words by their number in a document, the document's length and the word's weight."""
    m = 100 - LENGTH + (LENGTH * n * n_docs) // n_words
    return weights * ((SCALE * tf) // (TF * tf + SATURATION * m))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of batches up to the bounds of a shard, documents by rising id."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs += batch.num_rows
        entries += len(batch.column(2).flatten())
        if docs >= SHARD_DOCS or entries >= SHARD_ENTRIES:
            yield pa.Table.from_batches(held)
            held, docs, entries = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def best_of_shards(counted: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_words: int,
                   k: int) -> DataFrame:
    """``query, id, score``: the best k documents of each shard for each query, by its number."""
    kind = counted.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches):
            table = table.take(pc.sort_indices(table.column("id"), null_placement="at_end")).combine_chunks()
            lists = table.column("words").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(table.num_rows), sizes)
            word = lists.flatten().to_numpy()
            tf = table.column("tfs").combine_chunks().flatten().to_numpy()
            n = table.column("n").to_numpy()
            shard = Shard(doc, word, impacts(tf, n[doc], weights[word], n_docs, n_words), table.num_rows, len(weights))
            query, at, score = [], [], []
            for q, asked in enumerate(queries):
                docs, scores, _ = shard.best(asked, k)
                query += [q] * len(docs)
                at.append(docs)
                score.append(scores)
            rows = pa.array(np.concatenate(at)) if at else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), table.column("id").combine_chunks().take(rows),
                 pa.array(np.concatenate(score) if score else np.empty(0, np.int64))], ["query", "id", "score"])

    return counted.mapInArrow(run, f"query int, id {kind}, score bigint")


def _first(rows: DataFrame, groups: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Queries with their words; a block has BLOCK_WORDS different words at most, or is one query."""
    block, known = [], set()
    for row in queries.toLocalIterator():
        asked = Counter(words(row[1]))
        if not asked:
            continue
        if block and len(known | asked.keys()) > BLOCK_WORDS:
            yield block
            block, known = [], set()
        block.append((row[0], asked))
        known |= asked.keys()
    if block:
        yield block


def _answer(docs: DataFrame, block: list[tuple[object, Counter]], k: int, id_col: str, text_col: str, item_kind) -> DataFrame | None:
    number = {w: i for i, w in enumerate(sorted(set().union(*(asked for _, asked in block))))}
    counted = materialise(count_words(docs, number, id_col, text_col))
    n_docs, n_words = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = dict(counted.select(F.explode("words").alias("word")).groupBy("word").count().collect())
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(number))], np.int64)
    queries = [[(number[w], times) for w, times in asked.items() if number[w] in df and weights[number[w]] > 0] for _, asked in block]
    of_shards = best_of_shards(counted, queries, weights, n_docs, n_words, k)
    # one more step in between, so that the last one never meets all shards of a query in one task
    some = _first(of_shards.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))), ["query", "part"], k).drop("rank", "part")
    items = docs.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], _items_schema(item_kind))
    return _first(some, ["query"], k).join(F.broadcast(items), "query").select("item", "rank", "id", "score")


def _items_schema(item_kind):
    from pyspark.sql.types import IntegerType, StructType

    return StructType().add("query", IntegerType()).add("item", item_kind)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """``query_id_col, rank, id_col, score``: the k best documents with a score above 0 for each row of ``queries``.

    Equal scores go by rising id, null ids last. Null and empty texts have no words: such documents are never
    found and don't count, such queries give no rows. Every row is a document or a query of its own, so repeated
    rows are ranked beside each other, and a query that stands there twice is answered twice. Empty tables give an
    empty result. Other columns, whatever their names, are not read. The queries pass through the driver in
    blocks; of the documents only the number of rows with each word of the block does.
    """
    items = queries.select(queries[query_id_col].alias("item"), queries[query_text_col].cast("string").alias("text"))
    item_kind, id_kind = items.schema["item"].dataType, docs.schema[id_col].dataType
    answers = [_answer(docs, block, k, id_col, text_col, item_kind) for block in _blocks(items)]
    answers = [a for a in answers if a is not None]
    if not answers:
        empty = f"item {item_kind.simpleString()}, rank int, id {id_kind.simpleString()}, score bigint"
        answers = [docs.sparkSession.createDataFrame([], empty)]
    found = reduce(DataFrame.unionAll, answers)
    return found.select(F.col("item").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")
