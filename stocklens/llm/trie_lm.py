"""Language-model scores from an n-gram trie of Elias-Fano levels.

Level 1 holds the words, as sorted 64-bit hashes with their counts. Level k holds the n-grams of k words as one
monotone sequence of parent and child, in which a node's children are a range. From level 3 on a child is not written as a
word but as its rank among the words that follow the last word of its context, which is a small number.
Sequences are read where a task asks: a look-up costs the same whatever the size of the level.
Every node has its smoothed probability and its back-off weight, quantised to 16 bits.

Each level is cut into shards by its parent. Tasks count n-grams in chunks and send one compressed block
per shard; the task of a shard adds the blocks up and writes one file to the shared folder. Scoring maps the
files into memory, so a task holds only the parts it touches.

Probabilities: a word has (c + 0.1) / (N + 0.1 (V + 1)); given a context h the estimate of the shorter context
is worth SMOOTHING observations: (c(hw) + s P(w | shorter h)) / (c(h) + s). That is a distribution at each level.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm.elias_fano import EliasFano, map_sections, pack, write_sections
from stocklens.llm.hashed_words import hashed_words
from stocklens.llm.text import crc_fold
from stocklens.session import materialise, scratch_dir

ORDER = 3
SMOOTHING = 4.0
UNSEEN = 0.1
CHUNK_TOKENS = 2_200_000  # tokens that a task holds at once
SHARD_TOKENS = 2_000_000  # training tokens for each shard of a level
CHILD_BITS = 30  # a key is parent << 30 | child
QUANT = 3000.0  # steps for a factor of ten
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text


def _quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * QUANT), 0, 65535).astype(np.uint16)


def _pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, bytes of equal weight together, compressed."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(),
                             counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()])
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_counts(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:]), np.uint8)
    steps = np.ascontiguousarray(planes[:8 * n].reshape(8, n).T).view(np.uint64).ravel()
    counts = np.ascontiguousarray(planes[8 * n:].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint64), counts


class Trie:
    """The levels written so far; ``sizes[k - 1]`` lists the nodes of each shard of level k."""

    def __init__(self, folder: str, shards: int, sizes: tuple[tuple[int, ...], ...]):
        self.folder, self.shards = folder, shards
        self.starts = [np.concatenate(([0], np.cumsum(x))).astype(np.int64) for x in sizes]
        self.levels = len(sizes)
        self.files: dict[tuple[int, int], dict] = {}

    def file(self, level: int, shard: int) -> dict:
        if (level, shard) not in self.files:
            self.files[level, shard] = map_sections(f"{self.folder}/{level}-{shard}")
        return self.files[level, shard]

    def gather(self, level: int, name: str, nodes: np.ndarray) -> np.ndarray:
        """Values of nodes, in any order."""
        out = None
        order = np.argsort(nodes)
        nodes = nodes[order]
        cuts = np.searchsorted(nodes, self.starts[level - 1])
        for shard in range(self.shards):
            a, b = cuts[shard], cuts[shard + 1]
            if a < b:
                values = self.file(level, shard)[name][nodes[a:b] - self.starts[level - 1][shard]]
                out = np.empty(len(nodes), values.dtype) if out is None else out
                out[order[a:b]] = values
        return np.empty(0, np.float64) if out is None else out

    def words(self, hashes: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Numbers of words, -1 for those not in the training texts, and their counts if asked for."""
        back, distinct = pd.factorize(hashes.view(np.int64))
        order = np.argsort(distinct.view(np.uint64))
        wanted = distinct.view(np.uint64)[order]
        out, count = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64)
        cuts = np.searchsorted(_word_shard(wanted, self.shards), np.arange(self.shards + 1))
        for shard in range(self.shards):
            a, b = cuts[shard], cuts[shard + 1]
            known = self.file(1, shard)["hash"] if a < b and self.starts[0][shard + 1] > self.starts[0][shard] else ()
            if len(known):
                at = np.minimum(np.searchsorted(known, wanted[a:b]), len(known) - 1)
                hit = np.flatnonzero(known[at] == wanted[a:b])
                out[a:b][hit] = at[hit] + self.starts[0][shard]
                count[a:b][hit] = self.file(1, shard)["count"][at[hit]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return out[place][back], count[place][back] if counted else None

    def children(self, level: int, shard_of: np.ndarray, keys: np.ndarray, names: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
        """Nodes of a level by keys that ascend in each shard: ``node`` (-1 where there is none), on level 2 ``rank`` among
        the parent's children, and the named values."""
        out = {"node": np.full(len(keys), -1, np.int64)}
        if level == 2:
            out["rank"] = np.full(len(keys), -1, np.int64)
        out |= {name: np.zeros(len(keys), np.uint16) for name in names}
        cuts = np.searchsorted(shard_of, np.arange(self.shards + 1))
        for shard in range(self.shards):
            a, b = cuts[shard], cuts[shard + 1]
            if a == b or self.starts[level - 1][shard + 1] == self.starts[level - 1][shard]:
                continue
            f = self.file(level, shard)
            bits, sequence = int(f["bits"][0]), EliasFano(f, "child")
            row, child = keys[a:b] >> CHILD_BITS, keys[a:b] & (1 << CHILD_BITS) - 1
            # a child larger than all of the shard would run into the next parent
            asked = np.flatnonzero(child < 1 << bits)
            place, equal = sequence.successor((row[asked] << bits | child[asked]).view(np.uint64))
            asked, place = asked[equal], place[equal]
            out["node"][a + asked] = place + self.starts[level - 1][shard]
            if level == 2:
                row = row[asked]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                begin = sequence.successor((row[first] << bits).view(np.uint64))[0]
                out["rank"][a + asked] = place - np.repeat(begin, np.diff(np.append(first, len(row))))
            for name in names:
                out[name][a + asked] = f[name][place]
        return out

    def first_child(self, level: int, parents: np.ndarray) -> np.ndarray:
        """First node of the range of each parent (ascending by shard and parent)."""
        out = np.zeros(len(parents), np.int64)
        shard_of = parents % self.shards
        cuts = np.searchsorted(shard_of, np.arange(self.shards + 1))
        for shard in range(self.shards):
            a, b = cuts[shard], cuts[shard + 1]
            if a < b and self.starts[level - 1][shard + 1] > self.starts[level - 1][shard]:
                f = self.file(level, shard)
                begin = (parents[a:b] // self.shards << int(f["bits"][0])).view(np.uint64)
                out[a:b] = EliasFano(f, "child").successor(begin)[0] + self.starts[level - 1][shard]
        return out

    def sorted_keys(self, parents: np.ndarray, children: np.ndarray, way_back: bool):
        """Shards and keys of distinct pairs, by shard and key, their counts, and the way back to the pairs."""
        local = parents // self.shards
        shard = parents - local * self.shards
        if len(parents) and (local.max() >= 1 << 63 - CHILD_BITS or children.max() >= 1 << CHILD_BITS):
            raise OverflowError("too many nodes for the keys of this trie")
        key = (local << CHILD_BITS) | children
        del local
        bits = int(key.max()).bit_length() if len(key) else 0
        if bits + self.shards.bit_length() <= 63:  # shard and key in one number
            both = (shard << bits) | key
            del shard, key
            order = np.argsort(both) if way_back else None
            if way_back:
                both = both[order]
            else:
                both.sort()
            new = np.ones(len(both), bool)
            new[1:] = both[1:] != both[:-1]
            first = np.flatnonzero(new)
            s, k = both[first] >> bits, both[first] & (1 << bits) - 1
        else:
            order = np.lexsort((key, shard))
            s, k = shard[order], key[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            first = np.flatnonzero(new)
            s, k = s[first], k[first]
        back = None
        if way_back:
            back = np.empty(len(new), np.int32)
            back[order] = np.cumsum(new, dtype=np.int32) - 1
        return s, k, np.diff(np.append(first, len(new))), back

    def nodes(self, ids: np.ndarray, inner: np.ndarray, top: int, names: dict[int, tuple[str, ...]] | None = None):
        """Per level the node of the n-gram that ends at each token, -1 where unknown; ranks of level 2; named values.

        ``ids``: words of texts one after the other; ``inner[k]``: whether the n-gram of k + 1 words that
        ends at a token lies in one text.
        """
        found, ranks, values = {1: ids}, None, {}
        for level in range(2, top + 1):
            parents, children, use = self.keys(found, ranks, inner, level)
            node = np.full(len(ids), -1, np.int64)
            wanted = (names or {}).get(level, ())
            values[level] = {name: np.zeros(len(ids), np.uint16) for name in wanted}
            if level == 2:
                ranks = np.full(len(ids), -1, np.int64)
            if len(use):
                s, k, _, back = self.sorted_keys(parents, children, True)
                got = self.children(level, s, k, wanted)
                node[use] = got["node"][back]
                if level == 2:
                    ranks[use] = got["rank"][back]
                for name in wanted:
                    values[level][name][use] = got[name][back]
            found[level] = node
        return found, ranks, values

    def keys(self, found: dict[int, np.ndarray], ranks: np.ndarray | None, inner: np.ndarray, level: int):
        """Parents, children and places of the n-grams of a level whose parent and child are known."""
        child = found[1] if level == 2 else ranks
        before = np.concatenate(([-1], found[level - 1][:-1]))
        use = np.flatnonzero(inner[level - 1] & (before >= 0) & (child >= 0))
        return before[use], child[use], use


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards of words are ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@lru_cache(maxsize=1)
def _trie(folder: str, shards: int, sizes: tuple[tuple[int, ...], ...]) -> Trie:
    return Trie(folder, shards, sizes)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of some rows at a time: ids, hashes of all words with an end behind each text, words of each text."""
    ids, hashes, counts, tokens = [], [], [], 0
    for batch in batches:
        for row, h, n in hashed_words(batch.column(1)):
            ends = np.cumsum(n)
            ids.append(batch.column(0).slice(row, len(n)))
            hashes.append(np.insert(h, ends, END))
            counts.append(n + 1)
            tokens += len(h) + len(n)
            if tokens >= CHUNK_TOKENS:
                yield pa.chunked_array(ids).combine_chunks(), np.concatenate(hashes), np.concatenate(counts)
                ids, hashes, counts, tokens = [], [], [], 0
    if ids:
        yield pa.chunked_array(ids).combine_chunks(), np.concatenate(hashes), np.concatenate(counts)


def _inner(counts: np.ndarray, order: int) -> np.ndarray:
    """Row k: tokens with at least k tokens of the same text before them."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.array([place >= k for k in range(order)])


def _blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([_pack_counts(keys[cuts[s]:cuts[s + 1]], counts[cuts[s]:cuts[s + 1]]) for s in full], pa.binary())],
        ["shard", "block"])


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _ in _chunks(batches):
            words, counts = np.unique(hashes, return_counts=True)
            yield _blocks(_word_shard(words, shards), words, counts, shards)
    return run


def _count_ngrams(level: int, known: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(*known)
        for _, hashes, counts in _chunks(batches):
            inner = _inner(counts, level)
            found, ranks, _ = trie.nodes(trie.words(hashes)[0], inner, level - 1)
            parents, children, use = trie.keys(found, ranks, inner, level)
            if len(use):
                s, k, n, _ = trie.sorted_keys(parents, children, False)
                yield _blocks(s, k, n, trie.shards)
    return run


def _sum_blocks(blocks) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the blocks and their counts. Blocks are added up few at a time."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    waiting, size = [], 0

    def add():
        k = np.concatenate([keys, *[x[0] for x in waiting]])
        c = np.concatenate([counts, *[x[1].astype(np.int64) for x in waiting]])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
        return k[first], np.add.reduceat(c, first) if len(first) else c

    for block in blocks:
        waiting.append(_unpack_counts(block))
        size += len(waiting[-1][0])
        if size > len(keys) + 2_000_000:
            keys, counts = add()
            waiting, size = [], 0
    return add() if waiting else (keys, counts)


def _write_level(level: int, known: tuple, total: tuple[int, int], min_count: int, last: bool):
    """Writes the file of a shard; returns its number of nodes and the sum of its counts."""
    folder, shards, _ = known

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        keys, counts = _sum_blocks(rows["block"])
        if level == 1:
            write_sections(f"{folder}/1-{shard}", {"hash": keys, "count": counts})
            return pd.DataFrame({"shard": [shard], "nodes": [len(keys)], "total": [int(counts.sum())]})
        keys, counts = keys[counts >= min_count].astype(np.int64), counts[counts >= min_count]
        if len(keys):
            trie = _trie(*known)
            row, child = keys >> CHILD_BITS, keys & (1 << CHILD_BITS) - 1
            parents = row * shards + shard
            before, context = _lower(trie, level, parents, child, total)
            log = np.log10((counts + SMOOTHING * before) / (context + SMOOTHING))
            bits = int(child.max()).bit_length()
            sections = {"bits": np.array([bits]), **pack(row << bits | child, "child"), "log": _quantise(log)}
            if not last:
                sections["off"] = _quantise(np.log10(SMOOTHING / (counts + SMOOTHING)))
                sections["count"] = np.minimum(counts, 2**32 - 1).astype(np.uint32)
            write_sections(f"{folder}/{level}-{shard}", sections)
        return pd.DataFrame({"shard": [shard], "nodes": [len(keys)], "total": [int(counts.sum())]})

    return run


def _lower(trie: Trie, level: int, parents: np.ndarray, child: np.ndarray, total: tuple[int, int]):
    """Of n-grams: the probability of the last word in the context one word shorter, and the count of the context."""
    if level == 2:
        return _word_probability(trie.gather(1, "count", child), total), trie.gather(1, "count", parents)
    # the pair of the last two words is a child of the context's last word, at the rank that the n-gram has
    begin = np.flatnonzero(np.diff(parents, prepend=-1))
    last, back = np.unique(_last_words(trie, level - 1, parents[begin]), return_inverse=True)
    order = np.lexsort((last, last % trie.shards))
    first = np.empty(len(last), np.int64)
    first[order] = trie.first_child(2, last[order])
    first = np.repeat(first[back], np.diff(np.append(begin, len(parents))))
    if level == 3:
        return 10.0 ** (trie.gather(2, "log", first + child) / -QUANT), trie.gather(2, "count", parents)
    raise ValueError("levels above 3 are not built")


def _last_words(trie: Trie, level: int, nodes: np.ndarray) -> np.ndarray:
    """Last word of nodes of level 2 (ascending)."""
    out = np.empty(len(nodes), np.int64)
    order = np.argsort(nodes)
    nodes = nodes[order]
    cuts = np.searchsorted(nodes, trie.starts[level - 1])
    for shard in range(trie.shards):
        a, b = cuts[shard], cuts[shard + 1]
        if a < b:
            f = trie.file(level, shard)
            pair = EliasFano(f, "child").at(nodes[a:b] - trie.starts[level - 1][shard]).view(np.int64)
            out[order[a:b]] = pair & (1 << int(f["bits"][0])) - 1
    return out


def _word_probability(counts: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    tokens, words = total
    return (counts + UNSEEN) / (tokens + UNSEEN * (words + 1))


def build_trie(texts: DataFrame, folder: str, order: int = ORDER, min_counts: dict[int, int] | None = None) -> tuple[tuple, tuple[int, int]]:
    """Writes the levels for a table ``(id, text)``; returns what tasks need to open them, and (tokens, words)."""
    if not 1 <= order <= 3:
        raise ValueError("the order is 1, 2 or 3")
    os.makedirs(folder, exist_ok=True)
    rough = texts.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 5 + 1
    shards = int(max(1, -(-rough // SHARD_TOKENS)))
    known: tuple = (folder, shards, ())
    total = (0, 0)
    for level in range(1, order + 1):
        counted = texts.mapInArrow(_count_words(shards) if level == 1 else _count_ngrams(level, known), "shard int, block binary")
        write = _write_level(level, known, total, (min_counts or {}).get(level, 1), level == order)
        rows = counted.groupBy("shard").applyInPandas(write, "shard int, nodes long, total long").collect()  # one row a shard
        found = {r["shard"]: r for r in rows}
        sizes = tuple(found[s]["nodes"] if s in found else 0 for s in range(shards))
        if level == 1:
            total = (sum(r["total"] for r in rows), sum(sizes))
        known = (folder, shards, (*known[2], sizes))
    return known, total


def _score(known: tuple, total: tuple[int, int], order: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(*known)
        for ids, hashes, counts in _chunks(batches):
            inner = _inner(counts, order)
            words, seen = trie.words(hashes, True)
            del hashes
            base = np.log10(_word_probability(seen, total))
            names_of = {k: ("log",) if k == order else ("log", "off") for k in range(2, order + 1)}
            found, _, values = trie.nodes(words, inner, order, names_of)
            log = base
            for level in range(2, order + 1):
                # the shorter estimate times the weight that the context leaves to it, unless the n-gram is known
                context, node = np.concatenate(([-1], found[level - 1][:-1])), found[level]
                if level == 2:
                    off = np.log10(SMOOTHING / (np.concatenate(([0], seen[:-1])) + SMOOTHING))
                else:
                    off = np.concatenate(([0], values[level - 1]["off"][:-1])) / -QUANT
                log = np.where(inner[level - 1] & (context >= 0), log + off, log)
                log = np.where(node >= 0, values[level]["log"] / -QUANT, log)
            at = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts), pa.array(np.add.reduceat((seen > 0).astype(np.int64), at)),
                 pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(log, at))], names)
    return run


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, as a path that tasks can map into memory."""
    place = urlparse(scratch_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"the trie is mapped into memory: pass a folder that all executors mount, not {place.scheme}://")
    return f"{place.path}/trie-{uuid.uuid4().hex}"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0,
                    order: int = ORDER, min_counts: dict[int, int] | None = None, folder: str | None = None) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from the rows whose fold (crc32 of the id as text) is not ``held_out``. Tokens are the words, A-Z in
    lower case, and one end. ``base_score`` is the sum of log10 of the smoothed word frequencies, ``score``
    the log10 probability of the text in the n-gram model. Levels of the trie go to ``folder``, by default
    below spark.checkpoint.dir, and are removed when the scores are written.

    All n-grams are counted. ``min_counts`` can leave out those of a level that are seen fewer times; their share is not
    given to the others, so ``score`` is no probability then.

    Null text counts as empty: one token, the end. Null ids belong to the fold of the empty id; repeated rows count as
    often as they stand there and are scored alike. With no training rows all counts are 0. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    train = rows.filter(crc_fold("id", folds) != held_out)
    known, total = build_trie(train, folder, order, min_counts)
    names = ["id", "n_tokens", "n_known", "base_score", "score"]
    scored = materialise(rows.mapInArrow(_score(known, total, order, names), (
        f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")))
    shutil.rmtree(folder, ignore_errors=True)
    return scored.select(
        F.col("id").alias(id_col), (crc_fold("id", folds) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(total[0]).cast("bigint").alias("train_tokens"), "base_score", "score")
