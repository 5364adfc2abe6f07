"""Join of documents whose word shingles have a Jaccard similarity above a threshold, with set relations.

Sets with equal elements form a class and are compared once. Each set posts its prefix, the first of its
elements in one order of all elements (very frequent ones last), to index lists. A list is cut into blocks by
position, size and id; a block that no set at hand can reach is skipped as a whole. Sets that meet a smaller
id in a list gather in that id's group, first as bits of parity, which show most of those that met by chance to differ too
much; only sets with a possible partner in the group are moved whole. There the answers of one set (its overlaps with all others) are
derived from those of a similar set: only the elements in which the two differ are looked up. Pairs that
met in a list, but neither in a group nor in one component, are compared by a join at the end (again first
by parities, then by their sets), so no link is lost, and members of a group of copies are never paired out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.hashed_words import hashed_words, mix
from stocklens.llm.worker_memory import released
from stocklens.operators.keyed import attach_groups
from stocklens.operators.near_duplicates import connected_groups
from stocklens.session import materialise, scratch_dir

SHINGLE, PERCENT = 4, 85
HOT_ELEMENTS = 1 << 17  # so many of the most frequent elements come last in the order; this bounds what is broadcast
HOT_LEAST = 16
BLOCK = 128  # entries of a block of an index list
GROUP = 512  # sets of a group that meet in one task
FILTER_BITS = 1 << 24
BUCKET_ELEMENTS = 1 << 22  # elements of a bucket of sets, about
MOST_BUCKETS = 50_000  # beyond them buckets grow
SKETCH = 32  # words of 64 parities, the least for a set

c = F.col


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of runs of texts: place of the first, the distinct shingles of each in ascending order, their numbers."""
    for row, hashes, counts in hashed_words(texts):
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        ahead = np.repeat(ends, counts) - np.arange(len(hashes))  # words from here to the end of the text
        begin = (ahead >= words) | (np.repeat(counts, counts) < words) & (ahead == np.repeat(counts, counts))
        size = np.minimum(np.repeat(counts, counts), words)
        out = mix(size.astype(np.uint64))
        for k in range(words):
            word = np.roll(hashes, -k) if k else hashes
            out = np.where(k < size, mix(out * np.uint64(0x2545F4914F6CDD1D) + word), out)
        out, owner = out[begin], owner[begin]
        order = np.lexsort((out, owner))
        out, owner = out[order], owner[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        yield row, out[new], np.bincount(owner[new], minlength=len(counts))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _arrays(x: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of the given lengths as an array each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), _signed(x))


def _profiles(words: int):
    """Rows (0, id, n, k1, k2, sketch) of documents; rows (1, null, count, element, null, null) of elements frequent in a task's
    part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "k1", "k2", "sketch"]
        for batch in batches:
            for row, elements, sizes in shingle_sets(batch.column(1), words):
                at = np.cumsum(sizes) - sizes
                full = sizes > 0
                keys = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
                if full.any():
                    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                        keys[k][full] = np.add.reduceat(mix(elements ^ np.uint64(salt)), at[full])
                ids = batch.column(0).slice(row, len(sizes))
                bits, lengths = parities(elements, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int8)), ids, pa.array(sizes), _signed(keys[0]),
                                                  _signed(keys[1]), _arrays(bits, lengths)], names)
                often, counts = np.unique(elements, return_counts=True)
                often, counts = often[counts > 1], counts[counts > 1]
                if len(often) > HOT_ELEMENTS:
                    top = np.lexsort((often, -counts))[:HOT_ELEMENTS]
                    often, counts = often[top], counts[top]
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(often), np.int8)), none, pa.array(counts), _signed(often), none,
                     pa.nulls(len(often), pa.list_(pa.int64()))], names)

    return run


def _prefixes(words: int, percent: int, hot: np.ndarray):
    """Rows (element, id, n, place, k1) of the prefixes of all sets. ``hot``: frequent elements by rank."""
    hot_order = np.argsort(hot, kind="stable")
    hot_sorted = hot[hot_order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, elements, sizes in shingle_sets(batch.column(1), words):
                if not len(elements):
                    continue
                owner = np.repeat(np.arange(len(sizes)), sizes)
                rank = np.zeros(len(elements), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot_sorted, elements), len(hot) - 1)
                    rank = np.where(hot_sorted[at] == elements, 1 + hot_order[at], 0)
                order = np.lexsort((elements, rank, owner))
                place = np.arange(len(elements)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                prefix = sizes - (percent * sizes + 99) // 100 + 1
                at = np.cumsum(sizes) - sizes
                full = sizes > 0
                key = np.zeros(len(sizes), np.uint64)
                key[full] = np.add.reduceat(mix(elements ^ np.uint64(0x9E3779B97F4A7C15)), at[full])
                keep = np.flatnonzero(place < prefix[owner])
                who = owner[keep]
                ids = batch.column(0).slice(row, len(sizes)).take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [_signed(elements[order][keep]), ids, pa.array(sizes[who]), pa.array(place[keep]), _signed(key[who])],
                    ["element", "id", "n", "place", "k1"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of the rows that agree in the first ``keys`` columns, which are sorted; runs may span batches."""
    rest: list[list] = []
    for batch in batches:
        columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if not len(columns[0]):
            continue
        if rest:
            columns = [np.concatenate((a, b)) for a, b in zip(rest, columns)]
        change = np.zeros(len(columns[0]) - 1, bool)
        for k in range(keys):
            change |= columns[k][1:] != columns[k][:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1))
        for a, b in zip(cuts, cuts[1:]):
            yield [x[a:b] for x in columns]
        rest = [x[cuts[-1]:] for x in columns]
    if rest:
        yield rest


class _List:
    """An index list in blocks; tells which entries can reach the similarity, judged by size and position."""

    def __init__(self, n: np.ndarray, place: np.ndarray, percent: int):
        self.n, self.rest, self.percent = n, n - place, percent
        starts = np.arange(0, len(n), BLOCK)
        self.low, self.high = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
        self.most = np.maximum.reduceat(self.rest, starts)
        self.blocks = len(starts)

    def span(self, block: int) -> slice:
        return slice(block * BLOCK, min((block + 1) * BLOCK, len(self.n)))

    def skips(self, a: int, b: int) -> bool:
        """Whether no entry of block a can be similar to one of block b."""
        p = self.percent
        if self.high[a] * 100 < p * self.low[b] or self.high[b] * 100 < p * self.low[a]:
            return True
        return min(self.most[a], self.most[b]) * (100 + p) < p * (self.low[a] + self.low[b])

    def reach(self, a: int, b: int) -> np.ndarray:
        """Entries of block a by entries of block b: the sizes and what stands behind the positions allow it."""
        p, x, y = self.percent, self.span(a), self.span(b)
        n1, n2 = self.n[x, None], self.n[None, y]
        rest = np.minimum(self.rest[x, None], self.rest[None, y])
        return (np.minimum(n1, n2) * 100 >= p * np.maximum(n1, n2)) & (rest * (100 + p) >= p * (n1 + n2))


def _leaders(percent: int):
    """Lists (element, id, n, place), ids ascending -> rows (id, leader): the smallest id that a set can reach in a list.
    A set that only larger ids reach there is its own leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], []]
        waiting = 0
        for _, ids, n, place in _runs(batches, 1):
            index = _List(n, place, percent)
            leader, reached = np.full(len(ids), -1), np.zeros(len(ids), bool)
            for a in range(index.blocks):
                x = index.span(a)
                for b in range(a + 1):
                    y = index.span(b)
                    if (leader[x] >= 0).all() and (reached[y] | (leader[y] >= 0)).all():
                        continue
                    if index.skips(a, b):
                        continue
                    fits = index.reach(a, b) & (ids[None, y] < ids[x, None])
                    hit = x.start + np.flatnonzero(fits.any(1) & (leader[x] < 0))
                    leader[hit] = y.start + fits[hit - x.start].argmax(1)
                    reached[y] |= fits.any(0)
            leader = np.where((leader < 0) & reached, np.arange(len(ids)), leader)
            found = leader >= 0
            if found.any():
                out[0].append(ids[found])
                out[1].append(ids[leader[found]])
                waiting += int(found.sum())
            if waiting > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["id", "leader"])
                out, waiting = [[], []], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["id", "leader"])

    return run


def _open_pairs(percent: int):
    """Lists (element, id, n, place, component, home, part) -> rows (a, b, n_a, n_b): sets that can reach each other
    and neither belong to one component nor met in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, waiting = ["a", "b", "n_a", "n_b"], [[] for _ in range(4)], 0
        for _, ids, n, place, component, home, part in _runs(batches, 1):
            if (component == component[0]).all():
                continue
            index = _List(n, place, percent)
            for a in range(index.blocks):
                for b in range(a + 1):
                    if index.skips(a, b):
                        continue
                    x, y = index.span(a), index.span(b)
                    col = lambda v: (v[x, None], v[None, y])
                    (i, j), (ci, cj), (hi, hj), (pi, pj) = col(ids), col(component), col(home), col(part)
                    met = (hi == hj) & (pi == pj) | (hi == j) | (hj == i)
                    rows, cols = np.nonzero(index.reach(a, b) & (j < i) & (ci != cj) & ~met)
                    if len(rows):
                        for k, v in enumerate((ids[y][cols], ids[x][rows], n[y][cols], n[x][rows])):
                            out[k].append(v)
                        waiting += len(rows)
                if waiting > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names)
                    out, waiting = [[] for _ in range(4)], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names)

    return run


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set its numbers of common elements with all sets of the group.

    The first set's answers come from the index. Those of another set come from the answers of the first or of the
    set before it, whichever is closer, by taking off what the elements that it lacks contribute and adding
    what its own contribute; a set far from both is looked up anew.
    """
    sizes = np.array([len(s) for s in sets])
    elements, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    lists, ends = owner[order], np.cumsum(np.bincount(code, minlength=len(elements)))
    starts = np.concatenate(([0], ends[:-1]))
    bounds = np.concatenate(([0], np.cumsum(sizes)))

    def look(codes: np.ndarray) -> np.ndarray:
        length = ends[codes] - starts[codes]
        if not length.sum():
            return np.zeros(len(sets), np.int64)
        top = np.cumsum(length)
        places = np.arange(top[-1]) + np.repeat(starts[codes] - top + length, length)
        return np.bincount(lists[places], minlength=len(sets))

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(len(sets)):
        mine = code[bounds[i]:bounds[i + 1]]
        best = max((k for k in known if 2 * known[k][1][i] > sizes[i]), key=lambda k: known[k][1][i], default=None)
        if best is None:
            answer = look(mine)
        else:
            theirs, answer = known[best]
            answer = answer - look(np.setdiff1d(theirs, mine, assume_unique=True)) + look(
                np.setdiff1d(mine, theirs, assume_unique=True))
        known = {k: known[k] for k in known if k == 0} | {i: (mine, answer)}
        yield i, answer


def _link_groups(percent: int):
    """Groups (home, part, id, set) -> rows (a, b): enough links to connect all sets of a group that are connected in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, sets in _runs(batches, 2):
            if len(ids) < 2:
                continue
            sizes = np.array([len(s) for s in sets])
            label = np.arange(len(ids))
            a, b = [], []
            for i, common in overlaps([np.sort(s) for s in sets]):
                linked = common * (100 + percent) >= percent * (sizes + sizes[i])
                linked[i] = False
                for other in np.unique(label[linked]):
                    if other != label[i]:
                        j = int(np.flatnonzero(linked & (label == other))[0])
                        a.append(ids[i])
                        b.append(ids[j])
                        label[label == other] = label[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _filter_bytes(ids: DataFrame) -> np.ndarray:
    """A bit field of FILTER_BITS bits that has the bits of all ids set; its size does not depend on their number."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    found = words.toPandas()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def parities(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set words whose bits tell whether the number of its elements with a remainder is odd; how many words.

    Two sets differ in at least as many elements as their parities do in bits. There are two to four bits an element, at least
    SKETCH words, and always a power of two of them, so that the longer of two can be folded to the other's length.
    """
    lengths = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 32)).astype(np.int64).clip(0))
    first = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint64)
    word = (elements >> np.uint64(6)).astype(np.int64) & np.repeat(lengths - 1, sizes)
    np.bitwise_xor.at(out, np.repeat(first, sizes) + word, np.uint64(1) << (elements & np.uint64(63)))
    return out, lengths


def bits_apart(x: Column, y: Column) -> Column:
    """Bits in which the parities of two sets differ, the longer ones folded to the length of the others."""
    def folded(long: Column, length: Column) -> Column:
        every = lambda i: F.aggregate(F.sequence(i, F.size(long) - 1, length), F.lit(0).cast("bigint"),
                                      lambda bits, j: bits.bitwiseXOR(F.get(long, j)))
        return F.when(F.size(long) > length, F.transform(F.sequence(F.lit(0), length - 1), every)).otherwise(long)

    length = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(folded(x, length), folded(y, length), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0),
                       lambda n, m: n + m)


def _possible(percent: int):
    """Groups (home, part, id, n, sketch) -> rows (home, part, id): sets whose size and parities allow a link with another
    one of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, part, ids, n, sketches in _runs(batches, 2):
            lengths = np.array([len(x) for x in sketches])
            hit = np.zeros(len(ids), bool)
            for length in np.unique(lengths):
                long = np.flatnonzero(lengths >= length)
                folded = np.array([np.bitwise_xor.reduce(sketches[i].reshape(-1, length), axis=0) for i in long]).view(np.uint64)
                for k in np.flatnonzero(lengths[long] == length):
                    sizes, mine = n[long], n[long[k]]
                    fits = np.minimum(sizes, mine) * 100 >= percent * np.maximum(sizes, mine)
                    fits[k] = False
                    other = np.flatnonzero(fits)
                    apart = np.bitwise_count(folded[other] ^ folded[k]).sum(1, dtype=np.int64)
                    other = other[apart * (100 + percent) <= (100 - percent) * (sizes[other] + mine)]
                    if len(other):
                        hit[long[other]] = hit[long[k]] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (home, part, ids)], ["home", "part", "id"])

    return run


def _in_field(field: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose bit, the last column, is set in the field, without that column."""
    bit = batch.column(batch.num_columns - 1).to_numpy()
    keep = pa.array(np.flatnonzero(field[bit >> 6] >> (bit & 63) & 1))
    return pa.RecordBatch.from_arrays([x.take(keep) for x in batch.columns[:-1]], batch.schema.names[:-1])


def _only(field: np.ndarray):
    """Rows whose bit of the field is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _in_field(field, batch)

    return run


def _sets_of(words: int, field: np.ndarray):
    """Rows (id, set) of documents whose bit of the field is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _in_field(field, batch)
            for row, elements, sizes in shingle_sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sizes)), _arrays(elements, sizes)], ["id", "set"])

    return run


@contextmanager
def _in_buckets(sketches: DataFrame, buckets: int) -> Iterator[DataFrame]:
    """``sketches`` written in buckets of their ids: joins by id move the other side only. The table's name goes at the end."""
    spark, name = sketches.sparkSession, f"sketches_{uuid.uuid4().hex}"
    sketches.repartition(buckets, "id").write.format("parquet").bucketBy(buckets, "id").option(
        "path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def _in_lists(df: DataFrame, *order: str) -> DataFrame:
    """Rows of an index list side by side in one partition."""
    return df.repartition("element").sortWithinPartitions("element", *order)


def _posted(texts: DataFrame, profiles: DataFrame, words: int, percent: int) -> DataFrame:
    """Entries of the index lists that hold more than one class: element, id (smallest of its class), n, place."""
    frequent = profiles.filter("kind = 1").groupBy(c("k1").alias("element")).agg(F.sum("n").alias("times")).filter(
        c("times") >= HOT_LEAST).orderBy(c("times").desc(), "element").limit(HOT_ELEMENTS).collect()
    hot = np.array([r["element"] for r in reversed(frequent)], np.int64).view(np.uint64)
    entries = texts.mapInArrow(released(_prefixes(words, percent, hot)), "element long, id long, n long, place long, k1 long")
    # copies in a list count once; the shuffle is by element, so neither step below needs another
    classes = entries.repartition("element").groupBy("element", "k1", "n", "place").agg(F.min("id").alias("id"))
    of_list = Window.partitionBy("element")
    return classes.withColumn("entries", F.count(F.lit(1)).over(of_list)).filter("entries > 1").select(
        "element", "id", "n", "place")


def _groups(leaders: DataFrame) -> DataFrame:
    """(id, home, part): the group of each set that met another in a list. Large groups are cut into parts by hash."""
    homes = materialise(leaders.groupBy("id").agg(F.min("leader").alias("home")))
    sizes = materialise(homes.groupBy("home").agg(F.count(F.lit(1)).alias("members")))
    parts = F.ceil(c("members") / float(GROUP)).cast("bigint")
    return attach_groups(homes, sizes, "home", "members").select(
        "id", "home", F.pmod(F.xxhash64("id", F.lit(7)), parts).alias("part"), parts.alias("parts"))


def similar_components(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` per row: the smallest id reachable by links of similar documents.

    A document's set holds its distinct shingles of ``words`` words (A-Z in lower case); a shorter text is one
    shingle. Two documents are linked when 100 * common >= percent * union. Texts without words and null
    texts have an empty set and are linked with nothing.

    Ids are whole numbers. A row without id is linked with nothing and has no component. Rows with equal ids are one
    document: whatever is linked with one of them is linked with all. Repeated rows come out repeated. An
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(c(id_col).cast("bigint").alias("id"), c(text_col).cast("string").alias("text"))
    profiles = materialise(rows.mapInArrow(released(_profiles(words)), "kind tinyint, id long, n long, k1 long, k2 long, sketch array<long>"))
    own = profiles.filter("kind = 0")
    classes = materialise(own.filter("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size")))
    named = rows.filter(c("id").isNotNull())
    lists = materialise(_posted(named, profiles, words, percent))
    leaders = materialise(_in_lists(lists, "id").mapInArrow(released(_leaders(percent)), "id long, leader long"))
    groups = materialise(_groups(leaders))
    met = own.select("id", "n").join(groups.select("id").distinct(), "id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = min(max(-(-met // BUCKET_ELEMENTS), 1), MOST_BUCKETS)
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")

    def sets_of(ids: DataFrame) -> DataFrame:
        # the few others that the filter lets through find no partner below
        return named.select("id", "text", bit).mapInArrow(released(_sets_of(words, _filter_bytes(ids))), "id long, set array<long>")

    marked = own.filter("n > 0 and id is not null").select("id", "n", "sketch", bit).mapInArrow(
        released(_only(_filter_bytes(groups.select("id")))), "id long, n long, sketch array<long>")
    with _in_buckets(marked, buckets) as sketches:
        meet = groups.select("id", "home", "part").unionByName(groups.select("home", "parts").distinct().select(
            c("home").alias("id"), "home", F.explode(F.sequence(F.lit(0).cast("bigint"), c("parts") - 1)).alias("part"))).distinct()
        possible = materialise(sketches.join(meet, "id").select("home", "part", "id", "n", "sketch").repartition(
            "home", "part").sortWithinPartitions("home", "part", "id").mapInArrow(
            released(_possible(percent)), "home long, part long, id long").distinct())
        near = sets_of(possible.select("id")).join(possible, "id").select("home", "part", "id", "set").repartition(
            "home", "part").sortWithinPartitions("home", "part", "id").mapInArrow(
            released(_link_groups(percent)), "a long, b long")
        edges = materialise(near.unionByName(_same_ids(own, classes)))
        found = materialise(_components(edges))
        entries = lists.join(groups.select("id", "home", "part"), "id").join(found, "id", "left").select(
            "element", "id", "n", "place", F.coalesce("component", "id").alias("component"), "home", "part")
        # by a, as the buckets are: neither taking repeats out nor the join behind it moves the pairs again
        pairs = _in_lists(entries, "n", "id").mapInArrow(
            released(_open_pairs(percent)), "a long, b long, n_a long, n_b long").repartition(buckets, "a").distinct()
        # pairs whose parities differ too much can not be linked: sets are moved for the rest alone
        of = lambda x: sketches.select(c("id").alias(x), c("sketch").alias(f"sketch_{x}"))
        close = materialise(pairs.join(of("a"), "a").join(of("b"), "b").filter(
            bits_apart(c("sketch_a"), c("sketch_b")) * (100 + percent) <= (100 - percent) * (c("n_a") + c("n_b"))).select(
            "a", "b").distinct())
    sets = sets_of(close.select(c("a").alias("id")).unionByName(close.select(c("b").alias("id"))))
    common = F.size(F.array_intersect("set_a", "set_b"))
    late = materialise(close.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").filter(
        common * (100 + percent) >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b").distinct())
    if not late.isEmpty():
        found = materialise(_components(edges.unionByName(late)))
    return _result(own, classes, found, id_col)


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, all columns as they were.

    Rows without id and rows without words are linked with nothing and stay. See ``similar_components``.
    """
    found = similar_components(docs, words, percent, id_col, text_col)
    gone = materialise(found.filter(c(id_col) != c("component_id")).select(c(id_col).cast("bigint").alias("_gone")).distinct())
    names = [f"_c{i}" for i in range(len(docs.columns))]
    mine = c(names[docs.columns.index(id_col)]).cast("bigint")
    return docs.toDF(*names).join(gone, mine == c("_gone"), "left_anti").toDF(*docs.columns)


def _same_ids(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes that rows with one id belong to (a, b)."""
    full = own.filter("n > 0 and id is not null").select("id", "n", "k1", "k2").distinct()
    often = full.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("id")
    return full.join(often, "id").join(classes, ["n", "k1", "k2"]).select(
        c("id").alias("a"), c("first_id").alias("b")).filter("a <> b")


def _components(edges: DataFrame) -> DataFrame:
    """(id, component) of all sets with a link: component is the smallest id."""
    return connected_groups(edges).select(c("node").alias("id"), "component")


def _result(own: DataFrame, classes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Components of classes brought to all documents."""
    key = F.struct("n", "k1", "k2")
    of_class = classes.join(found.withColumnRenamed("id", "first_id"), "first_id", "left").select(
        key.alias("key"), F.coalesce("component", "first_id").alias("component"), "size")
    has = (c("n") > 0) & c("id").isNotNull()
    placed = attach_groups(own.filter(has).select("id", "n", key.alias("key")), materialise(of_class), "key", "size").select(
        "id", "n", "component")
    alone = own.filter(~has | has.isNull()).select("id", "n", c("id").alias("component"))
    return placed.unionByName(alone).select(c("id").alias(id_col), c("n").alias("n_shingles"), c("component").alias("component_id"))
