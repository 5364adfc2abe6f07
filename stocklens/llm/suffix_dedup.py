"""Removal of repeated byte strings with suffix arrays.

Every string of ``window`` bytes holds an anchor: the short gram with the smallest hash in it (of equal ones the
last). Equal strings have the same anchor at the same place, so all places that could be equal meet in the
group of an anchor. Neighbouring strings with one anchor form a segment. Segments that are equal as a whole
need no more work. The different segments of a group go into a suffix array, built by two-stage sorting, and
strings whose neighbours in it share ``window`` bytes are repeated. Anchors with very many different segments are
resolved by hashes of the single strings instead, so no task holds a group of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.hashed_words import mix
from stocklens.operators.keyed import attach_groups
from stocklens.session import materialise

WINDOW = 400
SORT_BYTES = 256 * 1024  # text of one suffix array, about
GROUP_SEGMENTS = 2000  # different segments of an anchor that are sorted together
LIST_STRINGS = 1 << 16  # repeated strings of an anchor that go to its segments at once, about
FILTER_BITS = 1 << 24

_P = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}

c = F.col


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_TABLES.get("up", ())) < n:
        size = max(n, 2 * len(_TABLES.get("up", ())), 1 << 14)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps, dtype=np.uint64)
    return _TABLES["up"], _TABLES["down"]


def gram_of(window: int) -> int:
    return max(1, min(64, window // 3))


def segments(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each segment, the place of its anchor, and the anchor's hash."""
    gram = gram_of(window)
    if len(data) < window:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])
    span = window - gram + 1
    # smallest hash, of equal ones the last: running minima from both ends of blocks as long as a string
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    starts = len(hashes) - span + 1
    blocks = np.full(-(-len(keys) // span) * span, np.uint64(2**64 - 1))
    blocks[:len(keys)] = keys
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:starts], ahead[span - 1:span - 1 + starts])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], starts) - 1
    anchor = (np.uint64(0xFFFFFFFF) - (least[first] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return first, last, anchor, hashes[anchor]


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _texts(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    for x in column.cast(pa.large_binary()):
        data = x.as_buffer().to_pybytes() if x.is_valid else b""
        yield data, np.frombuffer(data, np.uint8)


def _find_segments(window: int):
    """Rows (anchor, segment, doc, start, size) of all texts. ``segment`` names the bytes and the anchor's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for data, signs in _texts(batch.column(0)):
                first, last, place, hashes = segments(signs, window)
                if not len(first):
                    continue
                doc, ends = _digest(data), last + window
                out[0].append(hashes.view(np.int64))
                out[1].extend(_digest(data[a:b] + (p - a).to_bytes(4, "little")) for a, b, p in zip(
                    first.tolist(), ends.tolist(), place.tolist()))
                out[2].extend([doc] * len(first))
                out[3].append(first)
                out[4].append(ends - first)
            if out[0]:
                join = lambda k: pa.array(np.concatenate(out[k]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [join(0), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), join(3), join(4)],
                    ["anchor", "segment", "doc", "start", "size"])

    return run


def _segment_texts(window: int, field: np.ndarray):
    """Rows (anchor, segment, bytes) of the segments whose anchor has its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for data, signs in _texts(batch.column(0)):
                first, last, place, hashes = segments(signs, window)
                bit = (mix(hashes) % np.uint64(FILTER_BITS)).astype(np.int64)
                for k in np.flatnonzero(field[bit >> 6] >> (bit & 63) & 1) if len(first) else ():
                    a, b = int(first[k]), int(last[k]) + window
                    out[0].append(int(hashes[k].view(np.int64)))
                    out[1].append(_digest(data[a:b] + (int(place[k]) - a).to_bytes(4, "little")))
                    out[2].append(data[a:b])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                    ["anchor", "segment", "bytes"])

    return run


def suffix_array(text: bytes, depth: int) -> list[int]:
    """Places of the suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    A suffix is small if it is smaller than the suffix after it. The small ones are sorted directly. In the bucket of
    a first byte all others stand before the small ones; a scan from left to right finds their order, because a
    suffix that is not small comes after its successor.
    """
    n = len(text)
    if not n:
        return []
    signs = np.frombuffer(text, np.uint8).astype(np.int16)
    step = np.sign(np.diff(signs, append=-1))  # the end is smaller than all bytes
    nearest = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # next place where the byte changes
    small = step[nearest] > 0
    direct = sorted(np.flatnonzero(small).tolist(), key=lambda i: text[i:i + depth])
    sizes = np.bincount(signs, minlength=256)
    tails = np.cumsum(sizes)
    heads = (tails - sizes).tolist()
    order = np.full(n, -1, np.int64)
    of_byte = signs[direct] if direct else np.empty(0, np.int16)
    small_sizes = np.bincount(of_byte, minlength=256)
    for byte in np.flatnonzero(small_sizes):  # the sorted list has the bytes in order
        end = int(small_sizes[:byte + 1].sum())
        order[tails[byte] - small_sizes[byte]:tails[byte]] = direct[end - small_sizes[byte]:end]
    out, late = order.tolist(), (~small).tolist()
    byte = text[n - 1]
    out[heads[byte]] = n - 1
    heads[byte] += 1
    for place in out:
        before = place - 1
        if before >= 0 and late[before]:
            byte = text[before]
            out[heads[byte]] = before
            heads[byte] += 1
    return out


def repeated_starts(parts: list[bytes], window: int) -> list[np.ndarray]:
    """Of each part the starts of strings of ``window`` bytes that stand somewhere else in the parts as well."""
    text = b"\xff".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    room = np.repeat(ends, np.diff(np.append(begins, len(text)))) - np.arange(len(text)) >= window if text else np.empty(0, bool)
    hit = np.zeros(len(text) + 1, bool)
    before, last = b"", -1
    for place in suffix_array(text, window):
        if not room[place]:
            continue
        here = text[place:place + window]
        if here == before:
            hit[place] = hit[last] = True
        before, last = here, place
    return [np.flatnonzero(hit[a:b]) for a, b in zip(begins, ends)]


def _ranges(starts: np.ndarray, window: int) -> list[dict]:
    """Byte ranges that strings with these ascending starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    firsts, lasts = starts[np.concatenate(([0], cut))], starts[np.append(cut - 1, len(starts) - 1)]
    return [{"a": int(a), "b": int(b) + window} for a, b in zip(firsts, lasts)]


def _sort_groups(window: int):
    """Different segments (anchor, segment, bytes), anchors side by side -> (anchor, segment, ranges)."""

    def flush(keys, parts) -> pa.RecordBatch:
        ranges = [_ranges(s, window) for s in repeated_starts(parts, window)]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array(ranges, kind)],
            ["anchor", "segment", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, size = [], [], 0
        for batch in batches:
            for anchor, segment, data in zip(*(x.to_pylist() for x in batch.columns)):
                if size > SORT_BYTES and keys[-1][0] != anchor:
                    yield flush(keys, parts)
                    keys, parts, size = [], [], 0
                keys.append((anchor, segment))
                parts.append(data)
                size += len(data)
        if keys:
            yield flush(keys, parts)

    return run


def _string_hashes(window: int):
    """Segments of crowded anchors -> a row (anchor, string) for each string in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, _, data in zip(*(x.to_pylist() for x in batch.columns)):
                n = len(data) - window + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([_digest(data[k:k + window]) for k in range(n)], pa.binary())],
                    ["anchor", "string"])

    return run


def _known_strings(window: int):
    """Segments of crowded anchors with a list of repeated strings -> (anchor, segment, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            ranges = []
            for data, strings in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                known = set(strings)
                starts = [k for k in range(len(data) - window + 1) if _digest(data[k:k + window]) in known]
                ranges.append(_ranges(np.array(starts, np.int64), window))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranges, kind)], ["anchor", "segment", "ranges"])

    return run


def _anchor_filter(anchors: DataFrame) -> np.ndarray:
    """A bit field with the bits of all anchors set; its size does not depend on their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits).astype(np.int64))], ["bit"])

    words = anchors.mapInArrow(run, "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _crowded_ranges(crowded: DataFrame, window: int, marks_kind: str) -> DataFrame:
    """(anchor, segment, ranges) by counting equal strings. Counts are added up in each task before the shuffle; what goes
    back to the segments is the list of repeated strings of their anchor, in parts of bounded length, so a segment stays a row."""
    often = materialise(crowded.mapInArrow(_string_hashes(window), "anchor long, string binary").groupBy("anchor", "string").agg(
        F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor", "string"))
    parts = often.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / float(LIST_STRINGS)).alias("parts"))
    lists = often.join(parts, "anchor").groupBy("anchor", F.pmod(F.xxhash64("string"), c("parts")).alias("part")).agg(
        F.collect_list("string").alias("strings"))
    return crowded.join(lists.select("anchor", "strings"), "anchor").mapInArrow(_known_strings(window), marks_kind).filter(F.size("ranges") > 0)


def _keep(window: int):
    """Rows (id, text, ranges) -> (id, n_bytes, spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for (data, _), ranges in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                merged: list[list[int]] = []
                for r in sorted(ranges or [], key=lambda r: r["a"]):
                    if merged and r["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["b"])
                    else:
                        merged.append([r["a"], r["b"]])
                edges = [0, *(x for m in merged for x in m), len(data)]
                sizes.append(len(data))
                spans.append([{"a": a, "b": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, spans, kept`` per row: removed byte ranges ``array<struct<a, b>>`` and the bytes that are left.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else, in the same text or another.
    Strings never cross texts and are judged on the input. ``kept`` is binary, as a cut may part a character.

    Null text counts as empty; a text shorter than ``window`` stays. Rows are known by their text, not their id: null
    and repeated ids do no harm, and rows that repeat a text lose all of it if it has ``window`` bytes. An empty table
    gives an empty result; other columns are not read. Work on a text is in proportion to its length.
    """
    rows = docs.select(c(id_col).alias("id"), F.coalesce(c(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = materialise(rows.select("text").mapInArrow(
        _find_segments(window), "anchor long, segment binary, doc binary, start long, size long"))
    # counts and smallest and largest segment of an anchor are combined before the shuffle
    anchors = materialise(found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("places"), (F.min("segment") != F.max("segment")).alias("mixed")).filter("places > 1"))
    mixed = anchors.filter("mixed").select("anchor")
    marks_kind = "anchor long, segment binary, ranges array<struct<a:long,b:long>>"
    texts = rows.select("text").mapInArrow(_segment_texts(window, _anchor_filter(mixed)), "anchor long, segment binary, bytes binary")
    different = materialise(texts.groupBy("anchor", "segment").agg(F.min("bytes").alias("bytes")).join(mixed, "anchor"))
    crowd = materialise(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > GROUP_SEGMENTS))
    some = not crowd.isEmpty()
    alone = different.join(crowd, "anchor", "left_anti") if some else different
    marks = alone.repartition("anchor").sortWithinPartitions("anchor", "segment").select("anchor", "segment", "bytes").mapInArrow(
        _sort_groups(window), marks_kind).filter(F.size("ranges") > 0)
    if some:
        crowded = different.join(crowd.select("anchor"), "anchor").select("anchor", "segment", "bytes")
        marks = marks.unionByName(_crowded_ranges(crowded, window, marks_kind))
    whole = found.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("times"), F.max("size").alias("size")).filter(
        "times > 1").select("anchor", "segment", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), c("size").alias("b"))).alias("ranges"))
    marked = found.join(marks.unionByName(whole), ["anchor", "segment"]).select(
        "doc", F.explode(F.transform("ranges", lambda r: F.struct((r["a"] + c("start")).alias("a"), (r["b"] + c("start")).alias("b")))).alias("r"))
    # ranges of one text: neighbours are merged, copies of the text count once
    by_doc = Window.partitionBy("doc").orderBy("r.a", "r.b")
    reach = F.max("r.b").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach >= c("r.a"), 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.distinct().withColumn("island", island).groupBy("doc", "island").agg(
        F.struct(F.min("r.a").alias("a"), F.max("r.b").alias("b")).alias("r"))
    of_doc = merged.groupBy("doc").agg(F.collect_list("r").alias("ranges"))  # no more than the text has strings
    copies = found.filter("start = 0").groupBy("doc").agg(F.count(F.lit(1)).alias("rows"))
    of_doc = materialise(of_doc.join(copies, "doc"))
    keyed = rows.mapInArrow(_with_key, f"id {kind}, text binary, doc binary")
    joined = attach_groups(keyed, of_doc, "doc", "rows").select("id", "text", "ranges")
    return joined.mapInArrow(_keep(window), f"id {kind}, n_bytes long, spans array<struct<a:long,b:long>>, kept binary").withColumnRenamed("id", id_col)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_digest(data) for data, _ in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["id", "text", "doc"])
