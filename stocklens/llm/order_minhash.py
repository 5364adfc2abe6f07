"""Order MinHash fingerprints: sensitive to edit distance, because selected k-mers keep their order.

Each k-mer is numbered by its occurrence in the text, so repeats count. A hash deals the numbered k-mers
into buckets; from each bucket the smallest few are selected, put back into text order, and hashed as a
tuple. Two texts agree in a bucket when they share the selected k-mers and their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.text import whole

K = 3  # units in a k-mer
BUCKETS = 64
PICK = 2  # k-mers selected from a bucket
# Scripts that put no blanks between words: Thai to Tibetan, Burmese, Khmer, ideographs with kana and their like.
UNSPACED = r"\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{A4CF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}"
# The same units in every text: a character of such a script, or a word, of which 24 code points are one unit at most.
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,24}}"
# Rows between two borders of ids, about.
BLOCK_ROWS = 2000

_LOW = 0xFFFFFFFF
_FEATURE = (1 << 26) - 1


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def with_signature(df: DataFrame, text: str, out: str, k: int = K, pick: int = PICK) -> DataFrame:
    """``df`` with the signature of a text column (no nulls in it): array of bucket << 32 | hash.

    The empty text has an empty signature; a text of fewer than ``k`` units is one k-mer, and so is one of
    blanks alone, taken as a whole. Buckets without k-mers are left out.
    """
    keep = df.columns
    units = F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0))
    blank = F.when(F.char_length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    d = df.select(*keep, F.transform(units, lambda u: F.xxhash64(u)).alias("_w"), blank.alias("_blank"))
    d = d.select(*keep, F.when(F.size("_w") > 0, F.col("_w")).otherwise(F.col("_blank")).alias("_u"))
    kmer = lambda i: F.xxhash64(*[F.get("_u", i + j) for j in range(k)])
    kmers = F.when(F.size("_u") == 0, F.array().cast("array<bigint>")).when(
        F.size("_u") < k, F.array(F.xxhash64("_u"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_u") - k), kmer))
    # hash in the high half, place in the low half: sorting brings the occurrences of a k-mer together
    packed = F.transform(kmers, lambda h, i: F.shiftleft(_high(h), 32).bitwiseOR(i.cast("bigint")))
    d = d.select(*keep, F.sort_array(packed).alias("_p"))
    steps = F.array(*[F.lit(1 << s) for s in range(30, -1, -1)])

    def numbered(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(_high(F.get("_p", j)) == _high(x), F.lit(False))
        # equal hashes stand together, so their number before this one is found by halving steps
        before = F.aggregate(steps, F.lit(0), lambda m, s: F.when((i - m >= s) & same(i - m - s), m + s).otherwise(m))
        feature = F.xxhash64(_high(x), F.when(same(i - 1), before).otherwise(F.lit(0)))
        bucket = F.pmod(feature, F.lit(BUCKETS).cast("bigint"))
        short = F.shiftright(feature, 8).bitwiseAND(F.lit(_FEATURE).cast("bigint"))
        return F.shiftleft(bucket, 58).bitwiseOR(F.shiftleft(short, 32)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))

    d = d.select(*keep, F.sort_array(F.transform("_p", numbered)).alias("_n"))
    bucket = lambda x: F.shiftrightunsigned(x, 58)
    first = lambda a, x, i, n: F.coalesce(bucket(F.get(a, i - n)) != bucket(x), F.lit(True))
    d = d.select(*keep, F.filter("_n", lambda x, i: first("_n", x, i, pick)).alias("_s"))

    def tuple_hash(x: Column, i: Column) -> Column:
        group = F.filter(F.slice("_s", i + 1, F.lit(pick)), lambda y: bucket(y) == bucket(x))
        by_place = F.sort_array(F.transform(group, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_LOW)), 26).bitwiseOR(
            _high(y).bitwiseAND(F.lit(_FEATURE).cast("bigint")))))
        value = F.xxhash64(F.transform(by_place, lambda z: z.bitwiseAND(F.lit(_FEATURE).cast("bigint"))))
        return F.when(first("_s", x, i, 1), F.shiftleft(bucket(x), 32).bitwiseOR(F.shiftrightunsigned(value, 32)))

    signature = F.filter(F.transform("_s", tuple_hash), lambda v: v.isNotNull())
    return d.select(*keep, signature.alias(out))


def fingerprint(signature: str | Column) -> Column:
    """Signature as text: ten hex digits a bucket."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the buckets used by either text in which both agree; 1 for two empty texts."""
    buckets = F.size(F.array_union(F.transform(a, _high), F.transform(b, _high)))
    return F.when(buckets == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / buckets)


def _blocks(docs: DataFrame, id_col: str, block_rows: int) -> Column:
    """Block number of a row: blocks follow each other as the ids do and hold few rows each.

    64 quantiles of the ids are found first; between two of them ids are dealt evenly.
    """
    parts = 64
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("high"),
                   F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()
    if row["low"] is None:
        return F.lit(-1).cast("bigint")
    sub = max(1, -(-row["n"] // (parts * block_rows)))
    borders = sorted({row["low"], *row["q"]}) + [row["high"] + 1]
    i = F.col(id_col)
    places = [F.when((i >= a) & (i < b), F.floor((i - a).cast("double") / float(b - a) * sub).cast("bigint") + k * sub)
              for k, (a, b) in enumerate(zip(borders, borders[1:]))]
    return F.coalesce(*places, F.lit(-1).cast("bigint"))  # rows without id stand first


def with_next(docs: DataFrame, id_col: str, values: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with columns ``_next_<value>`` of the next row by id; after the last comes the first.

    The first of ``values`` holds no nulls. Rows move once, into blocks of ids; a block's last row finds the first row
    of the next block. All branches read one exchange, so the windows run over plain columns.
    """
    blocks = docs.withColumn("_block", _blocks(docs, id_col, block_rows))
    order = Window.partitionBy("_block").orderBy(F.col(id_col).asc_nulls_first(), *[F.col(v) for v in values])
    next_ = [f"_next_{v}" for v in values]
    ranked = blocks.select(*docs.columns, "_block", *[F.lead(v).over(order).alias(n) for v, n in zip(values, next_)],
                           F.lag(F.lit(1)).over(order).isNull().alias("_is_first"))
    inner = ranked.filter(F.col(next_[0]).isNotNull()).select(*docs.columns, *next_)
    lasts = ranked.filter(F.col(next_[0]).isNull()).select(*docs.columns, "_block")
    by_block = Window.orderBy("_block")  # one row per block
    following = lasts.select("_block").select("_block", F.coalesce(
        F.lead("_block").over(by_block), F.first("_block").over(by_block)).alias("_then"))
    firsts = ranked.filter("_is_first").select(F.col("_block").alias("_then"), *[F.col(v).alias(n) for v, n in zip(values, next_)])
    ends = lasts.join(following, "_block").join(firsts, "_then")
    return inner.unionByName(ends.select(*docs.columns, *next_))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fingerprints of texts and of their edited texts, with two measures of likeness.

    The edited text has its last half (rounded down, in code points) replaced by the first as many code
    points of the next document by id, or all it has; after the last document comes the first. Returns
    ``id_col, n_chars, edited, signature, edited_signature, near_edited, near_next``.

    Null text counts as empty. Integer ids; rows without id stand before all others, rows with equal ids
    are ordered by text, so repeated rows follow each other. A single document is followed by itself. An
    empty table gives an empty result, other columns are not read. Built-in functions only.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    placed = with_next(with_signature(rows, "_text", "_sig"), "_id", ["_text", "_sig"], block_rows)
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("_text"), n - half), F.left(F.col("_next__text"), half))
    d = placed.select("_id", n.cast("bigint").alias("n_chars"), "_sig", F.col("_next__sig").alias("_next_sig"),
                      edited.alias("_edited"))
    d = with_signature(d, "_edited", "_edited_sig")
    return d.select(
        F.col("_id").alias(id_col), "n_chars", F.col("_edited").alias("edited"), F.col("_sig").alias("signature"),
        F.col("_edited_sig").alias("edited_signature"),
        likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_next_sig")).alias("near_next"))
