"""Skew-safe building blocks: attach group results to rows, number rows inside groups.

Both split hot groups, so one key may hold a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.session import materialise

# At most this many groups are treated as hot, which bounds what is broadcast; a key that is not hot holds less than
# this share of all rows.
MAX_HOT_GROUPS = 20_000
# A group below this size is never hot.
MIN_HOT_ROWS = 20_000


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of ``rows`` with one row per key (``groups``), safe for hot keys.

    ``groups[size]`` is the number of rows of the key. A key counts as hot when it holds more
    than MIN_HOT_ROWS rows and more than 1/MAX_HOT_GROUPS of all rows, so there are fewer than
    MAX_HOT_GROUPS hot keys whatever the data size: only those are broadcast. ``groups`` is read
    three times; pass a written table where it is costly. Rows of hot keys are spread over all partitions of
    the shuffle join, which serves the other keys.
    """
    values = [c for c in groups.columns if c != key]
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).scalar()
    bound = F.greatest(F.lit(MIN_HOT_ROWS), total / F.lit(MAX_HOT_GROUPS))
    hot = groups.filter(F.col(size) > bound).select(
        F.col(key).alias("_hk"), F.struct(*values).alias("_hot"))
    cold = groups.select(F.col(key).alias("_ck"), F.struct(*values).alias("_cold"))
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        F.xxhash64(*[F.col(c) for c in rows.columns if _hashable(rows, c)]))
    marked = (rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
              .withColumn("_jk", F.when(F.col("_hot").isNull(), F.col(key)))
              .withColumn("_salt", spread))
    joined = marked.join(cold.withColumn("_cs", F.lit(0).cast("bigint")),
                         (F.col("_jk") == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
    picked = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[picked[v].alias(v) for v in values])


def _hashable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("string", "long", "integer", "double")


def number_rows(rows: DataFrame, group: list[str], rank: Column, idx: str, out: str,
                descending: bool = True, parts: int | None = None) -> DataFrame:
    """``row_number()`` over (partition by group order by rank, idx) without one task per group.

    All rows are sorted into ranges of (group, rank, idx), ``idx`` being unique: ranges are even, however many rows a
    group or a rank value has. Rows are numbered inside their range and group, and a prefix sum over
    the ranges of a group gives what lies before. Only groups that go on from the range before need it, one
    for each range at most, so that is what is broadcast. Rows without a group are a group; null ranks come
    last when descending, else first.
    """
    order = F.col("_rank").desc() if descending else F.col("_rank").asc()
    ranked = rows.withColumn("_rank", rank)
    by = [*group, order, idx]
    ranges = ranked.repartitionByRange(parts, *by) if parts else ranked.repartitionByRange(*by)
    # written, so that the ranges stay what they are when a lost task is run again
    placed = materialise(ranges.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_before > 0").select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), "_before")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order, idx))
    return placed.withColumn(out, local).join(F.broadcast(carried), same, "left").withColumn(
        out, (F.col(out) + F.coalesce("_before", F.lit(0))).cast("bigint")).select(*rows.columns, out)


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], spread: Column, counts: DataFrame | None = None,
                how: str = "inner") -> DataFrame:
    """Join on ``key`` (one or more columns), which may be hot on the left: its rows go to as many copies of the right
    rows as its number asks for.

    A key is hot above MIN_HOT_ROWS rows, or 1/MAX_HOT_GROUPS of all rows if that is more, and gets a copy of its right
    rows for every such number. So fewer than MAX_HOT_GROUPS keys (with a number each) are broadcast, and no key brings
    more left rows into one task. ``left`` is read twice, unless ``counts`` (key, m) is given; ``spread`` tells its rows apart.
    Null keys meet nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can copy the right rows")
    keys = [key] if isinstance(key, str) else key
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("m"), F.lit(0))).scalar()
    bound = F.greatest(F.lit(MIN_HOT_ROWS), total / F.lit(MAX_HOT_GROUPS))
    hot = F.broadcast(counts.filter(F.col("m") > bound).select(
        *[F.col(k).alias(f"_hk{i}") for i, k in enumerate(keys)], F.ceil(F.col("m") / bound).cast("int").alias("_copies")))
    mark = lambda df: df.join(hot, [F.col(k) == F.col(f"_hk{i}") for i, k in enumerate(keys)], "left")
    helpers = [*[f"_hk{i}" for i in range(len(keys))], "_copies"]
    salt = F.when(F.col("_copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_copies")).cast("int"))
    copies = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    many = mark(left).withColumn("_salt", salt).drop(*helpers)
    few = mark(right).withColumn("_salt", F.explode(copies)).drop(*helpers)
    return many.join(few, [*keys, "_salt"], how).drop("_salt")
