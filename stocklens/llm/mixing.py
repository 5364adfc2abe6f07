"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight, which sets how many words the mix takes from it, and a schedule, which
sets when in training they come. The schedule is integrated to a cumulative demand; the place of a
document in its source's stream of words, put through the inverse of that demand, is its training
position. Documents of all sources are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.text import word_count
from stocklens.session import materialise

WEIGHTS = (5, 2, 1)
# Relative weight of a source at equally spaced times from the start (0) to the end (1) of training,
# straight between them; sources take the schedules in turn, as they take the weights.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MAX_REPEAT = 3
# Rows of a source that one task puts in order, about.
BLOCK_ROWS = 50_000


def source_targets(totals: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size)`` -> with ``rank, target``.

    Targets share the sum of all sizes by weight, stop at ``max_repeat`` times the source's size, and the
    excess is shared again by weight. The end of that process has a closed form: with sources in the
    order of cap / weight, those before some place are at their caps and all others have weight * level.
    The windows below run over one row per source.
    """
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("_ratio", "rank")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_weight", F.get(turn, (F.col("rank") - 1) % len(weights))).withColumn(
        "_cap", F.col("source_size").cast("double") * max_repeat).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    open_ = ranked.withColumn("_left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(
        F.sum("_cap").over(before), F.lit(0.0))).withColumn("_share", F.sum("_weight").over(rest))
    # the first source whose cap is not reached sets the level of all that follow
    fits = F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_share")
    level = F.max(F.when(fits, F.col("_left") / F.col("_share"))).over(everything)
    return open_.withColumn("target", F.least("_cap", F.col("_weight") * level)).select(
        "source", "source_size", "rank", "target")


def demand_position(share: Column, schedule: tuple[float, ...]) -> Column:
    """Time in [0, 1] at which the integral of the schedule reaches ``share`` of its whole."""
    if len(schedule) < 2 or min(schedule) < 0 or sum(schedule) <= 0:
        raise ValueError("a schedule has two or more weights, none below 0 and one above")
    steps = len(schedule) - 1
    areas = [(a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    whole = sum(areas)
    out, done = None, 0.0
    for k, (a, b, area) in enumerate(zip(schedule, schedule[1:], areas)):
        d = F.least(F.greatest(share * whole - done, F.lit(0.0)), F.lit(area))
        # root of a*u + (b-a)*u*u/2 = d in the form that stays exact for equal weights
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * (b - a) * d, F.lit(0.0)))
        u = F.when(d <= 0, F.lit(0.0)).otherwise(F.least(2 * d / (a + root), F.lit(1.0)))
        here = (u + k) / steps
        inside = share * whole <= done + area
        out = F.when(inside, here) if out is None else out.when(inside, here)
        done += area
    return out.otherwise(F.lit(1.0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT, seed: int = 0,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with the struct ``mix(size, source_size, target, copies, taken, positions)`` added as last column.

    ``positions`` holds one training time in [0, 1] per copy. A source goes through all its documents as
    often as its target allows and then takes part of them once more, in an order that depends on
    ``seed`` and the id alone, up to the document that brings it nearest to the target.

    Null text has size 0 and null source is a source of its own, the last. A document of size 0 is
    taken as often as its neighbours. Rows with equal id and size are alike: they stand beside each
    other. Empty tables give empty results; a source without words has target 0 and no copies.

    Cumulative sums run inside blocks of a source (a range of the hash of the id), whose totals are
    added up first, so no task orders a whole source. Blocks grow in number with the rows.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = lambda c: names[docs.columns.index(c)]
    blocks = max(1, -(-docs.count() // block_rows))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(at(id_col)).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.toDF(*names).select(
        *names, F.coalesce(F.col(at(source_col)).cast("string"), F.lit("")).alias("_s"),
        F.col(at(source_col)).isNull().alias("_none"), word_count(at(text_col)).alias("_size"), key.alias("_key"))
    rows = rows.withColumn("_block", F.floor(
        F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32 * blocks).cast("bigint"))
    sums = materialise(rows.groupBy("_s", "_none", "_block").agg(F.sum("_size").alias("_sum")))
    totals = sums.groupBy("_s", "_none").agg(F.sum("_sum").alias("source_size")).select(
        F.when(~F.col("_none"), F.col("_s")).alias("source"), "_s", "_none", "source_size")
    targets = source_targets(totals.select("source", "source_size"), weights, max_repeat).select(
        F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"), "source_size", "rank", "target")
    earlier = Window.partitionBy("_s", "_none").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(
        targets, ["_s", "_none"]).drop("_sum"))
    within = Window.partitionBy("_s", "_none", "_block").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, ["_s", "_none", "_block"]).withColumn(
        "_start", F.col("_offset") + F.sum("_size").over(within) - F.col("_size"))
    size, whole, target = F.col("_size"), F.col("source_size"), F.col("target")
    rounds = F.when(whole > 0, F.floor(target / whole)).otherwise(F.lit(0))
    placed = placed.withColumn("_rounds", rounds.cast("bigint")).withColumn(
        "_copies", F.when(whole > 0, F.col("_rounds") + F.when(
            F.col("_start") + size / 2 < target - F.col("_rounds") * whole, 1).otherwise(0)).otherwise(F.lit(0)).cast("bigint"))
    share = lambda e: (e * whole + F.col("_start")) / target

    def position(e: Column) -> Column:
        out = None
        for k, schedule in enumerate(schedules):
            mine = (F.col("rank") - 1) % len(schedules) == k
            out = F.when(mine, demand_position(share(e), schedule)) if out is None else out.when(mine, demand_position(share(e), schedule))
        return out

    positions = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1), position)).otherwise(
        F.array().cast("array<double>"))
    mix = F.struct(size.alias("size"), whole.alias("source_size"), target.alias("target"), F.col("_copies").alias("copies"),
                   (F.col("_copies") * size).alias("taken"), positions.alias("positions"))
    out = placed.select(*names, mix.alias("mix"))
    return out.toDF(*docs.columns, "mix")


def in_training_order(plan: DataFrame, keep_position: str | None = None) -> DataFrame:
    """The rows of ``mix_plan``, one per copy, range-sorted by training position; a document may repeat."""
    inner = [f"_c{i}" for i in range(len(plan.columns) - 1)]
    copies = plan.toDF(*inner, "_mix").select(*inner, F.explode("_mix.positions").alias("_position"))
    ordered = copies.orderBy("_position", F.xxhash64(*inner[:1]))
    if keep_position:
        return ordered.toDF(*plan.columns[:-1], keep_position)
    return ordered.drop("_position").toDF(*plan.columns[:-1])
