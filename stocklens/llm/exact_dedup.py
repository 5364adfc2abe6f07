"""Exact copies: groups by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.text import lower_az, whole
from stocklens.operators.keyed import attach_groups
from stocklens.session import materialise

_KEY, _TEXT, _PART = "_content_hash", "_content", "_content_part"


def md5_bytes(text: Column) -> Column:
    """128-bit content hash."""
    return F.unhex(F.md5(text.cast("binary")))


def _groups(hashed: DataFrame, by: list[str], pick: Callable) -> DataFrame:
    # The smallest and the largest text of a hash are combined before the shuffle, so a task sends
    # at most two texts of a group, however many copies it holds. They differ only in a collision.
    return hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("group_size"), pick("_id").alias("keep_id"),
        (F.min(_TEXT) == F.max(_TEXT)).alias("_same"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names the id that stays in a group:
    ``min`` (smallest stable id) or ``max``. ``content_hash`` may be replaced; a weak one changes
    nothing but speed, because the bytes decide.

    Null text counts as empty. A row without id is counted in its group and stays only if no row of the
    group has an id. Rows that repeat id and text get equal values. An empty table gives an empty
    result; other columns of ``docs`` are not read.

    Only hashes and ids are joined back to the rows; texts move once, at most two per group and task.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    hashed = docs.select(F.col(id_col).alias("_id"), lower_az(whole(text_col)).alias(_TEXT)).withColumn(
        _KEY, content_hash(F.col(_TEXT)))
    groups = materialise(_groups(hashed, [_KEY], pick))
    rows = hashed.select("_id", _KEY, F.sha2(F.col(_TEXT).cast("binary"), 256).alias("text_sha256"))
    clean = groups.filter("_same").select(_KEY, "group_size", "keep_id")
    if groups.filter("not _same").isEmpty():
        joined = attach_groups(rows, clean, _KEY, "group_size")
    else:
        joined = _with_collisions(hashed, groups, clean, pick)
    return joined.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_collisions(hashed: DataFrame, groups: DataFrame, clean: DataFrame, pick: Callable) -> DataFrame:
    """Rows whose hash belongs to several texts are grouped by the text itself."""
    mixed = groups.filter("not _same").select(_KEY, F.lit(True).alias("_mixed"), "group_size")
    marked = attach_groups(hashed, mixed, _KEY, "group_size").withColumn(
        _PART, F.when(F.col("_mixed"), F.col(_TEXT)))
    parts = _groups(marked.filter("_mixed"), [_KEY, _PART], pick).select(
        _KEY, _PART, "group_size", "keep_id")
    sha = F.sha2(F.col(_TEXT).cast("binary"), 256).alias("text_sha256")
    narrow = marked.select("_id", _KEY, _PART, sha)
    plain = attach_groups(narrow.filter(F.col(_PART).isNull()).drop(_PART), clean, _KEY, "group_size")
    split = narrow.filter(F.col(_PART).isNotNull()).join(parts, [_KEY, _PART]).drop(_PART)
    return plain.unionByName(split.select(*plain.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    The row that stays has the smallest (``min``) or largest (``max``) id. Of rows that repeat id and
    text, one stays; among rows without id that have equal texts, one stays as well.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]  # clashing names of extra columns do no harm
    place = docs.columns.index
    inner = docs.toDF(*names)
    stay = exact_copies(inner, names[place(id_col)], names[place(text_col)], keep).filter("kept").select(
        F.col(names[place(id_col)]).alias("_stay"), "text_sha256")
    counted = materialise(stay.groupBy("_stay", "text_sha256").agg(F.count(F.lit(1)).alias("_rows")))
    sha = F.sha2(lower_az(whole(names[place(text_col)])).cast("binary"), 256)
    rows = inner.withColumn("_sha", sha)
    match = rows[names[place(id_col)]].eqNullSafe(counted["_stay"]) & (rows["_sha"] == counted["text_sha256"])
    kept = rows.join(counted, match)
    if not counted.filter("_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["_stay", "_sha"])
    return kept.select(*names).toDF(*docs.columns)
