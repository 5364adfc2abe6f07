"""Groups of products that share a value, and the issues they raise.

A group is kept as (group_id, size) on each member row. The members of a group are the rows of
``duplicate_members``; lists of "the other members" are never built, as one group may hold a large
share of the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import text as tx
from stocklens.functions.keywords import audit_base_code
from stocklens.operators.issues import ERROR, WARNING, as_issues, union_issues
from stocklens.operators.keyed import attach_groups
from stocklens.operators.products import product_rows

c = F.col


def group_keys(catalog: DataFrame, keep: list[str] | None = None, more: list[Column] | None = None) -> DataFrame:
    """One md5 per group value (NULL where the row takes no part), plus the columns to ``keep``.

    Texts are never shuffled, only their md5. ``more`` are columns over the plain texts that another job takes from the same scan.
    """
    rows = product_rows(catalog)
    low = lambda col: tx.trim_ws(F.lower(tx.text(c(col))))
    plain = F.lower(c("desc_plain"))
    key = lambda value, usable: F.when(usable, F.md5(value))
    ean = tx.trim_ws(tx.text(c("ean")))
    return rows.select(
        "row_idx", "code", "name", "parent_code", *(keep or []),
        key(plain, F.length(plain) > 50).alias("duplicate_description"),
        key(low("name"), low("name") != "").alias("duplicate_name"),
        key(low("code"), low("code") != "").alias("duplicate_code"),
        key(ean, ean != "").alias("duplicate_ean"),
        key(low("meta_description"), ~c("is_variant") & (F.length(low("meta_description")) > 30)
            ).alias("duplicate_meta_description"), *(more or []))


def keyed_by(keys: DataFrame, issue_type: str) -> DataFrame:
    return keys.filter(c(issue_type).isNotNull()).select(
        "row_idx", "code", "name", "parent_code", c(issue_type).alias("group_id"))


def group_sizes(keyed: DataFrame) -> DataFrame:
    """Size and variant-group test of each group, all partial aggregates."""
    base = audit_base_code(tx.trim_ws(c("code")))
    parent = F.when(~tx.empty(c("parent_code")), c("parent_code"))
    return keyed.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("group_size"),
        ((F.count(parent) == F.count(F.lit(1))) & (F.min(parent) == F.max(parent))).alias("one_parent"),
        ((F.count(base) == F.count(F.lit(1))) & (F.min(base) == F.max(base))).alias("one_base"),
    ).select("group_id", "group_size",
             F.coalesce((c("group_size") > 1) & (c("one_parent") | c("one_base")), F.lit(False)).alias("is_variants"))


def duplicate_members(keyed: DataFrame, variants_allowed: bool) -> DataFrame:
    """Members of all groups with more than one row; variant groups left out when allowed."""
    groups = group_sizes(keyed).filter(c("group_size") > 1)
    if variants_allowed:
        groups = groups.filter(~c("is_variants"))
    joined = attach_groups(keyed, groups.select("group_id", "group_size"), "group_id", "group_size")
    return joined.filter(c("group_size").isNotNull())


def _issues(members: DataFrame, family: str, kind: str, severity: str) -> DataFrame:
    return as_issues(members.select(
        F.lit(family).alias("family"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
        F.lit("product").alias("entity_kind"), c("code").alias("entity_key"),
        c("name").alias("entity_name"), "row_idx",
        F.concat(c("group_size").cast("string"), F.lit(" products")).alias("details"),
        "group_id", "group_size"))


# family, type (also the key column), severity, whether variant groups are left out
GROUP_RULES = [
    ("content", "duplicate_description", WARNING, False),
    ("data_quality", "duplicate_name", WARNING, True),
    ("data_quality", "duplicate_code", ERROR, False),
    ("data_quality", "duplicate_ean", ERROR, False),
    ("seo", "duplicate_meta_description", ERROR, True),
]


def group_issues(keys: DataFrame, types: list[str] | None = None) -> DataFrame:
    """C10, D03–D05, M09 from the table of :func:`group_keys`."""
    picked = [r for r in GROUP_RULES if types is None or r[1] in types]
    return union_issues([
        _issues(duplicate_members(keyed_by(keys, kind), skip), family, kind, severity)
        for family, kind, severity, skip in picked])


def description_groups(catalog: DataFrame, preview_chars: int | None = None) -> DataFrame:
    """A13 as a table: one row per member with the group's size and its text, which a display may cut."""
    norm = F.lower(c("desc_plain"))
    preview = norm if preview_chars is None else F.when(F.length(norm) > preview_chars, F.concat(
        F.substring(norm, 1, preview_chars), F.lit("..."))).otherwise(norm)
    rows = product_rows(catalog).filter(F.length(norm) > 50).select(
        "row_idx", "code", F.md5(norm).alias("group_id"), preview.alias("preview"))
    groups = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("group_size"), F.first("preview").alias("preview")).filter("group_size > 1")
    return attach_groups(rows.drop("preview"), groups, "group_id", "group_size").filter(
        "group_size is not null").select("group_id", "group_size", "row_idx", "code", "preview")
