"""Statistics, scores and roll-ups of a catalog audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import text as tx
from stocklens.functions.values import one_decimal, round_half_up
from stocklens.operators.issues import ERROR, WARNING
from stocklens.operators.products import product_rows
from stocklens.operators.variants import parents_with_variants

c = F.col

# Weight of each score in the overall score.
WEIGHTS = {"uniqueness": 0.12, "quality": 0.12, "completeness": 0.18, "business": 0.12,
           "data_quality": 0.12, "stock": 0.10, "categories": 0.10, "seo": 0.14}
# Points per error and per warning, by score.
PENALTIES = {"completeness": (["completeness"], 5, 2), "business": (["business"], 10, 3),
             "data_quality": (["data_quality"], 10, 3), "stock": (["stock"], 10, 3),
             "categories": (["categories", "product_category"], 5, 2), "seo": (["seo"], 8, 2)}
# Issue types behind the two shares.
UNIQUENESS_TYPES = ["duplicate_description", "near_duplicate"]
QUALITY_TYPES = ["lorem_ipsum", "test_content", "emoji_spam", "url_in_description"]


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Sixteen measures in one aggregate; parents with variants by a semi join."""
    rows = product_rows(catalog)
    long_len, short_len = F.length("desc_plain"), F.length("short_plain")
    count = F.coalesce(c("image_count"), F.lit(0))
    pictured = ~tx.empty(c("image")) | (count > 0)
    category = F.when(~tx.empty(c("category_text")), c("category_text")).when(
        ~tx.empty(c("default_category")), c("default_category"))
    mean = lambda total, n: F.coalesce(
        round_half_up(total / F.nullif(n, F.lit(0))), F.lit(0)).cast("bigint")
    sums = rows.agg(
        F.count(F.lit(1)).alias("total_products"),
        _count_if(long_len > 0).alias("with_description"),
        _count_if(short_len > 0).alias("with_short_description"),
        F.sum(long_len).alias("_long"), F.sum(short_len).alias("_short"),
        _count_if(c("price") > 0).alias("with_price"), _count_if(c("stock") > 0).alias("with_stock"),
        _count_if(c("is_action")).alias("in_action"), _count_if(pictured).alias("with_images"),
        F.sum(F.when(pictured, F.when(count == 0, 1).otherwise(count))).alias("_images"),
        _count_if(~tx.blank(c("ean"))).alias("with_ean"),
        _count_if(~tx.empty(c("manufacturer")) | ~tx.empty(c("brand"))).alias("with_manufacturer"),
        _count_if(category.isNotNull()).alias("with_category"),
        _count_if(c("is_variant")).alias("total_variants"),
        F.count_distinct(category).alias("total_categories"))
    parents = parents_with_variants(catalog).agg(F.count(F.lit(1)).alias("with_variants"))
    return sums.select(
        "total_products", "with_description", "with_short_description",
        mean(c("_long"), c("with_description")).alias("avg_description_length"),
        mean(c("_short"), c("with_short_description")).alias("avg_short_description_length"),
        "with_price", "with_stock", "in_action", "with_images",
        F.coalesce(one_decimal(c("_images") / F.nullif(c("with_images"), F.lit(0))), F.lit(0.0)).alias("avg_image_count"),
        "with_ean", "with_manufacturer", "with_category",
        parents.scalar().alias("with_variants"), "total_variants", "total_categories")


def audit_scores(issues: DataFrame, catalog: DataFrame) -> DataFrame:
    """Eight scores and the overall score, one row. Variant issues enter no score."""
    per = issues.groupBy("family", "type", "severity").agg(F.count(F.lit(1)).alias("n"))
    total = catalog.agg(F.count(F.lit(1))).scalar()
    n_of = lambda cond: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))
    sums = [n_of(c("type").isin(UNIQUENESS_TYPES) & (c("family") == "content")).alias("_dup"),
            n_of(c("type").isin(QUALITY_TYPES) & (c("family") == "content")).alias("_qual")]
    for name, (families, _, _) in PENALTIES.items():
        for sev in (ERROR, WARNING):
            sums.append(n_of(c("family").isin(families) & (c("severity") == sev)).alias(f"_{name}_{sev}"))
    counted = per.agg(*sums).withColumn("_n", F.nullif(total, F.lit(0)))
    floor0 = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x.cast("double")))
    raw = {"uniqueness": floor0(F.lit(100.0) - c("_dup") / c("_n") * 100),
           "quality": floor0(F.lit(100.0) - c("_qual") / c("_n") * 200)}
    for name, (_, e, w) in PENALTIES.items():
        raw[name] = floor0(F.lit(100) - c(f"_{name}_{ERROR}") * e - c(f"_{name}_{WARNING}") * w)
    scored = counted.select(*[v.alias(k) for k, v in raw.items()])
    overall = sum(c(k) * w for k, w in WEIGHTS.items())
    return scored.select(*[round_half_up(c(k)).cast("int").alias(k) for k in raw],
                         round_half_up(overall).cast("int").alias("overall"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Totals, errors and warnings on all levels (family, type); NULL means all."""
    return issues.rollup("family", "type").agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(c("severity") == ERROR).alias("errors"),
        F.count_if(c("severity") == WARNING).alias("warnings"))


def health(scores: DataFrame) -> DataFrame:
    """Health level of the overall score and up to five scores below 80, worst first."""
    order = ["completeness", "quality", "uniqueness", "data_quality", "stock", "categories", "business", "seo"]
    entries = F.array(*[F.struct(c(k).alias("score"), F.lit(i).alias("pos"), F.lit(k).alias("name"))
                        for i, k in enumerate(order)])
    worst = F.transform(F.slice(F.array_sort(F.filter(entries, lambda e: e["score"] < 80)), 1, 5),
                        lambda e: e["name"])
    level = F.when(c("overall") >= 90, "excellent").when(c("overall") >= 70, "good").when(
        c("overall") >= 50, "average").otherwise("critical")
    return scores.select("overall", level.alias("level"), worst.alias("priorities"))


def worst_status(statuses: DataFrame) -> DataFrame:
    """The worst of all platform statuses."""
    rank = {"major_outage": 0, "partial_outage": 1, "degraded": 2, "unknown": 3, "operational": 4}
    expr = F.lit(None).cast("int")
    for k, v in rank.items():
        expr = F.when(c("status") == k, v).otherwise(expr)
    low = statuses.agg(F.min(expr).alias("r"))
    names = F.array(*[F.lit(k) for k in rank])
    return low.select(F.coalesce(F.get(names, c("r")), F.lit("operational")).alias("status"))
