"""Bulk operations on a product list: visibility, price lists, promotions, ordering, search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import text as tx
from stocklens.functions.category import search_score
from stocklens.functions.values import money, parse_bool
from stocklens.operators.keyed import number_rows

c = F.col

# Default wholesale discounts in percent.
DISCOUNT_LEVELS = [10, 20, 30]


def _stock():
    return F.coalesce(c("stock").cast("double"), F.lit(0.0))


def hide_sold_out(products: DataFrame) -> DataFrame:
    """rows with stock 0 (missing counts as 0); variants and main products differ."""
    variant = ~tx.blank(c("pair_code"))
    return products.filter(_stock() == 0).select(
        "code", tx.text(c("pair_code")).alias("pairCode"),
        F.when(variant, 0).alias("variantVisibility"),
        F.when(~variant, "hidden").alias("productVisibility"))


def wholesale_prices(products: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """one row per product and discount level, no join."""
    discounts = F.array(*[F.lit(x) for x in levels or DISCOUNT_LEVELS])
    return products.select(
        "code", "name", c("price").alias("originalPrice"), F.explode(discounts).alias("discountPercent")).withColumn(
        "wholesalePrice", money(c("originalPrice") * (F.lit(1.0) - c("discountPercent") / F.lit(100.0))))


@dataclass(frozen=True)
class Promotion:
    flag: str
    price_from: float | None = None
    price_to: float | None = None
    brands: list[str] = field(default_factory=list)
    brandless_codes: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    valid_from: str | None = None
    valid_until: str | None = None
    discount_percent: float | None = None
    discount_fixed: float | None = None
    action_from: str | None = None
    action_until: str | None = None


def select_promotion(products: DataFrame, p: Promotion) -> DataFrame:
    """price range, brands (or chosen products without brand), category subtrees."""
    brand, category = tx.trim_ws(tx.text(c("manufacturer"))), tx.trim_ws(tx.text(c("category_text")))
    out = products
    if p.price_from:
        out = out.filter(c("price") >= p.price_from)
    if p.price_to:
        out = out.filter(c("price") <= p.price_to)
    if p.brands or p.brandless_codes:
        out = out.filter(((brand == "") & c("code").isin(p.brandless_codes)) |
                         ((brand != "") & brand.isin(p.brands)))
    if p.categories:
        out = out.filter((category != "") & reduce(or_, [
            (category == s) | category.startswith(f"{s} | ") for s in p.categories]))
    return out


def promotion_rows(products: DataFrame, p: Promotion) -> DataFrame:
    """flag, validity and action price columns of the selected products."""
    cols = [c("code"), tx.text(c("pair_code")).alias("pairCode"), F.lit(1).alias(f"{p.flag}FlagActive")]
    if p.valid_from:
        cols.append(F.lit(p.valid_from).alias(f"{p.flag}FlagValidFrom"))
    if p.valid_until:
        cols.append(F.lit(p.valid_until).alias(f"{p.flag}FlagValidUntil"))
    if p.discount_percent or p.discount_fixed:
        price = (money(c("price") * (F.lit(1.0) - F.lit(p.discount_percent) / 100)) if p.discount_percent
                 else F.greatest(money(c("price") - F.lit(p.discount_fixed)), F.lit(0.0)))
        cols.append(price.alias("actionPrice"))
        if p.action_from:
            cols.append(F.lit(p.action_from).alias("actionFrom"))
        if p.action_until:
            cols.append(F.lit(p.action_until).alias("actionUntil"))
    return select_promotion(products, p).select(*cols)


def active_flags(products: DataFrame) -> DataFrame:
    """F05 as a table: each flag of the products with the number of products that have it (1, true, yes, ano)."""
    found = flags(products.columns)
    counts = [F.count_if(parse_bool(c(f"`{x}FlagActive`").cast("string"))).alias(f"n{i}") for i, x in enumerate(found)]
    pairs = F.array(*[F.struct(F.lit(x).alias("flag"), c(f"n{i}").alias("products")) for i, x in enumerate(found)]) if found else (
        F.array().cast("array<struct<flag:string,products:bigint>>"))
    return products.agg(F.count(F.lit(1)).alias("_"), *counts).select(F.inline(pairs))


def flags(columns: list[str]) -> list[str]:
    """slugs of the ``<slug>FlagActive`` columns."""
    return [m.group(1) for m in (re.match(r"^(.+)FlagActive$", x) for x in columns) if m]


def search_products(products: DataFrame, query: str) -> DataFrame:
    """text contained in name, code or short description, any case."""
    q = query.lower()
    fields = [x for x in ("name", "code", "short_description") if x in products.columns]
    return products.filter(reduce(or_, [F.lower(tx.text(c(x))).contains(q) for x in fields]))


def needs_mapping(products: DataFrame, id_columns: list[str], overwrite: bool = False) -> DataFrame:
    """products that miss the category id of at least one platform."""
    if overwrite:
        return products
    return products.filter(reduce(or_, [tx.empty(c(x)) for x in id_columns]))


def search_categories(taxonomy: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """best categories for a text, ties by id."""
    scored = taxonomy.withColumn("score", search_score(c("name"), c("full_path"), query))
    return scored.filter("score > 0").orderBy(c("score").desc(), "platform", "id").limit(limit)


def brands(products: DataFrame) -> DataFrame:
    """distinct non-blank brands."""
    return products.select(tx.trim_ws(tx.text(c("manufacturer"))).alias("brand")).filter("brand <> ''").distinct()


def brandless(products: DataFrame) -> DataFrame:
    return products.filter(tx.blank(c("manufacturer")))


def stock_order(products: DataFrame) -> DataFrame:
    """Priority 1..n inside each category, most stock first, input order on ties."""
    rows = products.select(
        "row_idx", "code", F.when(~tx.blank(c("pair_code")), c("pair_code")).alias("pairCode"),
        F.when(tx.empty(c("category_text")), "bez-kategorie").otherwise(c("category_text")).alias("category"),
        _stock().alias("stock"))
    return number_rows(rows, ["category"], c("stock"), "row_idx", "priority")


def stock_bands(products: DataFrame, threshold: int = 5) -> DataFrame:
    """In stock above the threshold, low, sold out; negative stock is in none."""
    s = _stock()
    return products.agg(F.count_if(s > threshold).alias("in_stock"),
                        F.count_if((s > 0) & (s <= threshold)).alias("low_stock"),
                        F.count_if(s == 0).alias("sold_out"))


def sorted_categories(groups: DataFrame, name: str = "category", last: str = "Bez kategorie") -> DataFrame:
    """Czech order, one special value at the end."""
    return groups.orderBy((c(name) == last).cast("int"), F.collate(c(name), "cs"))


def seeded_order(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """A shuffle that is the same on every run."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), c(key).cast("string"))), key)
