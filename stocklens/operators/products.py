"""Canonical product rows with the derived columns that the rules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import text as tx

_OPTIONAL = {
    "brand": "string", "meta_title": "string", "meta_description": "string", "parent_code": "string",
    "pair_code": "string", "short_description": "string", "description": "string", "ean": "string",
    "manufacturer": "string", "default_category": "string", "category_text": "string",
    "availability": "string", "availability_in_stock": "string", "availability_out_of_stock": "string",
    "image": "string", "image_count": "int", "price": "double", "price_before_discount": "double",
    "stock": "double", "delivery_days": "double", "is_action": "boolean", "is_new": "boolean",
    "action_end_date": "timestamp", "created_at": "timestamp", "updated_at": "timestamp",
    "parameters": "map<string,string>",
}


def with_optional_columns(df: DataFrame) -> DataFrame:
    """Adds canonical columns a source does not have as NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in df.columns}
    if "filter_parameters" not in df.columns:
        listed = F.col("filter_params") if "filter_params" in df.columns else F.lit("")
        missing["filter_parameters"] = F.filter(
            F.transform(F.split(tx.text(listed), ","), tx.trim_ws), lambda x: x != "")
    if "additional_categories" not in df.columns:
        extra = [c for c in df.columns if c.startswith("category_text") and c != "category_text"]
        values = [tx.trim_ws(tx.text(F.col(c))) for c in extra]
        missing["additional_categories"] = (
            F.filter(F.array(*values), lambda x: x != "") if values
            else F.array().cast("array<string>"))
    return df.withColumns(missing) if missing else df


def product_rows(catalog: DataFrame) -> DataFrame:
    """Canonical rows plus plain texts and the variant flag."""
    return with_optional_columns(catalog).withColumns({
        "desc_plain": tx.strip_html(F.col("description")),
        "short_plain": tx.strip_html(F.col("short_description")),
        "is_variant": ~tx.empty(F.col("parent_code")),
    })
