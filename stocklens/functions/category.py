"""Category paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocklens.functions.text import blank, empty, text, trim_ws

NO_CATEGORY = "Bez kategorie"

# Path delimiters in the order they are tried.
PATH_DELIMITERS = [" | ", " > ", " / ", " \\ ", "|", ">", "/"]


def _parts(c: Column, pattern: str) -> Column:
    return F.transform(F.split(text(c), pattern), trim_ws)


def main_category(c: Column) -> Column:
    """First part of ``A > B > C``, NULL when blank."""
    return F.nullif(F.element_at(_parts(c, ">"), 1), F.lit(""))


def sub_category(c: Column) -> Column:
    """Everything after the first part, NULL when there is nothing."""
    parts = _parts(c, ">")
    return F.nullif(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " > "), F.lit(""))


def category_text_columns(columns: list[str]) -> list[str]:
    pattern = re.compile(r"^(categoryText|category_text)\d*$")
    return [c for c in columns if pattern.match(c)]


def category_texts(columns: list[str]) -> Column:
    """Trimmed non-blank values of all category text columns."""
    cols = [trim_ws(text(F.col(c))) for c in category_text_columns(columns)]
    return F.filter(F.array(*cols), lambda x: x != "")


def product_category(category_text: Column, default_category: Column) -> Column:
    """P10: the category a product is grouped under."""
    return F.when(~blank(category_text), trim_ws(category_text)).when(
        ~blank(default_category), trim_ws(default_category)).otherwise(F.lit(NO_CATEGORY))


def product_category_path(default_category: Column, texts: list[Column]) -> Column:
    """P10: all category values of a product, default category first."""
    values = F.filter(F.array(*[trim_ws(text(c)) for c in [default_category, *texts]]), lambda x: x != "")
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(NO_CATEGORY)))


def path_prefixes(c: Column, split_on: str = r"\|", join_with: str = " | ") -> Column:
    """Every ancestor path, the full path last."""
    parts = _parts(c, split_on)
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, F.lit(1), i), join_with))


def canonical_path(c: Column) -> Column:
    """Any of ``> | /`` as separator becomes `` > ``."""
    return F.array_join(_parts(c, r"[>|/]"), " > ")


def last_segment(c: Column) -> Column:
    """Last part, by the first delimiter that occurs."""
    out = F.when(empty(c), F.lit(""))
    for d in PATH_DELIMITERS:
        out = out.when(c.contains(d), trim_ws(F.element_at(F.split(c, re.escape(d)), -1)))
    return out.otherwise(c)


def search_score(name: Column, full_path: Column, query: str) -> Column:
    """Exact 100, prefix 50, contains 30, path contains 10; short paths get a bonus."""
    q = query.lower().strip()
    n, p = F.lower(name), F.lower(text(full_path))
    base = F.when(n == q, 100).when(n.startswith(q), 50).when(n.contains(q), 30).when(
        p.contains(q), 10).otherwise(0)
    segments = F.when(full_path.isNull(), 0).otherwise(F.size(F.split(full_path, r"\|")))
    return F.when(base > 0, base + F.greatest(F.lit(0), F.lit(20) - segments * 2)).otherwise(F.lit(0))
