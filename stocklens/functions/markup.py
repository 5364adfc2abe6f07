"""Markup checks on HTML fragments (no parser needed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocklens.functions.text import WS, text

# Elements without a closing tag.
VOID_TAGS = ["br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed",
             "source", "track", "wbr"]


def nesting_depth(c: Column) -> Column:
    """Deepest level of open tags (closing tags may push the level below zero)."""
    steps = F.transform(
        F.regexp_extract_all(text(c), F.lit(r"</?[a-zA-Z][^>]*>"), F.lit(0)),
        lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1))
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("deepest"))
    return F.aggregate(steps, start, lambda s, d: F.struct(
        (s["level"] + d).alias("level"),
        F.greatest(s["deepest"], s["level"] + d).alias("deepest")), lambda s: s["deepest"])


def empty_block_count(c: Column) -> Column:
    low = F.lower(text(c))
    # the closing tag is tested first: far cheaper than the pattern
    count = lambda tag: F.when(low.contains(f"</{tag}>"), F.regexp_count(low, F.lit(rf"<{tag}[^>]*>{WS}*</{tag}>"))).otherwise(0)
    return count("div") + count("span")


def break_run_count(c: Column) -> Column:
    """Runs of three or more line breaks."""
    low = F.lower(text(c))
    return F.when(low.contains("<br"), F.regexp_count(low, F.lit(rf"(<br{WS}*/?>{WS}*){{3,}}"))).otherwise(0)


def balance_error(c: Column) -> Column:
    """NULL when tags nest properly, else ``close:<tag>`` or ``open:<tags>``.

    The open tags are kept as one ``/a/b`` string; the first wrong closing tag ends the walk.
    """
    tags = F.regexp_extract_all(text(c), F.lit(r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>"), F.lit(0))
    steps = F.filter(F.transform(tags, lambda t: F.struct(
        t.startswith("</").alias("closing"),
        t.endswith("/>").alias("selfclosed"),
        F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("name"))),
        lambda s: ~s["selfclosed"] & ~s["name"].isin(VOID_TAGS))

    def step(stack: Column, s: Column) -> Column:
        top = F.concat(F.lit("/"), s["name"])
        return (F.when(stack.startswith("!"), stack)
                .when(~s["closing"], F.concat(stack, top))
                .when(stack.endswith(top), F.left(stack, F.length(stack) - F.length(top)))
                .otherwise(F.concat(F.lit("!"), s["name"])))

    left = F.aggregate(steps, F.lit(""), step)
    return (F.when(left == "", F.lit(None).cast("string"))
            .when(left.startswith("!"), F.concat(F.lit("close:"), F.substr(left, F.lit(2))))
            .otherwise(F.concat(F.lit("open:"), F.replace(F.substr(left, F.lit(2)), F.lit("/"), F.lit(",")))))
