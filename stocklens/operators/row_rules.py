"""Rules that need one product row only. Every family is a list of rules over the same scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import markup, stock, text as tx
from stocklens.functions.values import days_between, round_half_up
from stocklens.operators.issues import ERROR, WARNING, AuditParams, Rule, emit
from stocklens.operators.products import product_rows

c = F.col


def _say(*parts) -> Column:
    return F.concat_ws("", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _num(col: Column) -> Column:
    """Numbers in messages: whole numbers without decimals, as text."""
    return F.round(col.cast("double"), 2).cast("decimal(18,2)").cast("string")


def content_columns() -> list[dict[str, Column]]:
    """Costly values that several content rules read, computed once per row, stage by stage."""
    longer = F.when(F.length("desc_plain") > F.length("short_plain"), c("desc_plain")).otherwise(c("short_plain"))
    return [{
        # the text is plain already; only decoded tags or entities need another pass
        "language_text": F.when(F.length(longer) > 50, F.lower(F.when(
            longer.contains("<") | longer.contains("&"), tx.strip_html(longer)).otherwise(longer))),
        "low_long": F.lower(tx.text(c("description"))),
        "low_short": F.lower(tx.text(c("short_description"))),
    }, {
        "language_words": F.when(c("language_text").isNotNull(), tx.function_words(c("language_text"))),
        "long_words": tx.word_set(c("desc_plain"), plain=True),
        "short_words": tx.word_set(c("short_plain"), plain=True),
        "tag_depth": markup.nesting_depth(c("description")),
        "empty_blocks": markup.empty_block_count(c("description")),
        "break_runs": markup.break_run_count(c("description")),
    }, {
        "language_scores": F.when(c("language_text").isNotNull(), tx.language_scores(c("language_text"), c("language_words"))),
    }]


def content_rules(p: AuditParams) -> list[Rule]:
    """C01–C09. Rows without any text only get ``no_description``."""
    long_len, short_len = F.length("desc_plain"), F.length("short_plain")
    has_text = (long_len > 0) | (short_len > 0)
    language = F.when(c("language_scores").isNull(), "unknown").otherwise(tx.language_of(c("language_scores")))
    n_long, n_short = F.size("long_words"), F.size("short_words")
    # similarity > 0.9 as whole numbers: 10 * shared > 9 * (a + b - shared); sets are compared where their sizes allow it
    enough = lambda shared: F.lit(19) * shared > F.lit(9) * (n_long + n_short)
    alike = F.when(enough(F.least(n_long, n_short)), enough(F.size(F.array_intersect("long_words", "short_words")))).otherwise(False)
    depth, blocks, breaks = c("tag_depth"), c("empty_blocks"), c("break_runs")
    both = lambda f: f(c("low_long")) | f(c("low_short"))
    return [
        Rule("content", "no_description", ERROR, ~has_text),
        Rule("content", "too_short", WARNING, (long_len > 0) & (long_len < p.min_length),
             _say(long_len.cast("string"), f" characters, minimum {p.min_length}")),
        Rule("content", "same_short_long", WARNING, (long_len > 0) & (short_len > 0) & alike),
        Rule("content", "lorem_ipsum", ERROR, has_text & both(tx.has_lorem)),
        Rule("content", "test_content", ERROR, has_text & both(tx.has_placeholder)),
        Rule("content", "wrong_language", WARNING, ~language.isin("unknown", p.language),
             _say(language, f" found, {p.language} expected")),
        Rule("content", "html_in_description", WARNING,
             has_text & ((depth > 8) | (blocks > 5) | (breaks > 3)),
             F.when(blocks > 5, _say(blocks.cast("string"), " empty blocks"))
             .when(breaks > 3, F.lit("line break runs")).otherwise(F.lit("deep nesting"))),
        Rule("content", "url_in_description", WARNING, has_text & tx.has_url(c("desc_plain"))),
        Rule("content", "emoji_spam", WARNING,
             has_text & ((tx.emoji_count(c("description")) > 5) | (tx.emoji_count(c("short_description")) > 5))),
    ]


def business_rules(p: AuditParams) -> list[Rule]:
    """B01–B10; the family name carries price / availability / promo."""
    price, before = c("price"), c("price_before_discount")
    discount = (before - price) / F.nullif(before, F.lit(0.0)) * 100
    deliverable = stock.mentions(c("availability"), stock.DELIVERABLE) | F.coalesce(c("stock") > 0, F.lit(False))
    age = days_between(p.now, c("created_at"))
    until_end = days_between(c("action_end_date"), p.now)
    on_sale = F.coalesce(c("is_action"), F.lit(False))
    return [
        Rule("business", "zero_price", ERROR, price == 0, F.lit("price")),
        Rule("business", "negative_price", ERROR, price < 0, _say("price ", _num(price))),
        Rule("business", "discount_higher_than_price", ERROR, price > before,
             _say("price ", _num(price), " above ", _num(before))),
        Rule("business", "suspicious_discount", WARNING, discount > 50,
             _say("discount ", round_half_up(discount).cast("string"), "%")),
        Rule("business", "suspicious_round_price", WARNING,
             (price >= 1000) & (F.pmod(price, F.lit(1000.0)) == 0), _say("price ", _num(price))),
        Rule("business", "stock_delivery_conflict", WARNING, deliverable & (c("delivery_days") > 3),
             _say("delivery in ", c("delivery_days").cast("int").cast("string"), " days")),
        Rule("business", "long_inquiry_product", WARNING,
             stock.mentions(c("availability"), stock.ON_INQUIRY) & (age / 30 > 3),
             _say(round_half_up(age / 30).cast("string"), " months on inquiry")),
        Rule("business", "expired_action", ERROR, on_sale & (c("action_end_date") < p.now),
             _say("ended ", F.date_format("action_end_date", "yyyy-MM-dd"))),
        Rule("business", "old_product_new_flag", WARNING,
             F.coalesce(c("is_new"), F.lit(False)) & (age > 90),
             _say(round_half_up(age).cast("string"), " days old")),
        Rule("business", "permanent_action", WARNING,
             on_sale & before.isNotNull() & (
                 c("action_end_date").isNull() | ((until_end > 30) & (age > 30))),
             F.when(c("action_end_date").isNull(), F.lit("no end date")).otherwise(F.lit("more than 30 days"))),
    ]


def completeness_rules(p: AuditParams) -> list[Rule]:
    """Q01–Q11; variants inherit from their parent and are skipped."""
    base = ~c("is_variant")
    images = F.coalesce(c("image_count"), F.lit(0))
    no_image = tx.empty(c("image")) & (images == 0)
    shown = F.when(images == 0, 1).otherwise(images)
    long_len = F.length("desc_plain")
    return [
        Rule("completeness", "no_image", ERROR, base & no_image),
        Rule("completeness", "single_image", WARNING, base & ~no_image & (shown == 1)),
        Rule("completeness", "no_short_description", WARNING, base & tx.blank(c("short_description"))),
        Rule("completeness", "no_long_description", ERROR, base & tx.blank(c("description"))),
        Rule("completeness", "short_description_too_short", WARNING,
             base & ~tx.blank(c("description")) & (long_len < 100),
             _say(long_len.cast("string"), " characters")),
        Rule("completeness", "no_price", ERROR, base & c("price").isNull()),
        Rule("completeness", "zero_price", ERROR, base & (c("price") == 0)),
        Rule("completeness", "no_ean", WARNING, base & tx.blank(c("ean"))),
        Rule("completeness", "no_manufacturer", WARNING,
             base & tx.blank(c("manufacturer")) & tx.blank(c("brand"))),
        Rule("completeness", "no_category", ERROR,
             base & tx.blank(c("default_category")) & tx.blank(c("category_text"))),
        Rule("completeness", "no_filter_parameters", WARNING,
             base & (F.coalesce(F.size("filter_parameters"), F.lit(0)) <= 0)),
    ]


def markup_rules(p: AuditParams) -> list[Rule]:
    """D01–D02."""
    error = c("markup_error")
    return [
        Rule("data_quality", "html_errors", WARNING, error.isNotNull(), error),
        Rule("data_quality", "inline_styles", WARNING, tx.has_inline_style(c("description"))),
    ]


def stock_rules(p: AuditParams) -> list[Rule]:
    """N01–N07."""
    now, inside, out = c("availability"), c("availability_in_stock"), c("availability_out_of_stock")
    has, none = c("stock") > 0, c("stock") <= 0
    set_ = lambda x: ~tx.empty(x)
    conflict = ((has & set_(now) & set_(inside) & (now != inside) & ~stock.says_in_stock(now))
                | (none & set_(now) & set_(out) & (now != out) & ~stock.says_out_of_stock(now)))
    idle = days_between(p.now, c("updated_at"))
    return [
        Rule("stock", "no_availability_in_stock", WARNING, tx.blank(inside)),
        Rule("stock", "wrong_availability_in_stock", WARNING,
             ~tx.blank(inside) & ~stock.says_in_stock(inside), inside),
        Rule("stock", "no_availability_out_of_stock", WARNING, tx.blank(out)),
        Rule("stock", "wrong_availability_out_of_stock", WARNING,
             ~tx.blank(out) & ~stock.says_out_of_stock(out), out),
        Rule("stock", "in_stock_zero_quantity", ERROR, conflict,
             _say("stock ", c("stock").cast("int").cast("string"), " but ", now)),
        Rule("stock", "negative_stock", ERROR, c("stock") < 0,
             _say("stock ", c("stock").cast("int").cast("string"))),
        Rule("stock", "long_sold_out", WARNING, none & (idle > 30),
             _say(round_half_up(idle).cast("string"), " days")),
    ]


def categorisation_rules(p: AuditParams) -> list[Rule]:
    """H01–H02."""
    base = ~c("is_variant")
    every = F.concat(F.array(tx.text(c("default_category"))), c("additional_categories"))
    mains = F.filter(every, lambda x: (x != "") & ~x.contains(">") & ~x.contains("/"))
    return [
        Rule("product_category", "no_default_category", ERROR,
             base & tx.empty(c("default_category")) & tx.empty(c("category_text"))),
        Rule("product_category", "multiple_main_categories", WARNING,
             base & (F.size("additional_categories") > 0) & (F.size(mains) > 1),
             F.array_join(mains, ", ")),
    ]


def seo_rules(p: AuditParams) -> list[Rule]:
    """M01–M08; the title is the meta title or the name."""
    base = ~c("is_variant")
    title = F.when(~tx.empty(c("meta_title")), c("meta_title")).otherwise(tx.text(c("name")))
    meta = tx.text(c("meta_description"))
    low_title, low_meta = tx.trim_ws(F.lower(title)), tx.trim_ws(F.lower(meta))
    low_short = tx.trim_ws(F.lower(c("short_plain")))
    filled = base & ~tx.blank(meta)
    same = low_meta == low_title
    n, t = F.length(meta), F.length(title)
    chars = lambda x: _say(x.cast("string"), " characters")
    return [
        Rule("seo", "no_meta_description", WARNING, base & tx.blank(meta)),
        Rule("seo", "meta_too_short", WARNING, filled & (n < 70), chars(n)),
        Rule("seo", "meta_too_long", WARNING, filled & (n > 160), chars(n)),
        Rule("seo", "meta_same_as_title", ERROR, filled & same),
        Rule("seo", "meta_contains_title", WARNING,
             filled & ~same & low_meta.contains(low_title) & (F.length(low_title) > 15)
             & (F.length(low_title) / F.greatest(F.length(low_meta), F.lit(1)) > 0.7)),
        Rule("seo", "meta_same_as_short_desc", WARNING,
             filled & (low_short != "") & (low_meta == low_short)),
        Rule("seo", "title_too_long", WARNING, base & (t > 70), chars(t)),
        Rule("seo", "title_too_short", WARNING, base & (t > 0) & (t < 10), chars(t)),
    ]


FAMILIES = {
    "content": content_rules, "business": business_rules, "completeness": completeness_rules,
    "data_quality": markup_rules, "stock": stock_rules, "product_category": categorisation_rules,
    "seo": seo_rules,
}
DERIVED = {
    "content": content_columns,
    "data_quality": lambda: [{"markup_error": markup.balance_error(c("description"))}],
}


def row_issues(catalog: DataFrame, params: AuditParams, families: list[str] | None = None) -> DataFrame:
    """Issues of the given families (all by default), one scan of the catalog, no shuffle."""
    picked = families or list(FAMILIES)
    rows = product_rows(catalog)
    for f in picked:
        for stage in DERIVED[f]() if f in DERIVED else []:
            rows = rows.withColumns(stage)
    return emit(rows, [r for f in picked for r in FAMILIES[f](params)])
