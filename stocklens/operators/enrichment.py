"""Parameter enrichment: request table, response parsing, clean-up, grouping, wide output.

The model itself is outside: requests leave as a table and responses come back as one. All
clean-up works on arrays inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import parameters as pm, text as tx
from stocklens.functions.category import product_category, product_category_path

c = F.col

SCHEMA = "struct<filtering:array<struct<name:string,value:string>>,text:array<struct<key:string,value:string>>>"
FILTER_PREFIX, TEXT_PREFIX = "filteringProperty:", "textProperty"


def source_columns(columns: list[str]) -> dict[str, Column]:
    """Source text fields by canonical name, from camelCase or snake_case columns."""
    out = {}
    for name in pm.SOURCE_LABELS:
        snake = "".join(f"_{ch.lower()}" if ch.isupper() else ch for ch in name)
        for option in (name, snake):
            if option in columns:
                out[name] = c(option)
    return out


def enrichment_requests(products: DataFrame, chosen: list[str]) -> DataFrame:
    """The text sent per product; products without text get an error instead."""
    fields = {k: v for k, v in source_columns(products.columns).items() if k in chosen}
    label = F.when(~tx.empty(c("name")), c("name")).when(~tx.empty(c("code")), c("code")).otherwise(
        F.concat(F.lit("row "), (c("row_idx") + 1).cast("string")))
    rows = products.select("row_idx", "code", pm.source_text(fields).alias("source_text"), label.alias("_l"))
    return rows.withColumn("error", F.when(tx.blank(c("source_text")), F.concat(c("_l"), F.lit(": no source text")))).drop("_l")


def parse_responses(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Filtering and text arrays; no JSON is an error, another shape an empty result."""
    parsed = responses.withColumn("_r", F.from_json(c(payload), SCHEMA)).withColumn(
        "_json", F.try_parse_json(c(payload)).isNotNull())
    r = c("_r")
    well_formed = (r["filtering"].isNotNull() & r["text"].isNotNull()
                   & F.forall(r["filtering"], lambda x: (F.length(x["name"]) > 0) & x["value"].isNotNull())
                   & F.forall(r["text"], lambda x: (F.length(x["key"]) > 0) & x["value"].isNotNull()))
    ok = F.coalesce(well_formed, F.lit(False))
    empty_f = F.array().cast("array<struct<name:string,value:string>>")
    empty_t = F.array().cast("array<struct<key:string,value:string>>")
    return parsed.select(
        "row_idx", F.when(ok, r["filtering"]).otherwise(empty_f).alias("filtering"),
        F.when(ok, r["text"]).otherwise(empty_t).alias("text"),
        F.when(~c("_json"), F.concat(F.lit("row "), c("row_idx").cast("string"), F.lit(": no valid JSON"))).alias("error"))


def _first_of(items: Column, same, prefer) -> Column:
    """Keeps, of items that are the same, the first preferred one, else the first one."""
    placed = F.transform(items, lambda x, i: F.struct(i.alias("pos"), x.alias("v")))

    def chosen(x: Column) -> Column:
        group = F.filter(placed, lambda y: same(x["v"], y["v"]))
        return F.element_at(F.concat(F.filter(group, lambda y: prefer(y["v"])), group), 1)["pos"]

    return F.transform(F.filter(placed, lambda x: chosen(x) == x["pos"]), lambda x: x["v"])


def clean_parameters(parsed: DataFrame) -> DataFrame:
    """Split several values, one spelling, no duplicates.

    Of filtering parameters with equal values the first with a priority name stays, else the first.
    """
    split = F.flatten(F.transform(F.filter("filtering", lambda x: ~tx.blank(x["value"])), lambda x: F.transform(
        pm.split_values(x["value"]), lambda v: F.struct(x["name"].alias("name"), tx.trim_ws(v).alias("value")))))
    kept_texts = F.transform(F.filter("text", lambda x: ~tx.empty(x["key"]) & ~tx.empty(x["value"])), lambda x: F.struct(
        x["key"].alias("key"), tx.trim_ws(x["value"]).alias("value")))
    # stage by stage: inside one lambda every use of a value would compute it again
    lowered = F.transform(c("_split"), lambda x: F.struct(
        pm.parameter_name(x["name"]).alias("name"), pm.lowercase_first(x["value"]).alias("value")))
    spelled = F.transform(c("_lowered"), lambda x: F.struct(x["name"].alias("name"), pm.fix_acronyms(x["value"]).alias("value")))
    texts = F.transform(c("_kept"), lambda x: F.struct(
        pm.parameter_name(x["key"]).alias("key"), pm.fix_acronyms(x["value"]).alias("value")))
    rows = parsed.withColumns({"_split": split, "_kept": kept_texts}).withColumns(
        {"_lowered": lowered, "_text": texts}).withColumn("_spelled", spelled)
    lower_equal = lambda a, b: F.lower(a["value"]) == F.lower(b["value"])
    return rows.select(
        "row_idx",
        _first_of(c("_spelled"), lower_equal, lambda x: x["name"].isin(pm.PRIORITY_NAMES)).alias("filtering"),
        _first_of(c("_text"), lambda a, b: (a["key"] == b["key"]) & lower_equal(a, b), lambda x: F.lit(False)).alias("text"),
        "error")


def outcome_counts(rows: DataFrame) -> DataFrame:
    """A18."""
    return rows.agg(F.count_if(c("error").isNull()).alias("succeeded"), F.count_if(c("error").isNotNull()).alias("failed"))


def with_category(products: DataFrame, params: DataFrame) -> DataFrame:
    """Products with their parameters and the category they are grouped under (P10)."""
    texts = [c(x) for x in products.columns if x.startswith("category_text")]
    return products.select(
        "row_idx", "code", product_category(c("category_text"), c("default_category")).alias("category"),
        product_category_path(c("default_category"), texts).alias("category_path")).join(params, "row_idx", "left")


def _czech(names: Column) -> Column:
    ordered = F.array_sort(F.transform(names, lambda x: F.collate(x, "cs")))
    return F.transform(ordered, lambda x: x.cast("string"))


def category_groups(rows: DataFrame) -> DataFrame:
    """Products per category, path of the first one, parameter names in Czech order.

    Names are merged as sets before the shuffle; members stay rows of ``with_category``.
    """
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("products"), F.min_by("category_path", "row_idx").alias("category_path")).join(
        _names(rows, "filtering", "name"), "category", "left").join(_names(rows, "text", "key"), "category", "left")


def _names(rows: DataFrame, column: str, field: str) -> DataFrame:
    each = rows.select("category", F.explode_outer(F.transform(c(column), lambda x: x[field])).alias("n")).distinct()
    return each.groupBy("category").agg(_czech(F.collect_list("n")).alias(f"{column}_names"))


def remove_parameter(rows: DataFrame, category: str, kind: str, name: str) -> DataFrame:
    """Drops one parameter name from all products of a category."""
    field = "name" if kind == "filtering" else "key"
    kept = F.filter(kind, lambda x: x[field] != name)
    return rows.withColumn(kind, F.when(c("category") == category, kept).otherwise(c(kind)))


def edit_parameters(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """An edit replaces both parameter arrays of a row."""
    e = edits.select("row_idx", F.struct("filtering", "text").alias("_e"))
    return rows.join(e, "row_idx", "left").withColumns({
        "filtering": F.when(c("_e").isNotNull(), c("_e")["filtering"]).otherwise(c("filtering")),
        "text": F.when(c("_e").isNotNull(), c("_e")["text"]).otherwise(c("text"))}).drop("_e")


def parameter_names(params: DataFrame, max_filtering: int) -> list[str]:
    """Names that become columns, all of them: the columns of a table are known to the driver."""
    names = params.select(F.explode(F.slice("filtering", 1, max_filtering)).alias("x")).select(
        c("x")["name"].alias("name")).distinct().orderBy("name")
    return [r["name"] for r in names.collect()]


def long_output(params: DataFrame, max_filtering: int = 5) -> DataFrame:
    """E09 for any number of names: rows (row_idx, position, name, value) in place of a column for each name."""
    return params.select("row_idx", F.posexplode(F.slice("filtering", 1, max_filtering)).alias("position", "x")).select(
        "row_idx", "position", c("x")["name"].alias("name"), c("x")["value"].alias("value"))


def wide_output(products: DataFrame, params: DataFrame, max_filtering: int = 5, max_text: int = 3,
                clear_existing: bool = False) -> DataFrame:
    """Original columns, filtering columns by name, text parameters in free slots.

    A new filtering column takes the last value of its name, an existing one only fills if empty. The values of
    a row are put into two maps by name once, which all columns read.
    """
    names = parameter_names(params, max_filtering)
    kept = F.slice("filtering", 1, max_filtering)
    keys = F.array_distinct(F.transform(kept, lambda x: x["name"]))
    values = lambda n: F.transform(F.filter(kept, lambda x: x["name"] == n), lambda x: x["value"])
    by_name = lambda at: F.map_from_arrays(keys, F.transform(keys, lambda n: F.element_at(values(n), at)))
    joined = products.join(params.select("row_idx", by_name(1).alias("_first"), by_name(-1).alias("_last"),
                                         F.slice("text", 1, max_text).alias("_t")), "row_idx", "left")
    cols, slots = {}, {}
    for x in products.columns:
        is_text = x.startswith(TEXT_PREFIX) and (x == TEXT_PREFIX or x[len(TEXT_PREFIX):].isdigit())
        if is_text:
            slots[int(x[len(TEXT_PREFIX):] or 1)] = x
        wiped = clear_existing and (is_text or x.startswith(FILTER_PREFIX))
        cols[x] = F.lit("") if wiped else F.coalesce(c(f"`{x}`").cast("string"), F.lit(""))
    for n in names:
        col = f"{FILTER_PREFIX}{n}"
        if col in products.columns:
            cols[col] = F.when(cols[col] == "", F.coalesce(F.try_element_at("_first", F.lit(n)), F.lit(""))).otherwise(cols[col])
        else:
            cols[col] = F.coalesce(F.try_element_at("_last", F.lit(n)), F.lit(""))
    last = max(slots, default=0) + max_text
    taken = {k: cols[v] for k, v in slots.items()}
    free = F.filter(F.array(*[F.when(tx.blank(taken[k]) if k in taken else F.lit(True), F.lit(k)) for k in range(1, last + 1)]),
                    lambda k: k.isNotNull())
    out = joined.withColumn("_free", free)
    for k in range(1, last + 1):
        col = TEXT_PREFIX if k == 1 else f"{TEXT_PREFIX}{k}"
        turn = F.array_position(c("_free"), F.lit(k)).cast("int")
        filled = F.transform(c("_t"), lambda x: F.concat(x["key"], F.lit(";"), x["value"]))
        value = F.coalesce(F.when(turn > 0, F.get(filled, turn - 1)), F.lit(""))
        cols[col] = F.when(~tx.blank(taken[k]), taken[k]).otherwise(value) if k in taken else value
    return out.select(*[v.alias(k) for k, v in cols.items()])
