"""Mapping products to marketplace categories.

Words are matched once per vocabulary entry, not per product: distinct product words meet distinct
category words, the hits are summed per (word, category), and product texts join those hits.
Products with the same text share one scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions import keywords as kw, text as tx
from stocklens.operators.keyed import attach_groups, number_rows, spread_join
from stocklens.session import materialise

c = F.col

CANDIDATES = 20
ACCEPT_SCORE = 100
SHOWN_CANDIDATES = 15
REVIEW_BATCH = 10
# Points for each strong word in the name of a category, from two on.
BONUS = 30
# Entries that the first look for a threshold reads, in times of the wanted number; at least one list is read.
SEED_ENTRIES = 8


def product_contexts(products: DataFrame) -> DataFrame:
    """Products with the md5 of the text that is matched, its keywords and flags."""
    parts = [F.when(~tx.empty(c(x)), c(x)) for x in ("name", "category_text", "default_category")]
    context = F.concat_ws(" ", *parts)
    return products.select(
        "row_idx", "code", "name", kw.base_code(c("code")).alias("base"),
        kw.is_non_product(c("name")).alias("non_product"), F.md5(context).alias("ctx"),
        kw.keyword_tokens(context).alias("tokens"))


def context_words(contexts: DataFrame) -> DataFrame:
    """(ctx, word, n_strong, n_weak, accessory) of the distinct texts."""
    distinct = contexts.groupBy("ctx").agg(F.first("tokens").alias("tokens"))
    strong = F.filter("tokens", lambda w: ~kw.is_weak(w))
    weak = F.filter("tokens", kw.is_weak)
    accessory = kw.is_accessory(F.array_join(F.concat(strong, weak), " "))
    words = distinct.withColumn("accessory", accessory).select("ctx", "accessory", F.explode("tokens").alias("word"))
    is_weak = kw.is_weak(c("word"))
    return words.groupBy("ctx", "word").agg(
        F.count_if(~is_weak).alias("n_strong"), F.count_if(is_weak).alias("n_weak"),
        F.first("accessory").alias("accessory"))


def category_words(taxonomy: DataFrame) -> DataFrame:
    """(platform, id, word, leaf_strong, leaf_weak, path_strong) without seasonal categories."""
    path = F.when(~tx.empty(c("full_path")), c("full_path")).otherwise(c("name"))
    kept = taxonomy.filter(~kw.is_seasonal(path))
    mark = lambda source, kind: F.transform(kw.keyword_tokens(source), lambda w: F.struct(
        w.alias("word"), F.lit(kind).alias("kind")))
    words = kept.select("platform", "id", F.explode(F.concat(mark(c("name"), "leaf"), mark(path, "path"))).alias("x")).select(
        "platform", "id", c("x")["word"].alias("word"), c("x")["kind"].alias("kind"))
    weak, leaf = kw.is_weak(c("word")), c("kind") == "leaf"
    flag = lambda cond: F.max(cond.cast("int"))
    return words.groupBy("platform", "id", "word").agg(
        flag(leaf & ~weak).alias("leaf_strong"), flag(leaf & weak).alias("leaf_weak"),
        flag(~leaf & ~weak).alias("path_strong"))


def match_words(product_words: DataFrame, taxonomy_words: DataFrame) -> DataFrame:
    """J09 / P17 on vocabularies: (word, cat_word) that are equal, share a stem, or contain one
    another's stem. Containment is found through the first four letters of the shorter stem."""
    p = product_words.select("word").distinct().withColumn("p_stem", kw.stem(c("word")))
    t = taxonomy_words.select(c("word").alias("cat_word")).distinct().withColumn("t_stem", kw.stem(c("cat_word")))
    same = p.join(t, c("p_stem") == c("t_stem")).select("word", "cat_word")
    head = lambda s: F.left(s, F.lit(4))
    grams = lambda s: F.explode(F.transform(
        F.sequence(F.lit(1), F.length(s) - 3), lambda i: F.substr(s, i, F.lit(4))))
    long_p, long_t = p.filter(F.length("p_stem") >= 4), t.filter(F.length("t_stem") >= 4)
    inside_p = long_p.withColumn("g", grams(c("p_stem"))).join(
        long_t.withColumn("g", head(c("t_stem"))), "g").filter(c("p_stem").contains(c("t_stem"))).select("word", "cat_word")
    inside_t = long_t.withColumn("g", grams(c("t_stem"))).join(
        long_p.withColumn("g", head(c("p_stem"))), "g").filter(c("t_stem").contains(c("p_stem"))).select("word", "cat_word")
    return same.unionByName(inside_p).unionByName(inside_t).distinct()


def category_hits(words: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(word, platform, id, strong_points, weak_points, leaf_strong): what a word of a text brings to each category that it matches."""
    cat_words = category_words(taxonomy)
    hits = match_words(words, cat_words).join(
        cat_words.withColumnRenamed("word", "cat_word"), "cat_word").groupBy("word", "platform", "id").agg(
        F.max("leaf_strong").alias("leaf_strong"), F.max("leaf_weak").alias("leaf_weak"),
        F.max("path_strong").alias("path_strong"))
    return hits.select(
        "word", "platform", "id", F.when(c("leaf_strong") == 1, 100).when(c("path_strong") == 1, 20).otherwise(0).alias("strong_points"),
        F.when((c("leaf_strong") == 1) | (c("leaf_weak") == 1), 5).otherwise(0).alias("weak_points"), "leaf_strong")


def _points() -> list[Column]:
    return [F.sum(c("n_strong") * c("strong_points") + c("n_weak") * c("weak_points")).alias("points"),
            F.sum(c("n_strong") * c("leaf_strong")).alias("strong")]


def _scored(summed: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(ctx, platform, id, score) with score above 0, of points, strong words and the accessory flag."""
    path = F.when(~tx.empty(c("full_path")), c("full_path")).otherwise(c("name"))
    traits = taxonomy.select("platform", "id", kw.is_accessory(tx.normalize_text(c("name"))).alias("cat_accessory"),
                             F.size(F.split(path, "[|>]")).alias("depth"))
    trap = F.when(c("cat_accessory") & ~c("accessory"), 150).otherwise(0)
    base = c("points") - trap
    none, several = c("strong") == 0, c("strong") >= 2
    score = (F.when(none, F.floor(base / 4)).otherwise(base) + F.when(several, c("strong") * BONUS).otherwise(0)
             - F.when(none & (c("depth") > 4), c("depth") * 5).otherwise(0))
    return summed.join(traits, ["platform", "id"]).select("ctx", "platform", "id", score.cast("bigint").alias("score")).filter(
        "score > 0")


def score_categories(words: DataFrame, taxonomy: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """R01 in full: (ctx, platform, id, score) of every category with score above 0."""
    hits = category_hits(words, taxonomy) if hits is None else hits
    # a common word ("set") may occur in a large share of all texts
    summed = spread_join(words, hits, "word", c("ctx")).groupBy("ctx", "platform", "id").agg(
        *_points(), F.first("accessory").alias("accessory"))
    return _scored(summed, taxonomy)


def bounded_words(words: DataFrame, hits: DataFrame) -> DataFrame:
    """(ctx, platform, word, n_strong, n_weak, accessory, entries, bound): how many categories of a platform a word of a
    text matches, and the most that it can add to the score of one."""
    lists = hits.groupBy("word", "platform").agg(
        F.count(F.lit(1)).alias("entries"), F.max("strong_points").alias("_s"), F.max("weak_points").alias("_w"), F.max("leaf_strong").alias("_l"))
    bound = c("n_strong") * (c("_s") + c("_l") * BONUS) + c("n_weak") * c("_w")
    return spread_join(words, lists, "word", c("ctx")).select(
        "ctx", "platform", "word", "n_strong", "n_weak", "accessory", "entries", bound.alias("bound"))


def with_threshold(terms: DataFrame, hits: DataFrame, taxonomy: DataFrame, limit: int) -> DataFrame:
    """``terms`` with ``threshold``, a score that at least ``limit`` categories reach (0 if unknown), whether the word is
    needed to find the best ones, and ``rest``, the most that the other words add together.

    The threshold comes from the rarest words: a text's shortest lists up to SEED_ENTRIES entries. A score above 0 only
    grows with further words, so it is a lower bound. Then the words that bring the least for their entries are put
    aside as long as their bounds add up to less than the threshold: a category that matches only those can't be among the best.
    """
    group = Window.partitionBy("ctx", "platform")
    read = F.sum("entries").over(group.orderBy("entries", "word").rowsBetween(Window.unboundedPreceding, -1))
    seeds = terms.withColumn("_read", F.coalesce(read, F.lit(0))).filter(c("_read") < SEED_ENTRIES * limit).drop("_read")
    scores = _scored(_summed(seeds, hits, []), taxonomy)
    place = F.row_number().over(group.orderBy(c("score").desc()))
    reached = scores.withColumn("_place", place).filter(c("_place") <= limit).filter(c("_place") == limit).select(
        "ctx", "platform", c("score").alias("threshold"))
    least = group.orderBy(c("bound") / c("entries"), "word").rowsBetween(Window.unboundedPreceding, 0)
    marked = terms.join(reached, ["ctx", "platform"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0))).withColumn(
        "needed", F.sum("bound").over(least) >= c("threshold"))
    return marked.withColumn("rest", F.sum(F.when(~c("needed"), c("bound")).otherwise(0)).over(group))


def _summed(terms: DataFrame, hits: DataFrame, kept: list[str]) -> DataFrame:
    """Points per text and category over the given words; ``kept`` are columns that depend on text and platform alone."""
    return spread_join(terms, hits, ["word", "platform"], c("ctx")).groupBy("ctx", "platform", "id").agg(
        *_points(), F.first("accessory").alias("accessory"), *[F.first(x).alias(x) for x in kept])


def best_categories(words: DataFrame, taxonomy: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(ctx, platform, id, score) of at least the ``limit`` best categories, ties included: whole scores of all that may be among them.

    Words that match very many categories are not joined to all of them: categories come from the needed words,
    and the others are looked up for those whose points so far, with all that the others may add, reach the threshold.
    """
    hits = materialise(category_hits(words, taxonomy))
    terms = materialise(with_threshold(materialise(bounded_words(words, hits)), hits, taxonomy, limit))
    found = _summed(terms.filter("needed"), hits, ["threshold", "rest"])
    left = materialise(found.filter(c("points") + c("strong") * BONUS + c("rest") >= c("threshold")).drop("threshold"))
    others = terms.filter(~c("needed")).select("ctx", "platform", "word", "n_strong", "n_weak")
    asked = left.filter("rest > 0").select("ctx", "platform", "id", "accessory").join(others, ["ctx", "platform"])
    more = spread_join(asked, hits, ["word", "platform", "id"], c("ctx")).groupBy("ctx", "platform", "id").agg(
        *_points(), F.first("accessory").alias("accessory"))
    whole = left.drop("rest").unionByName(more).groupBy("ctx", "platform", "id").agg(
        F.sum("points").alias("points"), F.sum("strong").alias("strong"), F.first("accessory").alias("accessory"))
    return _scored(whole, taxonomy)


def top_candidates(scores: DataFrame, taxonomy: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Best categories per text and platform, ties by id; a group is as large as a taxonomy."""
    w = Window.partitionBy("ctx", "platform").orderBy(c("score").desc(), "id")
    ranked = scores.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= limit)
    return ranked.join(taxonomy.select("platform", "id", "name", "full_path"), ["platform", "id"]).select(
        "ctx", "platform", "rank", "id", "name", "full_path", "score")


def candidates(contexts: DataFrame, taxonomy: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    words = materialise(context_words(contexts))
    return top_candidates(best_categories(words, taxonomy, limit), taxonomy, limit)


def _target(confidence: int) -> Column:
    return F.struct(c("id").cast("string").alias("id"), "name", "full_path", F.lit(confidence).alias("confidence"))


def map_products(products: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapped, contexts, candidates).

    ``mapped`` has one row per product: the map platform → category, whether it was inherited, and
    whether it needs review.
    """
    contexts = materialise(product_contexts(products))
    cands = materialise(candidates(contexts, taxonomy))
    platforms = taxonomy.agg(F.count_distinct("platform")).scalar()
    accepted = (c("rank") == 1) & (c("score") >= ACCEPT_SCORE)
    per_ctx = cands.groupBy("ctx").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(accepted, F.struct("platform", _target(80)))))).alias("own"),
        F.count_if(accepted).alias("n_accepted"))
    sizes = contexts.groupBy("ctx").agg(F.count(F.lit(1)).alias("ctx_size")).join(per_ctx, "ctx", "left")
    rows = attach_groups(contexts.drop("tokens"), sizes, "ctx", "ctx_size").withColumns({
        "n_accepted": F.coalesce("n_accepted", F.lit(0)),
        "has_candidates": c("own").isNotNull(),
    }).withColumn("low", c("n_accepted") < platforms)
    usable = ~c("non_product") & (c("n_accepted") > 0)
    # A variant takes the mapping of its base product, else of the first mapped sibling
    bases = rows.filter(c("base").isNull() & usable).groupBy(c("code").alias("base")).agg(
        F.max_by("own", "row_idx").alias("base_map"))
    siblings = rows.filter(c("base").isNotNull()).groupBy("base").agg(
        F.count(F.lit(1)).alias("n_variants"), F.min(F.when(usable, c("row_idx"))).alias("sib_idx"),
        F.min_by("own", F.when(usable, c("row_idx"))).alias("sib_map")).join(bases, "base", "left")
    joined = attach_groups(rows, siblings, "base", "n_variants")
    from_base = c("base").isNotNull() & c("base_map").isNotNull()
    from_sibling = c("base").isNotNull() & (c("sib_idx") < c("row_idx"))
    inherited = ~c("non_product") & F.coalesce(from_base | from_sibling, F.lit(False))
    own = F.when(c("n_accepted") > 0, c("own"))
    mapping = F.when(c("non_product"), None).when(inherited, F.coalesce("base_map", "sib_map")).otherwise(own)
    mapped = joined.select(
        "row_idx", "code", "name", "base", "ctx", "non_product", inherited.alias("inherited"), mapping.alias("mapping"),
        (~c("non_product") & ~inherited & c("low") & c("has_candidates")).alias("needs_review"))
    return materialise(mapped), contexts, cands


def long_mapping(mapped: DataFrame) -> DataFrame:
    """(row_idx, code, platform, id, name, full_path, confidence)."""
    return mapped.select("row_idx", "code", F.explode("mapping").alias("platform", "m")).select(
        "row_idx", "code", "platform", "m.id", "m.name", "m.full_path", "m.confidence")


def review_queue(mapped: DataFrame, cands: DataFrame, products: DataFrame) -> DataFrame:
    """Products to review in batches of ten, base products first, with their candidates."""
    queue = mapped.filter("needs_review").select("row_idx", "code", "name", "ctx", c("base").isNotNull().cast("int").alias("v"))
    placed = number_rows(queue, [], c("v"), "row_idx", "position", descending=False)
    shown = cands.filter(c("rank") <= SHOWN_CANDIDATES).groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct(
        "platform", "rank", "id", "full_path"))).alias("candidates"))
    sizes = placed.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).join(shown, "ctx")
    texts = products.select("row_idx", c("category_text"), tx.review_text(
        c("description"), c("short_description")).alias("review_text"))
    return attach_groups(placed, sizes, "ctx", "n").join(texts, "row_idx").select(
        "row_idx", "code", "name", "category_text", "review_text", "position",
        F.floor((c("position") - 1) / REVIEW_BATCH).cast("bigint").alias("batch_id"), "candidates")


def apply_choices(mapping: DataFrame, choices: DataFrame, contexts: DataFrame, cands: DataFrame) -> DataFrame:
    """A chosen id counts only if it was a candidate for the product; confidence 90."""
    asked = choices.select("row_idx", "platform", c("chosen_id").cast("string").alias("id"))
    valid = asked.join(contexts.select("row_idx", "code", "ctx"), "row_idx").join(
        cands.select("ctx", "platform", c("id").cast("string").alias("id"), "name", "full_path"),
        ["ctx", "platform", "id"]).select(
        "row_idx", "code", "platform", "id", "name", "full_path", F.lit(90).alias("confidence"))
    return mapping.join(valid.select("row_idx", "platform"), ["row_idx", "platform"], "left_anti").unionByName(valid)


def manual_overrides(mapping: DataFrame, edits: DataFrame) -> DataFrame:
    """An edit replaces the category (confidence 100), a blank edit removes it."""
    e = edits.select("row_idx", "code", "platform", tx.trim_ws(tx.text(c("value"))).alias("id"))
    manual = e.filter("id <> ''").select("row_idx", "code", "platform", "id", F.lit("Manual").alias("name"),
                                         F.lit("Manual entry").alias("full_path"), F.lit(100).alias("confidence"))
    return mapping.join(e.select("row_idx", "platform"), ["row_idx", "platform"], "left_anti").unionByName(manual)


def simple_matches(products: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The single best category per product and platform, confidence 75."""
    contexts = product_contexts(products)
    best = candidates(contexts, taxonomy, 1).groupBy("ctx").agg(F.collect_list(F.struct(
        "platform", c("id").cast("string").alias("id"), "name", "full_path")).alias("best"))
    sizes = contexts.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).join(best, "ctx", "left")
    rows = attach_groups(contexts.select("row_idx", "code", "ctx"), sizes, "ctx", "n")
    return rows.select("row_idx", "code", F.explode("best").alias("b")).select(
        "row_idx", "code", "b.platform", "b.id", "b.name", "b.full_path", F.lit(75).alias("confidence"))


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """Products mapped per platform."""
    return mapping.groupBy("platform").agg(F.count_distinct("row_idx").alias("mapped"))


def wide_mapping(products: DataFrame, mapping: DataFrame, platforms: list[str]) -> DataFrame:
    """New category id if mapped, else the existing one; the google id also fills its feed column."""
    ids = mapping.groupBy("row_idx").pivot("platform", platforms).agg(F.first("id"))
    joined = products.join(ids, "row_idx", "left")
    out = []
    for p in platforms:
        old = f"{p}CategoryId"
        keep = F.nullif(tx.text(c(old)), F.lit("")) if old in products.columns else F.lit(None).cast("string")
        out.append(F.coalesce(c(p), keep).alias(old))
        if p == "google":
            feed = f"{p}CategoryIdInFeed"
            kept = c(feed) if feed in products.columns else F.lit(None).cast("string")
            out.append(F.when(c(p).isNotNull(), c(p)).when(keep.isNotNull(), kept).alias(feed))
    return joined.select("row_idx", "code", "name", "category_text", "default_category", *out)
