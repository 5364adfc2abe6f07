"""Related and alternative products.

The products of a group (main category, subcategory or category text) stand on a ring in seeded order. A
product's candidates are those that follow it, so links are drawn from the whole group and every
product is linked about equally often, in groups of any size. Rings are cut into blocks of bounded size; a
product meets its own block and the next one, never its whole group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions import category as cg
from stocklens.functions.values import one_decimal, round_half_up
from stocklens.operators.keyed import attach_groups
from stocklens.session import materialise

c = F.col

MAX_LINKS = 10  # links of a full list
RING_BLOCK = 256  # members of a ring block, at least; a block has fewer than twice as many
NUMBER_ROWS = 20_000  # rows that one task numbers, about


@dataclass(frozen=True)
class LinkSettings:
    related: bool = True
    alternative: bool = True
    related_count: int = MAX_LINKS
    alternative_count: int = MAX_LINKS
    seed: str = "fixture"

    def __post_init__(self):
        if not (1 <= self.related_count <= RING_BLOCK // 8 and 1 <= self.alternative_count <= RING_BLOCK // 8):
            raise ValueError(f"link counts lie between 1 and {RING_BLOCK // 8}")

    @property
    def r(self) -> int:
        return self.related_count if self.related else 0

    @property
    def a(self) -> int:
        return self.alternative_count if self.alternative else 0

    @property
    def pool(self) -> int:
        """Candidates of a kind that are enough: each pick uses up one, and the product itself is skipped."""
        return self.r + self.a + 1


def link_rows(products: DataFrame, default_category: str = "default_category") -> DataFrame:
    return products.select(
        "row_idx", "code", cg.main_category(c(default_category)).alias("main"),
        cg.sub_category(c(default_category)).alias("sub"),
        F.array_distinct(cg.category_texts(products.columns)).alias("texts"))


def ring_neighbours(rows: DataFrame, group: str, seed: str, want: int, asking: Column | None = None) -> DataFrame:
    """``rows`` with ``near``: the next ``want`` members of the group after each row, around the ring.

    ``rows`` has (group, code, sub, member); members are distinct. Rows that are no members stand at their place
    on the ring without being a neighbour of others; with ``asking`` only the rows where it holds come out. Places are numbered by
    blocks of a hash range whose sizes are added up first, so no task orders a whole group. A block is moved once with the
    members that follow it, and a row only takes its own slice of it: no row carries a block into another shuffle.
    """
    rows = materialise(rows.withColumn("key", F.md5(F.concat(F.lit(seed), c("code")))))
    ranges = max(1, -(-rows.count() // NUMBER_ROWS))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * ranges).cast("bigint"))
    of_group = Window.partitionBy(group)
    sizes = rows.groupBy(group, "range").agg(F.sum(c("member").cast("int")).alias("m")).withColumns({
        "n": F.sum("m").over(of_group),
        "before": F.coalesce(F.sum("m").over(of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    inside = Window.partitionBy(group, "range").orderBy("key", "code", c("sub").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(rows.join(sizes.drop("m"), [group, "range"]).withColumn(
        "place", c("before") + F.coalesce(F.sum(c("member").cast("int")).over(inside), F.lit(0))).filter("n > 0").select(
        group, "code", "sub", "member", "n", "place", F.expr(f"greatest(1, n div {RING_BLOCK})").alias("blocks")))
    blocks = materialise(placed.filter("member").groupBy(group, F.expr("place * blocks div n").alias("block")).agg(
        F.first("blocks").alias("blocks"), F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "code", "sub"))).alias("m")).select(
        group, "block", "first", ((c("block") + 1) % c("blocks")).alias("after"), F.transform("m", lambda x: F.struct(
            x["code"].alias("code"), x["sub"].alias("sub"))).alias("m")))
    nexts = blocks.select(group, c("block").alias("after"), F.slice("m", 1, want).alias("follow"))
    # the only block of a ring goes on with itself: the members before a row stand behind those after it
    follow = F.when(c("block") == c("after"), c("m")).otherwise(c("follow"))
    rings = blocks.join(nexts, [group, "after"]).select(group, "block", "first", F.concat("m", follow).alias("m"))
    start = F.when(c("member"), (c("place") + 1) % c("n")).otherwise(c("place") % c("n"))
    asked = placed if asking is None else placed.filter(asking)
    asked = asked.withColumn("start", start).select(
        group, "code", "sub", "start", F.least("n", F.lit(want)).cast("int").alias("want"), F.expr("start * blocks div n").alias("block"))
    return asked.join(rings, [group, "block"]).select(
        group, "code", "sub", F.slice("m", (c("start") - c("first") + 1).cast("int"), c("want")).alias("near"))


def related_candidates(rows: DataFrame, settings: LinkSettings) -> DataFrame:
    """(row_idx, related): other subcategories of the main category first, then the own one.

    The neighbours on the ring of the main category give both. Where one subcategory is the largest of its main
    category, its products also see the ring of all others, and every product sees the ring of its own.
    """
    listed = rows.filter(c("main").isNotNull())
    members = materialise(listed.select("main", "sub", "code").distinct())
    per_sub = members.filter(c("sub").isNotNull()).groupBy("main", "sub").agg(F.count(F.lit(1)).alias("k"))
    largest = per_sub.groupBy("main").agg(F.max_by("sub", F.struct("k", "sub")).alias("largest"))
    flagged = materialise(members.join(largest, "main", "left"))
    seed, want, wide = settings.seed, settings.pool, 8 * settings.pool
    ring = ring_neighbours(flagged.select("main", "code", "sub", F.lit(True).alias("member")), "main", seed, wide)
    is_largest = c("sub").eqNullSafe(c("largest")) & c("sub").isNotNull()
    far = ring_neighbours(flagged.filter(c("sub").isNotNull()).select("main", "code", "sub", (~is_largest).alias("member")),
                          "main", seed, want, asking=~c("member"))
    own = ring_neighbours(flagged.select(F.concat_ws("\u0001", "main", F.coalesce("sub", F.lit("\u0002"))).alias("ms"), "code", "sub",
                                         F.lit(True).alias("member")), "ms", seed, want)
    other = lambda x: F.coalesce(x["sub"] != c("sub"), F.lit(False))
    codes = lambda xs: F.slice(F.array_distinct(F.transform(xs, lambda x: x["code"])), 1, want)
    # each ring is cut to the codes that can still be taken before it moves: the first ``want`` of a kind
    part = lambda df, main, far, own: df.select(
        main.alias("main"), F.coalesce("sub", F.lit("\u0002")).alias("s"), "code",
        codes(F.filter("near", lambda x: (x["code"] != c("code")) & other(x))).alias(far),
        codes(F.filter("near", lambda x: (x["code"] != c("code")) & ~other(x))).alias(own))
    ring = part(ring, c("main"), "other", "same")
    far = part(far, c("main"), "far", "_").drop("_")
    own = part(own, F.split_part("ms", F.lit("\u0001"), F.lit(1)), "_", "own").drop("_")
    found = ring.join(far, ["main", "s", "code"], "left").join(own, ["main", "s", "code"], "left")
    none = F.array().cast("array<string>")
    joined = lambda a, b: F.slice(F.array_distinct(F.concat(a, F.coalesce(b, none))), 1, want)
    lists = found.select("main", "s", "code", F.array_distinct(F.concat(joined("other", "far"), joined("same", "own"))).alias("related"))
    return listed.withColumn("s", F.coalesce("sub", F.lit("\u0002"))).join(lists, ["main", "s", "code"]).select("row_idx", "related")


def _ordered(seed: str, candidates: Column) -> Column:
    """Distinct candidate codes in an order of the product's own."""
    keyed = F.transform(F.array_distinct(candidates), lambda x: F.struct(
        F.md5(F.concat(F.lit(seed), c("code"), F.lit("|"), x)).alias("h"), x.alias("code")))
    return F.transform(F.array_sort(keyed), lambda x: x["code"])


def alternative_candidates(rows: DataFrame, settings: LinkSettings) -> DataFrame:
    """(row_idx, alternative): products that share a category text."""
    exploded = materialise(rows.select("row_idx", "code", F.explode("texts").alias("text")))
    members = exploded.select("text", "code", F.lit(None).cast("string").alias("sub"), F.lit(True).alias("member")).distinct()
    near = ring_neighbours(members, "text", settings.seed, settings.pool).select(
        "text", "code", F.transform("near", lambda x: x["code"]).alias("near"))
    # a product has as many rows here as it has category texts
    merged = exploded.join(near, ["text", "code"]).groupBy("row_idx").agg(
        F.first("code").alias("code"), F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("row_idx", F.slice(_ordered(settings.seed, F.filter("near", lambda x: x != c("code"))), 1, settings.pool).alias("alternative"))


def assign(related: Column, alternative: Column, r: int, a: int) -> Column:
    """Picks in turns (related, alternative, related, …), each code once, then fills up."""
    start = F.struct(F.array().cast("array<string>").alias("rel"), F.array().cast("array<string>").alias("alt"))

    def used(s: Column) -> Column:
        return F.concat(s["rel"], s["alt"])

    def step(s: Column, i: Column) -> Column:
        take_rel = (i % 2 == 0) & (F.size(s["rel"]) < r)
        take_alt = (i % 2 == 1) & (F.size(s["alt"]) < a)
        return F.struct(
            F.when(take_rel, F.concat(s["rel"], F.slice(F.array_except(related, used(s)), 1, 1))).otherwise(s["rel"]).alias("rel"),
            F.when(take_alt, F.concat(s["alt"], F.slice(F.array_except(alternative, used(s)), 1, 1))).otherwise(s["alt"]).alias("alt"))

    def fill(s: Column) -> Column:
        rel = F.concat(s["rel"], F.slice(F.array_except(related, used(s)), F.lit(1), F.lit(r) - F.size(s["rel"])))
        alt = F.concat(s["alt"], F.slice(F.array_except(alternative, F.concat(rel, s["alt"])), F.lit(1),
                                         F.lit(a) - F.size(s["alt"])))
        return F.struct(rel.alias("rel"), alt.alias("alt"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(r + a - 1)), start, step, fill)


def link_products(products: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """(row_idx, code, related array, alternative array) for every product."""
    rows = materialise(link_rows(products))
    none = F.array().cast("array<string>")
    out = rows
    if settings.r:
        out = out.join(related_candidates(rows, settings), "row_idx", "left")
    if settings.a:
        out = out.join(alternative_candidates(rows, settings), "row_idx", "left")
    rel = F.coalesce("related", none) if settings.r else none
    alt = F.coalesce("alternative", none) if settings.a else none
    picked = out.select("row_idx", "code", rel.alias("_r"), alt.alias("_a")).withColumn(
        "_p", assign(c("_r"), c("_a"), settings.r, settings.a))
    return picked.select("row_idx", "code", c("_p")["rel"].alias("related"), c("_p")["alt"].alias("alternative"))


def wide_links(products: DataFrame, links: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """Original columns in order, then the link columns padded with ''."""
    original = [F.coalesce(c(x).cast("string"), F.lit("")).alias(x) for x in products.columns]
    wide = []
    for base, arr, k in (("relatedProduct", "related", settings.r), ("alternativeProduct", "alternative", settings.a)):
        wide += [F.coalesce(F.get(c(arr), F.lit(i)), F.lit("")).alias(base if i == 0 else f"{base}{i + 1}") for i in range(k)]
    joined = products.join(links.select("row_idx", "related", "alternative"), "row_idx", "left")
    return joined.select(*original, *wide)


def _other_codes(rows: DataFrame) -> DataFrame:
    """(ms, size, others): rows of each subcategory ``ms``, and codes that its main category has in other subcategories."""
    placed = rows.filter(c("main").isNotNull() & c("sub").isNotNull())
    # a code that stands in one subcategory only is no other one there
    codes = placed.filter(c("code").isNotNull()).groupBy("main", "code").agg(F.min("sub").alias("lo"), F.max("sub").alias("hi"))
    only = codes.groupBy("main", F.when(c("lo") == c("hi"), c("lo")).alias("sub")).agg(F.count(F.lit(1)).alias("k"))
    every = only.groupBy("main").agg(F.sum("k").alias("codes"))
    sizes = placed.groupBy("main", "sub").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(every, "main", "left").join(only, ["main", "sub"], "left").select(
        _place("main", "sub").alias("ms"), "size", (F.coalesce("codes", F.lit(0)) - F.coalesce("k", F.lit(0))).alias("others"))


def _place(main: str, sub: str) -> Column:
    return F.when(c(sub).isNotNull(), F.concat(c(main), F.lit("\u0001"), c(sub)))


def rules_broken(rows: DataFrame, links: DataFrame) -> DataFrame:
    """One row (products, repeated, bad_related, bad_alternative): links against the rules, from the rows of :func:`link_rows`.

    ``repeated`` counts products with a code twice in their lists. A link is bad when it leads to the product itself, to no product,
    or to one that shares neither main category (related) nor category text (alternative). Other subcategories come first:
    a related link that is in none is bad too where one that is stands after it, or is left that neither list has.
    """
    # what a product has joins its links before they are unfolded: its rows move once, not ten times
    own = links.join(rows.select("row_idx", "main", "sub", "texts", _place("main", "sub").alias("ms")), "row_idx")
    own = attach_groups(own, materialise(_other_codes(rows)), "ms", "size")
    by_code = rows.groupBy(c("code").alias("target")).agg(
        F.collect_set(F.struct("main", "sub")).alias("places"), F.flatten(F.collect_set("texts")).alias("target_texts"))
    # the product itself goes with its links, to learn whether its code stands in another subcategory as well
    kinds = lambda kind, codes: F.transform(codes, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("target")))
    met = own.select("row_idx", "code", "main", "sub", "texts", "others", F.inline(F.concat(
        kinds("r", c("related")), kinds("a", c("alternative")), kinds("s", F.array("code"))))).select(
        "row_idx", "code", "main", "sub", "kind", "at", "target", F.when(c("kind") == "a", c("texts")).alias("texts"),
        F.when(c("kind") == "s", c("others")).alias("others")).join(by_code, "target", "left")
    holds = lambda x: F.coalesce(x, F.lit(False))
    apart = F.exists("places", lambda p: (p["main"] == c("main")) & (p["sub"] != c("sub")))
    shares = F.when(c("kind") == "r", F.exists("places", lambda p: p["main"] == c("main"))).otherwise(F.arrays_overlap("texts", "target_texts"))
    checked = met.select("row_idx", "kind", "at", "others", holds(apart).alias("other"),
                         (c("code").eqNullSafe(c("target")) | ~holds(shares)).alias("bad"))
    related = c("kind") == "r"
    of_product = checked.groupBy("row_idx").agg(
        F.count_if(related & c("bad")).alias("r"), F.count_if((c("kind") == "a") & c("bad")).alias("a"),
        F.max(F.when(related & c("other"), c("at"))).alias("last"),
        F.collect_list(F.when(related & ~c("other") & ~c("bad"), c("at"))).alias("same"),
        (F.coalesce(F.max("others"), F.lit(0)) - F.count_if(c("other"))).alias("left"))
    early = F.when(c("left") > 0, F.size("same")).otherwise(F.size(F.filter("same", lambda i: i < c("last"))))
    broken = of_product.agg(F.coalesce(F.sum(c("r") + early), F.lit(0)).alias("r"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    both = F.concat("related", "alternative")
    return links.agg(F.count(F.lit(1)).alias("products"),
                     F.count_if(F.size(F.array_distinct(both)) < F.size(both)).alias("repeated")).crossJoin(broken).select(
        "products", "repeated", c("r").alias("bad_related"), c("a").alias("bad_alternative"))


def link_stats(rows: DataFrame) -> DataFrame:
    """Products, main categories, category texts."""
    texts = rows.select(F.explode("texts").alias("t")).agg(F.count_distinct("t"))
    return rows.agg(F.count(F.lit(1)).alias("total_products"), F.count_distinct("main").alias("main_categories")).select(
        "*", texts.scalar().alias("category_texts"))


def with_link_counts(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(links.select("row_idx", F.size("related").alias("n_related"),
                                  F.size("alternative").alias("n_alternative")), "row_idx")


def link_summary(counted: DataFrame) -> DataFrame:
    """Means, share of full lists, short lists, products without category text."""
    n = F.count(F.lit(1))
    share = lambda x: round_half_up(F.count_if(x) * 100.0 / F.nullif(n, F.lit(0))).cast("int")
    return counted.agg(
        n.alias("total_products"),
        one_decimal(F.avg("n_related")).alias("avg_related"),
        one_decimal(F.avg("n_alternative")).alias("avg_alternative"),
        share(c("n_related") == MAX_LINKS).alias("full_related_percent"),
        share(c("n_alternative") == MAX_LINKS).alias("full_alternative_percent"),
        F.count_if(c("n_related") < 3).alias("low_related"),
        F.count_if(c("n_alternative") < 3).alias("low_alternative"),
        F.count_if(F.size("texts") == 0).alias("without_category_text"))


def category_link_means(counted: DataFrame, by: str = "main") -> DataFrame:
    return counted.filter(c(by).isNotNull()).groupBy(c(by).alias("name")).agg(
        F.count(F.lit(1)).alias("products"), one_decimal(F.avg("n_related")).alias("avg_related"),
        one_decimal(F.avg("n_alternative")).alias("avg_alternative"), F.min("row_idx").alias("first_idx"))


def largest_categories(counted: DataFrame, n: int = 5) -> DataFrame:
    return category_link_means(counted).orderBy(c("products").desc(), "first_idx").limit(n)


def small_categories(counted: DataFrame, n: int = 5) -> DataFrame:
    return category_link_means(counted).filter("products < 10").orderBy(c("products").desc(), "first_idx").limit(n)


def best_linked_categories(counted: DataFrame, n: int = 3) -> DataFrame:
    return category_link_means(counted).filter("products >= 5").orderBy(
        c("avg_related").desc(), c("products").desc(), "first_idx").limit(n)


def single_product_subcategories(counted: DataFrame, n: int = 5) -> DataFrame:
    return category_link_means(counted, "sub").filter("products = 1").orderBy("first_idx").limit(n)


def best_linked_subcategories(counted: DataFrame, n: int = 3) -> DataFrame:
    return category_link_means(counted, "sub").filter("products >= 3").orderBy(
        c("avg_related").desc(), "first_idx").limit(n)
