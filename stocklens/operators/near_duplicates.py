"""Products whose descriptions share more than 80 % of their words. Exact, no cap.

Prefix filtering on word sets: two sets of Jaccard similarity above t share a word among the
rarest ``n - ceil(t*n) + 1`` words of each. Only those words are joined on, inside bands of similar
set size, and a positional bound drops pairs that cannot reach the threshold. Remaining pairs are
verified on the full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions import text as tx
from stocklens.operators.issues import WARNING, AuditParams, as_issues
from stocklens.operators.keyed import attach_groups, spread_join
from stocklens.operators.products import product_rows
from stocklens.session import materialise

c = F.col

# The threshold 0.8 as a fraction, so that all bounds are whole numbers.
NUM, DEN = 4, 5
# Rows of one part of a word's list; about twice as many at most. Two parts meet in a cell, so a cell is bounded too.
LIST_ROWS = 4_000
# Sets of one block of a cell, about; a cell compares two blocks.
CELL_SETS = 256
# Buckets of word hashes whose counts put words in order; the driver holds one byte of each.
BUCKETS = 2**18
# Sets of each list that all others of the list are compared with, before the rest is compared.
STARS = 2


def word_tokens() -> Column:
    """``tokens`` of product rows: sorted 64-bit hashes of the distinct words of descriptions over 50 characters, normalised."""
    norm = F.lower(c("desc_plain"))
    tokens = F.array_sort(F.array_distinct(F.transform(
        F.filter(tx.plain_words(norm), lambda w: F.length(w) > 2), lambda w: F.xxhash64(w))))
    return F.when(F.length(norm) > 50, tokens).alias("tokens")


def word_sets(rows: DataFrame) -> DataFrame:
    """Rows (row_idx, code, name, h, n, tokens, class_id) from written ones (:func:`written_words`)."""
    # 128 bits over the sorted word set name the class of texts with the same words
    class_id = F.concat_ws("/", F.xxhash64("tokens"), F.xxhash64(F.lit(1), "tokens"))
    return rows.select("row_idx", "code", "name", "h", F.size("tokens").alias("n"), "tokens", class_id.alias("class_id"))


def written_words(catalog: DataFrame) -> DataFrame:
    """Written rows (row_idx, code, name, h, tokens); ``h`` is the md5 of a normalised description of over 50 characters.

    The texts are read once; from then on words travel as 64-bit hashes and texts as md5. The
    table is written before it is filtered, because a filter on the word set would be pushed
    below the projection and compute it twice.
    """
    norm = F.lower(c("desc_plain"))
    return materialise(product_rows(catalog).select(
        "row_idx", "code", "name", F.when(F.length(norm) > 50, F.md5(norm)).alias("h"), word_tokens()))


def unique_texts(rows: DataFrame) -> DataFrame:
    """Texts that exactly one product has, without their word sets."""
    once = rows.filter("h is not null").groupBy("h").agg(
        F.count(F.lit(1)).alias("m"), F.min("row_idx").alias("row_idx")).filter("m = 1").select("row_idx")
    return rows.filter("n > 0").select("row_idx", "code", "name", "class_id").join(once, "row_idx", "left_semi")


def word_classes(texts: DataFrame) -> DataFrame:
    """Products with the same word set, each linked to the first product of its class."""
    keyed = texts.select("row_idx", "class_id")
    sizes = keyed.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("class_size"), F.min("row_idx").alias("first_idx"))
    return attach_groups(keyed, sizes, "class_id", "class_size")


def _word_ranks(sets: DataFrame) -> Column:
    """One byte for each bucket of word hashes: how often its words occur, on a scale of fourth roots of two."""
    counts = sets.select(F.explode("toks").alias("tok")).groupBy(F.pmod("tok", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(
        F.floor(F.log2(F.count(F.lit(1))) * 4).cast("int").alias("rank")).toArrow()
    ranks = bytearray(BUCKETS)
    for bucket, rank in zip(counts["bucket"].to_pylist(), counts["rank"].to_pylist()):
        ranks[bucket] = rank
    return F.lit(bytes(ranks))


def _prefix_size(n: Column) -> Column:
    return n - F.floor((n * NUM + DEN - 1) / DEN).cast("int") + 1


def prefix_sets(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """(row_idx, n, toks) of the sets in ``firsts``: the words of their prefixes, those of rare buckets first (ties by hash).

    Any order that is the same for all sets is right; this one needs no join by words. Whole sets do not move: the prefix is
    cut first, and an inner join is not pushed below the projection as a semi join would be.
    """
    ranks = _word_ranks(sets)
    rank = lambda w: F.substr(ranks, (F.pmod(w, F.lit(BUCKETS)) + 1).cast("int"), F.lit(1))
    ordered = F.array_sort(F.transform("toks", lambda w: F.struct(rank(w).alias("rank"), w.alias("tok"))))
    cut = sets.select("row_idx", "n", F.transform(F.slice(ordered, F.lit(1), _prefix_size(c("n"))), lambda x: x["tok"]).alias("toks"))
    return cut.join(firsts.distinct(), "row_idx")


def _band(n: Column) -> Column:
    """Sizes within a factor of 5/4 of each other fall into the same or the next band."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")


def word_lists(sets: DataFrame) -> DataFrame:
    """Rows (tok, g, row_idx, n, pos, band, block, k, part, parts): sets by the words of their prefixes.

    A list (tok, g) holds the sets of band g and, as possible smaller partners, those of the band before. Words of one set and
    bands without a partner are dropped before lists are written; ``k`` sets have the word. A list
    longer than LIST_ROWS is cut into parts in the order (n, block), by running sums over the counts of its
    blocks; ``parts`` is their number. Blocks divide all sets by hash, so no key of a join here is hot.
    """
    blocks = F.greatest(F.ceil(sets.agg(F.count(F.lit(1))).scalar() * 2 / F.lit(LIST_ROWS)), F.lit(1))
    words = sets.select("row_idx", "n", _band(c("n")).alias("band"), F.posexplode(F.slice("toks", F.lit(1), _prefix_size(c("n")))).alias("pos", "tok"))
    # bands from 62 on share a bit, so a list may hold a row without a partner, but never lacks one
    bit = lambda band: F.expr(f"shiftleft(1L, least(greatest({band}, 0), 62))")
    known = materialise(words.groupBy("tok").agg(F.count(F.lit(1)).alias("k"), F.bit_or(bit("band")).alias("bands")).filter("k > 1"))
    own = (c("bands").bitwiseAND(bit("band - 1")) != 0) | (c("k") > F.bit_count("bands"))
    after = c("bands").bitwiseAND(bit("band + 1")) != 0
    rows = materialise(attach_groups(words, known, "tok", "k").filter("k is not null").select(
        "row_idx", "n", "band", "pos", "tok", "k", F.pmod(F.xxhash64("row_idx"), blocks).alias("block"),
        F.explode(F.array_compact(F.array(F.when(own, c("band")), F.when(after, c("band") + 1)))).alias("g")))
    many = rows.filter(c("k") > LIST_ROWS)  # only these can be in long lists
    long_lists = many.groupBy("tok", "g").agg(F.count(F.lit(1)).alias("total")).filter(c("total") > LIST_ROWS)
    counts = many.join(long_lists, ["tok", "g"]).groupBy("tok", "g", "total", "n", "block").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("tok", "g").orderBy("n", "block").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("m").over(before), F.lit(0)) / F.lit(LIST_ROWS))
    cuts = counts.select("tok", "g", "n", "block", part.cast("int").alias("part"),
                         F.ceil(c("total") / F.lit(LIST_ROWS)).cast("int").alias("parts"))
    cut = many.join(cuts, ["tok", "g", "n", "block"], "left").withColumns({
        "part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1))})
    return rows.filter(c("k") <= LIST_ROWS).withColumns({"part": F.lit(0), "parts": F.lit(1)}).unionByName(cut)


def _may_be_similar(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Bounds by the sizes of two sets and the places of a shared word; similarity > 4/5  <=>  9 * shared > 4 * (n1 + n2)."""
    rest = F.least(n1 - p1, n2 - p2)
    return ((F.least(n1, n2) * DEN > F.greatest(n1, n2) * NUM) & (rest * (NUM + DEN) > (n1 + n2) * NUM))


def candidate_pairs(lists: DataFrame, different: str | None = None) -> DataFrame:
    """(i1, i2, cell) that share a word of their prefixes within the bounds; with ``different``, a column that must differ.

    ``cell`` is the same for pairs that are compared together: those of a word and two blocks of its sets.
    The part pairs of a list are cells of a triangle: a row meets the parts from its own on as the smaller set,
    and those up to its own as the larger one, so no cell holds more than two parts, however long the list is.
    """
    side = lambda k: [c("row_idx").alias(f"i{k}"), c("n").alias(f"n{k}"), c("pos").alias(f"p{k}"), c("block").alias(f"b{k}"),
                      *([c(different).alias(f"d{k}")] if different else [])]
    smaller = lists.select("tok", "g", "k", c("part").alias("lo"), F.explode(F.sequence("part", c("parts") - 1)).alias("hi"), *side(1))
    larger = lists.filter(c("band") == c("g")).select(
        "tok", "g", F.explode(F.sequence(F.lit(0), "part")).alias("lo"), c("part").alias("hi"), *side(2))
    # the order of the parts decides which of two sets of one size is the smaller one
    ordered = F.struct("n1", "b1", "i1") < F.struct("n2", "b2", "i2")
    met = smaller.join(larger, ["tok", "g", "lo", "hi"]).filter(
        ordered & _may_be_similar(c("n1"), c("p1"), c("n2"), c("p2")) & ((c("d1") != c("d2")) if different else F.lit(True)))
    of_cell = lambda i: F.pmod(F.xxhash64(i), F.ceil(c("k") / F.lit(CELL_SETS)))
    return met.groupBy("i1", "i2").agg(F.min(F.xxhash64("tok", of_cell("i1"), of_cell("i2"))).alias("cell"))


def star_candidates(lists: DataFrame) -> DataFrame:
    """(i1, i2, cell) of each set and STARS sets of its part of a list: at most so many rows for each row of a list."""
    of_part = Window.partitionBy("tok", "g", "part")
    star = lambda i: F.first(F.struct("row_idx", "n", "pos")).over(of_part.orderBy(F.xxhash64("row_idx", F.lit(i)), "row_idx"))
    met = lists.withColumns({f"star{i}": star(i) for i in range(STARS)}).select(
        "row_idx", "n", "pos", "k", F.explode(F.array_distinct(F.array(*[f"star{i}" for i in range(STARS)]))).alias("star")).filter(
        (c("row_idx") != c("star.row_idx")) & _may_be_similar(c("n"), c("pos"), c("star.n"), c("star.pos")))
    block = F.pmod(F.xxhash64("row_idx"), F.ceil(c("k") / F.lit(CELL_SETS)))
    return met.groupBy(F.least("row_idx", "star.row_idx").alias("i1"), F.greatest("row_idx", "star.row_idx").alias("i2")).agg(
        F.min(F.xxhash64("star.row_idx", block)).alias("cell"))


def _sketch(words: Column) -> Column:
    """About every fourth word, as its place among 65,536 buckets. Each bucket that only one of two sketches has stands for
    a word that only one of the sets has, so sketches never show more differences than there are.
    """
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.pmod(w, F.lit(4)) == 0), lambda w: (
        F.pmod(F.shiftright(w, 8), F.lit(65536)) - 32768).cast("smallint")))


def _in_cells(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs`` (i1, i2, cell) with the sizes n1, n2 of the whole sets, w1, w2 of their ``words`` and of the ``shared`` ones.

    A set is sent once to each cell that compares it, not once for each pair.
    """
    asked = materialise(pairs.select("cell", F.explode(F.array("i1", "i2")).alias("row_idx")).distinct())
    sent = asked.join(words, "row_idx").groupBy("cell", "row_idx").agg(F.min(F.struct("n", "words")).alias("s"))
    held = sent.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("row_idx", "s"))).alias("held"))
    compared = pairs.groupBy("cell").agg(F.collect_list(F.struct("i1", "i2")).alias("pairs")).join(held, "cell")
    of = lambda i: c("held")[i]
    return compared.select("cell", F.inline(F.transform("pairs", lambda p: F.struct(
        p["i1"].alias("i1"), p["i2"].alias("i2"), of(p["i1"])["n"].alias("n1"), of(p["i2"])["n"].alias("n2"),
        F.size(of(p["i1"])["words"]).alias("w1"), F.size(of(p["i2"])["words"]).alias("w2"),
        F.size(F.array_intersect(of(p["i1"])["words"], of(p["i2"])["words"])).alias("shared")))))


def verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, union_n) of the candidates (i1, i2, cell) with similarity above 0.8, by whole sets.

    Sketches go first: similarity > 4/5  <=>  9 * differences < n1 + n2, and pairs whose sketches differ more are done with.
    """
    candidates = materialise(candidates)
    sketched = _in_cells(candidates, sets.select("row_idx", "n", _sketch(c("toks")).alias("words")))
    close = materialise(sketched.filter(
        (c("w1") + c("w2") - c("shared") * 2) * (NUM + DEN) < (c("n1") + c("n2")) * (DEN - NUM)).select("i1", "i2", "cell"))
    both = _in_cells(close, sets.select("row_idx", "n", c("toks").alias("words")))
    return both.filter(c("shared") * (NUM + DEN) > (c("n1") + c("n2")) * NUM).select(
        F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"), "shared",
        (c("n1") + c("n2") - c("shared")).alias("union_n"))


def similar_pairs(prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, union_n) of all pairs a < b with similarity above 0.8."""
    return verified(candidate_pairs(word_lists(prefixes)), sets)


def _compared(written: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts, their classes, the prefixes of the first text of each class, and all word sets."""
    rows = word_sets(written)
    texts = materialise(unique_texts(rows))
    classes = materialise(word_classes(texts))
    firsts = classes.filter(c("row_idx") == c("first_idx")).select("row_idx")
    sets = rows.filter("n > 0").select("row_idx", "n", c("tokens").alias("toks"))
    return texts, classes, materialise(prefix_sets(sets, firsts)), sets


def near_duplicate_pairs(catalog: DataFrame) -> DataFrame:
    """Pairs (a earlier than b) with similarity in whole percent."""
    return pairs_of_words(written_words(catalog))


def pairs_of_words(written: DataFrame) -> DataFrame:
    """:func:`near_duplicate_pairs` from rows as :func:`written_words` gives them.

    Products with the same word set form a class: each is paired with the first of its class, and
    classes are compared once, through their first products. Between different word sets all pairs are
    rows of the result; :func:`near_duplicate_groups` needs no such rows.
    """
    texts, classes, prefixes, sets = _compared(written)
    names = texts.select("row_idx", "code", "name")
    percent = F.floor(c("shared") * 100.0 / c("union_n") + 0.5).cast("int")
    between = similar_pairs(prefixes, sets).select("a", "b", percent.alias("similarity"))
    within = classes.filter(c("row_idx") != c("first_idx")).select(
        c("first_idx").alias("a"), c("row_idx").alias("b"), F.lit(100).alias("similarity"))
    pairs = materialise(between.unionByName(within))
    n = lambda s: names.select(*[c(x).alias(f"{s}_{x}") for x in ("row_idx", "code", "name")])
    named = spread_join(pairs.withColumnRenamed("a", "a_row_idx"), n("a"), "a_row_idx", c("b"))
    return named.join(n("b"), c("b") == c("b_row_idx")).select(
        "a_row_idx", "a_code", "a_name", "b_row_idx", "b_code", "b_name", "similarity")


def near_duplicate_issues(catalog: DataFrame, params: AuditParams) -> DataFrame:
    """C11: one row per pair on the earlier product."""
    return pair_issues(near_duplicate_pairs(catalog))


def pair_issues(pairs: DataFrame) -> DataFrame:
    return as_issues(pairs.select(
        F.lit("content").alias("family"), F.lit("near_duplicate").alias("type"),
        F.lit(WARNING).alias("severity"), F.lit("product").alias("entity_kind"),
        c("a_code").alias("entity_key"), c("a_name").alias("entity_name"), c("a_row_idx").alias("row_idx"),
        F.concat(c("similarity").cast("string"), F.lit("% like "), c("b_code")).alias("details"),
        c("b_code").alias("related_key")))


def connected_groups(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) pairs as (node, component = smallest node).

    Alternates large-star and small-star steps; the edge table is written once per round, so a lost
    executor costs one round. Stops when a round changes nothing.
    """
    edges = materialise(pairs.select(c("a").cast("bigint"), c("b").cast("bigint")).distinct())
    signature = None
    for _ in range(max_rounds):
        edges = materialise(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(c("b").alias("node"), c("a").alias("component")).unionByName(
        edges.select(c("a").alias("node"), c("a").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(c("b").alias("a"), c("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return attach_groups(both, low, "a", "n").filter("b > a").select(
        c("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest one."""
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = attach_groups(down, low, "u", "n")
    return linked.filter("v <> m").select(c("m").alias("a"), c("v").alias("b")).unionByName(
        low.select(c("m").alias("a"), c("u").alias("b"))).distinct()


def star_groups(prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that are similar to others, without all pairs.

    First each set is compared with a few sets of each of its lists, whose links join most of a family of similar
    sets: n sets give about n links. Then only sets that are not joined yet are compared; two sets of different
    components are the only ones whose similarity still matters, so the components are those of all pairs.
    """
    lists = word_lists(prefixes)
    links = materialise(verified(star_candidates(lists), sets).select("a", "b"))
    joined = connected_groups(links)
    rest = verified(candidate_pairs(_with_component(lists, joined), "component"), sets).select("a", "b")
    return connected_groups(links.unionByName(rest))


def _with_component(lists: DataFrame, joined: DataFrame) -> DataFrame:
    known = joined.select(c("node").alias("row_idx"), "component")
    return materialise(lists.drop("component").join(known, "row_idx", "left").withColumn(
        "component", F.coalesce("component", "row_idx")))


def near_duplicate_groups(catalog: DataFrame) -> DataFrame:
    """Near-duplicate groups: (group_id, row_idx, code, group_size); the representative of a group is its first product, ``group_id``."""
    _, classes, prefixes, sets = _compared(written_words(catalog))
    parts = star_groups(prefixes, sets)
    firsts = classes.filter(c("row_idx") == c("first_idx")).join(parts, c("row_idx") == c("node"), "left").select(
        "class_id", "class_size", F.coalesce("component", "row_idx").alias("group_id"))
    firsts = materialise(firsts)
    sizes = firsts.groupBy("group_id").agg(F.sum("class_size").alias("group_size"), F.count(F.lit(1)).alias("n"))
    placed = materialise(attach_groups(firsts, sizes, "group_id", "n").filter("group_size > 1").drop("n"))
    members = attach_groups(classes.select("row_idx", "class_id"), placed, "class_id", "class_size").filter("group_id is not null")
    return members.join(catalog.select("row_idx", "code"), "row_idx").select("group_id", "row_idx", "code", "group_size")
