"""Properties and brute-force comparisons of the larger jobs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stocklens.operators import enrichment as en, keyed, linking, mapping, near_duplicates as nd, tools
from stocklens.operators.linking import LinkSettings
from stocklens.session import materialise


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Makes ordinary groups count as hot and lists as long."""
    monkeypatch.setattr(keyed, "MIN_HOT_ROWS", 5)
    monkeypatch.setattr(nd, "LIST_ROWS", 3)


def skewed(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 50 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), (F.col("id") % 4).alias("v"))


def test_attach_groups_with_hot_key(spark, tiny_blocks):
    rows = skewed(spark)
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("row_idx").alias("s"))
    got = keyed.attach_groups(rows, groups, "key", "n")
    want = rows.join(groups, "key", "left").select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_number_rows_equals_window(spark, parts):
    """Many rank values and few, null keys and ranks, and a key that holds nine of ten rows."""
    rows = skewed(spark).withColumn("v", F.when(F.col("row_idx") % 11 > 0, F.col("row_idx") * 7919 % 1000))
    rows = rows.withColumn("key", F.when(F.col("row_idx") % 10 > 0, "hot").otherwise(F.col("key")))
    for group, rank, descending in ((["key"], F.col("v"), True), (["key"], F.col("row_idx") % 4, False), ([], F.col("v"), False)):
        got = keyed.number_rows(rows, group, rank, "row_idx", "pos", descending, parts)
        w = Window.partitionBy(*group).orderBy(rank.desc() if descending else rank.asc(), "row_idx")
        want = rows.withColumn("pos", F.row_number().over(w).cast("bigint"))
        assert got.exceptAll(want).isEmpty() and got.count() == want.count() and got.columns == want.columns


def test_numbering_gives_no_task_a_whole_group(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row_idx"), F.lit("one").alias("key"), (F.col("id") % 3).alias("v"))
    got = keyed.number_rows(rows, ["key"], F.col("v"), "row_idx", "pos", parts=8)
    ranges = spark.read.parquet(*got.inputFiles()).groupBy("_range").count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 5_000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, tiny_blocks, how):
    rows = skewed(spark)
    small = rows.select("key").distinct().filter("key <> 'k7' or key is null").withColumn("x", F.length("key"))
    small = small.union(small)
    got, want = keyed.spread_join(rows, small, "key", F.col("row_idx"), how=how), rows.join(small, "key", how)
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count() > 3000
    counts = rows.groupBy("key").agg(F.count("*").alias("m"))
    assert keyed.spread_join(rows, small, "key", F.col("row_idx"), counts, how).count() == want.count()


def texts(spark, seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(10, 40))] for _ in range(20)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, f"P{i}", f"n{i}", " ".join(words)))
    return rows


def brute_pairs(rows):
    """(first of each class and a later member, 100), and pairs of firsts above 0.8 with their similarity."""
    by_text = {}
    for i, _, _, t in rows:
        by_text.setdefault(t, []).append(i)
    classes = {}
    for t, ids in by_text.items():
        if len(ids) == 1 and len(t) > 50:
            classes.setdefault(frozenset(t.split()), []).append(ids[0])
    want, firsts = set(), [(min(ids), s) for s, ids in classes.items()]
    for s, ids in classes.items():
        want |= {(min(ids), i, 100) for i in ids if i != min(ids)}
    for x, (i, a) in enumerate(firsts):
        for j, b in firsts[x + 1:]:
            if 5 * len(a & b) > 4 * len(a | b):
                want.add((min(i, j), max(i, j), int(100 * len(a & b) / len(a | b) + 0.5)))
    return want


def brute_groups(pairs):
    """Smallest member of each member's group."""
    group = {}
    for a, b, _ in pairs:
        group.setdefault(a, a)
        group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b, _ in pairs:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return group


def with_common_word(rows, share=0.9):
    """A word that nine of ten texts hold, among the first of their lists since all words are common."""
    return [(i, code, name, (t + " everywhere") if i % 10 < share * 10 else t) for i, code, name, t in rows]


TEXTS = "row_idx long, code string, name string, description string"


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, tiny_blocks, seed):
    rows = with_common_word(texts(spark, seed))
    df = spark.createDataFrame(rows, TEXTS)
    got = {(r["a_row_idx"], r["b_row_idx"], r["similarity"]) for r in nd.near_duplicate_pairs(df).collect()}
    want = brute_pairs(rows)
    assert got == want and len(want) > 20
    groups = brute_groups(want)
    rows = nd.near_duplicate_groups(df).collect()
    assert {r["row_idx"]: r["group_id"] for r in rows} == groups
    assert all(r["group_size"] == sum(g == r["group_id"] for g in groups.values()) for r in rows)


def test_long_lists_are_cut(spark, monkeypatch):
    """A word in all texts: each set meets all others once, and no cell or part holds more rows than its bound."""
    monkeypatch.setattr(nd, "LIST_ROWS", 40)
    n = 600
    sets = spark.range(n).select(F.col("id").alias("row_idx"), F.concat(F.array(F.lit(1).cast("bigint")), F.sequence(
        F.col("id") * 10 + 10, F.col("id") * 10 + 15)).alias("toks")).withColumn("n", F.size("toks"))
    lists = nd.word_lists(sets)
    parts = lists.filter("tok = 1 and band = g").groupBy("part").count().collect()
    assert len(parts) >= n // 40 and max(r["count"] for r in parts) <= 120
    monkeypatch.setattr(nd, "_may_be_similar", lambda *a: F.lit(True))
    assert nd.candidate_pairs(lists).count() == n * (n - 1) // 2


def test_family_of_similar_texts_needs_few_links(spark, monkeypatch):
    """Texts of one family: stars join nearly all, so far fewer pairs than the square are compared."""
    base, rnd = [f"word{i}" for i in range(80)], random.Random(5)
    rows = []
    for i in range(150):
        words = list(base)
        words[rnd.randrange(80)] = f"own{i}"
        rows.append((i, f"P{i}", "n", " ".join(words)))
    seen = []
    check = nd.verified
    monkeypatch.setattr(nd, "verified", lambda pairs, sets: seen.append(pairs.count()) or check(pairs, sets))
    got = nd.near_duplicate_groups(spark.createDataFrame(rows, TEXTS)).collect()
    assert {r["group_id"] for r in got} == {0} and len(got) == 150
    assert sum(seen) < 150 * 149 // 2 // 4


def test_audit_reads_texts_once_for_keys_and_word_sets(spark, monkeypatch):
    from stocklens.operators.issues import AuditParams
    from stocklens.plans.catalog_audit import audit_issues

    df = spark.createDataFrame(texts(spark, 3), TEXTS).withColumns({"category_text": F.lit("A | B"), "default_category": F.lit("A > B")})
    want = nd.near_duplicate_issues(df, AuditParams()).collect()
    monkeypatch.setattr(nd, "product_rows", lambda rows: pytest.fail("the texts are read once more"))
    got = audit_issues(df, AuditParams()).filter("type = 'near_duplicate'").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 20


def test_language_rule_takes_a_text_apart_once(spark):
    from stocklens.operators import row_rules
    from stocklens.operators.issues import AuditParams

    rows = row_rules.row_issues(spark.createDataFrame(texts(spark, 3), TEXTS), AuditParams(), ["content"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(language_text") == 1


def test_connected_groups(spark, tiny_blocks):
    chain = [(i, i + 1) for i in range(20)] + [(100, 90), (90, 95), (200, 201)]
    got = {r["node"]: r["component"] for r in nd.connected_groups(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[100] == got[95] == 90 and got[201] == 200


def catalog(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("P"), F.when(F.col("id") % 97 == 3, F.col("id") - 1).otherwise(F.col("id"))).alias("code"),
        F.when(F.col("id") % 41 == 0, "").when(F.col("id") % 3 > 0, "Big > Main").when(F.col("id") % 9 == 0, "Big > Rare").when(
            F.col("id") % 9 == 3, "Big").otherwise(F.concat(F.lit("Small"), F.col("id") % 7, F.lit(" > S"))).alias("default_category"),
        F.when(F.col("id") % 2 == 0, "T").otherwise(F.concat(F.lit("U"), F.col("id") % 60)).alias("category_text"),
        F.when(F.col("id") % 5 == 0, "V").otherwise("").alias("category_text2"))


def test_links_obey_the_rules(spark):
    df = catalog(spark)
    rows = {r["row_idx"]: r for r in linking.link_rows(df).collect()}
    links = linking.link_products(df).collect()
    mains, subs, by_text = {}, {}, {}
    for r in rows.values():
        mains.setdefault(r["main"], set()).add(r["code"])
        subs.setdefault((r["main"], r["code"]), set()).add(r["sub"])
        for t in r["texts"]:
            by_text.setdefault(t, set()).add(r["code"])
    assert len(links) == len(rows)
    for link in links:
        r = rows[link["row_idx"]]
        rel, alt = link["related"], link["alternative"]
        assert r["code"] not in rel + alt and len(set(rel + alt)) == len(rel + alt)
        group = mains[r["main"]] - {r["code"]} if r["main"] else set()
        pool = set().union(*[by_text[t] for t in r["texts"]]) - {r["code"]}
        assert set(rel) <= group and set(alt) <= pool
        # lists are as long as the groups allow once the other list has taken its share
        assert len(rel) == min(10, len(group)) or len(rel) >= min(10, len(group - set(alt)))
        assert len(alt) == min(10, len(pool)) or len(alt) >= min(10, len(pool - set(rel)))
        other = {x for x in group if r["sub"] and any(s and s != r["sub"] for s in subs[(r["main"], x)])}
        if len(other - set(alt)) >= len(rel):
            assert set(rel) <= other


def test_broken_link_rules_are_counted(spark):
    """Itself, another main category, no product, other texts; the own subcategory before another one, or instead of it."""
    rows = spark.createDataFrame([
        (i, code, "M" if code < "x" else "N", sub, ["t"] if i % 2 else ["t", "u"]) for i, (code, sub) in enumerate(
            [("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("e", None), ("d", "1"), ("x", "1")])],
        "row_idx long, code string, main string, sub string, texts array<string>")

    def broken(related, alternative, row=0):
        code = rows.filter(F.col("row_idx") == row).first()["code"]
        links = spark.createDataFrame([(row, code, related, alternative)], "row_idx long, code string, related array<string>, alternative array<string>")
        return tuple(linking.rules_broken(rows, links).first())

    assert broken(["c", "d", "b", "e"], ["x"]) == (1, 0, 0, 0)
    assert broken(["c", "b"], ["d"]) == (1, 0, 0, 0)  # the lists share their codes
    assert broken(["b", "c", "d"], []) == (1, 0, 1, 0)
    assert broken(["c", "b", "e"], []) == (1, 0, 2, 0)  # d is left
    assert broken(["b", "e"], [], row=3) == (1, 0, 1, 0)  # a is left, d itself is not
    assert broken(["a", "b"], ["c"], row=3) == (1, 0, 0, 0)
    assert broken(["c", "d", "a", "x", "gone"], ["b", "b", "a", "gone"]) == (1, 1, 3, 2)
    assert broken(["b", "a"], [], row=4) == (1, 0, 0, 0)  # no subcategory is known
    assert broken(["c"], ["c"], row=6) == (1, 1, 1, 0)


def test_link_settings(spark):
    df = catalog(spark, 100)
    only = linking.link_products(df, LinkSettings(alternative=False, related_count=3)).collect()
    assert all(r["alternative"] == [] and len(r["related"]) <= 3 for r in only)
    many = LinkSettings(related_count=2, alternative_count=14)
    wide = linking.wide_links(df, linking.link_products(df, many), many)
    assert wide.columns == df.columns + ["relatedProduct", "relatedProduct2", "alternativeProduct"] + [
        f"alternativeProduct{i}" for i in range(2, 15)]
    for bad in (0, 99):
        with pytest.raises(ValueError):
            LinkSettings(related_count=bad)


def test_links_are_spread_over_a_large_category(spark):
    """20,000 products of one category, nine tenths of them in one subcategory."""
    df = spark.range(20_000).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("P"), "id").alias("code"), F.lit("").alias("category_text"),
        F.concat(F.lit("A > "), F.when(F.col("id") % 10 == 0, F.concat(F.lit("S"), F.col("id") % 70)).otherwise("big")).alias("default_category"))
    links = linking.link_products(df, LinkSettings(alternative=False))
    per_target = links.select(F.explode("related").alias("t")).groupBy("t").count()
    assert links.agg(F.min(F.size("related"))).first()[0] == 10
    assert per_target.count() > 1900 and per_target.agg(F.max("count")).first()[0] < 400
    even = linking.link_products(df.withColumn("default_category", F.concat(F.lit("A > S"), F.col("row_idx") % 7)), LinkSettings(alternative=False))
    spread = even.select(F.explode("related").alias("t")).groupBy("t").count().agg(F.max("count"), F.count("*")).first()
    assert spread[0] < 40 and spread[1] == 20_000


def test_assign_takes_turns(spark):
    df = spark.sql("select array('a','b','c','d') r, array('a','b','x','y') t").select(
        linking.assign(F.col("r"), F.col("t"), 2, 3).alias("p")).first()["p"]
    assert df["rel"] == ["a", "c"] and df["alt"] == ["b", "x", "y"]


def test_mapping_scores(spark):
    tax = spark.createDataFrame([
        ("g", "1", "Hrnky", "Dum | Kuchyne | Hrnky"), ("g", "2", "Hrnky prislusenstvi", "Dum | Hrnky prislusenstvi"),
        ("g", "3", "Vanocni hrnky", "Vánoce | Vanocni hrnky"), ("g", "4", "Ostatni", "A | B | C | Hrnky | Ostatni")],
        "platform string, id string, name string, full_path string")
    df = spark.createDataFrame([(0, "1/A", "Hrnek modry", "", ""), (1, "1/B", "Neco", "", ""), (2, "5", "Voucher hrnek", "", "")],
                               "row_idx long, code string, name string, category_text string, default_category string")
    ctx = mapping.product_contexts(df)
    got = {r["id"]: r["score"] for r in mapping.candidates(ctx.filter("row_idx = 0"), tax).collect()}
    # 1: strong leaf match; 2: accessory, 100 - 150 < 0; 3: seasonal; 4: path match 20 -> 5, depth 5 -> -20
    assert got == {"1": 100}
    mapped = {r["row_idx"]: r for r in mapping.map_products(df, tax)[0].collect()}
    assert mapped[0]["mapping"]["g"]["id"] == "1" and not mapped[0]["needs_review"]
    assert mapped[1]["inherited"] and mapped[1]["mapping"]["g"]["id"] == "1"
    assert mapped[2]["non_product"] and mapped[2]["mapping"] is None


def test_enrichment_priority_and_slots(spark):
    payload = ('{"filtering":[{"name":"Producent země","value":"X"},{"name":"výrobce","value":"x"},{"name":"barva","value":"bílá a modrá"}],'
               '"text":[{"key":"druh","value":"usb"},{"key":"Typ produktu","value":"USB"}]}')
    responses = spark.createDataFrame([(0, payload), (1, "oops"), (2, '{"filtering":[{"name":"","value":"a"}],"text":[]}')], "row_idx long, payload string")
    rows = {r["row_idx"]: r for r in en.clean_parameters(en.parse_responses(responses)).collect()}
    assert [(x["name"], x["value"]) for x in rows[0]["filtering"]] == [("Značka", "x"), ("Barva", "bílá"), ("Barva", "modrá")]
    assert [(x["key"], x["value"]) for x in rows[0]["text"]] == [("Typ produktu", "USB")]
    assert rows[1]["error"] and not rows[2]["error"] and rows[2]["filtering"] == []
    products = spark.createDataFrame([(0, "", "z;z"), (2, "a;a", "")], "row_idx long, textProperty string, textProperty2 string")
    out = {r["row_idx"]: r.asDict() for r in en.wide_output(products, en.clean_parameters(en.parse_responses(responses)), 5, 2).collect()}
    assert out["0"]["textProperty"] == "Typ produktu;USB" and out["0"]["textProperty2"] == "z;z"
    assert out["0"]["filteringProperty:Barva"] == "modrá" and out["2"]["filteringProperty:Barva"] == ""


def test_promotion(spark):
    df = spark.createDataFrame([("a", "", 100.0, "B", "X | Y"), ("b", "", 50.0, "", "X"), ("c", "", 10.0, "C", "Xa")],
                               "code string, pair_code string, price double, manufacturer string, category_text string")
    p = tools.Promotion("f", brands=["B", "C"], brandless_codes=["b"], categories=["X"], discount_fixed=60)
    assert {(r["code"], r["actionPrice"]) for r in tools.promotion_rows(df, p).collect()} == {("a", 40.0), ("b", 0.0)}
    assert tools.flags(["newFlagActive", "FlagActive", "x"]) == ["new"]


def test_czech_order(spark):
    df = spark.createDataFrame([(x,) for x in ("Chata", "Hrad", "Bez kategorie", "Cena", "Čaj")], "category string")
    assert [r[0] for r in tools.sorted_categories(df).collect()] == ["Cena", "Čaj", "Hrad", "Chata", "Bez kategorie"]


def mapped_words(spark, seed, n_texts=60, n_cats=400):
    """Texts of rare and common words, and a taxonomy whose paths hold the common ones."""
    rnd = random.Random(seed)
    rare, common = [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(40)], ["zbozi", "dilna", "zahrada", "stroje"]
    cats = []
    for i in range(n_cats):
        name = " ".join(rnd.sample(rare, rnd.randint(1, 2)) + (["prislusenstvi"] if i % 9 == 0 else []))
        cats.append((rnd.choice(["p", "q"]), f"c{i}", name, " > ".join([*rnd.sample(common, rnd.randint(1, 4)), "x y z", name])))
    products = [(i, f"P{i}", " ".join(rnd.sample(rare, rnd.randint(0, 3)) + rnd.sample(common, rnd.randint(0, 4)) + rnd.choice([[], ["set"], ["obal"]])), "", "")
                for i in range(n_texts)]
    contexts = mapping.product_contexts(spark.createDataFrame(
        products, "row_idx long, code string, name string, category_text string, default_category string"))
    return (materialise(mapping.context_words(contexts)), spark.createDataFrame(cats, "platform string, id string, name string, full_path string"))


@pytest.mark.parametrize("seed", range(2))
def test_best_categories_are_those_of_whole_sums(spark, tiny_blocks, monkeypatch, seed):
    monkeypatch.setattr(mapping, "SEED_ENTRIES", 2)
    words, taxonomy = mapped_words(spark, seed)
    for limit in (1, 5):
        want = materialise(mapping.top_candidates(mapping.score_categories(words, taxonomy), taxonomy, limit))
        got = materialise(mapping.top_candidates(mapping.best_categories(words, taxonomy, limit), taxonomy, limit))
        assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 60


def test_words_of_many_categories_are_looked_up_only(spark):
    words, taxonomy = mapped_words(spark, 7, n_texts=30, n_cats=3000)
    hits = materialise(mapping.category_hits(words, taxonomy))
    every = words.join(hits, "word").count()
    terms = materialise(mapping.with_threshold(mapping.bounded_words(words, hits), hits, taxonomy, 5))
    needed = terms.filter("needed").join(hits, ["word", "platform"]).count()
    assert needed < every / 2
    assert terms.filter("not needed and bound >= threshold").isEmpty()


def test_wide_output_of_five_thousand_names(spark):
    params = spark.range(1000).select(F.col("id").alias("row_idx"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(
        F.concat(F.lit("n"), F.col("id") * 5 + k).alias("name"), F.concat(F.lit("v"), k).alias("value"))).alias("filtering"),
        F.array().cast("array<struct<key:string,value:string>>").alias("text"))
    products = params.select(F.col("row_idx"), F.concat(F.lit("P"), F.col("row_idx")).alias("code"), F.lit("").alias("filteringProperty:n7"))
    out = en.wide_output(products, params)
    assert len([x for x in out.columns if x.startswith("filteringProperty:")]) == 5000
    row = out.select("code", *[f"`filteringProperty:n{k}`" for k in (5, 7, 9, 10)]).filter("code = 'P1'").first()
    assert tuple(row) == ("P1", "v0", "v2", "v4", "")
    assert en.long_output(params).count() == 5000


def shuffled(df):
    """MB that the shuffles of ``df`` itself write, without broadcasts; tables written on the way are not among them."""
    spark, size = df.sparkSession, 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.collect()
        open_nodes = [df._jdf.queryExecution().executedPlan()]
        while open_nodes:
            node = open_nodes.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                open_nodes.append(node.executedPlan())
            elif name.endswith("QueryStageExec"):
                open_nodes.append(node.plan())
            else:
                if name == "ShuffleExchangeExec":
                    size += node.metrics().apply("dataSize").value()
                open_nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return size / 1e6


def test_blocks_of_a_ring_move_once(spark):
    """A row takes its neighbours from a block of some 300 codes without carrying the block into another shuffle."""
    rows = spark.range(3_000).select(F.lit("g").alias("main"), F.concat(F.lit("code"), "id").alias("code"), F.lit("s").alias("sub"),
                                     F.lit(True).alias("member"))
    near = linking.ring_neighbours(rows, "main", "s", 21)
    assert shuffled(near) < 3
    assert near.filter(F.size(F.array_distinct("near.code")) == 21).count() == 3_000


def test_rows_that_do_not_ask_are_neighbours_only(spark):
    rows = spark.range(900).select(F.lit("g").alias("main"), F.concat(F.lit("c"), "id").alias("code"), F.lit("s").alias("sub"),
                                   (F.col("id") % 3 > 0).alias("member"))
    near = linking.ring_neighbours(rows, "main", "s", 5, asking=~F.col("member"))
    members = {r["code"] for r in rows.filter("member").collect()}
    got = near.collect()
    assert len(got) == 300 and all(r["code"] not in members and len(r["near"]) == 5 and {x["code"] for x in r["near"]} <= members for r in got)


def test_sets_move_once_for_all_pairs_of_a_cell(spark):
    """1,770 pairs of 60 sets of 400 words: each set is sent to the cell of its family, not to each pair."""
    sets = spark.range(60).select(F.col("id").alias("row_idx"), F.lit(400).alias("n"), F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(399)), lambda i: F.xxhash64(i)), F.array(F.xxhash64("id", F.lit("own")))).alias("toks"))
    pairs = sets.select(F.col("row_idx").alias("i1")).join(sets.select(F.col("row_idx").alias("i2")), F.col("i1") < F.col("i2")).withColumn(
        "cell", F.lit(7).cast("bigint"))
    found = nd.verified(pairs, sets)
    assert shuffled(found) < 1
    assert {tuple(r) for r in found.select("shared", "union_n").collect()} == {(399, 401)} and found.count() == 1_770
