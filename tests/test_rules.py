from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stocklens.operators import category_tree, duplicates, report, row_rules, variants
from stocklens.operators.issues import AuditParams, errors_first, union_issues

P = AuditParams()
LONG = "Toto je popis výrobku, který je dost dlouhý na to, aby nebyl hlášen jako krátký, protože má více než sto znaků."


def fired(spark, family, **values):
    base = {"row_idx": 0, "code": "A", "name": "Good product", "description": LONG, "short_description": "Krátký popis výrobku",
            "meta_description": "m" * 100, "price": 99.0, "stock": 5.0, "ean": "1", "manufacturer": "M", "image": "i.jpg",
            "image_count": 3, "default_category": "A > B", "filter_params": "x", "availability": "Skladem",
            "availability_in_stock": "Skladem", "availability_out_of_stock": "Vyprodáno"}
    row = {**base, **values}
    types = {"row_idx": "long", "price": "double", "price_before_discount": "double", "stock": "double", "image_count": "int",
             "delivery_days": "int", "is_action": "boolean", "is_new": "boolean", "action_end_date": "timestamp",
             "created_at": "timestamp", "updated_at": "timestamp"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'string')}" for k in row))
    return sorted(r["type"] for r in row_rules.row_issues(df, P, [family]).collect())


@pytest.mark.parametrize("family", ["content", "business", "completeness", "data_quality", "stock", "product_category", "seo"])
def test_clean_product_raises_nothing(spark, family):
    assert fired(spark, family) == []


@pytest.mark.parametrize("n, expected", [(69, ["meta_too_short"]), (70, []), (160, []), (161, ["meta_too_long"]), (0, ["no_meta_description"])])
def test_meta_length(spark, n, expected):
    assert fired(spark, "seo", meta_description="m" * n) == expected


@pytest.mark.parametrize("price, expected", [(999.0, []), (1000.0, ["suspicious_round_price"]), (0.0, ["zero_price"]), (-1.0, ["negative_price"]), (1000.5, [])])
def test_price(spark, price, expected):
    assert fired(spark, "business", price=price) == expected


@pytest.mark.parametrize("price, before, expected", [(50.0, 100.0, []), (49.0, 100.0, ["suspicious_discount"]),
                                                     (101.0, 100.0, ["discount_higher_than_price"]), (5.0, 0.0, ["discount_higher_than_price"])])
def test_discount(spark, price, before, expected):
    assert fired(spark, "business", price=price, price_before_discount=before) == expected


def test_dates(spark):
    day = lambda n: P.as_of - timedelta(days=n)
    assert fired(spark, "business", is_new=True, created_at=day(90)) == []
    assert fired(spark, "business", is_new=True, created_at=day(91)) == ["old_product_new_flag"]
    assert fired(spark, "business", availability="Na dotaz", created_at=day(90)) == []
    assert fired(spark, "business", availability="Na dotaz", created_at=day(91)) == ["long_inquiry_product"]
    assert fired(spark, "business", is_action=True, action_end_date=day(1)) == ["expired_action"]
    assert fired(spark, "business", is_action=True, price_before_discount=99.0) == ["permanent_action"]
    far = {"is_action": True, "price_before_discount": 99.0, "action_end_date": day(-31)}
    assert fired(spark, "business", created_at=day(31), **far) == ["permanent_action"]
    assert fired(spark, "business", created_at=day(30), **far) == []
    assert fired(spark, "stock", stock=0.0, availability="Vyprodáno", updated_at=day(30)) == []
    assert fired(spark, "stock", stock=0.0, availability="Vyprodáno", updated_at=day(31)) == ["long_sold_out"]


def test_content(spark):
    assert fired(spark, "content", description="", short_description="<p> </p>") == ["no_description"]
    assert "too_short" in fired(spark, "content", description="abc")
    assert "same_short_long" in fired(spark, "content", short_description=LONG)
    assert "lorem_ipsum" in fired(spark, "content", description=LONG + " Lorem ipsum")
    assert "url_in_description" in fired(spark, "content", description=LONG + " http://x.cz")
    assert "emoji_spam" in fired(spark, "content", description=LONG + "🎁" * 6)
    assert "html_in_description" in fired(spark, "content", description=LONG + "<div></div>" * 6)
    assert "wrong_language" in fired(spark, "content", description="this is the product for you and it is not that bad at all, " * 3)


def test_completeness(spark):
    assert fired(spark, "completeness", image="", image_count=0) == ["no_image"]
    assert fired(spark, "completeness", image="x", image_count=0) == ["single_image"]
    assert fired(spark, "completeness", image_count=1) == ["single_image"]
    assert fired(spark, "completeness", price=None, ean=" ", manufacturer="", default_category="", filter_params=", ") == [
        "no_category", "no_ean", "no_filter_parameters", "no_manufacturer", "no_price"]
    assert fired(spark, "completeness", price=None, ean="", parent_code="P") == []


def test_seo_titles(spark):
    assert fired(spark, "seo", name="x" * 70) == [] and fired(spark, "seo", name="x" * 71) == ["title_too_long"]
    assert fired(spark, "seo", name="x" * 9) == ["title_too_short"] and fired(spark, "seo", name="x" * 10) == []
    assert fired(spark, "seo", name="Long product title", meta_description="LONG product title ") == ["meta_same_as_title", "meta_too_short"]


def test_stock_texts(spark):
    assert fired(spark, "stock", availability="Na dotaz") == ["in_stock_zero_quantity"]
    assert fired(spark, "stock", availability="Vyprodáno", stock=-1.0) == ["negative_stock"]
    assert fired(spark, "stock", availability_in_stock="možná", availability="možná") == ["wrong_availability_in_stock"]


def products(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "row_idx long, code string, name string, parent_code string, ean string, stock double, availability string, image string, filter_params string")


def test_variant_groups_are_no_duplicates(spark):
    rows = [("1/A", "Mug", "1", "", 1.0, "", "i", "x"), ("1/B", "mug ", "1", "", 0.0, "", "i", "x"), ("2", "Cup", "", "9", 1.0, "", "i", "x"),
            ("3", "cup", "", "9", 1.0, "", "i", "x"), ("1", "Set", "", "", 1.0, "", "i", "x"), ("4/A", "Pot", "77", "", 1.0, "", "", "")]
    df = products(spark, rows)
    keys = duplicates.group_keys(df)
    found = {(r["type"], r["entity_key"]) for r in duplicates.group_issues(keys).collect()}
    assert found == {("duplicate_name", "2"), ("duplicate_name", "3"), ("duplicate_ean", "2"), ("duplicate_ean", "3")}
    v = {(r["type"], r["entity_key"]) for r in variants.variant_issues(variants.variant_rows(df)).collect()}
    assert v == {("orphan_variant", "4/A"), ("variant_identical_names", "1/A"), ("variant_identical_names", "1/B")}
    n = variants.variant_stock_issues(variants.variant_rows(df)).collect()
    assert [(r["entity_key"], r["entity_name"]) for r in n] == [("1", "Mug")]


@pytest.mark.parametrize("names, mixed", [(["A - 1", "A - 2", "A - 3"], False), (["A - 1", "A 2", "A 3"], True),
                                          (["A (1)", "A (2)", "A, 3"], True), (["A", "B", "C"], False), (["A - 1, x", "A - 2", "A - 3"], False)])
def test_naming_pattern(spark, names, mixed):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert df.agg(variants.naming_is_mixed(F.col("name")).alias("m")).first()["m"] is mixed


def test_category_cycle_ends(spark):
    cats = spark.createDataFrame([("A", "A", "B", "A"), ("B", "B", "A", "B"), ("C", "C", None, "C"), ("D", "D", "C", "C | D")],
                                 "code string, name string, parent_code string, path string")
    depth = {r["code"]: r["depth"] for r in category_tree.category_depths(cats).collect()}
    assert depth["C"] == 1 and depth["D"] == 2 and depth["A"] > 4


def test_deep_chain_of_categories(spark):
    rows = [(f"C{i}", f"C{i}", f"C{i - 1}" if i else None, "") for i in range(60)] + [("L", "L", "C59", ""), ("A", "A", "B", ""), ("B", "B", "A", "")]
    cats = spark.createDataFrame(rows, "code string, name string, parent_code string, path string")
    depth = {r["code"]: r["depth"] for r in category_tree.category_depths(cats).collect()}
    assert depth["C59"] == 60 and depth["L"] == 61 and depth["C0"] == 1 and depth["A"] == depth["B"] == 64


def test_scores(spark):
    rows = [("completeness", "no_image", "error")] * 3 + [("content", "near_duplicate", "warning")] * 2 + [("variants", "orphan_variant", "error")] * 9
    issues = spark.createDataFrame(rows, "family string, type string, severity string")
    s = report.audit_scores(issues, spark.range(10)).first()
    assert (s["completeness"], s["uniqueness"], s["quality"], s["stock"]) == (85, 80, 100, 100)
    assert s["overall"] == int(80 * .12 + 100 * .12 + 85 * .18 + 100 * .58 + .5)
    empty = report.audit_scores(issues.limit(0), spark.range(0)).first()
    assert empty["uniqueness"] is None and empty["overall"] is None
    h = report.health(report.audit_scores(issues, spark.range(10))).first()
    assert h["level"] == "excellent" and h["priorities"] == []


def test_errors_first(spark):
    df = spark.createDataFrame([("a", "x", "warning"), ("b", "y", "error")], "family string, type string, severity string").withColumns(
        {"row_idx": F.lit(1), "entity_key": F.lit("k")})
    assert [r["severity"] for r in errors_first(df).collect()] == ["error", "warning"]


def test_rules_run_once_before_their_rows_are_ordered(spark):
    from stocklens.operators.issues import errors_first

    issues = spark.createDataFrame([("a", "t", "warning", "k1", 1), ("b", "t", "error", "k2", 2)],
                                   "family string, type string, severity string, entity_key string, row_idx long")
    ordered = errors_first(issues.withColumn("details", F.rand()))
    assert [r["entity_key"] for r in ordered.collect()] == ["k2", "k1"] and ordered.inputFiles()


def test_texts_join_the_catalog_last(spark, tmp_path):
    """A product's text is not moved again to find its order; rows are those of the SQL as it stands."""
    from stocklens import fixtures

    n = spark.range(40)
    n.selectExpr("id as p_partkey", "concat('red bolt ', id) as p_name", "'B' as p_brand", "'SMALL' as p_type", "cast(id as int) as p_size",
                 "10.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    n.filter("id < 7").selectExpr("id as doc_id", "concat('text ', id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    n.filter("id % 3 = 0").selectExpr("id as o_orderkey", "timestamp '2024-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = fixtures.load(spark, str(tmp_path), "catalog")
    sql, tables = fixtures.VIEWS["catalog"]
    want = spark.sql(fixtures.sql_over(sql, tables), **{t: fixtures.table(spark, str(tmp_path), t) for t in tables})
    assert got.count() == 40 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    first = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1].split(",")[0]
    assert first(want) == "LeftOuter" and first(got) == "Inner"
