import pytest
from pyspark.sql import functions as F

from stocklens.sources import catalog as sc, gates, sitemap, taxonomy as tax


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)
    return write


def test_csv(spark, put):
    path = put("p.csv", 'Kód;Název;Popis;Cena;Sklad;Obrázek;Obrázek 2;Další obrázky;Konec akce\n'
                        'P1;"a; b";"x ""y""\nz";12,5;3;i;j;k, ,l;2024-01-05\n\nP2;c;;;;;;;bad\n;no code;;;;;;;\n')
    rows = sc.canonical_products(sc.read_csv(spark, path, line_breaks=True)).orderBy("code").collect()
    assert [(r["code"], r["name"], r["description"], r["price"], r["stock"], r["image_count"]) for r in rows] == [
        ("P1", "a; b", 'x "y"\nz', 12.5, 3.0, 4), ("P2", "c", "", None, None, 0)]
    assert str(rows[0]["action_end_date"])[:10] == "2024-01-05" and rows[1]["action_end_date"] is None
    assert rows[0]["is_visible"] and not rows[0]["is_action"]


def test_files_to_issues(spark, put):
    """The whole way from files to the issue table."""
    from stocklens.operators.issues import AuditParams
    from stocklens.plans.catalog_audit import audit_issues
    lines = "".join(f"P{i};Product {i};A > B{i % 2};{i};EAN{i % 3}\n" for i in range(6))
    path = put("p.csv", "code;name;defaultCategory;price;ean\n" + lines)
    catalog = sc.canonical_products(sc.with_row_index(sc.read_csv(spark, path)))
    issues = audit_issues(catalog, AuditParams(), near=False)
    found = {(r["type"], r["n"]) for r in issues.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert {("duplicate_ean", 6), ("no_description", 6), ("no_image", 6), ("no_meta_description", 6)} <= found
    assert ("zero_price", 2) in found  # once as a business and once as a completeness issue


def test_csv_comma_and_aliases(spark, put):
    path = put("p.csv", "code,CODE2,brand,categoryText,categoryText2,paramName1,paramValue1,filterParams\nA,x,B,C,D,size,L,\"a, b\"\n")
    r = sc.canonical_products(sc.read_csv(spark, path)).first()
    assert (r["manufacturer"], r["brand"], r["additional_categories"], r["filter_parameters"]) == ("B", "B", ["D"], ["a", "b", "size:L"])


def test_xml_products(spark, put):
    path = put("f.xml", """<?xml version="1.0"?><SHOP>
      <SHOPITEM><ITEM_ID>1</ITEM_ID><PRODUCTNAME><![CDATA[A & B]]></PRODUCTNAME><price>5</price><PRICE_VAT>6,5</PRICE_VAT>
        <IMGURL>i</IMGURL><IMGURL_ALTERNATIVE>j</IMGURL_ALTERNATIVE><IMGURL_ALTERNATIVE>k</IMGURL_ALTERNATIVE>
        <PARAM><PARAM_NAME>c</PARAM_NAME><VAL>red</VAL></PARAM><PARAM><PARAM_NAME>d</PARAM_NAME><VAL></VAL></PARAM></SHOPITEM>
      <SHOPITEM><name>only name</name></SHOPITEM><SHOPITEM><EAN>9</EAN></SHOPITEM></SHOP>""")
    raw = sc.read_xml_products(spark, path)
    assert raw.count() == 2
    rows = sc.canonical_products(raw).collect()
    assert [(r["code"], r["name"], r["price"], r["image_count"], r["filter_parameters"]) for r in rows] == [
        ("1", "A & B", 6.5, 3, ["c:red"])]


def test_xml_with_several_row_elements(spark, put):
    path = put("m.xml", "<r><SHOPITEM><ITEM_ID>1</ITEM_ID></SHOPITEM><item><id>2</id></item><entry><id>3</id></entry><PRODUCT><code>4</code></PRODUCT></r>")
    assert sorted(r["code"] for r in sc.canonical_products(sc.read_xml_products(spark, path)).collect()) == ["1", "2", "3", "4"]
    path = put("k.xml", "<r><category><id>1</id><name>A</name></category><item><id>2</id><name>B</name></item></r>")
    assert sorted(r["code"] for r in sc.read_categories(spark, path).collect()) == ["1", "2"]


def test_many_numbered_columns(spark):
    columns = ["code", "image", *[f"image{i}" for i in range(2, 26)], *[f"paramName{i}" for i in range(1, 31)], *[f"paramValue{i}" for i in range(1, 31)]]
    row = ["x"] + ["i"] * 25 + [f"n{i}" for i in range(1, 31)] + [f"v{i}" for i in range(1, 31)]
    r = sc.canonical_products(spark.createDataFrame([row], ", ".join(f"`{x}` string" for x in columns))).first()
    assert r["image_count"] == 25 and r["filter_parameters"] == [f"n{i}:v{i}" for i in range(1, 31)]


def test_deep_trees(spark, put):
    xml, js = "", ""
    for i in range(15, 0, -1):
        xml = f"<CATEGORY><CATEGORY_ID>{i}</CATEGORY_ID><CATEGORY_NAME>N{i}</CATEGORY_NAME>{xml}</CATEGORY>"
        js = f'{{"id":{i},"name":"N{i}","children":[{js}]}}'
    leaf = " | ".join(f"N{i}" for i in range(1, 16))
    assert [tuple(r) for r in tax.read_nested_xml(spark, put("d.xml", f"<HEUREKA>{xml}</HEUREKA>")).collect()] == [("15", "N15", leaf)]
    assert {r["id"]: r["full_path"] for r in tax.read_nested_json(spark, put("d.json", f"[{js}]")).collect()} == {
        str(i): " | ".join(f"N{k}" for k in range(1, i + 1)) for i in range(1, 16)}
    ring = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a")], "id string, name string, parent_id string")
    with pytest.raises(ValueError):
        tax.tree_paths(ring)


def test_xml_other_row_tag_and_namespace(spark, put):
    path = put("g.xml", '<rss xmlns:g="http://base.google.com/ns/1.0"><item><g:id>7</g:id><title>T</title><g:price>3</g:price></item></rss>')
    r = sc.canonical_products(sc.read_xml_products(spark, path)).first()
    assert (r["code"], r["name"], r["price"]) == ("7", "T", 3.0)


def test_categories(spark, put):
    csv = sc.read_categories(spark, put("c.csv", "GUID;Cesta;PARENT_ID;visible\n1;A | B;0;ne\n2;;;\n;;x;\n")).orderBy("code").collect()
    assert [(r["code"], r["name"], r["is_active"]) for r in csv] == [("1", "B", False), ("2", "2", True)]
    xml = sc.read_categories(spark, put("c.xml", "<cs><category><id>5</id><TITLE>N</TITLE><parentId>1</parentId><count>3</count></category></cs>")).first()
    assert (xml["code"], xml["name"], xml["parent_code"], xml["product_count"]) == ("5", "N", "1", 3)


def test_taxonomies(spark, put):
    listed = tax.read_list(spark, put("g.txt", "# v\n1 - A > B\n\n2 - Q\nzz\n")).orderBy("id").collect()
    assert [(r["id"], r["name"], r["full_path"]) for r in listed] == [("1", "B", "A > B"), ("2", "Q", "Q")]
    node = lambda i, n, inner="": f"<CATEGORY><CATEGORY_ID>{i}</CATEGORY_ID><CATEGORY_NAME>{n}</CATEGORY_NAME>{inner}</CATEGORY>"
    nested = tax.read_nested_xml(spark, put("h.xml", f"<HEUREKA>{node(1, 'A', node(2, 'B') + node(3, 'C', node(4, 'D')))}</HEUREKA>"))
    assert {(r["id"], r["full_path"]) for r in nested.collect()} == {("2", "A | B"), ("4", "A | C | D")}
    js = tax.read_nested_json(spark, put("z.json", '[{"id":1,"name":"A","children":[{"id":2,"name":"B","categoryText":"X | B","children":'
                                                   '[{"id":5,"name":"E"}]},{"name":"nil","children":[{"id":4,"name":"D"}]}]}]'))
    assert {(r["id"], r["full_path"]) for r in js.collect()} == {("1", "A"), ("2", "X | B"), ("5", "X | B | E"), ("4", "A | nil | D")}
    flat = tax.read_flat_xml(spark, put("f.xml", "<G><CATEGORY><CATEGORY_ID>1</CATEGORY_ID><CATEGORY_NAME>N</CATEGORY_NAME>"
                                                 "<CATEGORY_FULLNAME>A | N</CATEGORY_FULLNAME></CATEGORY></G>")).first()
    assert tuple(flat) == ("1", "N", "A | N")


def test_sitemaps(spark):
    index = spark.createDataFrame([("s", '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> u1 </loc></sitemap>'
                                         "<sitemap><loc>u2</loc></sitemap></sitemapindex>")], "site string, xml string")
    docs = spark.createDataFrame([("u1", "<urlset><url><loc>a&amp;b</loc></url><url><loc>c</loc><lastmod>2024-01-01</lastmod></url></urlset>")],
                                 "url string, xml string")
    rows = sitemap.sitemap_entries(sitemap.expand_indexes(index, docs)).collect()
    assert {(r["site"], r["loc"], r["lastmod"]) for r in rows} == {("s", "a&b", None), ("s", "c", "2024-01-01")}


def test_gates(spark):
    assert gates.find_column(["Kód", " IMGURL "], gates.IMAGE_COLUMNS) == " IMGURL "
    assert gates.find_column(["a"], gates.NAME_COLUMNS) is None
    df = spark.createDataFrame([("1", "", "n", "c", "t")], "code string, pairCode string, name string, defaultCategory string, categoryText string")
    assert gates.linking_gate(df).valid
    assert gates.linking_gate(df.limit(0)).errors == ["no data"]
    e = spark.createDataFrame([("1", "", " ", None)], "code string, name string, shortDescription string, description string")
    assert gates.enrichment_gate(e).errors == ["no row has any text"]
    ok = gates.enrichment_gate(e.withColumn("name", F.lit("x")).withColumn("filteringProperty:a", F.lit("")).withColumn("Image7", F.lit("")))
    assert ok.valid and len(ok.warnings) == 1


def test_clean_cells(spark):
    r = gates.clean_cells(spark.createDataFrame([("a_x000d_\r\nb\rc", 1)], "` t ` string, n int")).first()
    assert r.asDict() == {"t": "a\nb\nc", "n": "1"}
