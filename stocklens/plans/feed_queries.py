"""Registered queries of sources, enrichment and status polls."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F, types as T

from stocklens.fixtures import load, oracle, table
from stocklens.functions import parameters as pm
from stocklens.functions import url as ur, values as vl
from stocklens.operators import enrichment as en, tools
from stocklens.operators.issues import AuditParams, issue_codes
from stocklens.operators.report import worst_status
from stocklens.operators.row_rules import row_issues
from stocklens.plans import duck as d
from stocklens.plans.audit_queries import ORACLES as AUDIT
from stocklens.session import materialise, scratch_dir
from stocklens.sources import catalog as sc, gates, sinks, taxonomy as tax
from stocklens.sources.platform import ExportAdapter
from stocklens.streaming import status as st

QUERIES, ORACLES = {}, {}
c = F.col


def _cat(s, f):
    return load(s, f, "catalog")


def _add(name, fn, sql=None, views=("catalog",)):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = oracle(list(views), sql) if views else sql


# ---- sources -------------------------------------------------------------------------------

_RENAME = {"code": "Kód", "name": "Název", "description": "Popis", "short_description": "perex", "price": "Cena s DPH",
           "stock": "Sklad", "ean": "EAN", "manufacturer": "Výrobce", "parent_code": "Kód rodiče", "image": "Obrázek",
           "filter_params": "Parametry pro filtr", "is_action": "V akci", "category_text": "categoryText", "category_text2": "categoryText2"}


def _sheet(s, f):
    """The catalog as a shop export: Czech headers, all cells text, decimal commas."""
    cat = _cat(s, f)
    cells = [c(k).cast("string").alias(v) for k, v in _RENAME.items() if k != "price"]
    return cat.select("row_idx", *cells, F.replace(c("price").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("Cena s DPH"),
                      F.when(c("row_idx") % 2 == 0, "b.jpg").alias("Obrázek 2"), F.when(c("row_idx") % 3 == 0, "c.jpg, ,d.jpg").alias("additionalImages"),
                      F.lit("barva").alias("paramName1"), F.when(c("row_idx") % 4 == 0, "modrá").otherwise("").alias("paramValue1"))


_SHEET_COLS = ["row_idx", "code", "name", "description", "short_description", "price", "stock", "ean", "manufacturer", "parent_code", "is_action", "is_visible", "image_count"]
_SHEET_SQL = """select row_idx, code, name, description, short_description, price::decimal(18,2)::double as price, stock::double as stock, ean, manufacturer, parent_code,
 is_action, true as is_visible, ((image <> '')::int + (row_idx % 2 = 0)::int + case when row_idx % 3 = 0 then 2 else 0 end)::integer as image_count,
 array_to_string(list_concat(case when filter_params = '' then [] else [filter_params] end, case when row_idx % 4 = 0 then ['barva:modrá'] else [] end), '|') as filter_parameters,
 category_text2 as additional_categories from catalog"""


def _canonical(df):
    return df.select(*_SHEET_COLS, F.array_join("filter_parameters", "|").alias("filter_parameters"),
                     F.array_join("additional_categories", "|").alias("additional_categories"))


_add("s05_s06_s07_canonical_products", lambda s, f: _canonical(sc.canonical_products(_sheet(s, f))), _SHEET_SQL)


def _csv_round_trip(s, f):
    folder = f"{scratch_dir(s)}/csv-{uuid.uuid4().hex}"
    _sheet(s, f).withColumn("row_idx", c("row_idx").cast("string")).write.option("header", True).option("sep", ";").option(
        "quoteAll", True).option("escape", '"').csv(folder)
    return _canonical(sc.canonical_products(sc.read_csv(s, folder, line_breaks=True)).withColumn("row_idx", c("row_idx").cast("bigint")))


_add("s01_csv_catalog", _csv_round_trip, _SHEET_SQL.replace("name, description, short", f"name, {d.trim('description')} as description, {d.trim('short_description')} as short", 1)
     .replace("code, name,", "code, trim(name) as name,", 1))


def _xml_items(s, f, element="SHOPITEM"):
    """Products with an XML element each; ``element`` is its name."""
    element = F.lit(element) if isinstance(element, str) else element
    tag = lambda t, x: F.concat(F.lit(f"<{t}>"), x, F.lit(f"</{t}>"))
    cdata = lambda x: F.concat(F.lit("<![CDATA["), x, F.lit("]]>"))
    cat = _cat(s, f)
    xml = F.concat(
        F.lit("<"), element, F.lit(">"), tag("item_id", c("code")), tag("PRODUCTNAME", cdata(c("name"))), tag("DESCRIPTION", cdata(c("description"))),
        F.coalesce(tag("PRICE_VAT", c("price").cast("string")), F.lit("")), tag("EAN", c("ean")), tag("BRAND", c("manufacturer")),
        tag("IMGURL", c("image")), tag("IMGURL_ALTERNATIVE", F.lit("https://img.example/2.jpg")), tag("ITEMGROUP_ID", c("parent_code")),
        F.lit("<PARAM><PARAM_NAME>size</PARAM_NAME><VAL>"), c("stock").cast("string"), F.lit("</VAL></PARAM><PARAM><PARAM_NAME>empty</PARAM_NAME><VAL></VAL></PARAM></"), element, F.lit(">"))
    return cat.select("row_idx", xml.alias("xml"))


def _folder(s, kind):
    return f"{scratch_dir(s)}/{kind}-{uuid.uuid4().hex}"


def _write_xml(s, rows, xml, path, root="SHOP"):
    """Rows with one XML element each as files of some thousand elements, each with a root element around them."""
    part = F.pmod(F.xxhash64(xml), F.lit(max(4, rows.count() // 5000)))
    rows.select(part.alias("part"), xml.alias("x")).groupBy("part").agg(F.array_join(F.collect_list("x"), "\n").alias("x")).select(
        "part", F.concat(F.lit(f"<{root}>"), "x", F.lit(f"</{root}>")).alias("value")).write.partitionBy("part").text(path)


def _xml_records(s, f):
    # explode keeps the parsed struct as one value; otherwise each field would parse the text again
    return _xml_items(s, f).select("row_idx", F.explode(F.array(
        F.from_xml("xml", sc.xml_schema().simpleString(), {"ignoreNamespace": "true"}))).alias("r"))


_add("s02_s03_xml_products", lambda s, f: sc.canonical_products(sc.xml_products(_xml_records(s, f), "r")).select(
    "row_idx", "code", "name", F.md5("description").alias("description"), "price", "ean", "manufacturer", "image_count", "parent_code",
    F.array_join("filter_parameters", "|").alias("filter_parameters")), f"""
select row_idx, code, trim(name) as name, md5({d.trim('description')}) as description, price, ean, manufacturer, (1 + (image <> '')::int)::integer as image_count, parent_code,
 'size:' || stock as filter_parameters from catalog""")
def _xml_file(s, f):
    """Products written as XML with two kinds of elements, and read back from the files."""
    folder = _folder(s, "xml")
    items = _xml_items(s, f, F.when(c("row_idx") % 3 == 0, "item").otherwise("SHOPITEM"))
    _write_xml(s, items, c("xml"), folder)
    return sc.canonical_products(sc.read_xml_products(s, folder)).select(
        "code", "name", F.md5("description").alias("description"), "price", "ean", "manufacturer", "image_count", "parent_code",
        F.array_join("filter_parameters", "|").alias("filter_parameters"))


_add("s02_xml_product_files", _xml_file, f"""
select code, trim(name) as name, md5({d.trim('description')}) as description, price, ean, manufacturer, (1 + (image <> '')::int)::integer as image_count, parent_code,
 'size:' || stock as filter_parameters from catalog""")


def _category_files(s, f):
    """The category feed as CSV and as XML files, both read back."""
    cats = load(s, f, "categories").select("code", "name", F.coalesce("parent_code", F.lit("")).alias("parent_code"), "path", "description")
    csv, xml = _folder(s, "categories"), _folder(s, "categories") + ".xml"
    sinks.write_csv(cats.select(c("code").alias("GUID"), c("name").alias("Název"), c("parent_code").alias("PARENT_ID"),
                                c("path").alias("CATEGORY_FULLNAME"), c("description").alias("Popis")), csv)
    tag = lambda t, x: F.concat(F.lit(f"<{t}>"), c(x), F.lit(f"</{t}>"))
    element = F.when(F.length("code") % 2 == 0, "item").otherwise("category")
    _write_xml(s, cats, F.concat(F.lit("<"), element, F.lit(">"), tag("id", "code"), tag("TITLE", "name"), tag("parentId", "parent_code"),
                                 tag("CATEGORY_FULLNAME", "path"), tag("description", "description"), F.lit("</"), element, F.lit(">")), xml)
    read = lambda path, kind: sc.read_categories(s, path).select(
        F.lit(kind).alias("kind"), "code", "name", "parent_code", "path", "description")
    return read(csv, "csv").unionByName(read(xml, "xml"))


_add("s04_category_files", _category_files, """
select kind, code, name, coalesce(parent_code, '') as parent_code, path, description from categories, (select unnest(['csv', 'xml']) as kind)""", ["categories"])


def _nested_nodes(s, f):
    """The taxonomy's paths as a tree of three levels: platform, first and last name of the path."""
    parts = F.split("full_path", r" \| | > ")
    rows = load(s, f, "taxonomy").select("platform", F.element_at(parts, 1).alias("top"), F.element_at(parts, -1).alias("leaf")).distinct()
    return rows.select("platform", "top", "leaf", F.md5(F.concat_ws("/", "platform", "top", "leaf")).alias("id"),
                       F.md5(F.concat_ws("/", "platform", "top")).alias("top_id"), F.md5("platform").alias("platform_id"))


_NODES = """
, w as (select distinct platform, regexp_split_to_array(full_path, ' [|>] ') as p from taxonomy)
, n as (select distinct platform, p[1] as top, p[-1] as leaf from w)
"""


def _nested_xml_files(s, f):
    folder, open_ = _folder(s, "tree"), lambda i, n: F.concat(
        F.lit("<CATEGORY><CATEGORY_ID>"), c(i), F.lit("</CATEGORY_ID><CATEGORY_NAME>"), c(n), F.lit("</CATEGORY_NAME>"))
    close = F.lit("</CATEGORY>")
    tops = _nested_nodes(s, f).withColumn("x", F.concat(open_("id", "leaf"), close)).groupBy("platform", "platform_id", "top", "top_id").agg(
        F.array_join(F.collect_list("x"), "").alias("inner"))
    roots = tops.withColumn("x", F.concat(open_("top_id", "top"), c("inner"), close)).groupBy("platform", "platform_id").agg(
        F.array_join(F.collect_list("x"), "").alias("inner"))
    roots.select("platform", F.concat(F.lit("<HEUREKA>"), open_("platform_id", "platform"), c("inner"), close, F.lit("</HEUREKA>")).alias(
        "value")).write.partitionBy("platform").text(folder)
    return tax.read_nested_xml(s, folder)


_add("s13_nested_xml_files", _nested_xml_files, _NODES + """
select md5(platform || '/' || top || '/' || leaf) as id, leaf as name, platform || ' | ' || top || ' | ' || leaf as full_path from n""", ["taxonomy"])


def _nested_json_files(s, f):
    """One document per platform; a node of its own path starts there, and one without id is skipped."""
    folder = _folder(s, "tree")
    leaf = F.struct("id", c("leaf").alias("name"), F.when(F.length("leaf") % 3 == 0, F.concat(F.lit("Own | "), c("leaf"))).alias("categoryText"))
    tops = _nested_nodes(s, f).groupBy("platform", "platform_id", "top", "top_id").agg(F.collect_list(leaf).alias("children"))
    roots = tops.groupBy("platform", "platform_id").agg(F.collect_list(F.struct(c("top_id").alias("id"), c("top").alias("name"), "children")).alias("children"))
    roots.select(F.to_json(F.struct(F.when(F.length("platform") % 2 == 0, c("platform_id")).alias("id"), c("platform").alias("name"), "children")).alias(
        "value"), "platform").write.partitionBy("platform").text(folder)
    read = [tax.read_nested_json(s, f"{folder}/platform={r['platform']}") for r in load(s, f, "taxonomy").select("platform").distinct().collect()]
    return reduce(lambda a, b: a.unionByName(b), read)


_add("s14_nested_json_files", _nested_json_files, _NODES + """
select md5(platform || '/' || top || '/' || leaf) as id, leaf as name, case when length(leaf) % 3 = 0 then 'Own | ' || leaf else platform || ' | ' || top || ' | ' || leaf end as full_path from n
union all select distinct md5(platform || '/' || top), top, platform || ' | ' || top from n
union all select distinct md5(platform), platform, platform from n where length(platform) % 2 = 0""", ["taxonomy"])


def _flat_xml_files(s, f):
    folder, tag = _folder(s, "flat"), lambda t, x: F.concat(F.lit(f"<{t}>"), x, F.lit(f"</{t}>"))
    _write_xml(s, load(s, f, "taxonomy"), tag("CATEGORY", F.concat(
        F.when(F.length("id") % 4 != 0, tag("CATEGORY_ID", c("id"))).otherwise(""), tag("CATEGORY_NAME", F.concat(F.lit(" "), c("name"))),
        tag("CATEGORY_FULLNAME", F.replace("full_path", F.lit(">"), F.lit("&gt;"))))), folder)
    return tax.read_flat_xml(s, folder)


_add("s15_flat_xml_files", _flat_xml_files, "select id, trim(name) as name, trim(full_path) as full_path from taxonomy where length(id) % 4 <> 0", ["taxonomy"])


def _list_files(s, f):
    folder = _folder(s, "list")
    load(s, f, "taxonomy").select(
        F.concat(F.when(F.length("id") % 5 == 0, "# ").otherwise(""), F.length("id").cast("string"), F.lit(" - "), c("full_path"))).write.text(folder)
    return tax.read_list(s, folder)


_add("s12_list_files", _list_files, """
select cast(length(id) as varchar) as id, full_path, trim(string_split(full_path, ' > ')[-1]) as name from taxonomy where length(id) % 5 <> 0""", ["taxonomy"])


def _price_list_files(s, f):
    folder = _folder(s, "prices")
    sinks.write_price_lists(tools.wholesale_prices(_cat(s, f)), folder)
    return s.read.option("header", True).csv(folder).select(
        "code", c("discountPercent").cast("int").alias("discountPercent"), c("wholesalePrice").cast("double").alias("wholesalePrice"))


_add("f02_price_list_files", _price_list_files, """
select code, p as discountPercent, floor(price * (1 - p / 100.0::double) * 100.0 + 0.5) / 100.0 as wholesalePrice from catalog, (select unnest([10, 20, 30]) as p)""")


def _code_files(s, f):
    folder = _folder(s, "codes")
    sinks.write_issue_codes(row_issues(_cat(s, f), AuditParams(), ["business"]), "suspicious_discount", folder)
    return sc.read_csv(s, folder)


_add("s22_issue_code_files", _code_files)
ORACLES["s22_issue_code_files"] = "select distinct entity_key as code from (" + AUDIT["b01_b10_business"] + ") where type = 'suspicious_discount'"
_add("s04_p12_category_feed", lambda s, f: sc.canonical_categories(load(s, f, "categories").select(
    c("code").alias("GUID"), F.when(F.length("code") % 2 == 0, c("name")).otherwise("").alias("Název"), c("parent_code").alias("PARENT_ID"),
    c("path").alias("CATEGORY_FULLNAME"), c("description").alias("Popis"), F.when(c("is_active"), "ano").otherwise("ne").alias("Aktivní"))).select(
    "code", "name", "parent_code", "path", "description", "is_active"), """
select code, case when length(code) % 2 = 0 then name else trim(string_split(path, ' | ')[-1]) end as name, coalesce(parent_code, '') as parent_code,
 path, description, is_active from categories""", ["categories"])


def _gate_row(s, f):
    cat = _cat(s, f)
    good = cat.select("code", c("pair_code").alias("pairCode"), "name", c("default_category").alias("defaultCategory"),
                      c("category_text").alias("categoryText"), c("category_text2").alias("categoryText2"))
    results = [gates.linking_gate(good), gates.linking_gate(good.drop("pairCode")), gates.linking_gate(good.withColumn("ean", F.lit("1")))]
    text = "|".join(";".join(r.errors) or "ok" for r in results)
    return cat.agg(F.count(F.lit(1)).alias("rows")).withColumn("linking", F.lit(text)).withColumn(
        "found", F.lit(gates.find_column(["Row", " Cena ", "Title"], gates.PRICE_COLUMNS)))


_add("s08_s09_gates", _gate_row, """select count(*) as rows, 'ok|missing columns: pairCode|columns not allowed: ean' as linking, ' Cena ' as found from catalog""")


def _linking_file(s, f):
    return _cat(s, f).select("code", "name", c("default_category").alias("defaultCategory"), c("category_text").alias("categoryText"),
                             c("category_text2").alias("categoryText2"), "ean", c("price").alias(" Cena "))


def _verdicts(s, f):
    """Verdicts of all columns, and the text that the gate refuses the file with in the row of the first one."""
    df = _linking_file(s, f)
    refused = "; ".join(gates.linking_gate(df).errors)
    return gates.column_report(df).withColumn("refused", F.when(c("column") == "code", refused))


_add("s09_column_verdicts", _verdicts, ", catalog2 as (select *, coalesce(cast(price as varchar), '') as p from catalog)\n" + " union all ".join(
    f"select {d.q(x)} as \"column\", {d.q(v)} as verdict, {n} as filled, {r} as refused from catalog2" for x, v, n, r in [
        ("code", "required", "count(*) filter (trim(code) <> '')", "'missing columns: pairCode'"), ("name", "required", "count(*) filter (trim(name) <> '')", "null"),
        ("defaultCategory", "required", "count(*) filter (trim(default_category) <> '')", "null"),
        ("categoryText", "required", "count(*) filter (trim(category_text) <> '')", "null"),
        ("categoryText2", "allowed", "count(*) filter (trim(category_text2) <> '')", "null"),
        ("ean", "not allowed", "count(*) filter (trim(ean) <> '')", "null"), (" Cena ", "not allowed", "count(*) filter (p <> '')", "null"),
        ("pairCode", "missing", "count(*) filter (false)", "null")]))
_add("s08_found_columns", lambda s, f: gates.meaning_report(_linking_file(s, f).drop("code")), """
select 'image' as meaning, null as "column", 0 as filled union all select 'price', ' Cena ', count(*) filter (price is not null) from catalog
union all select 'name', 'name', count(*) filter (trim(name) <> '') from catalog union all select 'code', 'ean', count(*) filter (trim(ean) <> '') from catalog""")
_add("p05_p06_stock_and_dates", lambda s, f: _cat(s, f).select(
    "row_idx", vl.parse_stock(F.when(c("row_idx") % 3 == 0, F.concat(F.lit(" "), c("stock"), F.lit(".5 "))).when(c("row_idx") % 3 == 1, c("availability"))).alias("stock"),
    F.unix_micros(vl.parse_date(c("price") * 20, T.DoubleType())).alias("from_number"),
    F.unix_micros(vl.parse_date(F.when(c("row_idx") % 4 == 0, "").when(c("row_idx") % 4 == 1, c("name")).otherwise(
        c("created_at").cast("string")), T.StringType())).alias("from_text")), """
select row_idx, case when row_idx % 3 = 0 then cast(stock || '.5' as double) else 0.0 end as stock,
 cast(trunc((price * 20 - 25569) * 86400000) as bigint) * 1000 as from_number, case when row_idx % 4 in (2, 3) then epoch_us(created_at) end as from_text from catalog""")


def _adapter(s, f):
    """An export with spreadsheet line ends, cleaned, checked and turned into requests by the platform's adapter."""
    a = ExportAdapter()
    raw = _cat(s, f).select("code", "name", c("short_description").alias("shortDescription"), F.concat(
        F.lit("x_x000d_\r\n"), "manufacturer").alias("manufacturer"), F.lit("").alias("description"), "row_idx")
    parsed = a.parse(raw)
    refusals = len(a.validate(parsed.drop("row_idx")).errors)
    found = a.find(parsed.columns, "name")
    return a.requests(parsed, [found, "manufacturer"]).select(
        c("row_idx").cast("bigint").alias("row_idx"), "source_text", "error", F.lit(refusals).alias("refusals"))


_add("platform_adapter_requests", _adapter, """
select row_idx, concat_ws(chr(10) || chr(10), case when name <> '' then 'Název produktu: ' || name end, 'Výrobce: x' || chr(10) || manufacturer) as source_text,
 null as error, 0 as refusals from catalog""")


def _coverage(s, f):
    cat = _cat(s, f).select("code", F.when(c("row_idx") % 3 == 0, c("name")).otherwise(" ").alias("name"),
                            F.when(c("row_idx") % 5 == 0, c("short_description")).otherwise("").alias("shortDescription"),
                            F.lit("").alias("description"), F.lit("x").alias("image12"), F.lit("x").alias("textProperty2"), F.lit("x").alias("odd"))
    counted = materialise(gates.text_coverage(cat))
    g = gates.enrichment_gate(cat, counted)
    return counted.withColumn("errors", F.lit(";".join(g.errors))).withColumn("warnings", F.lit(len(g.warnings)))


_add("s10_enrichment_gate", _coverage, """select count(*) as rows, count(*) filter (not (row_idx % 3 = 0 and trim(name) <> '') and not (row_idx % 5 = 0 and trim(short_description) <> '')) as rows_without_text,
 'columns not allowed: odd' as errors, 2 as warnings from catalog""")
_add("s11_clean_cells", lambda s, f: gates.clean_cells(table(s, f, "documents").select(
    "doc_id", F.concat(F.replace("text", F.lit(" "), F.lit("_x000d_\r\n")), F.lit("\rend")).alias(" text "))), """
select cast(doc_id as varchar) as doc_id, replace(text, ' ', chr(10)) || chr(10) || 'end' as text from (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents)""", None)
_add("s12_taxonomy_list", lambda s, f: tax.parse_list(load(s, f, "taxonomy").select(
    F.concat(F.length("id").cast("string"), F.lit(" - "), c("full_path")).alias("value"))), """
select cast(length(id) as varchar) as id, full_path, trim(string_split(full_path, ' > ')[-1]) as name from taxonomy""", ["taxonomy"])


def _tree(s, f):
    """Parent links rebuilt from the paths of a taxonomy, then expanded to paths again."""
    parts = F.split(F.concat("platform", F.lit(" | "), "full_path"), r" \| ")
    upto = lambda i: F.array_join(F.slice(c("p"), F.lit(1), i), " | ")
    nodes = load(s, f, "taxonomy").select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).select(
        F.md5(upto(c("i"))).alias("id"), F.element_at("p", c("i")).alias("name"),
        F.when(c("i") > 1, F.md5(upto(c("i") - 1))).alias("parent_id")).distinct()
    return tax.tree_paths(nodes).select("name", "full_path", "is_leaf")


_add("s13_s14_taxonomy_tree", _tree, """
, p as (select string_split(platform || ' | ' || full_path, ' | ') as p from taxonomy)
, n as (select distinct array_to_string(p[1:i], ' | ') as full_path, p[i] as name from (select p, unnest(range(1, len(p) + 1)) as i from p))
select name, full_path, not exists (select 1 from n k where starts_with(k.full_path, n.full_path || ' | ')) as is_leaf from n""", ["taxonomy"])
_add("s17_pages", lambda s, f: table(s, f, "pages").join(load(s, f, "fetches"), "url").select(
    "page_id", "url", "status", F.md5("html").alias("html_md5")), """
select page_id, p.url, status, md5(html) as html_md5 from pages p join fetches using (url)""", ["fetches"])
_add("s22_u02_issue_codes", lambda s, f: issue_codes(row_issues(_cat(s, f), AuditParams(), ["business"]), "suspicious_discount"))
ORACLES["s22_u02_issue_codes"] = "select distinct entity_key as code from (" + AUDIT["b01_b10_business"] + ") where type = 'suspicious_discount'"
_add("p27_typed_site_urls", lambda s, f: table(s, f, "pages").select("page_id", ur.complete_site_url(
    F.when(c("page_id") % 2 == 0, ur.host(c("url"))).otherwise(F.concat(F.lit("http://shop"), c("page_id").cast("string"), F.lit(".cz")))).alias("site")), """
select page_id, case when page_id % 2 = 1 then 'http://www.shop' || page_id || '.cz/'
 else 'https://' || case when starts_with(h, 'www.') then h else 'www.' || h end end as site
from (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as h from pages)""", None)

# ---- enrichment ----------------------------------------------------------------------------


def _cap(x):
    return f"upper(left({x}, 1)) || substr({x}, 2)"


def _name(x):
    cases = " ".join(f"when {d.q(k)} then {d.q(v)}" for k, v in pm.NAME_SYNONYMS.items())
    return f"case lower({d.trim(x)}) {cases} else {_cap(d.trim(x))} end"


def _acr(x):
    for k, v in pm.ACRONYMS.items():
        x = f"regexp_replace({x}, '(?i)\\b{k}\\b', '{v}', 'g')"
    return x


_FIRST = r"regexp_extract(v, '^([^\s,;\-]*)', 1)"
_KEEP = (f"(regexp_matches({_FIRST}, '^[A-Z0-9]+$') or (regexp_matches({_FIRST}, {d.q(pm.TITLE_CASE)}) and not (" +
         " or ".join(f"ends_with(lower({_FIRST}), '{e}')" for e in pm.COMMON_ENDINGS) + ")) or " +
         " or ".join(f"starts_with(v, {d.q(b)})" for b in pm.KEPT_BEGINNINGS) + ")")
_SPLIT = "case " + " ".join(f"when contains(value, {d.q(sep)}) then string_split(value, {d.q(sep)})" for sep in pm.VALUE_SEPARATORS) + " else [value] end"
_PARAMS = f""", js as (select row_idx, case when json_valid(payload) then payload end as j from responses)
, f0 as (select row_idx, unnest(range(0, json_array_length(j, '$.filtering')::int)) as i, j from js where j is not null)
, f1 as (select row_idx, i, json_extract_string(j, '$.filtering[' || i || '].name') as name, json_extract_string(j, '$.filtering[' || i || '].value') as value from f0)
, f2 as (select row_idx, i, name, {d.trim('unnest(parts)')} as v, unnest(range(0, len(parts))) as k from (select *, {_SPLIT} as parts from f1 where trim(value) <> ''))
, f3 as (select row_idx, row_number() over (partition by row_idx order by i, k) as pos, {_name('name')} as name,
   {_acr(f"case when {_KEEP} then v else lower(left(v, 1)) || substr(v, 2) end")} as value from f2 where v <> '')
, fil as (select * from f3 qualify row_number() over (partition by row_idx, lower(value) order by name in {d.in_list(pm.PRIORITY_NAMES)} desc, pos) = 1)
, t0 as (select row_idx, unnest(range(0, json_array_length(j, '$.text')::int)) as i, j from js where j is not null)
, t1 as (select row_idx, i, json_extract_string(j, '$.text[' || i || '].key') as key, json_extract_string(j, '$.text[' || i || '].value') as value from t0)
, t2 as (select row_idx, i as pos, {_name('key')} as key, {_acr(d.trim('value'))} as value from t1 where key <> '' and value <> '')
, txt as (select * from t2 qualify row_number() over (partition by row_idx, key, lower(value) order by pos) = 1)
, par as (select js.row_idx, (select string_agg(name || '=' || value, '|' order by pos) from fil where fil.row_idx = js.row_idx) as filtering,
   (select string_agg(key || '=' || value, '|' order by pos) from txt where txt.row_idx = js.row_idx) as text,
   case when j is null then 'row ' || js.row_idx || ': no valid JSON' end as error from js)
"""


def _params(s, f):
    return en.clean_parameters(en.parse_responses(load(s, f, "responses")))


def _flat(df, *more):
    join = lambda col, k: F.nullif(F.array_join(F.transform(col, lambda x: F.concat(x[k], F.lit("="), x["value"])), "|"), F.lit(""))
    return df.select("row_idx", *more, join("filtering", "name").alias("filtering"), join("text", "key").alias("text"))


_RV = ["responses"]
_add("e01_p30_requests", lambda s, f: en.enrichment_requests(
    _cat(s, f).withColumn("name", F.when(c("row_idx") % 9 == 0, "").otherwise(c("name"))), ["name", "shortDescription", "manufacturer"]).select(
    "row_idx", "source_text", "error"), """
, r as (select row_idx, code, case when row_idx % 9 = 0 then '' else name end as name, short_description as sd, manufacturer as mf from catalog)
select row_idx, concat_ws(chr(10) || chr(10), case when name <> '' then 'Název produktu: ' || name end, case when sd <> '' then 'Krátký popis: ' || sd end,
 case when mf <> '' then 'Výrobce: ' || mf end) as source_text, case when name = '' and sd = '' and mf = '' then coalesce(nullif(name, ''), code) || ': no source text' end as error from r""")
_add("e02_parse_responses", lambda s, f: _flat(en.parse_responses(load(s, f, "responses")), "error"), _PARAMS + """
select row_idx, case when j is null then 'row ' || row_idx || ': no valid JSON' end as error,
 (select string_agg(name || '=' || value, '|' order by i) from f1 where f1.row_idx = js.row_idx) as filtering,
 (select string_agg(key || '=' || value, '|' order by i) from t1 where t1.row_idx = js.row_idx) as text from js""", _RV)
_add("e03_e06_p29_parameters", lambda s, f: _flat(_params(s, f), "error"), _PARAMS + "select row_idx, error, filtering, text from par", _RV)
_add("a18_outcomes", lambda s, f: en.outcome_counts(_params(s, f)), _PARAMS + """
select count(*) filter (error is null) as succeeded, count(*) filter (error is not null) as failed from par""", _RV)


def _grouped(s, f):
    return en.with_category(_cat(s, f), _params(s, f))


def _groups(rows):
    return en.category_groups(rows).select("category", "products", F.array_join("category_path", "/").alias("category_path"),
                                           F.array_join("filtering_names", ",").alias("filtering_names"), F.array_join("text_names", ",").alias("text_names"))


_CG = """, cr as (select row_idx, case when trim(category_text) <> '' then trim(category_text) when trim(default_category) <> '' then trim(default_category) else 'Bez kategorie' end as category,
  array_to_string(list_filter([trim(default_category), trim(category_text), trim(category_text2)], lambda x: x <> ''), '/') as p from catalog)
, fl as (select * from fil {where})
, gr as (select category, count(*) as products, coalesce(nullif(arg_min(p, row_idx), ''), 'Bez kategorie') as category_path from cr group by 1)
select gr.*, coalesce((select string_agg(n, ',' order by n collate cs) from (select distinct name as n from fl join cr using (row_idx) where cr.category = gr.category)), '') as filtering_names,
 coalesce((select string_agg(n, ',' order by n collate cs) from (select distinct key as n from txt join cr using (row_idx) where cr.category = gr.category)), '') as text_names from gr"""
_add("a06_e07_category_groups", lambda s, f: _groups(_grouped(s, f)), _PARAMS + _CG.format(where=""), ["catalog", "responses"])
_add("e08_remove_parameter", lambda s, f: _groups(en.remove_parameter(_grouped(s, f), "SMALL | ring", "filtering", "Barva")),
     _PARAMS + _CG.format(where="where not (name = 'Barva' and row_idx in (select row_idx from cr where category = 'SMALL | ring'))"), ["catalog", "responses"])


def _edits(s, f):
    empty = "array<struct<{k}:string,value:string>>"
    e = _cat(s, f).filter("availability = 'Na dotaz'").select(
        "row_idx", F.array(F.struct(F.lit("Barva").alias("name"), F.lit("bílá").alias("value"))).alias("filtering"),
        F.array().cast(empty.format(k="key")).alias("text"))
    return _flat(en.edit_parameters(_params(s, f), e))


_add("j13_edit_parameters", _edits, _PARAMS + """select par.row_idx, case when availability = 'Na dotaz' then 'Barva=bílá' else filtering end as filtering,
 case when availability = 'Na dotaz' then null else text end as text from par join catalog using (row_idx)""", ["catalog", "responses"])


def _wide(s, f):
    products = _cat(s, f).select("row_idx", "code", F.when(c("row_idx") % 2 == 0, "stará").alias("filteringProperty:Barva"),
                                 F.when(c("row_idx") % 3 == 0, "a;b").alias("textProperty"), F.lit("c;d").alias("textProperty2"))
    return en.wide_output(products, _params(s, f), 5, 2)


_add("e09_s23_wide_output", _wide, _PARAMS + """
, ff as (select *, row_number() over (partition by row_idx order by pos) as k from fil), f5 as (select * from ff where k <= 5)
, tt as (select *, row_number() over (partition by row_idx order by pos) as k from txt)
, w as (select c.row_idx, c.code, (select arg_min(value, pos) from f5 where f5.row_idx = c.row_idx and name = 'Barva') as barva,
  (select arg_max(value, pos) from f5 where f5.row_idx = c.row_idx and name = 'Značka') as znacka,
  (select any_value(key || ';' || value) from tt where tt.row_idx = c.row_idx and k = 1) as a, (select any_value(key || ';' || value) from tt where tt.row_idx = c.row_idx and k = 2) as b from catalog c)
select cast(row_idx as varchar) as row_idx, code, case when row_idx % 2 = 0 then 'stará' else coalesce(barva, '') end as "filteringProperty:Barva", coalesce(znacka, '') as "filteringProperty:Značka",
 case when row_idx % 3 = 0 then 'a;b' else coalesce(a, '') end as "textProperty", 'c;d' as "textProperty2",
 case when row_idx % 3 = 0 then coalesce(a, '') else coalesce(b, '') end as "textProperty3", case when row_idx % 3 = 0 then coalesce(b, '') else '' end as "textProperty4" from w""",
     ["catalog", "responses"])

# ---- status polls --------------------------------------------------------------------------


def _polls(df):
    return df.select("poll_id", c("ts").cast("timestamp").alias("ts"), "platform", st.status_of(c("indicator")).alias("status"),
                     F.concat(F.lit("text "), "indicator").alias("status_text"), "indicator")


_ST = """, sp as (select *, case indicator when 'none' then 'operational' when 'minor' then 'degraded' when 'major' then 'partial_outage' when 'critical' then 'major_outage' else 'unknown' end as status from status_polls)
, lg as (select *, lag(status) over (partition by platform order by ts, poll_id) as previous from sp)
, ch as (select *, previous is null or previous <> status as changed, coalesce(previous, 'unknown') in ('operational', 'degraded', 'unknown') and status in ('partial_outage', 'major_outage') as alert from lg)
, ls as (select platform, arg_max(status, (ts, poll_id)) as status, 'text ' || arg_max(indicator, (ts, poll_id)) as status_text, arg_max(indicator, (ts, poll_id)) as indicator,
   max(epoch_us(ts)) as last_checked, max(epoch_us(ts)) filter (changed) as last_changed from ch group by 1)
"""
_SV = ["status_polls"]
_micros = lambda x: F.unix_micros(c(x)).alias(x)
_add("s18_json_polls", lambda s, f: load(s, f, "status_polls").select("poll_id", st.parse_json_poll(F.when(
    c("poll_id") % 11 == 0, "oops").otherwise(F.concat(F.lit('{"page":{"id":"x"},"status":{"indicator":"'), "indicator", F.lit('","description":"Text '), "indicator", F.lit('"}}')))).alias("r")).select(
    "poll_id", "r.*"), _ST + """
select poll_id, case when poll_id % 11 = 0 then 'unknown' else status end as status, case when poll_id % 11 = 0 then 'Unable to fetch status' else 'Text ' || indicator end as status_text,
 case when poll_id % 11 = 0 then 'unknown' else indicator end as indicator from sp""", _SV)


def _rss(s, f):
    line = lambda text: F.concat(F.lit("<item><description>Service "), text, F.lit("</description></item>"))
    phrase = F.when(c("indicator") == "none", "is Operational").when(c("indicator") == "minor", "has Degraded Performance").when(
        c("indicator") == "major", "Partial Outage").when(c("indicator") == "critical", "Major Outage").otherwise("talks")
    extra = F.when(c("poll_id") % 3 == 0, line(F.lit("under maintenance"))).otherwise("")
    return load(s, f, "status_polls").select("poll_id", st.parse_feed_poll(F.concat(F.lit("<rss><channel>"), line(phrase), extra, F.lit("</channel></rss>"))).alias("r")).select("poll_id", "r.*")


_add("s19_feed_polls", _rss, _ST + """
select poll_id, case indicator when 'critical' then 'major_outage' when 'major' then 'partial_outage' when 'minor' then 'degraded' else case when poll_id % 3 = 0 then 'degraded' when indicator = 'none' then 'operational' else 'unknown' end end as status,
 case indicator when 'critical' then 'Major Outage (1 services)' when 'major' then 'Partial Outage (1 services)' when 'minor' then 'Degraded (' || (1 + (poll_id % 3 = 0)::int) || ' services)'
 else case when poll_id % 3 = 0 then 'Degraded (1 services)' when indicator = 'none' then 'All Systems Operational' else 'Unable to determine status' end end as status_text from sp""", _SV)
_add("w05_j14_status_changes", lambda s, f: st.status_changes(_polls(load(s, f, "status_polls"))).select(
    "poll_id", "platform", "status", "previous", "changed", "alert"), _ST + "select poll_id, platform, status, previous, changed, alert from ch", _SV)
_add("s24_t01_state", lambda s, f: st.next_state(st.status_changes(_polls(load(s, f, "status_polls")))).select(
    "platform", "status", "status_text", "indicator", _micros("last_checked"), _micros("last_changed")), _ST + "select * from ls", _SV)


def _view(s, f):
    polls = _polls(load(s, f, "status_polls"))
    more = polls.select("platform").unionByName(polls.select(F.concat("platform", F.lit("_new")).alias("platform"))).distinct()
    return st.current_view(more, st.next_state(st.status_changes(polls))).select(
        "platform", "status", "status_text", "indicator", _micros("last_checked"), _micros("last_changed"))


_add("t02_current_view", _view, _ST + """select * from ls union all select platform || '_new', 'unknown', 'Not yet checked', 'unknown', null, null from ls""", _SV)
_add("a16_worst_status", lambda s, f: worst_status(st.next_state(st.status_changes(_polls(load(s, f, "status_polls"))))), _ST + """
select case min(case status when 'major_outage' then 0 when 'partial_outage' then 1 when 'degraded' then 2 when 'unknown' then 3 else 4 end)
 when 0 then 'major_outage' when 1 then 'partial_outage' when 2 then 'degraded' when 3 then 'unknown' else 'operational' end as status from ls""", _SV)


def _stream(s, f):
    """The poll log as a stream, read to its end; result: all alerts."""
    s.conf.set("spark.sql.session.timeZone", "UTC")
    schema = s.read.parquet(f"{f}/events.parquet").schema
    events = s.readStream.schema(schema).parquet(f"{f}/events*.parquet")
    polls = events.select(
        c("event_id").alias("poll_id"), "ts", F.concat(F.lit("platform_"), c("user_id") % 4).alias("platform"),
        F.when(c("event_type") == "view", "none").when(c("event_type") == "click", "minor").when(c("event_type") == "signup", "major").when(
            c("event_type") == "error", "critical").otherwise("n/a").alias("indicator"))
    folder = f"{scratch_dir(s)}/status-{uuid.uuid4().hex}"
    st.monitor(_polls(polls), folder, interval=None).awaitTermination()
    return st.read_alerts(s, folder).select("poll_id", "platform", "previous", "status")


_add("t01_t03_alert_stream", _stream, _ST + "select poll_id, platform, previous, status from ch where alert", _SV)


POLLS_AT_ONCE = 1_000_000  # polls that the log grows by, about


def _poll_log(s, f):
    """A log of all polls that grows while it is watched: its earlier part is read to the end, then the next one after a restart.

    There are two parts, and more where a part would have over POLLS_AT_ONCE polls: a task holds those of one platform in a
    part, so its memory does not grow with the log. Polls of one time are in one part.
    """
    log, folder = (f"{scratch_dir(s)}/{x}-{uuid.uuid4().hex}" for x in ("polls", "status"))
    polls = load(s, f, "status_polls")
    failed = c("poll_id") % 11 == 0
    service = F.when(c("indicator") == "none", "is Operational").when(c("indicator") == "minor", "has Degraded Performance").when(
        c("indicator") == "major", "Partial Outage").when(c("indicator") == "critical", "Major Outage").otherwise("talks")
    is_feed = c("platform") == "platform_1"
    body = F.when(failed, None).when(is_feed, F.concat(F.lit("<rss><description>Service "), service, F.lit("</description></rss>"))).otherwise(
        F.concat(F.lit('{"status":{"indicator":"'), "indicator", F.lit('"}}')))
    lines = polls.select("ts", F.to_json(F.struct(
        "poll_id", F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("fetched_at"), "platform",
        F.when(is_feed, "feed").otherwise("json").alias("kind"), body.alias("body"))).alias("value"))
    k = max(2, -(-polls.count() // POLLS_AT_ONCE))
    cuts = materialise(polls.agg(F.percentile_approx("ts", [i / k for i in range(1, k)], 100 * k).alias("cuts"))).scalar()
    for i in range(k):
        after = F.get(cuts, F.lit(i - 1)) < c("ts") if i else F.lit(True)
        until = c("ts") <= F.get(cuts, F.lit(i)) if i < k - 1 else F.lit(True)
        lines.filter(after & until).select("value").write.mode("append").text(log)
        st.monitor(st.poll_stream(s, log), folder, interval=None).awaitTermination()
    return st.read_alerts(s, folder).select("poll_id", "platform", "previous", "status")


_add("t03_poll_log", _poll_log, """, pl as (select poll_id, ts, platform, case when poll_id % 11 = 0 then 'unknown' else case indicator
  when 'none' then 'operational' when 'minor' then 'degraded' when 'major' then 'partial_outage' when 'critical' then 'major_outage' else 'unknown' end end as status from status_polls)
select * from (select poll_id, platform, lag(status) over (partition by platform order by ts, poll_id) as previous, status from pl)
where status in ('partial_outage', 'major_outage') and (previous is null or previous in ('operational', 'degraded', 'unknown'))""", _SV)
