"""Registered queries of the product tools and of product linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocklens.fixtures import load, oracle
from stocklens.functions.category import path_prefixes
from stocklens.operators import linking, tools
from stocklens.operators.linking import LinkSettings
from stocklens.operators.tools import Promotion
from stocklens.session import materialise

QUERIES, ORACLES = {}, {}


def _cat(spark, sf):
    return load(spark, sf, "catalog")


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = oracle(["catalog"], sql)


_add("f01_hide_sold_out", lambda s, d: tools.hide_sold_out(_cat(s, d)), """
select code, pair_code as pairCode, case when trim(pair_code) <> '' then 0 end as variantVisibility,
 case when trim(pair_code) = '' then 'hidden' end as productVisibility from catalog where coalesce(stock, 0) = 0""")
_add("f02_wholesale_prices", lambda s, d: tools.wholesale_prices(_cat(s, d)), """
select code, name, price as originalPrice, p as discountPercent, floor(price * (1 - p / 100.0::double) * 100.0 + 0.5) / 100.0 as wholesalePrice
from catalog, (select unnest([10, 20, 30]) as p)""")
_PROMO = Promotion(flag="summer", price_from=901, price_to=1500, brands=["Brand#2", "Brand#17", "Brand#5"],
                   brandless_codes=["P31", "P62", "P155"], categories=["SMALL", "ECONOMY | ring"],
                   valid_from="2024-02-01", valid_until="2024-03-01", discount_percent=15, action_from="2024-02-05")
_WHERE = """price >= 901 and price <= 1500 and ((trim(manufacturer) = '' and code in ('P31', 'P62', 'P155')) or
 trim(manufacturer) in ('Brand#2', 'Brand#17', 'Brand#5')) and (trim(category_text) = 'SMALL' or starts_with(trim(category_text), 'SMALL | ')
 or trim(category_text) = 'ECONOMY | ring' or starts_with(trim(category_text), 'ECONOMY | ring | '))"""
_add("f03_f04_promotion", lambda s, d: tools.promotion_rows(_cat(s, d), _PROMO), f"""
select code, pair_code as pairCode, 1 as summerFlagActive, '2024-02-01' as summerFlagValidFrom, '2024-03-01' as summerFlagValidUntil,
 floor(price * (1.0::double - 15.0::double / 100) * 100.0 + 0.5) / 100.0 as actionPrice, '2024-02-05' as actionFrom from catalog where {_WHERE}""")
_FIXED = Promotion(flag="sale", discount_fixed=950.5)
_add("f04_fixed_discount", lambda s, d: tools.promotion_rows(_cat(s, d), _FIXED), """
select code, pair_code as pairCode, 1 as saleFlagActive,
 case when price is null then 0 else greatest(floor((price - 950.5::double) * 100.0 + 0.5) / 100.0, 0.0) end as actionPrice from catalog""")
_add("f05_flags", lambda s, d: tools.active_flags(_cat(s, d).withColumns({
    "newFlagActive": F.col("is_new"), "tipFlagActive": F.col("is_action").cast("int"), "flagActive": F.lit("1")})), """
select 'new' as flag, count(*) filter (is_new) as products from catalog union all select 'tip', count(*) filter (is_action) from catalog""")
_add("f06_search", lambda s, d: tools.search_products(_cat(s, d), "Blue").select("row_idx", "code", "name"), """
select row_idx, code, name from catalog where contains(lower(name), 'blue') or contains(lower(code), 'blue')
 or contains(lower(short_description), 'blue')""")
_add("f07_needs_mapping", lambda s, d: tools.needs_mapping(_cat(s, d).select(
    "row_idx", "code", F.col("category_text2").alias("heurekaCategoryId"), F.col("ean").alias("googleCategoryId")),
    ["heurekaCategoryId", "googleCategoryId"]).select("row_idx", "code"), """
select row_idx, code from catalog where category_text2 = '' or ean = ''""")
_add("f09_brands", lambda s, d: tools.brands(_cat(s, d)), """
select distinct trim(manufacturer) as brand from catalog where trim(manufacturer) <> ''""")
_add("f09_brandless", lambda s, d: tools.brandless(_cat(s, d)).select("row_idx", "code"), """
select row_idx, code from catalog where trim(manufacturer) = ''""")
_add("w01_stock_order", lambda s, d: tools.stock_order(_cat(s, d)), """
select row_idx, code, nullif(pair_code, '') as pairCode, coalesce(nullif(category_text, ''), 'bez-kategorie') as category,
 coalesce(stock, 0)::double as stock,
 row_number() over (partition by coalesce(nullif(category_text, ''), 'bez-kategorie') order by coalesce(stock, 0) desc, row_idx) as priority
from catalog""")
_add("a12_stock_bands", lambda s, d: tools.stock_bands(_cat(s, d)), """
select count(*) filter (coalesce(stock, 0) > 5) as in_stock, count(*) filter (stock > 0 and stock <= 5) as low_stock,
 count(*) filter (coalesce(stock, 0) = 0) as sold_out from catalog""")
_add("k03_sorted_categories", lambda s, d: tools.sorted_categories(
    _cat(s, d).groupBy(F.when(F.col("category_text") == "", "Bez kategorie").otherwise(F.col("category_text")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))), """
select coalesce(nullif(category_text, ''), 'Bez kategorie') as category, count(*) as n from catalog group by 1""")
_add("k04_seeded_order", lambda s, d: tools.seeded_order(_cat(s, d).select(
    "row_idx", "code", F.md5(F.concat(F.lit("fixture"), F.col("row_idx").cast("string"))).alias("place")), "row_idx", "fixture"), """
select row_idx, code, md5('fixture' || row_idx) as place from catalog order by place, row_idx""")
_add("p11_path_prefixes", lambda s, d: _cat(s, d).select("row_idx", F.posexplode(path_prefixes(F.col("category_text")))).select(
    "row_idx", F.col("pos").alias("level"), F.col("col").alias("path")), """
select row_idx, (i - 1)::integer as level, array_to_string(p[1:i], ' | ') as path from (select row_idx, p, unnest(range(1, len(p) + 1)) as i from
 (select row_idx, list_transform(string_split(category_text, '|'), lambda x: trim(x)) as p from catalog))""")
QUERIES["f08_category_search"] = lambda s, d: tools.search_categories(load(s, d, "taxonomy"), "ring").select(
    "platform", "id", "name", "score")
ORACLES["f08_category_search"] = oracle(["taxonomy"], """, s as (select *, case when lower(name) = 'ring' then 100 when starts_with(lower(name), 'ring') then 50
 when contains(lower(name), 'ring') then 30 when contains(lower(full_path), 'ring') then 10 else 0 end as b from taxonomy)
select platform, id, name, (b + greatest(0, 20 - 2 * len(string_split(full_path, '|'))))::integer as score from s where b > 0
order by score desc, platform, id limit 10""")

# ---- linking -------------------------------------------------------------------------------

_MAIN = "nullif(trim(string_split(default_category, '>')[1]), '')"
_SUB = "nullif(array_to_string(list_transform(string_split(default_category, '>')[2:], lambda x: trim(x)), ' > '), '')"
_LINKS = f""", r as (select row_idx, code, {_MAIN} as main, {_SUB} as sub,
   list_distinct(list_filter([trim(category_text), trim(category_text2)], lambda x: x <> '')) as texts from catalog)
, mc as (select main, count(distinct code) as n from r group by 1)
, tx as (select distinct unnest(texts) as t, code from r)
, al as (select r.row_idx, count(distinct tx.code) as n from r, tx where list_contains(r.texts, tx.t) and tx.code <> r.code group by 1)
, k as (select r.*, least(10, case when r.main is null then 0 else mc.n - 1 end)::integer as n_related, least(10, coalesce(al.n, 0))::integer as n_alternative
   from r left join mc on mc.main = r.main left join al on al.row_idx = r.row_idx)
"""


def _counts(s, d):
    """Each side on its own: then the list lengths follow from the group sizes alone."""
    cat = _cat(s, d)
    rel = linking.link_products(cat, LinkSettings(alternative=False)).select("row_idx", "related")
    alt = linking.link_products(cat, LinkSettings(related=False)).select("row_idx", "alternative")
    return linking.with_link_counts(linking.link_rows(cat), rel.join(alt, "row_idx"))


def _ring_sql(name, members, group, want, asked=None):
    """Neighbours on a ring: (group, code, sub, j, c2, s2) for the j-th member after each row."""
    order = "md5('fixture' || code), code, sub nulls first"
    asked = asked or f"{name}_p"
    return f"""
, {name}_m as ({members})
, {name}_p as (select *, row_number() over (partition by {group} order by {order}) - 1 as place, count(*) over (partition by {group}) as n from {name}_m)
, {name} as (select a.{group}, a.code, a.sub, j, b.code as c2, b.sub as s2 from {asked} a cross join range(1, {want + 1}) t(j)
   join {name}_p b on b.{group} = a.{group} and b.place = (a.place + j) % b.n where j <= a.n)
"""


_PICKS = _LINKS + ", mm as (select distinct main, sub, code from r where main is not null)" + _ring_sql(
    "rg", "select main, sub, code from mm", "main", 168) + """
, lg as (select main, arg_max(sub, k * 1000000 + rk) as largest from (
   select main, sub, count(*) as k, row_number() over (partition by main order by sub) as rk from mm where sub is not null group by 1, 2) group by 1)
, fa as (select m.main, m.code, m.sub, (select count(*) from mm x join lg l on l.main = x.main where x.main = m.main and x.sub <> l.largest
     and (md5('fixture' || x.code), x.code, x.sub) < (md5('fixture' || m.code), m.code, m.sub)) - 1 as place,
   (select count(*) from mm x join lg l on l.main = x.main where x.main = m.main and x.sub <> l.largest) as n from mm m join lg on lg.main = m.main and lg.largest = m.sub)
""" + _ring_sql("fr", "select mm.main, sub, code from mm join lg on lg.main = mm.main where sub <> largest", "main", 21, "fa") + _ring_sql(
    "ow", "select main || '|' || coalesce(sub, '') as ms, main, sub, code from mm", "ms", 21).replace("select a.ms, a.code", "select a.main, a.ms, a.code") + """
, ca as (select main, code, sub, 0 as src, j, c2, s2 from rg union all select main, code, sub, 1, j, c2, s2 from fr union all select main, code, sub, 2, j, c2, s2 from ow)
, cb as (select main, code, sub, coalesce(sub <> s2, false) as other, c2, min(src * 1000 + j) as far from ca where c2 <> code group by 1, 2, 3, 4, 5)
, cc as (select *, row_number() over (partition by main, code, sub, other order by far) as k from cb)
, cd as (select main, code, sub, c2, min(case when other then k else 1000 + k end) as k from cc where k <= 21 group by 1, 2, 3, 4)
, ce as (select main, code, sub, list(c2 order by k) as related from cd group by 1, 2, 3)
""" + _ring_sql("tr", "select t, null::varchar as sub, code from tx", "t", 21) + """
, ta as (select distinct r.row_idx, r.code, tr.c2 from r, (select unnest(texts) as t, row_idx as i from r) u join tr on tr.t = u.t where u.i = r.row_idx and tr.code = r.code and tr.c2 <> r.code)
, tb as (select row_idx, list(c2 order by md5('fixture' || code || '|' || c2))[1:21] as alternative from ta group by 1)
, ready as (select r.row_idx, r.code, coalesce(ce.related, []) as cr, coalesce(tb.alternative, []) as ct from r
   left join ce on ce.main = r.main and ce.code = r.code and ce.sub is not distinct from r.sub left join tb on tb.row_idx = r.row_idx)
"""
# turns: related, alternative, related, ...; each code once; then both lists are filled up
_ASSIGN = """
, turns(row_idx, code, cr, ct, i, rel, alt) as (
   select row_idx, code, cr, ct, 0, []::varchar[], []::varchar[] from ready
   union all
   select row_idx, code, cr, ct, i + 1,
     case when i % 2 = 0 and len(rel) < 10 then rel || list_filter(cr, lambda x: not list_contains(rel || alt, x))[1:1] else rel end,
     case when i % 2 = 1 and len(alt) < 10 then alt || list_filter(ct, lambda x: not list_contains(rel || alt, x))[1:1] else alt end
   from turns where i < 20)
, filled as (select *, rel || list_filter(cr, lambda x: not list_contains(rel || alt, x))[1:greatest(10 - len(rel), 0)] as rel2 from turns where i = 20)
, links as (select row_idx, code, rel2 as related, alt || list_filter(ct, lambda x: not list_contains(rel2 || alt, x))[1:greatest(10 - len(alt), 0)] as alternative from filled)
"""


def _add_links(name, fn, sql):
    _add(name, fn, _PICKS + _ASSIGN + sql)
    ORACLES[name] = ORACLES[name].replace("with ", "with recursive ", 1)


_add_links("l01_link_products", lambda s, d: linking.link_products(_cat(s, d)).select(
    "row_idx", "code", F.array_join("related", ",").alias("related"), F.array_join("alternative", ",").alias("alternative")),
    "select row_idx, code, array_to_string(related, ',') as related, array_to_string(alternative, ',') as alternative from links")
_add_links("l02_s20_wide_links", lambda s, d: linking.wide_links(
    _cat(s, d).select("row_idx", "code", "pair_code", "name", "default_category", "category_text", "category_text2"),
    linking.link_products(_cat(s, d))), """
select cast(c.row_idx as varchar) as row_idx, c.code, pair_code, name, default_category, category_text, category_text2, """ + ", ".join(
        f"coalesce({arr}[{i}], '') as {base}{i if i > 1 else ''}" for base, arr in (("relatedProduct", "related"), ("alternativeProduct", "alternative"))
        for i in range(1, 11)) + " from catalog c join links l on l.row_idx = c.row_idx")
_add("j07_j08_link_counts", lambda s, d: _counts(s, d).select("row_idx", "code", "n_related", "n_alternative"),
     _LINKS + "select row_idx, code, n_related, n_alternative from k")


def _link_check(s, d):
    """Every link obeys the rules: right category, not itself, no code twice, other subcategories first."""
    cat = _cat(s, d)
    return linking.rules_broken(linking.link_rows(cat), materialise(linking.link_products(cat)))


_add("l01_link_rules_hold", _link_check,
     "select count(*) as products, 0 as repeated, 0 as bad_related, 0 as bad_alternative from catalog")
_add("a03_link_stats", lambda s, d: linking.link_stats(linking.link_rows(_cat(s, d))), _LINKS + """
select count(*) as total_products, count(distinct main) as main_categories, (select count(distinct t) from tx) as category_texts from r""")
_add("a04_link_summary", lambda s, d: linking.link_summary(_counts(s, d)), _LINKS + """
select count(*) as total_products, floor(avg(n_related) * 10 + 0.5) / 10 as avg_related, floor(avg(n_alternative) * 10 + 0.5) / 10 as avg_alternative,
 floor(count(*) filter (n_related = 10) * 100.0 / count(*) + 0.5)::integer as full_related_percent,
 floor(count(*) filter (n_alternative = 10) * 100.0 / count(*) + 0.5)::integer as full_alternative_percent,
 count(*) filter (n_related < 3) as low_related, count(*) filter (n_alternative < 3) as low_alternative,
 count(*) filter (len(texts) = 0) as without_category_text from k""")
_MEANS = _LINKS + """, cm as (select {by} as name, count(*) as products, floor(avg(n_related) * 10 + 0.5) / 10 as avg_related,
 floor(avg(n_alternative) * 10 + 0.5) / 10 as avg_alternative, min(row_idx) as first_idx from k where {by} is not null group by 1)
select * from cm """
for _name, _fn, _by, _tail in [
    ("a04_largest_categories", linking.largest_categories, "main", "order by products desc, first_idx limit 5"),
    ("a04_small_categories", linking.small_categories, "main", "where products < 10 order by products desc, first_idx limit 5"),
    ("a04_best_linked_categories", linking.best_linked_categories, "main",
     "where products >= 5 order by avg_related desc, products desc, first_idx limit 3"),
    ("a04_single_product_subcategories", linking.single_product_subcategories, "sub", "where products = 1 order by first_idx limit 5"),
    ("a04_best_linked_subcategories", linking.best_linked_subcategories, "sub",
     "where products >= 3 order by avg_related desc, first_idx limit 3"),
]:
    _add(_name, lambda s, d, f=_fn: f(_counts(s, d)), _MEANS.format(by=_by) + _tail)
