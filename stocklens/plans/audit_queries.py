"""Registered queries of the catalog audit and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocklens.fixtures import load, oracle, table
from stocklens.functions import category as cg, markup, stock as st, text as tx
from stocklens.functions import keywords as kw, values as vl
from stocklens.operators import category_tree, duplicates, near_duplicates, report, row_rules, variants
from stocklens.operators.issues import AuditParams, errors_first
from stocklens.plans import duck as d
from stocklens.plans.catalog_audit import audit_issues
from stocklens.session import materialise

P = AuditParams()
QUERIES, ORACLES = {}, {}
ISSUE = ["family", "type", "severity", "entity_key", "row_idx", "details"]


def _cat(spark, sf):
    return load(spark, sf, "catalog")


def row_issues_all(spark, sf):
    return row_rules.row_issues(_cat(spark, sf), P)


def _narrow(issues):
    return issues.select(*ISSUE)


# ---- row rules -----------------------------------------------------------------------------

_LONGER = "case when length(lp) > length(sp) then lp else sp end"
_STEPS = ("list_transform(regexp_extract_all(coalesce(description, ''), '</?[a-zA-Z][^>]*>'), "
          "lambda t: case when starts_with(t, '</') then -1 when ends_with(t, '/>') then 0 else 1 end)")
_DEPTH = (f"greatest(0, coalesce(list_max(list_transform(range(1, len({_STEPS}) + 1), "
          f"lambda i: list_sum({_STEPS}[1:i]))), 0))")
_BLOCKS = (f"(len(regexp_extract_all(low, {d.q(f'<div[^>]*>{tx.WS}*</div>')})) + "
           f"len(regexp_extract_all(low, {d.q(f'<span[^>]*>{tx.WS}*</span>')})))")
_BREAKS = f"len(regexp_extract_all(low, {d.q(f'(<br{tx.WS}*/?>{tx.WS}*){{3,}}')}))"
_TAGS = (f"list_filter(list_transform(list_filter(regexp_extract_all(coalesce(description, ''), "
         f"'</?[a-zA-Z][a-zA-Z0-9]*[^>]*>'), lambda t: not ends_with(t, '/>')), "
         f"lambda t: case when starts_with(t, '</') then 'c' else 'o' end || "
         f"lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))), "
         f"lambda t: t[2:] not in {d.in_list(markup.VOID_TAGS)})")
_STACK = (f"list_reduce({_TAGS}, lambda acc, t: case when starts_with(acc, '!') then acc "
          f"when t[1] = 'o' then acc || '/' || t[2:] "
          f"when ends_with(acc, '/' || t[2:]) then left(acc, length(acc) - length(t)) "
          f"else '!' || t[2:] end, '')")


def _score(lang):
    words = f"len(list_filter(string_split(lt, ' '), lambda w: w in {d.in_list(tx.LANGUAGE_WORDS[lang])})) * 2"
    if lang in tx.LANGUAGE_LETTERS:
        words += f" + case when regexp_matches(lt, '{tx.LANGUAGE_LETTERS[lang]}') then 10 else 0 end"
    return words


_BASE = f"""
, t0 as (select *, {d.strip('description')} as lp, {d.strip('short_description')} as sp,
   lower(coalesce(description, '')) as low, lower(coalesce(short_description, '')) as lows,
   coalesce(parent_code, '') <> '' as is_variant,
   list_filter(list_transform(string_split(filter_params, ','), lambda x: {d.trim('x')}), lambda x: x <> '') as fp
 from catalog)
, t1 as (select *, case when length({_LONGER}) > 50 then lower({d.strip(_LONGER)}) end as lt,
   {_DEPTH} as depth, {_BLOCKS} as blocks, {_BREAKS} as breaks, {_STACK} as stack,
   {d.word_set('lp')} as lw, {d.word_set('sp')} as sw from t0)
, t2 as (select *, {_score('cs')} as cs, {_score('de')} as de, {_score('en')} as en,
   len(list_intersect(lw, sw)) as shared from t1)
, b as (select *, case when lt is null or greatest(cs, de, en) < 5 then 'unknown' when cs >= de and cs >= en then 'cs'
   when de >= en then 'de' else 'en' end as lang from t2)
"""


def _rules_sql(rules) -> str:
    return "\nunion all\n".join(
        f"select {d.q(f)} as family, {d.q(t)} as type, {d.q(s)} as severity, code as entity_key, row_idx, "
        f"cast({det} as varchar) as details from b where {cond}" for f, t, s, cond, det in rules)


def _money(x):
    return f"cast(round(cast({x} as double), 2) as decimal(18,2))"


_e, _w = "error", "warning"
_has = "(length(lp) > 0 or length(sp) > 0)"
RULES = {
    "content": [
        ("no_description", _e, f"not {_has}", "''"),
        ("too_short", _w, "length(lp) > 0 and length(lp) < 100", "length(lp) || ' characters, minimum 100'"),
        ("same_short_long", _w, "length(lp) > 0 and length(sp) > 0 and 19 * shared > 9 * (len(lw) + len(sw))", "''"),
        ("lorem_ipsum", _e, f"{_has} and ({d.matches('low', tx.LOREM_PATTERNS)} or {d.matches('lows', tx.LOREM_PATTERNS)})", "''"),
        ("test_content", _e, f"{_has} and ({d.matches('low', tx.PLACEHOLDER_PATTERNS)} or {d.matches('lows', tx.PLACEHOLDER_PATTERNS)})", "''"),
        ("wrong_language", _w, "lang not in ('unknown', 'cs')", "lang || ' found, cs expected'"),
        ("html_in_description", _w, f"{_has} and (depth > 8 or blocks > 5 or breaks > 3)",
         "case when blocks > 5 then blocks || ' empty blocks' when breaks > 3 then 'line break runs' else 'deep nesting' end"),
        ("url_in_description", _w, f"{_has} and regexp_matches(lower(lp), {d.q(tx.URL_PATTERN)})", "''"),
        ("emoji_spam", _w, f"{_has} and (len(regexp_extract_all(description, {d.q(tx.EMOJI_PATTERN)})) > 5 "
                           f"or len(regexp_extract_all(short_description, {d.q(tx.EMOJI_PATTERN)})) > 5)", "''"),
    ],
    "business": [
        ("zero_price", _e, "price = 0", "'price'"),
        ("negative_price", _e, "price < 0", f"'price ' || {_money('price')}"),
        ("discount_higher_than_price", _e, "price > price_before_discount",
         f"'price ' || {_money('price')} || ' above ' || {_money('price_before_discount')}"),
        ("suspicious_discount", _w, "(price_before_discount - price) / nullif(price_before_discount, 0) * 100 > 50",
         f"'discount ' || {d.fold('(price_before_discount - price) / nullif(price_before_discount, 0) * 100')} || '%'"),
        ("suspicious_round_price", _w, "price >= 1000 and price % 1000 = 0", f"'price ' || {_money('price')}"),
        ("stock_delivery_conflict", _w,
         f"({d.contains_any('lower(availability)', st.DELIVERABLE)} or coalesce(stock > 0, false)) and delivery_days > 3",
         "'delivery in ' || delivery_days || ' days'"),
        ("long_inquiry_product", _w,
         f"{d.contains_any('lower(availability)', st.ON_INQUIRY)} and {d.days(d.NOW, 'created_at')} / 30 > 3",
         f"{d.fold(d.days(d.NOW, 'created_at') + ' / 30')} || ' months on inquiry'"),
        ("expired_action", _e, f"is_action and action_end_date < {d.NOW}",
         "'ended ' || strftime(action_end_date, '%Y-%m-%d')"),
        ("old_product_new_flag", _w, f"is_new and {d.days(d.NOW, 'created_at')} > 90",
         f"{d.fold(d.days(d.NOW, 'created_at'))} || ' days old'"),
        ("permanent_action", _w,
         f"is_action and price_before_discount is not null and (action_end_date is null or "
         f"({d.days('action_end_date', d.NOW)} > 30 and {d.days(d.NOW, 'created_at')} > 30))",
         "case when action_end_date is null then 'no end date' else 'more than 30 days' end"),
    ],
    "completeness": [
        ("no_image", _e, f"not is_variant and {d.empty('image')} and coalesce(image_count, 0) = 0", "''"),
        ("single_image", _w, f"not is_variant and not ({d.empty('image')} and coalesce(image_count, 0) = 0) "
                             "and (case when coalesce(image_count, 0) = 0 then 1 else image_count end) = 1", "''"),
        ("no_short_description", _w, f"not is_variant and {d.blank('short_description')}", "''"),
        ("no_long_description", _e, f"not is_variant and {d.blank('description')}", "''"),
        ("short_description_too_short", _w, f"not is_variant and not {d.blank('description')} and length(lp) < 100",
         "length(lp) || ' characters'"),
        ("no_price", _e, "not is_variant and price is null", "''"),
        ("zero_price", _e, "not is_variant and price = 0", "''"),
        ("no_ean", _w, f"not is_variant and {d.blank('ean')}", "''"),
        ("no_manufacturer", _w, f"not is_variant and {d.blank('manufacturer')}", "''"),
        ("no_category", _e, f"not is_variant and {d.blank('default_category')} and {d.blank('category_text')}", "''"),
        ("no_filter_parameters", _w, "not is_variant and len(fp) = 0", "''"),
    ],
    "data_quality": [
        ("html_errors", _w, "stack <> ''",
         "case when starts_with(stack, '!') then 'close:' || stack[2:] else 'open:' || replace(stack[2:], '/', ',') end"),
        ("inline_styles", _w, f"regexp_matches(low, {d.q(tx.INLINE_STYLE_PATTERN)})", "''"),
    ],
    "stock": [
        ("no_availability_in_stock", _w, d.blank("availability_in_stock"), "''"),
        ("wrong_availability_in_stock", _w,
         f"not {d.blank('availability_in_stock')} and not {d.contains_any('lower(availability_in_stock)', st.IN_STOCK)}",
         "availability_in_stock"),
        ("no_availability_out_of_stock", _w, d.blank("availability_out_of_stock"), "''"),
        ("wrong_availability_out_of_stock", _w,
         f"not {d.blank('availability_out_of_stock')} and not {d.contains_any('lower(availability_out_of_stock)', st.OUT_OF_STOCK)}",
         "availability_out_of_stock"),
        ("in_stock_zero_quantity", _e,
         f"availability <> '' and ((stock > 0 and availability_in_stock <> '' and availability <> availability_in_stock "
         f"and not {d.contains_any('lower(availability)', st.IN_STOCK)}) or (stock <= 0 and availability_out_of_stock <> '' "
         f"and availability <> availability_out_of_stock and not {d.contains_any('lower(availability)', st.OUT_OF_STOCK)}))",
         "'stock ' || stock || ' but ' || availability"),
        ("negative_stock", _e, "stock < 0", "'stock ' || stock"),
        ("long_sold_out", _w, f"stock <= 0 and {d.days(d.NOW, 'updated_at')} > 30",
         f"{d.fold(d.days(d.NOW, 'updated_at'))} || ' days'"),
    ],
    "product_category": [
        ("no_default_category", _e, f"not is_variant and {d.empty('default_category')} and {d.empty('category_text')}", "''"),
        ("multiple_main_categories", _w,
         "not is_variant and category_text2 <> '' and len(list_filter([default_category, category_text2], "
         "lambda x: x <> '' and not contains(x, '>') and not contains(x, '/'))) > 1",
         "array_to_string([default_category, category_text2], ', ')"),
    ],
    "seo": [
        ("no_meta_description", _w, f"not is_variant and {d.blank('meta_description')}", "''"),
        ("meta_too_short", _w, f"not is_variant and not {d.blank('meta_description')} and length(meta_description) < 70",
         "length(meta_description) || ' characters'"),
        ("meta_too_long", _w, f"not is_variant and not {d.blank('meta_description')} and length(meta_description) > 160",
         "length(meta_description) || ' characters'"),
        ("meta_same_as_title", _e, f"not is_variant and not {d.blank('meta_description')} and "
                                   f"{d.trim('lower(meta_description)')} = {d.trim('lower(name)')}", "''"),
        ("meta_contains_title", _w,
         f"not is_variant and not {d.blank('meta_description')} and {d.trim('lower(meta_description)')} <> {d.trim('lower(name)')} "
         f"and contains({d.trim('lower(meta_description)')}, {d.trim('lower(name)')}) and length({d.trim('lower(name)')}) > 15 "
         f"and length({d.trim('lower(name)')}) / greatest(length({d.trim('lower(meta_description)')}), 1) > 0.7", "''"),
        ("meta_same_as_short_desc", _w,
         f"not is_variant and not {d.blank('meta_description')} and {d.trim('lower(sp)')} <> '' and "
         f"{d.trim('lower(meta_description)')} = {d.trim('lower(sp)')}", "''"),
        ("title_too_long", _w, "not is_variant and length(name) > 70", "length(name) || ' characters'"),
        ("title_too_short", _w, "not is_variant and length(name) > 0 and length(name) < 10", "length(name) || ' characters'"),
    ],
}


def _family_sql(families):
    return _rules_sql([(f, *r) for f in families for r in RULES[f]])


_NAMES = {"c01_c09_content": "content", "b01_b10_business": "business", "q01_q11_completeness": "completeness",
          "d01_d02_markup": "data_quality", "n01_n07_stock": "stock", "h01_h02_categorisation": "product_category",
          "m01_m08_seo": "seo"}
for _key, _fam in _NAMES.items():
    QUERIES[_key] = lambda spark, sf, fam=_fam: _narrow(row_rules.row_issues(_cat(spark, sf), P, [fam]))
    ORACLES[_key] = oracle(["catalog"], _BASE + _family_sql([_fam]))

# ---- group rules ---------------------------------------------------------------------------

_BASECODE = r"nullif(regexp_extract(trim(code), '^(.+?)[/\-_](.+)$', 1), '')"


def _group_sql(family, kind, sev, key, usable, skip):
    exempt = ("and not ((count(nullif(parent_code, '')) = count(*) and count(distinct nullif(parent_code, '')) = 1) or "
              f"(count({_BASECODE}) = count(*) and count(distinct {_BASECODE}) = 1))") if skip else ""
    return (f"select {d.q(family)} as family, {d.q(kind)} as type, {d.q(sev)} as severity, code as entity_key, row_idx, "
            f"n || ' products' as details from t0 join (select {key} as k, count(*) as n from t0 where {usable} "
            f"group by 1 having count(*) > 1 {exempt}) g on g.k = {key} where {usable}")


_T0 = _BASE.split(", t1 as")[0]
_GROUPS = {
    "c10_duplicate_description": ("content", "duplicate_description", _w, "lower(lp)", "length(lp) > 50", False),
    "d03_duplicate_name": ("data_quality", "duplicate_name", _w, d.trim("lower(name)"), f"{d.trim('lower(name)')} <> ''", True),
    "d04_duplicate_code": ("data_quality", "duplicate_code", _e, d.trim("lower(code)"), f"{d.trim('lower(code)')} <> ''", False),
    "d05_duplicate_ean": ("data_quality", "duplicate_ean", _e, d.trim("ean"), f"{d.trim('ean')} <> ''", False),
    "m09_duplicate_meta": ("seo", "duplicate_meta_description", _e, d.trim("lower(meta_description)"),
                           f"not is_variant and length({d.trim('lower(meta_description)')}) > 30", True),
}
for _key, _spec in _GROUPS.items():
    QUERIES[_key] = lambda spark, sf, t=_spec[1]: _narrow(duplicates.group_issues(
        materialise(duplicates.group_keys(_cat(spark, sf))), [t]))
    ORACLES[_key] = oracle(["catalog"], _T0 + _group_sql(*_spec))

QUERIES["a13_description_groups"] = lambda spark, sf: duplicates.description_groups(_cat(spark, sf))
ORACLES["a13_description_groups"] = oracle(["catalog"], _T0 + """
select md5(lower(lp)) as group_id, n as group_size, row_idx, code,
 lower(lp) as preview
from (select *, count(*) over (partition by lower(lp)) as n from t0 where length(lp) > 50) where n > 1""")

_VAR = """, v as (select c.*, c.parent_code in (select code from catalog) as known,
   count(*) over (partition by parent_code) as n,
   count(*) over (partition by parent_code, lower(trim(name))) as twins from catalog c where parent_code <> '')
, pn as (select code, arg_max(name, row_idx) as name from catalog group by 1)
"""
_SEPS = [s for s in variants.NAME_SEPARATORS]
_MIXED = "case " + " ".join(
    f"when sum(case when contains(name, {d.q(s)}) then 1 else 0 end) > 0 then sum(case when contains(name, {d.q(s)}) then 1 else 0 end) < count(*)"
    for s in _SEPS) + " else false end"
QUERIES["v01_v05_variants"] = lambda spark, sf: _narrow(variants.variant_issues(
    materialise(variants.variant_rows(_cat(spark, sf)))))
ORACLES["v01_v05_variants"] = oracle(["catalog"], _VAR + f"""
select 'variants' as family, 'orphan_variant' as type, 'error' as severity, code as entity_key, row_idx, parent_code as details from v where not known
union all select 'variants', 'variant_identical_names', 'warning', code, row_idx, '' from v where known and twins > 1
union all select 'variants', 'variant_no_diff_params', 'warning', code, row_idx, '' from v where known and trim(filter_params) = ''
union all select 'variants', 'variant_no_image', 'warning', code, row_idx, '' from v where known and image = '' and image_count = 0
union all select 'variants', 'variant_inconsistent_naming', 'warning', parent_code, null, '' from v where known
  group by parent_code having count(*) >= 3 and {_MIXED}""")
QUERIES["n08_variant_stock"] = lambda spark, sf: variants.variant_stock_issues(
    variants.variant_rows(_cat(spark, sf))).select(
    "family", "type", "severity", "entity_key", "entity_name", "group_size")
ORACLES["n08_variant_stock"] = oracle(["catalog"], """, s as (select *, case when contains(lower(availability), 'skladem') or stock > 0 then 'in'
  when contains(lower(availability), 'vyprodán') or stock <= 0 then 'out' else 'unknown' end as state from catalog where parent_code <> '')
select 'stock' as family, 'variant_stock_inconsistent' as type, 'warning' as severity, parent_code as entity_key,
 coalesce(nullif(arg_min(name, row_idx), ''), parent_code) as entity_name, count(*) as group_size
from s group by parent_code having count(distinct nullif(state, 'unknown')) > 1""")
QUERIES["j01_orphan_variants"] = lambda spark, sf: variants.orphan_variants(_cat(spark, sf))
ORACLES["j01_orphan_variants"] = oracle(["catalog"], """select row_idx, code, parent_code from catalog
where parent_code <> '' and parent_code not in (select code from catalog)""")
QUERIES["j02_parents_with_variants"] = lambda spark, sf: variants.parents_with_variants(_cat(spark, sf))
ORACLES["j02_parents_with_variants"] = oracle(["catalog"], """select row_idx, code from catalog
where parent_code = '' and code in (select parent_code from catalog where parent_code <> '')""")
QUERIES["a15_variant_groups"] = lambda spark, sf: duplicates.group_sizes(
    duplicates.keyed_by(duplicates.group_keys(_cat(spark, sf)), "duplicate_name"))
ORACLES["a15_variant_groups"] = oracle(["catalog"], f"""select md5({d.trim('lower(name)')}) as group_id, count(*) as group_size,
 count(*) > 1 and ((count(nullif(parent_code, '')) = count(*) and count(distinct nullif(parent_code, '')) = 1)
  or (count({_BASECODE}) = count(*) and count(distinct {_BASECODE}) = 1)) as is_variants
from catalog where {d.trim('lower(name)')} <> '' group by 1""")

# ---- near duplicates -----------------------------------------------------------------------


def _documents_as_catalog(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_idx"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("code"),
        F.col("source").alias("name"), F.col("text").alias("description"))


_DOCS = "docs as (select doc_id as row_idx, 'D' || doc_id as code, source as name, text as description from documents)"


def _near_sql(source):
    return f""", u as (select min(row_idx) as row_idx, {d.word_set('norm')} as ws from
  (select row_idx, lower({d.strip('description')}) as norm from {source}) where length(norm) > 50 group by norm having count(*) = 1)
, classes as (select min(row_idx) as first_idx, list_sort(ws) as ws, list(row_idx) as members from u where len(ws) > 0 group by list_sort(ws))
, tok as (select first_idx, len(ws) as n, unnest(ws) as w from classes)
, pairs as (select a.first_idx as i, b.first_idx as j, count(*) as k, any_value(a.n + b.n) as s from tok a join tok b
   on a.w = b.w and a.first_idx < b.first_idx and a.n * 5 > b.n * 4 and b.n * 5 > a.n * 4 group by 1, 2)
, allp as (select i as a, j as b, cast(floor(k * 100.0 / (s - k) + 0.5) as integer) as similarity from pairs where 9 * k > 4 * s
  union all select first_idx, m, 100 from (select first_idx, unnest(members) as m from classes) where m <> first_idx)
"""


QUERIES["c11_j06_near_duplicates"] = lambda spark, sf: near_duplicates.near_duplicate_pairs(_cat(spark, sf)).select(
    "a_row_idx", "a_code", "b_row_idx", "b_code", "similarity")
ORACLES["c11_j06_near_duplicates"] = oracle(["catalog"], _near_sql("catalog") + """
select a as a_row_idx, x.code as a_code, b as b_row_idx, y.code as b_code, similarity
from allp join catalog x on x.row_idx = a join catalog y on y.row_idx = b""")
QUERIES["j06_near_duplicate_documents"] = lambda spark, sf: near_duplicates.near_duplicate_pairs(
    _documents_as_catalog(spark, sf)).select("a_row_idx", "b_row_idx", "similarity")
ORACLES["j06_near_duplicate_documents"] = f"with {_DOCS}" + _near_sql("docs") + """
select a as a_row_idx, b as b_row_idx, similarity from allp"""
QUERIES["z08_near_duplicate_groups"] = lambda spark, sf: near_duplicates.near_duplicate_groups(
    _documents_as_catalog(spark, sf)).select("group_id", "row_idx", "code", "group_size")
ORACLES["z08_near_duplicate_groups"] = f"with recursive {_DOCS}" + _near_sql("docs") + """
, e as (select a, b from allp union select b, a from allp)
, r as (select a as node, a as root from e union select r.node, e.b from r join e on e.a = r.root)
, g as (select node, min(root) as group_id from r group by node)
select group_id, node as row_idx, 'D' || node as code, count(*) over (partition by group_id) as group_size from g"""

# ---- categories ----------------------------------------------------------------------------

_CATS = ["catalog", "categories"]
_CANON = "array_to_string(list_transform(regexp_split_to_array({x}, '[>|/]'), lambda s: trim(s)), ' > ')"
_FEED = f""", pv as (select case when default_category <> '' then default_category else category_text end as v from catalog)
, pc as (select v, {_CANON.format(x='v')} as canon, count(*) as n from pv where v <> '' group by 1)
, cp as (select c.*, coalesce(nullif(path, ''), name) as category_path from categories c)
, cc as (select cp.*, coalesce((select sum(n) from pc where pc.v = cp.code),
   (select sum(n) from pc where pc.canon = {_CANON.format(x='cp.category_path')}), 0)::bigint as products,
   (exists (select 1 from categories k where k.parent_code = cp.code) or exists
    (select 1 from cp k where starts_with(k.category_path, cp.category_path || ' | '))) as has_children,
   count(*) over (partition by lower(trim(name))) as same_name from cp)
, walk as (select code as leaf, parent_code as up, 1 as depth from categories
   union all select leaf, c.parent_code, depth + 1 from walk join categories c on c.code = walk.up where depth < 50)
, dp as (select leaf, max(depth)::integer as depth from walk group by 1)
, f as (select cc.*, dp.depth, parent_code <> '' and parent_code not in (select code from categories) as orphan
   from cc join dp on dp.leaf = cc.code)
"""


def _recursive(views, sql):
    return oracle(views, sql).replace("with ", "with recursive ", 1)


QUERIES["g01_g07_category_feed"] = lambda spark, sf: category_tree.feed_issues(
    load(spark, sf, "categories"), _cat(spark, sf), P).select(
    "family", "type", "severity", "entity_key", "entity_name", "details")
_FEED_RULES = [
    ("empty_category", _w, "products = 0 and not has_children and is_active", "''"),
    ("single_product_category", _w, "products = 1 and not has_children and is_active", "''"),
    ("too_deep_category", _w, "depth > 4", "depth || ' levels'"),
    ("orphan_category", _e, "coalesce(orphan, false)", "parent_code"),
    ("category_no_description", _w, f"is_active and {d.blank('description')}", "''"),
    ("empty_category", _e, "not is_active and products > 0", "products || ' products in a hidden category'"),
    ("duplicate_category_name", _w, "same_name > 1", "same_name || ' categories'"),
]
ORACLES["g01_g07_category_feed"] = _recursive(_CATS, _FEED + "\nunion all\n".join(
    f"select 'categories' as family, {d.q(t)} as type, {d.q(s)} as severity, category_path as entity_key, "
    f"name as entity_name, {det} as details from f where {cond}" for t, s, cond, det in _FEED_RULES))
QUERIES["j03_category_depth"] = lambda spark, sf: category_tree.category_depths(load(spark, sf, "categories"))
ORACLES["j03_category_depth"] = _recursive(_CATS, _FEED + "select leaf as code, depth from dp")
QUERIES["j03_orphan_categories"] = lambda spark, sf: category_tree.orphan_categories(
    load(spark, sf, "categories")).select("code", "name", "parent_code")
ORACLES["j03_orphan_categories"] = oracle(["categories"], """select code, name, parent_code from categories
where parent_code <> '' and parent_code not in (select code from categories)""")
QUERIES["j04_j05_category_counts"] = lambda spark, sf: category_tree.with_children(category_tree.with_product_counts(
    load(spark, sf, "categories"), _cat(spark, sf))).select("code", "products", "has_children")
ORACLES["j04_j05_category_counts"] = _recursive(_CATS, _FEED + "select code, products, has_children from cc")
_TREE = f""", own as (select {_CANON.format(x='v')} as path, count(*) as n from
   (select case when category_text <> '' then category_text else default_category end as v from catalog) where v <> '' group by 1)
, nodes as (select path, n, string_split(path, ' > ') as parts, unnest(range(1, len(string_split(path, ' > ')) + 1)) as i from own)
, tr as (select array_to_string(parts[1:i], ' > ') as node, sum(case when i = len(parts) then n else 0 end)::bigint as products,
   max(case when i < len(parts) then 1 else 0 end) as inner_node from nodes group by 1)
, tn as (select *, string_split(node, ' > ') as parts, string_split(node, ' > ')[-1] as name,
   count(*) over (partition by lower(string_split(node, ' > ')[-1])) as same_name from tr)
"""
QUERIES["g01_g07_derived_categories"] = lambda spark, sf: category_tree.derived_issues(_cat(spark, sf), P).select(
    "family", "type", "severity", "entity_key", "entity_name", "details")
ORACLES["g01_g07_derived_categories"] = oracle(["catalog"], _TREE + "\nunion all\n".join(
    f"select 'categories' as family, {d.q(t)} as type, 'warning' as severity, node as entity_key, name as entity_name, "
    f"{det} as details from tn where {cond}" for t, cond, det in [
        ("empty_category", "products = 0 and inner_node = 0", "''"),
        ("single_product_category", "products = 1", "''"),
        ("too_deep_category", "len(parts) > 4", "len(parts) || ' levels'"),
        ("duplicate_category_name", "same_name > 1 and name <> ''", "same_name || ' categories'")]))
QUERIES["a05_tree_counts"] = lambda spark, sf: category_tree.tree_counts(_cat(spark, sf))
ORACLES["a05_tree_counts"] = oracle(["catalog"], """, s as (select list_transform(string_split(trim(category_text), '|'), lambda x: trim(x)) as parts
  from catalog where trim(category_text) <> '')
, x as (select parts, unnest(range(1, len(parts) + 1)) as i from s)
, g as (select parts[1:i] as p, count(*) as products from x group by 1)
select array_to_string(p, ' | ') as path, p[-1] as name, nullif(array_to_string(p[1:len(p) - 1], ' | '), '') as parent_path,
 len(p)::integer as depth, products from g""")

# ---- statistics, scores, roll-ups ----------------------------------------------------------

QUERIES["a01_catalog_stats"] = lambda spark, sf: report.catalog_stats(_cat(spark, sf))
ORACLES["a01_catalog_stats"] = oracle(["catalog"], _T0 + """
select count(*) as total_products, count(*) filter (length(lp) > 0) as with_description,
 count(*) filter (length(sp) > 0) as with_short_description,
 cast(floor(sum(length(lp)) / count(*) filter (length(lp) > 0) + 0.5) as bigint) as avg_description_length,
 cast(floor(sum(length(sp)) / count(*) filter (length(sp) > 0) + 0.5) as bigint) as avg_short_description_length,
 count(*) filter (price > 0) as with_price, count(*) filter (stock > 0) as with_stock, count(*) filter (is_action) as in_action,
 count(*) filter (image <> '' or image_count > 0) as with_images,
 floor(sum(case when image_count = 0 then 1 else image_count end) filter (image <> '' or image_count > 0)
  / count(*) filter (image <> '' or image_count > 0) * 10 + 0.5) / 10 as avg_image_count,
 count(*) filter (trim(ean) <> '') as with_ean, count(*) filter (manufacturer <> '') as with_manufacturer,
 count(*) filter (default_category <> '' or category_text <> '') as with_category,
 (select count(*) from catalog where parent_code = '' and code in (select parent_code from catalog)) as with_variants,
 count(*) filter (is_variant) as total_variants,
 count(distinct coalesce(nullif(category_text, ''), nullif(default_category, ''))) as total_categories from t0""")


def _all_issues(spark, sf):
    return audit_issues(_cat(spark, sf), P, load(spark, sf, "categories"))


_ALL = (_BASE + _FEED + _VAR + _near_sql("catalog") + ", issues as (" + _family_sql(list(RULES)) + " union all " +
        " union all ".join("(" + _group_sql(*s) + ")" for s in _GROUPS.values()) +
        " union all select family, type, severity, entity_key, row_idx, details from (" +
        ORACLES["v01_v05_variants"].split("from catalog group by 1)\n")[1].lstrip() + ")"
        " union all select 'stock', 'variant_stock_inconsistent', 'warning', parent_code, null, '' from (select *, case when "
        "contains(lower(availability), 'skladem') or stock > 0 then 'in' when contains(lower(availability), 'vyprodán') or stock <= 0 "
        "then 'out' end as state from catalog where parent_code <> '') group by parent_code having count(distinct state) > 1"
        " union all " + "\nunion all\n".join(
            f"select 'categories', {d.q(t)}, {d.q(s)}, category_path, null, {det} from f where {cond}"
            for t, s, cond, det in _FEED_RULES) +
        " union all select 'content', 'near_duplicate', 'warning', cast(a as varchar), a, '' from allp)\n")

QUERIES["u01_a11_issue_rollup"] = lambda spark, sf: report.issue_rollup(_all_issues(spark, sf))
ORACLES["u01_a11_issue_rollup"] = _recursive(_CATS, _ALL + """
select family, type, count(*) as issues, count(*) filter (severity = 'error') as errors,
 count(*) filter (severity = 'warning') as warnings from issues group by rollup (family, type)""")
_PEN = ", ".join(
    f"greatest(0.0, 100 - {e} * count(*) filter (family in {d.in_list(f)} and severity = 'error') "
    f"- {w} * count(*) filter (family in {d.in_list(f)} and severity = 'warning'))::double as {k}"
    for k, (f, e, w) in report.PENALTIES.items())
_SCORES = _ALL + f""", raw as (select
 greatest(0.0, 100.0 - count(*) filter (type in {d.in_list(report.UNIQUENESS_TYPES)} and family = 'content') / (select count(*) from catalog) * 100)::double as uniqueness,
 greatest(0.0, 100.0 - count(*) filter (type in {d.in_list(report.QUALITY_TYPES)} and family = 'content') / (select count(*) from catalog) * 200)::double as quality,
 {_PEN} from issues)
, scores as (select {', '.join(f'cast(floor({k} + 0.5) as integer) as {k}' for k in report.WEIGHTS)},
 cast(floor({' + '.join(f'{k} * {w}' for k, w in report.WEIGHTS.items())} + 0.5) as integer) as overall from raw)
"""
QUERIES["a02_audit_scores"] = lambda spark, sf: report.audit_scores(_all_issues(spark, sf), _cat(spark, sf))
ORACLES["a02_audit_scores"] = _recursive(_CATS, _SCORES + "select * from scores")


def _health(spark, sf):
    h = report.health(report.audit_scores(_all_issues(spark, sf), _cat(spark, sf)))
    return h.select("overall", "level", F.array_join("priorities", ",").alias("priorities"))


QUERIES["a11_health"] = _health
_ORDER = ["completeness", "quality", "uniqueness", "data_quality", "stock", "categories", "business", "seo"]
ORACLES["a11_health"] = _recursive(_CATS, _SCORES + f"""
, en as (select * from (values {', '.join(f"({d.q(k)}, {i})" for i, k in enumerate(_ORDER))}) t(k, pos)
  join (unpivot (select {', '.join(report.WEIGHTS)} from scores) on {', '.join(report.WEIGHTS)} into name k2 value score) u on u.k2 = t.k)
, pick as (select k, score, pos from en where score < 80 order by score, pos limit 5)
select overall, case when overall >= 90 then 'excellent' when overall >= 70 then 'good' when overall >= 50 then 'average' else 'critical' end as level,
 (select string_agg(k, ',' order by score, pos) from pick) as priorities from scores""")

QUERIES["k02_errors_first"] = lambda spark, sf: errors_first(row_issues_all(spark, sf)).select(*ISSUE)
ORACLES["k02_errors_first"] = oracle(["catalog"], _BASE + ", issues as (" + _family_sql(list(RULES)) + """)
select * from issues order by severity <> 'error', family, type, row_idx, entity_key""")

# ---- expressions over whole texts ----------------------------------------------------------


def _text_expressions(spark, sf):
    c = F.col
    return table(spark, sf, "documents").select(
        "doc_id", tx.strip_html(c("text")).alias("plain"), F.md5(tx.strip_html_ext(c("text"))).alias("plain_ext"),
        F.md5(tx.normalize_text(c("text"))).alias("normalized"), tx.detect_language(c("text")).alias("language"),
        F.size(tx.word_set(c("text"))).cast("bigint").alias("words"), tx.emoji_count(c("text")).cast("bigint").alias("emoji"))


QUERIES["p01_p23_text_expressions"] = _text_expressions
_LT = f"lower({d.strip('text')})"
ORACLES["p01_p23_text_expressions"] = f"""with t as (select doc_id, text, lower({d.strip('text')}) as lt from documents)
, s as (select *, {_score('cs')} as cs, {_score('de')} as de, {_score('en')} as en from t)
select doc_id, {d.strip('text')} as plain, md5({d.strip('text', tx.ENTITIES_EXT)}) as plain_ext,
 md5({d.normalize('text')}) as normalized, case when greatest(cs, de, en) < 5 then 'unknown' when cs >= de and cs >= en then 'cs'
 when de >= en then 'de' else 'en' end as language, len({d.word_set('text')}) as words,
 len(regexp_extract_all(text, {d.q(tx.EMOJI_PATTERN)})) as emoji from s"""


def _product_expressions(spark, sf):
    c = F.col
    return _cat(spark, sf).select(
        "row_idx", cg.main_category(c("default_category")).alias("main"), cg.sub_category(c("default_category")).alias("sub"),
        cg.last_segment(c("default_category")).alias("last"), kw.base_code(c("code")).alias("base"),
        kw.audit_base_code(c("code")).alias("audit_base"), F.array_join(kw.strong_keywords(c("name")), " ").alias("strong"),
        F.array_join(kw.weak_keywords(c("name")), " ").alias("weak"),
        cg.product_category(c("category_text"), c("default_category")).alias("category"),
        vl.money(c("price") * 0.87).alias("discounted"), tx.review_text(c("description"), c("short_description")).alias("review"))


QUERIES["p03_p28_product_expressions"] = _product_expressions
_KW = f"list_filter(string_split({d.normalize('name')}, ' '), lambda w: length(w) >= 2 and w not in {d.in_list(kw.STOP_WORDS)})"
_WK = f"(w in {d.in_list(kw.WEAK_WORDS)} or length(w) < 3)"
ORACLES["p03_p28_product_expressions"] = oracle(["catalog"], f"""select row_idx,
 nullif(trim(string_split(default_category, '>')[1]), '') as main,
 nullif(array_to_string(list_transform(string_split(default_category, '>')[2:], lambda x: trim(x)), ' > '), '') as sub,
 trim(string_split(default_category, ' > ')[-1]) as last,
 nullif(regexp_extract(code, '^([^/\\-]+)[/\\-].+$', 1), '') as base, {_BASECODE} as audit_base,
 array_to_string(list_filter({_KW}, lambda w: not {_WK}), ' ') as strong, array_to_string(list_filter({_KW}, lambda w: {_WK}), ' ') as weak,
 case when trim(category_text) <> '' then trim(category_text) when trim(default_category) <> '' then trim(default_category) else 'Bez kategorie' end as category,
 floor(price * 0.87 * 100.0 + 0.5) / 100.0 as discounted,
 trim(regexp_replace(regexp_replace(case when description <> '' then description else short_description end, '<[^>]*>?', '', 'g'), {d.q(tx.WS + '+')}, ' ', 'g')) as review
from catalog""")
