"""Registered queries of the category mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocklens.fixtures import load, oracle
from stocklens.functions import keywords as kw
from stocklens.functions.text import naive_normalize
from stocklens.operators import mapping
from stocklens.plans import duck as d

QUERIES, ORACLES = {}, {}
c = F.col


def _in(spark, sf):
    return load(spark, sf, "catalog"), load(spark, sf, "taxonomy")


def _stem(x):
    return "case " + " ".join(
        f"when length({x}) > {len(s) + 2} and ends_with({x}, '{s}') then left({x}, length({x}) - {len(s)})"
        for s in kw.SUFFIXES) + f" else {x} end"


def _words(x):
    return f"list_filter(string_split({d.normalize(x)}, ' '), lambda w: length(w) >= 2 and w not in {d.in_list(kw.STOP_WORDS)})"


def _norm_any(x, phrases):
    return d.contains_any(x, list(dict.fromkeys(naive_normalize(p) for p in phrases)))


_WEAK = f"(w in {d.in_list(kw.WEAK_WORDS)} or length(w) < 3)"
_SEASON = "|".join(f"({p})" for p in kw.SEASONAL_PATTERNS)
_VIEWS = ["catalog", "taxonomy"]
_SQL = f""", pr as (select row_idx, code, name, concat_ws(' ', nullif(name, ''), nullif(category_text, ''), nullif(default_category, '')) as ctx,
  nullif(regexp_extract(code, '^([^/\\-]+)[/\\-].+$', 1), '') as base, {_norm_any(d.normalize('name'), kw.NON_PRODUCT)} as non_product from catalog)
, cx as (select distinct ctx, {_words('ctx')} as toks from pr)
, ca as (select *, {_norm_any(f"array_to_string(list_concat(list_filter(toks, lambda w: not {_WEAK}), list_filter(toks, lambda w: {_WEAK})), ' ')", kw.ACCESSORY)} as acc from cx)
, pw as (select ctx, acc, w, {_WEAK} as weak, count(*) as n, {_stem('w')} as st from (select ctx, acc, unnest(toks) as w from ca) group by 1, 2, 3)
, ct as (select platform, id, name, full_path, {_norm_any(d.normalize('name'), kw.ACCESSORY)} as cacc, len(regexp_split_to_array(full_path, '[|>]')) as depth
  from taxonomy where not regexp_matches(full_path, {d.q(kw.SEASONAL_EMOJI)}) and not regexp_matches(lower(full_path), {d.q(_SEASON)}))
, cw as (select platform, id, kind, w, {_WEAK} as weak, {_stem('w')} as st from (
   select platform, id, 'leaf' as kind, unnest({_words('name')}) as w from ct union select platform, id, 'path', unnest({_words('full_path')}) from ct))
, vp as (select distinct w, st from pw), vc as (select distinct w, st from cw)
, mt as (select vp.w as pw, vc.w as cw from vp, vc where vp.w = vc.w or vp.st = vc.st or
   (length(vp.st) >= 4 and length(vc.st) >= 4 and (contains(vp.st, vc.st) or contains(vc.st, vp.st))))
, hit as (select pw, platform, id, max(case when kind = 'leaf' and not weak then 1 else 0 end) as ls, max(case when kind = 'leaf' and weak then 1 else 0 end) as lw,
   max(case when kind = 'path' and not weak then 1 else 0 end) as ps from mt join cw on cw.w = mt.cw group by 1, 2, 3)
, sm as (select ctx, platform, id, any_value(acc) as acc, sum(case when not weak then n * (case when ls = 1 then 100 when ps = 1 then 20 else 0 end)
   else n * (case when ls = 1 or lw = 1 then 5 else 0 end) end) as pts, sum(case when not weak then n * ls else 0 end) as sg
   from pw join hit on hit.pw = pw.w group by 1, 2, 3)
, sc as (select sm.ctx, sm.platform, sm.id, cast((case when sg = 0 then floor((pts - case when cacc and not acc then 150 else 0 end) / 4.0) else pts - case when cacc and not acc then 150 else 0 end end)
   + case when sg >= 2 then sg * 30 else 0 end - case when sg = 0 and depth > 4 then depth * 5 else 0 end as bigint) as score, ct.name, ct.full_path
   from sm join ct on ct.platform = sm.platform and ct.id = sm.id)
, cand as (select *, row_number() over (partition by ctx, platform order by score desc, id) as rank from sc where score > 0 qualify rank <= 20)
, acc as (select ctx, count(*) as n_acc from cand where rank = 1 and score >= 100 group by 1)
, hc as (select distinct ctx from cand)
, np as (select count(distinct platform) as n from taxonomy)
, ow as (select pr.*, coalesce(n_acc, 0) as n_acc, hc.ctx is not null as has_cand from pr left join acc on acc.ctx = pr.ctx left join hc on hc.ctx = pr.ctx)
, bs as (select code, max(row_idx) as src from ow where base is null and not non_product and n_acc > 0 group by 1)
, sb as (select base, min(row_idx) as src from ow where base is not null and not non_product and n_acc > 0 group by 1)
, mp as (select ow.*, case when non_product then null when ow.base is not null and bs.src is not null then bs.src
    when ow.base is not null and sb.src < ow.row_idx then sb.src when n_acc > 0 then ow.row_idx end as src,
    not non_product and ow.base is not null and (bs.src is not null or coalesce(sb.src < ow.row_idx, false)) as inherited
   from ow left join bs on bs.code = ow.base left join sb on sb.base = ow.base)
, lm as (select mp.row_idx, mp.code, k.platform, k.id, k.name, k.full_path, 80 as confidence from mp join pr s on s.row_idx = mp.src
   join cand k on k.ctx = s.ctx and k.rank = 1 and k.score >= 100)
, rv as (select row_idx, code, ctx, base, row_number() over (order by base is not null, row_idx) as position from mp
   where not non_product and not inherited and has_cand and n_acc < (select n from np))
"""


def _add(name, fn, sql, more=False):
    QUERIES[name] = fn
    ORACLES[name] = oracle(_VIEWS, _SQL + sql) if not more else oracle(
        ["catalog", "taxonomy_more"], ", taxonomy as (select * from taxonomy_more)" + _SQL + sql)


def _candidates(spark, sf):
    cat, tax = _in(spark, sf)
    return mapping.candidates(mapping.product_contexts(cat), tax).select("ctx", "platform", "rank", "id", "score")


_add("j09_r01_w03_candidates", _candidates, "select md5(ctx) as ctx, platform, rank, id, score from cand")


def _mapping(spark, sf):
    cat, tax = _in(spark, sf)
    return mapping.long_mapping(mapping.map_products(cat, tax)[0])


_add("r02_j10_mapping", _mapping, "select * from lm")
_add("a07_mapping_stats", lambda s, f: mapping.mapping_stats(_mapping(s, f)),
     "select platform, count(distinct row_idx) as mapped from lm group by 1")


def _queue(spark, sf):
    cat, tax = load(spark, sf, "catalog"), load(spark, sf, "taxonomy_more")
    mapped, _, cands = mapping.map_products(cat, tax)
    return mapping.review_queue(mapped, cands, cat).select(
        "row_idx", "code", "position", "batch_id", "review_text",
        F.array_join(F.transform("candidates", lambda x: F.concat(x["platform"], F.lit(":"), x["id"])), ",").alias("candidates"))


_add("r04_review_queue", _queue, f"""
select rv.row_idx, rv.code, position, (position - 1) // 10 as batch_id,
 trim(regexp_replace(regexp_replace(case when description <> '' then description else short_description end, '<[^>]*>?', '', 'g'), {d.q(d.WS + '+')}, ' ', 'g')) as review_text,
 (select string_agg(platform || ':' || id, ',' order by platform, rank) from cand where cand.ctx = rv.ctx and rank <= 15) as candidates
from rv join catalog c on c.row_idx = rv.row_idx""", more=True)


def _chosen(spark, sf):
    """Reviewed choices derived from the candidates: the second best where there is one, and a wrong id."""
    cat, tax = load(spark, sf, "catalog"), load(spark, sf, "taxonomy_more")
    mapped, contexts, cands = mapping.map_products(cat, tax)
    rows = mapped.filter("needs_review").select("row_idx", "ctx").join(cands.filter("rank = 2"), "ctx").select(
        "row_idx", "platform", F.when(c("row_idx") % 3 == 0, "no-such-id").otherwise(c("id")).alias("chosen_id"))
    return mapping.apply_choices(mapping.long_mapping(mapped), rows, contexts, cands)


_add("j12_r05_apply_choices", _chosen, """
, ch as (select rv.row_idx, rv.code, k.platform, k.id, k.name, k.full_path, 90 as confidence from rv join cand k on k.ctx = rv.ctx and rank = 2 where rv.row_idx % 3 <> 0)
select * from ch union all select lm.* from lm where not exists (select 1 from ch where ch.row_idx = lm.row_idx and ch.platform = lm.platform)""", more=True)


def _edited(spark, sf):
    cat, tax = _in(spark, sf)
    edits = cat.select("row_idx", "code", F.lit("google").alias("platform"),
                       F.when(c("row_idx") % 7 == 0, " ").otherwise(F.concat(F.lit("m-"), c("row_idx"))).alias("value"))
    return mapping.manual_overrides(mapping.long_mapping(mapping.map_products(cat, tax)[0]), edits)


_add("j13_manual_overrides", _edited, """
select * from lm where platform <> 'google'
union all select row_idx, code, 'google', 'm-' || row_idx, 'Manual', 'Manual entry', 100 from catalog where row_idx % 7 <> 0""")
_add("r06_simple_matches", lambda s, f: mapping.simple_matches(*_in(s, f)), """
select row_idx, code, platform, id, k.name, full_path, 75 as confidence from pr join cand k on k.ctx = pr.ctx where rank = 1""")


def _wide(spark, sf):
    cat, tax = _in(spark, sf)
    long = mapping.long_mapping(mapping.map_products(cat, tax)[0])
    return mapping.wide_mapping(cat.withColumn("googleCategoryId", F.col("ean")), long, ["google", "heureka"])


_add("s21_wide_mapping", _wide, """
select c.row_idx, c.code, c.name, category_text, default_category, coalesce(g.id, nullif(ean, '')) as googleCategoryId,
 g.id as googleCategoryIdInFeed, h.id as heurekaCategoryId
from catalog c left join lm g on g.row_idx = c.row_idx and g.platform = 'google' left join lm h on h.row_idx = c.row_idx and h.platform = 'heureka'""")
_add("r03_non_products", lambda s, f: mapping.product_contexts(_in(s, f)[0]).select("row_idx", "base", "non_product"),
     "select row_idx, base, non_product from pr")
