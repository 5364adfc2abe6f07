"""The shop tables that the registered queries read, derived from the Parquet test tables.

Each table is SQL that runs unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = """
select
 cast(p.p_partkey as bigint) as row_idx,
 case when p.p_partkey % 10 in (1,2,3) then concat('P', cast(p.p_partkey - p.p_partkey % 10 as bigint), '/', p.p_partkey % 10)
      when p.p_partkey % 210 = 18 then concat('P', p.p_partkey - 1)
      else concat('P', p.p_partkey) end as code,
 case when p.p_partkey % 10 in (1,2,3) then concat('P', p.p_partkey - p.p_partkey % 10)
      when p.p_partkey % 97 = 5 then concat('GONE', p.p_partkey)
      else '' end as parent_code,
 case when p.p_partkey % 110 in (2, 3) then concat('Twin ', p.p_partkey - p.p_partkey % 10)
      when p.p_partkey % 83 = 0 then repeat(concat(p.p_name, ' '), 8) when p.p_partkey % 89 = 0 then substr(p.p_name, 1, 6)
      when p.p_partkey % 10 = 1 then concat(p.p_name, ' - ', p.p_size) else concat(p.p_name, ' ', p.p_brand) end as name,
 case when p.p_partkey = 77 then 'Solo' when p.p_partkey = 87 then concat(p.p_type, ' > Alone') when p.p_partkey % 71 = 0 then '' else concat(p.p_type, ' > ', split_part(p.p_name, ' ', 2), case when p.p_size > 40 then ' > big > huge > giant' else '' end) end as default_category,
 case when p.p_partkey = 77 then 'Solo' when p.p_partkey % 71 = 0 then '' else concat(p.p_type, ' | ', split_part(p.p_name, ' ', 2)) end as category_text,
 case when p.p_partkey = 77 then 'Second' when p.p_partkey % 5 = 0 then split_part(p.p_name, ' ', 1) else '' end as category_text2,
 case when p.p_partkey % 113 = 5 then concat('Test popis ', d.text)
      when p.p_partkey % 113 = 11 then concat(repeat('<div>', 10), d.text, repeat('</div>', 10))
      when p.p_partkey % 113 = 17 then concat(d.text, repeat('<p></p>', 7))
      when p.p_partkey % 113 = 23 then concat(repeat(concat(repeat('<br>', 4), 'x'), 5), d.text)
      when p.p_partkey % 113 = 29 then concat(d.text, ' viz https://example.com/page')
      when p.p_partkey % 113 = 31 then concat(d.text, repeat('😀', 7))
      when p.p_partkey % 101 = 0 then concat('Lorem ipsum dolor sit amet ', d.text)
      when p.p_partkey % 103 = 0 then concat('<div style="x"><b>', d.text, '</div>')
      when p.p_partkey % 107 = 0 then ''
      when p.p_partkey % 3 = 0 then concat('<p>', d.text, '</p>') else d.text end as description,
 case when p.p_partkey % 11 = 0 then '' when p.p_partkey % 13 = 0 then d.text else substr(d.text, 1, 120) end as short_description,
 case when p.p_partkey % 127 = 3 then concat(p.p_name, ' ', p.p_brand) when p.p_partkey % 127 = 7 then concat(p.p_name, ' ', p.p_brand, ' x')
      when p.p_partkey % 6 = 0 then '' else substr(d.text, 1, 40 + p.p_size * 4) end as meta_description,
 cast(case when p.p_partkey % 50 = 9 then 0.0 when p.p_partkey % 333 = 4 then -1.0 when p.p_partkey % 41 = 7 then 2000.0 when p.p_partkey % 61 = 8 then null else p.p_retailprice end as double) as price,
 cast(case when p.p_partkey % 4 = 0 then round(p.p_retailprice * (0.9 + (p.p_partkey % 17) / 10.0), 2) end as double) as price_before_discount,
 cast(case when p.p_partkey % 7 = 0 then 0 when p.p_partkey % 91 = 3 then -2 else p.p_size end as int) as stock,
 case when p.p_partkey % 7 = 0 then 'Vyprodáno' when p.p_partkey % 19 = 0 then 'Na dotaz' else 'Skladem' end as availability,
 case when p.p_partkey % 23 = 0 then '' when p.p_partkey % 37 = 0 then 'Na dotaz' else 'Skladem' end as availability_in_stock,
 case when p.p_partkey % 29 = 0 then '' when p.p_partkey % 37 = 1 then 'Skladem' else 'Vyprodáno' end as availability_out_of_stock,
 cast(p.p_partkey % 8 as int) as delivery_days,
 case when p.p_partkey % 15 = 0 then '' else concat('859', lpad(cast(p.p_partkey % 1950 as string), 10, '0')) end as ean,
 case when p.p_partkey % 31 = 0 then '' else p.p_brand end as manufacturer,
 cast(case when p.p_partkey % 30 = 21 then 0 else p.p_partkey % 5 end as int) as image_count,
 p.p_partkey % 9 = 0 as is_action,
 p.p_partkey % 14 = 0 as is_new,
 cast(case when p.p_partkey % 45 = 0 then timestamp '2024-01-15 00:00:00' when p.p_partkey % 27 = 0 then timestamp '2024-06-01 00:00:00' end as timestamp) as action_end_date,
 cast(case when p.p_partkey % 3 = 0 then timestamp '2024-01-10 00:00:00' else o.o_orderdate end as timestamp) as created_at,
 cast(case when p.p_partkey % 2 = 0 then timestamp '2024-01-20 00:00:00' else timestamp '2023-11-01 00:00:00' end as timestamp) as updated_at,
 case when p.p_partkey % 5 = 0 or p.p_partkey % 30 = 21 then '' else concat('https://img.example/', p.p_partkey, '.jpg') end as image,
 case when p.p_partkey % 16 = 0 then '' else concat('size:', p.p_size) end as filter_params,
 case when p.p_partkey % 10 in (1,2,3) then concat('P', p.p_partkey - p.p_partkey % 10) else '' end as pair_code
from (select part.*, p_partkey % (select count(*) from documents) as doc_ref from part) p
join documents d on d.doc_id = p.doc_ref
left join orders o on o.o_orderkey = p.p_partkey
"""

CATEGORIES = """
with c as (select distinct p_type as t, split_part(p_name, ' ', 2) as w from part)
select t as code, t as name, cast(null as string) as parent_code, t as path,
       case when t in ('PROMO', 'LARGE') then '' else concat('All ', t) end as description, true as is_active
from (select distinct t from c) x
union all
select concat(t, '/', w), w, t, concat(t, ' | ', w), case when w = 'ring' then '' else concat('About ', w) end, not (t = 'SMALL' and w = 'bolt')
from c
union all select 'X1', 'Lost', 'NOPE', 'Nope | Lost', 'lost', true
union all select 'X3', 'Solo', cast(null as string), 'Solo', 'one', true
union all select 'X2', 'Empty', cast(null as string), 'Empty', '', true
union all select concat('D', n), concat('Deep ', n), case when n > 1 then concat('D', n - 1) end, concat('Deep ', n), 'deep', true
from (select 1 as n union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) d
"""

TAXONOMY = """
with w as (select distinct split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part)
select 'google' as platform, concat('g-', a, '-', b) as id, concat(a, ' ', b) as name, concat('Goods > ', b, ' > ', a, ' ', b) as full_path from w
union all select distinct 'heureka', concat('h-', b), b, concat('Zbozi | Dilna | ', b) from w
union all select distinct 'heureka', concat('ha-', b), concat(b, ' příslušenství'), concat('Zbozi | Dilna | ', b, ' | ', b, ' příslušenství') from w
union all select distinct 'heureka', concat('hs-', b), concat(b, ' výprodej'), concat('Akce | ', b, ' výprodej') from w
"""

# The taxonomy plus a platform whose categories match by path only, so that products need review.
TAXONOMY_MORE = TAXONOMY + """union all select distinct 'glami', concat('gl-', b), 'Ostatni', concat('Zbozi | ', b, ' | Ostatni') from w
"""

STATUS_POLLS = """
select event_id as poll_id, ts,
 concat('platform_', user_id % 4) as platform,
 case event_type when 'view' then 'none' when 'click' then 'minor' when 'signup' then 'major' when 'error' then 'critical' else 'n/a' end as indicator
from events
"""

# Crawled pages with what the raw ones lack: heads with stylesheets, scripts and fonts, images, external links,
# home pages, skipped headings, pages without title and headings, large pages.
_SITE_URL = "case when page_id % 25 = 3 then concat('https://shop', page_id, '.example/') else url end"
SITE_PAGES = f"""
select page_id, url, concat('<head>',
  case when page_id % 7 = 0 then repeat('<link rel="stylesheet" href="/s.css">', 6) else '<link rel="stylesheet" href="/t.css">' end,
  case when page_id % 11 = 0 then repeat('<link rel="preload" href="https://fonts.googleapis.com/css">', 4) else '' end,
  case when page_id % 13 = 0 then repeat('<script src="/a.js"></script>', 11) when page_id % 5 = 0 then '<script src="/b.js"></script>' else '' end,
  case when page_id % 3 = 1 then '<script async src="https://cdn.jsdelivr.net/y.js"></script>' else '' end,
  case when page_id % 9 = 0 then '<script src="https://evil.example/z.js"></script>' else '' end,
  case when page_id % 2 = 0 then '<meta name="description" content="d">' else '' end,
  case when page_id % 50 = 3 then concat(repeat('<meta property="og:title" content="o">', 3), repeat('<meta name="twitter:card" content="t">', 2)) else '' end,
  '</head>',
  case when page_id % 4 = 0 then repeat('<img src="/p.png">', 12) when page_id % 4 = 1 then '<img src="/q.png" alt="ok" loading="lazy" srcset="/m.png 1x, /n.png 2x">' else '' end,
  case when page_id % 6 = 0 then concat('<img alt="x" src="http://', regexp_extract(url, '^https?://([^/?#]+)', 1), '/i.png">') else '' end,
  case when page_id % 8 = 0 then '<h1>A</h1><h3>B</h3>' else '' end,
  case when page_id % 12 = 0 then repeat('<a href="#">x</a>', 12) else '' end,
  case when page_id % 3 = 0 then concat('<a href="https://social.example/p">s</a><a href="https://gone', page_id % 7, '.example/', page_id, '">g</a>') else '' end,
  case when page_id % 60 = 0 then repeat('<p>filler text</p>', 30000) else '' end,
  case when page_id % 10 = 7 then '<p>plain</p>' else html end) as html
from (select page_id, {_SITE_URL} as url, html from pages) p
"""

SITE_FETCHES = f"""
select {_SITE_URL} as url, case when page_id % 17 = 0 then 404 when page_id % 23 = 0 then 0 when page_id % 29 = 0 then 301 else 200 end as status from pages
"""

FETCHES = """
select url, case when page_id % 17 = 0 then 404 when page_id % 23 = 0 then 0 when page_id % 29 = 0 then 301 else 200 end as status,
 length(html) as n_bytes from pages
"""

RESPONSES = """
select p_partkey as row_idx,
 case when p_partkey % 37 = 0 then 'not json'
 else concat('{"filtering":[{"name":"Výrobce","value":"', p_brand, '"},{"name":"Značka","value":"', lower(p_brand), '"},{"name":"barva","value":"',
   split_part(p_name, ' ', 1), case when p_partkey % 2 = 0 then ', modrá' else ' a usb' end, '"}],"text":[{"key":"druh","value":"', split_part(p_name, ' ', 2), '"}]}') end as payload
from part
"""

VIEWS = {
    "catalog": (CATALOG, ["part", "documents", "orders"]),
    "categories": (CATEGORIES, ["part"]),
    "taxonomy": (TAXONOMY, ["part"]),
    "taxonomy_more": (TAXONOMY_MORE, ["part"]),
    "status_polls": (STATUS_POLLS, ["events"]),
    "fetches": (FETCHES, ["pages"]),
    "site_pages": (SITE_PAGES, ["pages"]),
    "site_fetches": (SITE_FETCHES, ["pages"]),
    "responses": (RESPONSES, ["part"]),
}


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the shop tables over the Parquet files in ``sf_dir``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql, tables = VIEWS[view]
    if view == "catalog":
        sql = _texts_last(sql)
    return spark.sql(sql_over(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _texts_last(sql: str) -> str:
    """The catalog with its two joins the other way round: the same rows, but a product's text is not moved again to find its
    order. The left join reads columns of the product only, so it may stand before the inner one.
    """
    texts, orders = "join documents d on d.doc_id = p.doc_ref\n", "left join orders o on o.o_orderkey = p.p_partkey\n"
    if texts + orders not in sql:
        raise ValueError("the joins of the catalog are not the known ones")
    return sql.replace(texts + orders, orders + texts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, read as it is; ``spark.sql.files.maxPartitionBytes`` sets the size of the parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(sql: str, tables: list[str]) -> str:
    """Names the given tables as CTEs bound to DataFrame arguments."""
    return "with " + ", ".join(f"{t} as (select * from {{{t}}})" for t in tables) + \
        f"\nselect * from ({_escape(sql)})"


def _escape(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


def oracle(views: list[str], sql: str) -> str:
    """``sql`` for DuckDB with the named shop tables in front."""
    return "with " + ",\n".join(f"{v} as ({VIEWS[v][0]})" for v in views) + "\n" + sql
