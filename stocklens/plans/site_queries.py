"""Registered queries of the site audit, over the crawled pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stocklens.fixtures import SITE_FETCHES, SITE_PAGES, load, table
from stocklens.functions import url as ur
from stocklens.operators import site_pages as sp, site_rules as sr
from stocklens.plans import duck as d
from stocklens.session import materialise

QUERIES, ORACLES = {}, {}
c = F.col
AS_OF = datetime(2024, 2, 1)
_STATUS = "case when length({x}) % 5 = 0 then 404 when length({x}) % 5 = 1 then 0 else 200 end"


def _pages(s, f):
    return load(s, f, "site_pages")


def _sites(s, f):
    return _pages(s, f).select(ur.origin(c("url")).alias("site")).distinct()


def _link_fetches(s, f, links, images):
    """A fetch result for every page, link and image."""
    found = links.select(c("link").alias("url")).unionByName(images.select(c("image").alias("url"))).distinct().withColumn(
        "status", F.expr(_STATUS.format(x="url")))
    return load(s, f, "site_fetches").unionByName(found.join(_pages(s, f).select("url"), "url", "left_anti"))


def _probes(s, f, paths):
    """A fetch result for every site and well-known path."""
    listed = F.explode(F.array(*[F.lit(p) for p in paths])).alias("path")
    return _sites(s, f).select("site", listed).select(F.concat("site", "path").alias("url")).withColumn(
        "status", F.expr(_STATUS.format(x="url")))


def _attr(t, name):
    return (f"regexp_replace(regexp_extract({t}, " + d.q(rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""") +
            ", 1), " + d.q("""^["']|["']$""") + ", '', 'g')")


def _tags(x, names):
    return f"regexp_extract_all({x}, " + d.q(rf"(?i)<(?:{names})(?:\s[^>]*|/)?>") + ")"


def _origin(x):
    return f"regexp_replace(regexp_replace(lower(regexp_extract({x}, '^([a-zA-Z]+://[^/?#\\\\]+)', 1)), '^(http://[^:]+):80$', '\\1'), '^(https://[^:]+):443$', '\\1')"


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'),
 '(?i)(<script\b[^>]*>)[\s\S]*?</script\s*>', '\1</script>', 'g'), '(?i)(<style\b[^>]*>)[\s\S]*?</style\s*>', '\1</style>', 'g')"""
_INNER = lambda x: d.trim(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
_HAS = lambda t, name: f"regexp_matches({t}, " + d.q(rf"(?i)\s{name}(\s*=|\s|/?>)") + ")"
_HOST = lambda x: f"regexp_replace(lower(regexp_extract({x}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
_ABS = lambda h: (f"case when starts_with({h}, 'http://') or starts_with({h}, 'https://') then {h} when starts_with({h}, '//') then 'https:' || {h} "  # noqa: E731
                  f"when starts_with({h}, '/') then site || {h} end")
_PG = f"""with site_pages as ({SITE_PAGES})
, pg as (select page_id, url, html, {_CLEAN} as clean, {_origin('url')} as site from site_pages)
, ft as (select *, {d.trim("regexp_replace(regexp_extract(clean, '(?i)<title(?:" + chr(92) + "s[^>]*)?>([" + chr(92) + "s" + chr(92) + "S]*?)</title" + chr(92) + "s*>', 1), '<[^>]*>', '', 'g')")} as ttl,
  list_transform(regexp_extract_all(clean, '(?i)<h1(?:\\s[^>]*)?>([\\s\\S]*?)</h1\\s*>', 1), lambda x: {_INNER('x')}) as h1s,
  list_transform({_tags('clean', 'h[1-6]')}, lambda t: t[3]) as hs,
  list_filter({_tags('clean', 'img')}, lambda t: {_attr('t', 'alt')} = '') as noalt,
  list_filter(regexp_extract_all(clean, '(?i)<a(?:\\s[^>]*)?>(?:[\\s\\S]*?)</a\\s*>'), lambda a: {_attr("regexp_extract(a, '^<[^>]*>', 0)", 'href')} in {d.in_list(sp.EMPTY_HREFS)}) as empt,
  list_transform(list_filter({_tags('clean', 'script')}, lambda t: {_HAS('t', 'src')}), lambda t: {_attr('t', 'src')}) as scr,
  len(list_filter({_tags("regexp_extract(clean, '(?i)<head" + chr(92) + "b[^>]*>([" + chr(92) + "s" + chr(92) + "S]*?)</head" + chr(92) + "s*>', 1)", 'script')},
   lambda t: {_HAS('t', 'src')} and not {_HAS('t', 'async')} and not {_HAS('t', 'defer')})) as blk,
  list_transform(list_filter({_tags('clean', 'link')}, lambda t: lower({_attr('t', 'rel')}) = 'stylesheet'), lambda t: {_attr('t', 'href')}) as sheets,
  len(list_filter({_tags('clean', 'link')}, lambda t: contains({_attr('t', 'href')}, 'fonts.googleapis.com') or contains({_attr('t', 'href')}, 'fonts.gstatic.com'))) as fonts,
  len(list_filter({_tags('clean', 'img')}, lambda t: {_attr('t', 'loading')} = 'lazy' or {_HAS('t', 'data-src')} or {_HAS('t', 'data-lazy')})) > 0 as lazy,
  list_transform({_tags('clean', 'img|script|iframe|embed|object|audio|video|source')}, lambda t: coalesce(nullif({_attr('t', 'src')}, ''), {_attr('t', 'data')})) as media,
  len(list_filter({_tags('clean', 'meta')}, lambda t: {_attr('t', 'name')} = 'description' and {_attr('t', 'content')} <> '')) > 0 as md,
  len(list_filter({_tags('clean', 'meta')}, lambda t: starts_with({_attr('t', 'name')}, 'twitter:'))) >= 2 as tw,
  len(list_filter({_tags('clean', 'meta')}, lambda t: starts_with({_attr('t', 'property')}, 'og:'))) >= 3 as og
 from pg)
, fu as (select *, case when starts_with(url, 'https://') then list_filter(list_concat(media, sheets), lambda u: starts_with(u, 'http://') and {_HOST('u')} = {_HOST('url')}) else [] end as mixed,
  list_filter(list_transform(scr, lambda h: {_ABS('h')}), lambda u: u is not null and {_origin('u')} <> site) as ext from ft)
"""
_HREFS = (", lk as (select distinct page_id, url as page_url, site, case when starts_with(h, 'http://') or starts_with(h, 'https://') then h "
          "when starts_with(h, '//') then 'https:' || h when starts_with(h, '/') then site || h end as link from "
          f"(select page_id, url, site, unnest(list_transform({_tags('clean', 'a')}, lambda t: {_attr('t', 'href')})) as h from pg) where h <> '')\n"
          ", ln as (select * from lk where link is not null)\n")


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def _features(s, f):
    x = sp.page_features(_pages(s, f))
    return x.select(
        "page_id", "url", "origin", "page_size", "title", "h1_count", F.array_join("h1_texts", "|").alias("h1_texts"),
        F.array_join(F.transform("headings", lambda h: h.cast("string")), ",").alias("headings"),
        "images_without_alt_count", F.array_join("images_without_alt", "|").alias("images_without_alt"),
        F.array_join("empty_links", "|").alias("empty_links"), "js_files", "css_files", "blocking_scripts", "webfonts", "lazy_loading",
        "has_meta_description", "has_og", "has_twitter", F.array_join("external_scripts", "|").alias("external_scripts"),
        F.array_join("mixed_content", "|").alias("mixed_content"))


_add("x01_page_features", _features, _PG + f"""select page_id, url, site as origin, length(html) as page_size, nullif(ttl, '') as title, len(list_filter(hs, lambda h: h = '1')) as h1_count,
 array_to_string(h1s, '|') as h1_texts, array_to_string(hs, ',') as headings, len(noalt) as images_without_alt_count,
 array_to_string(list_filter(list_transform(noalt, lambda t: coalesce(nullif({_attr('t', 'src')}, ''), {_attr('t', 'data-src')})), lambda x: x <> ''), '|') as images_without_alt,
 array_to_string(list_transform(empt, lambda a: coalesce(nullif({_INNER('a')}, ''), '[no text]') || ' -> ' ||
  coalesce(nullif({_attr("regexp_extract(a, '^<[^>]*>', 0)", 'href')}, ''), '[no href]')), '|') as empty_links,
 len(scr) as js_files, len(sheets) as css_files, blk as blocking_scripts, fonts as webfonts, lazy as lazy_loading, md as has_meta_description, og as has_og, tw as has_twitter,
 array_to_string(ext, '|') as external_scripts, array_to_string(mixed, '|') as mixed_content from fu""")
_add("x02_p25_links", lambda s, f: sp.page_links(_pages(s, f)), _PG + _HREFS + "select page_id, page_url, link from ln")
_IMAGES = f""", im as (select distinct page_id, url as page_url, site, {_ABS('h')} as image from (select page_id, url, site, unnest(list_concat(
  list_transform({_tags('clean', 'img')}, lambda t: {_attr('t', 'src')}),
  flatten(list_transform(list_transform({_tags('clean', 'img|source')}, lambda t: {_attr('t', 'srcset')}),
   lambda s: list_transform(string_split(s, ','), lambda x: string_split({d.trim('x')}, ' ')[1]))))) as h from pg) where h <> '')
"""
_add("x03_images", lambda s, f: sp.page_images(_pages(s, f)), _PG + _IMAGES + "select page_id, page_url, image from im where image is not null")
_add("w02_first_sources", lambda s, f: sp.first_sources(sp.page_links(_pages(s, f)), "link"), _PG + _HREFS + """
select link, min(page_id) as page_id, arg_min(page_url, page_id) as source, count(*) as pages from ln group by 1""")
_add("f11_crawlable_links", lambda s, f: sp.crawlable(sp.page_links(_pages(s, f))), _PG + _HREFS + f"""
select page_id, page_url, link from ln where regexp_replace({_origin('link')}, '^[a-z]+://', '') = regexp_replace(site, '^[a-z]+://', '')
 and not regexp_matches(lower(link), {d.q(ur.ASSET_PATTERN)})""")
_add("f10_page_sample", lambda s, f: sp.sample_pages(table(s, f, "orders").select(
    c("o_orderkey").alias("page_id"), F.concat(F.lit("https://shop.example/order/"), "o_orderkey").alias("url")), "fixture"), """with r as (
 select url, row_number() over (order by page_id) as a, row_number() over (order by page_id desc) as z, page_id
 from (select o_orderkey as page_id, 'https://shop.example/order/' || o_orderkey as url from orders))
, m as (select url, row_number() over (order by md5('fixture|' || url), page_id) as k from r where a > 100 and z > 50)
select url from r where a <= 100 or z <= 50 union select url from m where k <= 350""")
_add("p27_normalized_urls", lambda s, f: _pages(s, f).select(
    "page_id", ur.normalize_page_url(c("url")).alias("norm"), ur.host(c("url")).alias("host"), ur.is_asset(c("url")).alias("asset")), f"""with site_pages as ({SITE_PAGES})
select page_id, regexp_replace(regexp_replace(url, '^(https?://[^/?#]+)([?#].*)?$', '\\1/\\2'), '^(https?://[^/?#]+/[^?#]*)/([?#].*)?$', '\\1\\2') as norm,
 regexp_replace({_origin('url')}, '^[a-z]+://', '') as host, regexp_matches(lower(url), {d.q(ur.ASSET_PATTERN)}) as asset from site_pages""")

_TRUSTED = " or ".join(f"{_HOST('u').replace(chr(94) + 'www', chr(94) + 'www')} = {d.q(t)} or ends_with({_HOST('u')}, {d.q('.' + t)})" for t in sr.TRUSTED_DOMAINS)
_ISSUES = f""", iss as (
 select site, 'performance' as family, 'large_page_size' as type, 'warning' as severity, url, page_id, cast(floor(length(html) / 1024 + 0.5) as bigint) || 'KB' as details from fu where length(html) > 500000
 union all select site, 'performance', 'too_many_js', 'warning', url, page_id, len(scr) || ' scripts' from fu where len(scr) > 10
 union all select site, 'performance', 'too_many_css', 'warning', url, page_id, len(sheets) || ' stylesheets' from fu where len(sheets) > 5
 union all select site, 'performance', 'render_blocking_script', 'warning', url, page_id, blk || ' blocking scripts' from fu where blk > 0
 union all select site, 'performance', 'too_many_webfonts', 'warning', url, page_id, fonts || ' webfonts' from fu where fonts > 3
 union all select site, 'performance', 'missing_lazy_loading', 'warning', url, page_id, '' from fu where not lazy and len(noalt) > 5
 union all select site, 'html', 'missing_h1', 'error', url, page_id, '' from fu where not list_contains(hs, '1')
 union all select site, 'html', 'duplicate_h1', 'warning', url, page_id, len(list_filter(hs, lambda h: h = '1')) || ': ' || array_to_string(h1s, ', ') from fu where len(list_filter(hs, lambda h: h = '1')) > 1
 union all select site, 'html', 'heading_hierarchy', 'warning', url, page_id, 'h' || hs[i] || ' -> h' || hs[i + 1] from (
   select *, list_filter(range(1, len(hs)), lambda k: hs[k + 1]::int > hs[k]::int + 1)[1] as i from fu) where i is not null
 union all select site, 'html', 'missing_alt', 'warning', url, page_id, len(noalt) || ' images' from fu where len(noalt) > 0
 union all select site, 'html', 'empty_link', 'warning', url, page_id, len(empt) || ' links' from fu where len(empt) > 0
 union all select site, 'html', 'missing_meta_description', 'warning', url, page_id, '' from fu where not md
 union all select site, 'html', 'missing_title', 'error', url, page_id, '' from fu where ttl = ''
 union all select site, 'config', 'missing_og_tags', 'warning', url, page_id, '' from fu where regexp_matches(url, '^https?://[^/?#]+/?$') and not og
 union all select site, 'config', 'missing_twitter_cards', 'warning', url, page_id, '' from fu where regexp_matches(url, '^https?://[^/?#]+/?$') and not tw
 union all select site, 'security', 'mixed_content', 'error', url, page_id, u from (select *, unnest(mixed) as u from fu)
 union all select site, 'security', 'untrusted_scripts', 'warning', url, page_id, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)) from (select *, unnest(ext) as u from fu) where not ({_TRUSTED}))
"""
_COLS = ["site", "family", "type", "severity", "url", "page_id", "details"]


def _page_issues(s, f):
    return sr.page_issues(sp.page_features(_pages(s, f)))


_add("x04_x12_page_issues", lambda s, f: _page_issues(s, f).select(*_COLS), _PG + _ISSUES + "select * from iss")
_FX = _HREFS + _IMAGES + f""", fx as (select url, status from ({SITE_FETCHES})
 union all select l, {_STATUS.format(x='l')} from (select link as l from ln union select image from im where image is not null) where l not in (select url from pg))
, tg as (select site, link as url, min(page_id) as page_id, arg_min(page_url, page_id) as source from ln group by 1, 2)
, ext as (select tg.*, regexp_replace({_origin('url')}, '^[a-z]+://', '') <> regexp_replace(site, '^[a-z]+://', '') as external from tg)
, ti as (select site, image as url, min(page_id) as page_id from im where image is not null group by 1, 2)
, brk as (select site, 'links' as family, 'page_404' as type, 'error' as severity, pg.url, page_id, '404' as details from pg join fx on fx.url = pg.url where status = 404
 union all select site, 'links', 'internal_link_404', 'error', ext.url, page_id, '404' from ext join fx on fx.url = ext.url where not external and status = 404 and ext.url not in (select url from pg)
 union all select site, 'links', 'external_link_404', 'error', ext.url, page_id, '404' from ext join fx on fx.url = ext.url where external and status in (0, 404)
 union all select site, 'links', 'broken_image', 'error', ti.url, page_id, '404' from ti join fx on fx.url = ti.url where status in (0, 404))
"""


def _broken(s, f):
    pages = _pages(s, f)
    # found once: the checks and the fetches read them, and the HTML is costly
    links, images = materialise(sp.page_links(pages)), materialise(sp.page_images(pages))
    return sr.link_checks(links, images, pages, _link_fetches(s, f, links, images))


_add("j11_x16_link_checks", lambda s, f: _broken(s, f).select(*_COLS), _PG + _FX + "select * from brk")


def _site_issues(s, f):
    return _page_issues(s, f).unionByName(_broken(s, f))


def _scanned(s, f):
    return _pages(s, f).groupBy(ur.origin(c("url")).alias("site")).agg(F.count(F.lit(1)).alias("pages"))


# Link rows are facts about single targets: they are neither deduplicated nor collapsed.
_A10 = """, si as (select *, type || ':' || details as sig, regexp_replace(regexp_replace(url, '^(https?://[^/?#]+)([?#].*)?$', '\\1/\\2'), '^(https?://[^/?#]+/[^?#]*)/([?#].*)?$', '\\1\\2') as norm from iss)
, s1 as (select * from si qualify row_number() over (partition by site, sig, norm order by page_id, url) = 1)
, s2 as (select *, count(*) over (partition by site, sig) as n, row_number() over (partition by site, sig order by page_id, norm) as nth from s1)
, s3 as (select s2.*, n > 0.7 * pages and pages > 2 as coll from s2 join (select site, count(*) as pages from pg group by 1) k using (site))
, ded as (select site, family, type, severity, url, page_id, case when coll then trim(details || ' [on ' || n || ' pages]') else details end as details from s3 where not coll or nth = 1
 union all select * from brk)
"""


def _deduped(s, f):
    return sr.collapse_repeated(_site_issues(s, f), _scanned(s, f))


_add("a10_collapsed_issues", lambda s, f: _deduped(s, f).select(*_COLS), _PG + _ISSUES + _FX + _A10 + "select * from ded")
_cnt = lambda f, s: f"count(*) filter (family = '{f}' and severity = '{s}')"
_A08 = ", sc as (select k.site, greatest(0, 100 - 5 * count(*) filter (family = 'links')) as links, " + ", ".join(
    f"greatest(0, 100 - {e} * {_cnt(f, 'error')} - {w} * {_cnt(f, 'warning')}) as {f}" for f, (e, w) in sr.SITE_PENALTIES.items()) + \
    " from (select distinct site from pg) k left join ded on ded.site = k.site group by 1)\n"
_add("a08_site_scores", lambda s, f: sr.site_scores(_deduped(s, f), _sites(s, f)), _PG + _ISSUES + _FX + _A10 + _A08 + """
select *, cast(floor((links + performance + html + config + security) / 5.0 + 0.5) as integer) as overall from sc""")
_add("a17_issue_summary", lambda s, f: sr.issue_summary(_site_issues(s, f)).select(
    "site", "family", "issues", F.array_join("examples", ",").alias("examples")), _PG + _ISSUES + _FX + """
, al as (select * from iss union all select * from brk)
, rk as (select *, row_number() over (partition by site, family order by page_id, type, url, details) as rn from al)
select site, family, count(*) as issues, string_agg(type || ' ' || url, ',' order by rn) filter (rn <= 5) as examples from rk group by 1, 2""")


def _robots(s, f):
    return _sites(s, f).select("site", F.when(F.length("site") % 4 == 0, 404).otherwise(200).alias("status"), F.when(
        F.length("site") % 3 == 0, F.lit("User-agent: *\nDisallow: /cart")).otherwise(F.concat(F.lit("Sitemap: "), "site")).alias("content"))


_add("x13_robots", lambda s, f: sr.robots_issues(_robots(s, f)).select("site", "type", "severity", "details"), _PG + """
, rb as (select distinct site, case when length(site) % 4 = 0 then 404 else 200 end as status, length(site) % 3 = 0 as ua from pg)
select site, 'missing_robots' as type, 'warning' as severity, 'status 404' as details from rb where status = 404
union all select site, 'invalid_robots', 'warning', 'no user-agent line' from rb where status = 200 and not ua
union all select site, 'invalid_robots', 'warning', 'no sitemap line' from rb where status = 200 and ua""")


def _sitemap_docs(s, f):
    """One sitemap document per page; some documents list nothing."""
    entry = F.concat(
        F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>2024-01-"),
        F.lpad((c("page_id") % 30 + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    return _pages(s, f).select(ur.origin(c("url")).alias("site"), F.concat(
        F.lit('<?xml version="1.0"?><urlset>'), F.when(c("page_id") % 5 == 0, "").otherwise(entry), F.lit("</urlset>")).alias("xml"))


def _sitemap_urls(s, f):
    from stocklens.sources.sitemap import sitemap_entries
    return sitemap_entries(_sitemap_docs(s, f)).select("site", "loc", "lastmod")


_add("s16_sitemap_entries", _sitemap_urls, _PG + """select site, url as loc, '2024-01-' || lpad(cast(page_id % 30 + 1 as varchar), 2, '0') as lastmod from pg where page_id % 5 <> 0""")
def _sitemap_files(s, f):
    """What was fetched as sitemap of each site: lists of pages, empty lists, an index, or nothing."""
    docs = _sitemap_docs(s, f).select("site", F.when(F.length("site") % 6 == 0, 404).otherwise(200).alias("status"), "xml")
    index = _sites(s, f).filter(F.length("site") % 7 == 0).select("site", F.lit(200).alias("status"), F.lit(
        "<sitemapindex><sitemap><loc>/a.xml</loc><lastmod>2024-01-05</lastmod></sitemap></sitemapindex>").alias("xml"))
    return docs.unionByName(index)


_add("x14_sitemap_health", lambda s, f: sr.sitemap_issues(_sites(s, f), _sitemap_files(s, f), AS_OF).select(
    "site", "type", "severity", "details"), _PG + """
, dc as (select site, case when length(site) % 6 = 0 then 404 else 200 end as status, case when page_id % 5 <> 0 then page_id % 30 + 1 end as dd from pg
 union all select distinct site, 200, 5 from pg where length(site) % 7 = 0)
, nw as (select site, count(*) filter (status = 200) as files, max(dd) filter (status = 200) as dd from dc group by 1)
select site, 'missing_sitemap' as type, 'error' as severity, '' as details from nw where files = 0
union all select site, 'outdated_sitemap', 'warning', (32 - dd) || ' days' from nw where 32 - dd > 7""")
_FAV = ", ".join(f"({d.q(p)})" for p in sr.FAVICON_PATHS)
_add("x15_favicon", lambda s, f: sr.favicon_issues(_sites(s, f), _probes(s, f, sr.FAVICON_PATHS)).select("site", "type", "severity", "url"), _PG + f"""
select distinct site, 'missing_favicon' as type, 'warning' as severity, site || '/favicon.ico' as url from pg where not exists (
 select 1 from (values {_FAV}) t(p) where {_STATUS.format(x="(pg.site || p)")} = 200)""")


def _https(s, f):
    return sr.https_issues(_sites(s, f).select("site", F.when(F.length("site") % 3 == 0, 301).when(F.length("site") % 3 == 1, 200).otherwise(0).alias("status"),
                                               F.when(F.length("site") % 2 == 0, F.concat(F.lit("https://"), F.regexp_replace("site", "^https?://", ""))).alias("location")))


_add("x15_https_redirect", lambda s, f: _https(s, f).select("site", "type", "severity"), _PG + """
select distinct site, 'no_https_redirect' as type, case when starts_with(site, 'http://') then 'error' else 'warning' end as severity from pg
where length(site) % 3 = 1 or (length(site) % 3 = 0 and length(site) % 2 = 1)""")
_add("x17_script_classes", lambda s, f: sr.script_classes(sp.page_features(table(s, f, "pages").select(
    "page_id", "url", F.concat(F.lit('<script src="https://'), F.when(c("page_id") % 3 == 0, "cdn.jsdelivr.net/a.js").when(
        c("page_id") % 3 == 1, "cdn.myshoptet.com/b.js").otherwise("files.example.com/user/c.js"), F.lit('"></script>'), "html").alias("html")))), """
select case when page_id % 3 = 0 then 'trusted' when page_id % 3 = 1 then 'shoptet' else 'custom' end as source_class, count(*) as scripts from pages group by 1""")


def _trust(s, f):
    pages = _pages(s, f)
    first = pages.groupBy(ur.origin(c("url")).alias("site")).agg(F.min("page_id").alias("page_id"))
    home = first.join(pages.select("page_id", "html"), "page_id").select("site", F.when(
        F.length("site") % 2 == 0, F.concat("html", F.lit('<footer>© 2021 tel. +420 123 456 789, IČO: 12345678</footer>'))).otherwise(c("html")).alias("html"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, ps in enumerate(sr.TRUST_PATHS.values()) for p in ps]))
    url = F.concat("site", "w.p")
    # one kind of page is missing on each site
    probes = _sites(s, f).select("site", kinds.alias("w")).select(url.alias("url"), F.when(
        F.length("site") % len(sr.TRUST_PATHS) == c("w.i"), 404).otherwise(F.expr(_STATUS.format(x="concat(site, w.p)"))).alias("status"))
    return sr.trust_analysis(_sites(s, f), probes, home, 2024)


def _trust_sql():
    has = lambda k: ("exists (select 1 from (values " + ", ".join(f"({d.q(p)})" for p in sr.TRUST_PATHS[k]) +  # noqa: E731
                     f") t(p) where {_STATUS.format(x='(h.site || p)')} = 200 and length(h.site) % {len(sr.TRUST_PATHS)} <> {list(sr.TRUST_PATHS).index(k)})")
    return _PG + f""", h0 as (select site, arg_min(html, page_id) as html from pg group by 1)
, h as (select site, case when length(site) % 2 = 0 then html || '<footer>© 2021 tel. +420 123 456 789, IČO: 12345678</footer>' else html end as html from h0)
, t as (select site, {', '.join(f'{has(k)} as has_{k}' for k in sr.TRUST_PATHS)}, {has('shipping')} as has_payment,
 cast(nullif(regexp_extract(lower(array_to_string(list_transform(regexp_extract_all({_CLEAN}, '(?i)<footer(?:\\s[^>]*)?>([\\s\\S]*?)</footer\\s*>', 1), lambda x: {_INNER('x')}), '')), {d.q(sr.COPYRIGHT_PATTERN)}, 1), '') as integer) as copyright_year,
 regexp_matches(html, {d.q(sr.PHONE_PATTERN)}) as has_phone, regexp_matches(html, {d.q(sr.EMAIL_PATTERN)}) as has_email,
 {d.contains_any('lower(html)', sr.ADDRESS_WORDS)} as has_address, regexp_matches(lower(html), {d.q(sr.COMPANY_PATTERN)}) as has_company from h)
, u as (select *, coalesce(copyright_year < 2023, false) as stale_copyright from t)
, v as (select *, greatest(0, 100 - case when has_contact then 0 else 20 end - case when has_terms then 0 else 20 end - case when has_privacy then 0 else 10 end
 - case when has_shipping then 0 else 10 end - case when has_phone or has_email then 0 else 15 end - case when has_company then 0 else 10 end
 - case when stale_copyright then 5 else 0 end) as trust_score from u)
"""


_add("y01_y02_a09_trust", _trust, _trust_sql() + "select * from v")
_add("y01_y02_trust_issues", lambda s, f: sr.trust_issues(_trust(s, f)), _trust_sql() + "\nunion all\n".join(
    [f"select site, '{t}' as type, '{sev}' as severity from v where not has_{k}" for k, (t, sev) in sr.TRUST_ISSUES.items()] +
    ["select site, 'outdated_copyright', 'warning' from v where stale_copyright",
     "select site, 'missing_contact_info', 'warning' from v where not has_phone and not has_email",
     "select site, 'missing_company_info', 'warning' from v where not has_company"]))
