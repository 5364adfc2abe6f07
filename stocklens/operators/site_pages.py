"""Features, links and images of crawled pages, from their HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions import text as tx, url as ur

c = F.col

# Hrefs that lead nowhere.
EMPTY_HREFS = ["", "#", "javascript:void(0)", "javascript:;"]


def clean_html(html: Column) -> Column:
    """HTML without comments and without the bodies of scripts and styles."""
    out = F.regexp_replace(tx.text(html), r"<!--[\s\S]*?-->", "")
    out = F.regexp_replace(out, r"(?i)(<script\b[^>]*>)[\s\S]*?</script\s*>", "$1</script>")
    return F.regexp_replace(out, r"(?i)(<style\b[^>]*>)[\s\S]*?</style\s*>", "$1</style>")


def tags(html: Column, names: str) -> Column:
    """All opening tags of the given element names, in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{names})(?:\s[^>]*|/)?>"), F.lit(0))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)\s{name}(\s*=|\s|/?>)")


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute; '' when it is missing or empty."""
    raw = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(raw, """^["']|["']$""", "")


def inner_text(html: Column) -> Column:
    return tx.trim_ws(F.regexp_replace(html, "<[^>]*>", ""))


def element_texts(html: Column, name: str) -> Column:
    bodies = F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?:\s[^>]*)?>([\s\S]*?)</{name}\s*>"), F.lit(1))
    return F.transform(bodies, inner_text)


def page_features(pages: DataFrame) -> DataFrame:
    """One row per page. JVM expressions only; the cleaned HTML is computed once."""
    rows = pages.select("page_id", "url", F.length("html").alias("page_size"), clean_html(c("html")).alias("clean"))
    rows = rows.withColumns({
        "origin": ur.origin(c("url")), "host": F.regexp_replace(ur.hostname(c("url")), r"^www\.", ""),
        "head": F.regexp_extract(c("clean"), r"(?i)<head\b[^>]*>([\s\S]*?)</head\s*>", 1),
        "imgs": tags(c("clean"), "img"), "scripts": F.filter(tags(c("clean"), "script"), lambda t: has_attr(t, "src")),
        "links": tags(c("clean"), "link"), "metas": tags(c("clean"), "meta"),
        "anchors": F.regexp_extract_all(c("clean"), F.lit(r"(?i)<a(?:\s[^>]*)?>(?:[\s\S]*?)</a\s*>"), F.lit(0)),
        "headings": F.transform(tags(c("clean"), "h[1-6]"), lambda t: F.substr(t, F.lit(3), F.lit(1)).cast("int")),
        "media": tags(c("clean"), "img|script|iframe|embed|object|audio|video|source"),
    })
    alt_missing = F.filter("imgs", lambda t: attr(t, "alt") == "")
    shown_src = F.filter(F.transform(alt_missing, lambda t: F.when(attr(t, "src") != "", attr(t, "src")).otherwise(
        attr(t, "data-src"))), lambda s: s != "")
    opening = lambda a: F.regexp_extract(a, "^<[^>]*>", 0)
    empty_anchor = F.filter("anchors", lambda a: attr(opening(a), "href").isin(EMPTY_HREFS))
    head_scripts = F.filter(tags(c("head"), "script"), lambda t: has_attr(t, "src"))
    stylesheet = lambda t: F.lower(attr(t, "rel")) == "stylesheet"
    on_https = c("url").startswith("https://")
    same_host = lambda u: F.regexp_replace(ur.hostname(u), r"^www\.", "") == c("host")
    loaded = F.concat(
        F.transform("media", lambda t: F.when(attr(t, "src") != "", attr(t, "src")).otherwise(attr(t, "data"))),
        F.transform(F.filter("links", stylesheet), lambda t: attr(t, "href")))
    mixed = F.filter(loaded, lambda u: u.startswith("http://") & same_host(u))
    absolute = F.transform("scripts", lambda t: ur.resolve_url(attr(t, "src"), c("url")))
    external = F.filter(absolute, lambda u: u.isNotNull() & (ur.origin(u) != c("origin")))
    meta = lambda key, start: F.size(F.filter("metas", lambda t: attr(t, key).startswith(start)))
    description = F.filter(F.filter("metas", lambda t: attr(t, "name") == "description"), lambda t: attr(t, "content") != "")
    return rows.select(
        "page_id", "url", "origin", "page_size",
        F.nullif(tx.trim_ws(F.coalesce(F.get(element_texts(c("clean"), "title"), F.lit(0)), F.lit(""))), F.lit("")).alias("title"),
        F.size(F.filter("headings", lambda h: h == 1)).alias("h1_count"),
        element_texts(c("clean"), "h1").alias("h1_texts"), "headings",
        shown_src.alias("images_without_alt"), F.size(alt_missing).alias("images_without_alt_count"),
        F.transform(empty_anchor, lambda a: F.concat(
            F.when(inner_text(a) == "", "[no text]").otherwise(inner_text(a)), F.lit(" -> "),
            F.when(attr(opening(a), "href") == "", "[no href]").otherwise(attr(opening(a), "href")))).alias("empty_links"),
        F.size("scripts").alias("js_files"), F.size(F.filter("links", stylesheet)).alias("css_files"),
        F.size(F.filter(head_scripts, lambda t: ~has_attr(t, "async") & ~has_attr(t, "defer"))).alias("blocking_scripts"),
        F.size(F.filter("links", lambda t: attr(t, "href").contains("fonts.googleapis.com")
                        | attr(t, "href").contains("fonts.gstatic.com"))).alias("webfonts"),
        F.exists("imgs", lambda t: (attr(t, "loading") == "lazy") | has_attr(t, "data-src") | has_attr(t, "data-lazy")).alias("lazy_loading"),
        F.when(on_https, mixed).otherwise(F.array().cast("array<string>")).alias("mixed_content"),
        external.alias("external_scripts"),
        F.exists("links", lambda t: attr(t, "rel").contains("icon")).alias("has_favicon"),
        (meta("property", "og:") >= 3).alias("has_og"), (meta("name", "twitter:") >= 2).alias("has_twitter"),
        (F.size(description) > 0).alias("has_meta_description"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, link), distinct per page, no shuffle."""
    rows = pages.select("page_id", "url", clean_html(c("html")).alias("clean"))
    found = rows.withColumn("hrefs", F.filter(F.transform(tags(c("clean"), "a"), lambda t: attr(t, "href")), lambda h: h != ""))
    resolved = found.withColumn("targets", F.array_distinct(F.transform("hrefs", lambda h: ur.resolve_url(h, c("url")))))
    return resolved.select("page_id", c("url").alias("page_url"), F.explode_outer("targets").alias("link")).filter(
        c("link").isNotNull())


def page_images(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, image) from src and srcset, distinct per page."""
    rows = pages.select("page_id", "url", clean_html(c("html")).alias("clean"))
    src = F.filter(F.transform(tags(c("clean"), "img"), lambda t: attr(t, "src")), lambda s: s != "")
    sets = F.filter(F.transform(tags(c("clean"), "img|source"), lambda t: attr(t, "srcset")), lambda s: s != "")
    firsts = F.flatten(F.transform(sets, lambda s: F.transform(
        F.split(s, ","), lambda part: F.element_at(F.split(tx.trim_ws(part), " "), 1))))
    found = rows.withColumn("targets", F.array_distinct(F.transform(
        F.concat(src, firsts), lambda h: ur.resolve_url(h, c("url")))))
    return found.select("page_id", c("url").alias("page_url"), F.explode_outer("targets").alias("image")).filter(
        c("image").isNotNull())


def first_sources(found: DataFrame, target: str) -> DataFrame:
    """The first page (by page_id) on which each link or image occurs."""
    return found.groupBy(target).agg(F.min("page_id").alias("page_id"), F.min_by("page_url", "page_id").alias("source"),
                                     F.count(F.lit(1)).alias("pages"))


def crawlable(links: DataFrame, link: str = "link", site: str = "page_url") -> DataFrame:
    """internal links that are pages."""
    return links.filter(~ur.is_external(c(link), c(site)) & ~ur.is_asset(c(link)))


def sample_pages(urls: DataFrame, seed: str, limit: int = 500, first: int = 100, last: int = 50) -> DataFrame:
    """the first 100 urls, the last 50 and seeded picks from between, ``limit`` in all.

    Three top-k reports over the same table; fewer than ``limit`` urls are all taken. Crawls that are to be read
    whole do not call it.
    """
    head = urls.orderBy("page_id").limit(first)
    tail = urls.orderBy(c("page_id").desc()).limit(last)
    ends = head.unionByName(tail).select("page_id").distinct()  # at most first + last rows
    rest = urls.join(F.broadcast(ends), "page_id", "left_anti")
    picked = rest.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "url")), "page_id").limit(limit - first - last)
    return head.unionByName(picked).unionByName(tail).select("url").distinct()
