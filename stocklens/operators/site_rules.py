"""Rules, link checks, trust checks and scores of crawled sites (one site = one origin)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions import text as tx, url as ur
from stocklens.functions.values import days_between, round_half_up
from stocklens.operators.keyed import attach_groups, spread_join
from stocklens.operators.site_pages import clean_html, element_texts
from stocklens.session import materialise

c = F.col
ERROR, WARNING = "error", "warning"
SITE_COLUMNS = ["site", "family", "type", "severity", "url", "page_id", "details", "source"]

# Hosts whose scripts are trusted.
TRUSTED_DOMAINS = ["googleapis.com", "gstatic.com", "google.com", "googletagmanager.com", "google-analytics.com",
                   "facebook.net", "facebook.com", "cloudflare.com", "cloudflareinsights.com", "jquery.com",
                   "jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com", "shoptet.cz"]
# Classes of script sources, first match wins.
SCRIPT_CLASSES = {
    "shoptet": ["shoptet", "cdn.shoptet"],
    "trusted": ["google", "facebook", "fbcdn", "cloudflare", "jsdelivr", "cdnjs", "unpkg", "jquery", "bootstrap"],
    "custom": ["ftp", "/user/", "/custom/"],
}
# Paths of the pages a shop should have.
TRUST_PATHS = {
    "contact": ["/kontakt", "/contact", "/kontakty", "/contacts", "/kontakt.html"],
    "terms": ["/obchodni-podminky", "/terms", "/vseobecne-obchodni-podminky", "/vop", "/terms-and-conditions"],
    "privacy": ["/ochrana-osobnich-udaju", "/privacy", "/gdpr", "/privacy-policy", "/zasady-ochrany-osobnich-udaju"],
    "shipping": ["/doprava", "/doprava-a-platba", "/shipping", "/delivery", "/doprava-platba"],
}
TRUST_ISSUES = {"contact": ("missing_contact_page", ERROR), "terms": ("missing_terms", ERROR),
                "privacy": ("missing_privacy_policy", WARNING), "shipping": ("missing_shipping_info", WARNING)}
FAVICON_PATHS = ["/favicon.ico", "/favicon.png", "/apple-touch-icon.png"]
# Signs of contact data in a page.
PHONE_PATTERN = r"(\+?\d{3}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3})|(\d{3}[\s-]?\d{3}[\s-]?\d{3})"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
COMPANY_PATTERN = r"ičo?:?\s*[0-9]{8}|dič:?\s*[a-z]{2}[0-9]+"
ADDRESS_WORDS = ["ulice", "ul.", "street", "adresa", "sídlo", "psč", "zip"]
COPYRIGHT_PATTERN = r"(?:©|copyright)\s*([0-9]{4})"
# Points per error and per warning.
SITE_PENALTIES = {"performance": (10, 3), "html": (10, 3), "config": (15, 5), "security": (20, 5)}


def skipped_heading(headings: Column) -> Column:
    """``h1 -> h3`` at the first skipped level, else NULL."""
    pairs = F.arrays_zip(F.slice(headings, F.lit(1), F.greatest(F.size(headings) - 1, F.lit(0))).alias("a"),
                         F.slice(headings, F.lit(2), F.greatest(F.size(headings) - 1, F.lit(0))).alias("b"))
    skips = F.filter(pairs, lambda p: p["b"] > p["a"] + 1)
    first = F.get(skips, F.lit(0))
    return F.concat(F.lit("h"), first["a"].cast("string"), F.lit(" -> h"), first["b"].cast("string"))


def is_trusted_host(host: Column) -> Column:
    return reduce(or_, [(host == t) | host.endswith(f".{t}") for t in TRUSTED_DOMAINS])


def page_issues(features: DataFrame) -> DataFrame:
    """Every rule over one scan of the features; resource rules give one row per resource."""
    n = lambda x, s: F.concat(x.cast("string"), F.lit(s))
    no_alt, no_target = c("images_without_alt_count"), F.size("empty_links")
    home = c("url").rlike(r"^https?://[^/?#]+/?$")
    skip = skipped_heading(c("headings"))
    rules = [
        ("performance", "too_many_js", WARNING, c("js_files") > 10, n(c("js_files"), " scripts")),
        ("performance", "too_many_css", WARNING, c("css_files") > 5, n(c("css_files"), " stylesheets")),
        ("performance", "render_blocking_script", WARNING, c("blocking_scripts") > 0, n(c("blocking_scripts"), " blocking scripts")),
        ("performance", "too_many_webfonts", WARNING, c("webfonts") > 3, n(c("webfonts"), " webfonts")),
        ("performance", "missing_lazy_loading", WARNING, ~c("lazy_loading") & (no_alt > 5), F.lit("")),
        ("performance", "large_page_size", WARNING, c("page_size") > 500000,
         n(round_half_up(c("page_size") / 1024), "KB")),
        ("html", "missing_h1", ERROR, c("h1_count") == 0, F.lit("")),
        ("html", "duplicate_h1", WARNING, c("h1_count") > 1,
         F.concat(n(c("h1_count"), ": "), F.array_join("h1_texts", ", "))),
        ("html", "heading_hierarchy", WARNING, skip.isNotNull(), skip),
        ("html", "missing_alt", WARNING, no_alt > 0, n(no_alt, " images")),
        ("html", "empty_link", WARNING, no_target > 0, n(no_target, " links")),
        ("html", "missing_meta_description", WARNING, ~c("has_meta_description"), F.lit("")),
        ("html", "missing_title", ERROR, c("title").isNull(), F.lit("")),
        ("config", "missing_og_tags", WARNING, home & ~c("has_og"), F.lit("")),
        ("config", "missing_twitter_cards", WARNING, home & ~c("has_twitter"), F.lit("")),
    ]
    row = lambda f, t, s, det, src: F.struct(F.lit(f).alias("family"), F.lit(t).alias("type"),
                                             F.lit(s).alias("severity"), det.alias("details"), src.alias("source"))
    none = F.lit(None).cast("string")
    single = F.array_compact(F.array(*[F.when(cond, row(f, t, s, det, none)) for f, t, s, cond, det in rules]))
    mixed = F.transform("mixed_content", lambda u: row("security", "mixed_content", ERROR, u, u))
    foreign = F.transform(F.filter("external_scripts", lambda u: ~is_trusted_host(ur.hostname(u))),
                          lambda u: row("security", "untrusted_scripts", WARNING, ur.hostname(u), u))
    marked = features.select(c("origin").alias("site"), "url", "page_id", F.concat(single, mixed, foreign).alias("_i"))
    return marked.select("site", "url", "page_id", F.inline_outer("_i")).filter(c("type").isNotNull()).select(*SITE_COLUMNS)


def link_checks(links: DataFrame, images: DataFrame, pages: DataFrame, fetches: DataFrame) -> DataFrame:
    """Broken pages, internal and external links, images, once per site and target.

    Each target is checked once; its source is the first page that names it. Internal links to
    scanned pages are left out. A missing answer (0) is reported as 404.
    """
    def targets(found: DataFrame, col: str) -> DataFrame:
        return found.groupBy(ur.origin(c("page_url")).alias("site"), c(col).alias("url")).agg(
            F.min("page_id").alias("page_id"), F.min_by("page_url", "page_id").alias("source"))

    status = fetches.select("url", "status")
    external = ur.is_external(c("url"), c("site"))
    kind = F.when(external, "external_link_404").when(~external, "internal_link_404")
    named = materialise(targets(links, "link").withColumn("kind", kind).unionByName(
        targets(images, "image").withColumn("kind", F.lit("broken_image"))))
    scanned = pages.select("url").distinct()
    internal = named.filter("kind = 'internal_link_404'").join(scanned, "url", "left_anti").join(status.filter("status = 404"), "url")
    # a url that very many sites name is checked in as many tasks as the number of its rows asks for
    silent = spread_join(named.filter("kind <> 'internal_link_404'"), status.filter("status in (0, 404)"), "url", c("site"))
    broken = pages.select(ur.origin(c("url")).alias("site"), "url", "page_id", F.lit(None).cast("string").alias("source")).join(
        status.filter("status = 404"), "url").withColumn("kind", F.lit("page_404"))
    columns = ["site", "url", "page_id", "source", "status", "kind"]
    found = broken.select(*columns).unionByName(internal.select(*columns)).unionByName(silent.select(*columns))
    return found.select(
        "site", F.lit("links").alias("family"), c("kind").alias("type"), F.lit(ERROR).alias("severity"), "url", "page_id",
        F.when(c("status") == 0, 404).otherwise(c("status")).cast("string").alias("details"), "source")


def robots_issues(robots: DataFrame) -> DataFrame:
    """X13 on (site, status, content); a missing file has another status than 200."""
    low = F.lower(tx.text(c("content")))
    ok = c("status") == 200
    rule = lambda cond, t, det: F.when(cond, F.struct(F.lit(t).alias("type"), det.alias("details")))
    found = F.array_compact(F.array(
        rule(~ok, "missing_robots", F.concat(F.lit("status "), c("status").cast("string"))),
        rule(ok & ~low.contains("user-agent"), "invalid_robots", F.lit("no user-agent line")),
        rule(ok & ~low.contains("sitemap"), "invalid_robots", F.lit("no sitemap line"))))
    return _site_rows(robots.select("site", F.inline(found)), "config", WARNING, F.concat(c("site"), F.lit("/robots.txt")))


def sitemap_issues(sites: DataFrame, documents: DataFrame, as_of: datetime) -> DataFrame:
    """Sites without a sitemap, and sitemaps whose newest date is over seven days old.

    ``documents`` has (site, status, xml) of the fetched sitemap files. A site whose file was fetched (status 2xx) has a
    sitemap, even one that lists nothing; dates count wherever they stand in it, also in an index.
    """
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    dates = F.regexp_extract_all("xml", F.lit(r"(?i)<(?:\w+:)?lastmod(?:\s[^>]*)?>([^<]*)</"), F.lit(1))
    newest = documents.filter("status between 200 and 299").groupBy("site").agg(
        F.max(F.array_max(F.transform(dates, tx.trim_ws))).alias("newest"))
    age = days_between(now, c("newest").try_cast("timestamp"))
    joined = sites.join(newest.withColumn("known", F.lit(True)), "site", "left")
    missing = joined.filter("known is null").select("site", F.lit("missing_sitemap").alias("type"), F.lit("").alias("details"))
    old = joined.filter(age > 7).select("site", F.lit("outdated_sitemap").alias("type"),
                                        F.concat(F.floor(age).cast("string"), F.lit(" days")).alias("details"))
    return _site_rows(missing, "config", ERROR, c("site")).unionByName(_site_rows(old, "config", WARNING, c("site")))


def favicon_issues(sites: DataFrame, fetches: DataFrame) -> DataFrame:
    """None of the usual icon paths was fetched successfully."""
    paths = F.explode(F.array(*[F.lit(p) for p in FAVICON_PATHS]))
    wanted = sites.select("site", paths.alias("path")).select("site", F.concat("site", "path").alias("url"))
    found = wanted.join(fetches.filter("status between 200 and 299"), "url").select("site").distinct()
    return _site_rows(sites.join(found, "site", "left_anti").select(
        "site", F.lit("missing_favicon").alias("type"), F.lit("").alias("details")), "config", WARNING,
        F.concat(c("site"), F.lit("/favicon.ico")))


def https_issues(probes: DataFrame) -> DataFrame:
    """X15 on (site, status, location) of the http address; no answer (status 0) says nothing."""
    good = c("status").between(300, 399) & F.coalesce(c("location").startswith("https://"), F.lit(False))
    bad = probes.filter((c("status") != 0) & ~good).select(
        "site", F.lit("no_https_redirect").alias("type"), F.lit("").alias("details"))
    plain = _site_rows(bad.filter(c("site").startswith("http://")), "security", ERROR, c("site"))
    return plain.unionByName(_site_rows(bad.filter(~c("site").startswith("http://")), "security", WARNING, c("site")))


def _site_rows(df: DataFrame, family: str, severity: str, url: Column) -> DataFrame:
    return df.select("site", F.lit(family).alias("family"), "type", F.lit(severity).alias("severity"), url.alias("url"),
                     F.lit(None).cast("bigint").alias("page_id"), "details", F.lit(None).cast("string").alias("source"))


def script_classes(features: DataFrame) -> DataFrame:
    """External scripts by class of source."""
    scripts = features.select(F.explode_outer("external_scripts").alias("src")).filter(c("src").isNotNull())
    return scripts.groupBy(script_class(c("src")).alias("source_class")).agg(F.count(F.lit(1)).alias("scripts"))


def script_class(src: Column) -> Column:
    low = F.lower(tx.text(src))
    out = None
    for name, needles in SCRIPT_CLASSES.items():
        hit = reduce(or_, [low.contains(x) for x in needles])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def collapse_repeated(issues: DataFrame, scanned_pages: DataFrame) -> DataFrame:
    """A10: one row per signature and normalised URL; a signature on more than 70 % of a site's
    pages (and more than two pages) keeps its first row, marked with the number of pages. Link rows are
    facts about single targets and stay as they are.

    ``scanned_pages`` has (site, pages).
    """
    links = issues.filter(c("family") == "links").select(*SITE_COLUMNS)
    rows = issues.filter(c("family") != "links").withColumns({
        "sig": F.concat_ws(":", "type", F.coalesce("details", F.lit(""))),
        "norm": F.coalesce(ur.normalize_page_url(c("url")), F.lit(""))})
    key = F.concat_ws("\u0001", "site", "sig")
    first = rows.groupBy("site", "sig", "norm").agg(F.min_by(
        F.struct("family", "type", "severity", "url", "page_id", "details", "source"),
        F.struct(F.coalesce("page_id", F.lit(-1)), "url")).alias("i"))
    single = first.select("site", key.alias("k"), "sig", "norm", "i.*")
    sigs = materialise(single.groupBy("k").agg(
        F.min("site").alias("site"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.coalesce("page_id", F.lit(-1)).alias("p"), "norm")).alias("first_row")).join(
        scanned_pages, "site", "left").select("k", "n", "first_row", (
            (c("n") > c("pages") * 0.7) & (c("pages") > 2)).alias("collapse")))
    joined = attach_groups(single, sigs, "k", "n")
    first_row = (F.coalesce("page_id", F.lit(-1)) == c("first_row.p")) & (c("norm") == c("first_row.norm"))
    keep = ~F.coalesce("collapse", F.lit(False)) | first_row
    text = F.when(c("collapse"), tx.trim_ws(F.concat("details", F.lit(" [on "), c("n").cast("string"), F.lit(" pages]")))
                  ).otherwise(c("details"))
    return joined.filter(keep).withColumn("details", text).select(*SITE_COLUMNS).unionByName(links)


def site_scores(issues: DataFrame, sites: DataFrame) -> DataFrame:
    """Five scores and their mean, one row per site."""
    n = lambda f, s: F.count_if((c("family") == f) & (c("severity") == s))
    per = issues.groupBy("site").agg(
        F.count_if(c("family") == "links").alias("links_n"),
        *[n(f, s).alias(f"{f}_{s}") for f in SITE_PENALTIES for s in (ERROR, WARNING)])
    joined = sites.select("site").join(per, "site", "left").fillna(0)
    scores = {"links": F.greatest(F.lit(0), F.lit(100) - c("links_n") * 5)}
    for f, (e, w) in SITE_PENALTIES.items():
        scores[f] = F.greatest(F.lit(0), F.lit(100) - c(f"{f}_{ERROR}") * e - c(f"{f}_{WARNING}") * w)
    scored = joined.select("site", *[v.cast("int").alias(k) for k, v in scores.items()])
    return scored.withColumn("overall", round_half_up(sum(c(k) for k in scores) / F.lit(5.0)).cast("int"))


def issue_summary(issues: DataFrame, first: int = 5) -> DataFrame:
    """Per site and family the number of issues and the first five (a top-k, cut early).

    The issues are written first: they are read twice, and finding them is the costly part.
    """
    issues = materialise(issues.select("site", "family", "page_id", "type", "url", "details"))
    w = Window.partitionBy("site", "family").orderBy(F.coalesce("page_id", F.lit(-1)), "type", "url", "details")
    top = issues.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= first).groupBy("site", "family").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "type", "url"))),
                    lambda x: F.concat(x["type"], F.lit(" "), x["url"])).alias("examples"))
    return issues.groupBy("site", "family").agg(F.count(F.lit(1)).alias("issues")).join(top, ["site", "family"])


def trust_analysis(sites: DataFrame, fetches: DataFrame, homepages: DataFrame, year: int) -> DataFrame:
    """One row per site. ``homepages`` has (site, html)."""
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("path"))
                                 for k, ps in TRUST_PATHS.items() for p in ps]))
    probes = sites.select("site", wanted.alias("w")).select("site", "w.kind", F.concat("site", "w.path").alias("url"))
    present = probes.join(fetches.filter("status between 200 and 299").select("url"), "url", "left_semi").groupBy("site").agg(
        *[F.max((c("kind") == k).cast("int")).alias(f"has_{k}") for k in TRUST_PATHS])
    html = tx.text(c("html"))
    low = F.lower(html)
    footer = F.lower(F.array_join(element_texts(clean_html(html), "footer"), ""))
    texts = homepages.select(
        "site", F.nullif(F.regexp_extract(footer, COPYRIGHT_PATTERN, 1), F.lit("")).cast("int").alias("copyright_year"),
        html.rlike(PHONE_PATTERN).alias("has_phone"), html.rlike(EMAIL_PATTERN).alias("has_email"),
        reduce(or_, [low.contains(w) for w in ADDRESS_WORDS]).alias("has_address"),
        low.rlike(COMPANY_PATTERN).alias("has_company"))
    flags = [f"has_{k}" for k in TRUST_PATHS]
    joined = sites.select("site").join(present, "site", "left").join(texts, "site", "left")
    out = joined.select(
        "site", *[(F.coalesce(f, F.lit(0)) == 1).alias(f) for f in flags],
        (F.coalesce("has_shipping", F.lit(0)) == 1).alias("has_payment"), "copyright_year",  # the shipping pages tell both
        *[F.coalesce(f, F.lit(False)).alias(f) for f in ("has_phone", "has_email", "has_address", "has_company")])
    stale = F.coalesce(c("copyright_year") < year - 1, F.lit(False))
    off = lambda cond, points: F.when(cond, points).otherwise(0)
    score = (F.lit(100) - off(~c("has_contact"), 20) - off(~c("has_terms"), 20) - off(~c("has_privacy"), 10)
             - off(~c("has_shipping"), 10) - off(~c("has_phone") & ~c("has_email"), 15) - off(~c("has_company"), 10) - off(stale, 5))
    return out.withColumn("stale_copyright", stale).withColumn("trust_score", F.greatest(F.lit(0), score))


def trust_issues(analysis: DataFrame) -> DataFrame:
    """Issues of :func:`trust_analysis`."""
    rows = [(~c(f"has_{k}"), t, s) for k, (t, s) in TRUST_ISSUES.items()]
    rows += [(c("stale_copyright"), "outdated_copyright", WARNING),
             (~c("has_phone") & ~c("has_email"), "missing_contact_info", WARNING),
             (~c("has_company"), "missing_company_info", WARNING)]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity")))
                                      for cond, t, s in rows]))
    return analysis.select("site", F.inline(found))
