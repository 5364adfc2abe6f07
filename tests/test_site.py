from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stocklens.operators import keyed, site_pages as sp, site_rules as sr

HTML = """<html><head><title> Shop </title><meta name="description" content="d"><meta property="og:title" content="a">
<meta property="og:type" content="b"><meta property='og:url' content="c"><link rel="stylesheet" href="http://a.cz/s.css">
<link rel="shortcut icon" href="/f.ico"><link href="https://fonts.googleapis.com/x" rel="preload">
<script src="/x.js"></script><script async src="https://cdn.jsdelivr.net/y.js"></script><script src="https://evil.example/z.js"></script>
<script>var a = "<h1>no</h1><img src='no.png'>";</script></head><body><!-- <h1>no</h1> --><h1>One <b>x</b></h1><h3>t</h3><H1>Two</H1>
<img src="/p.png"><img src="q.png" alt=""><img data-src="/l.png" alt="ok" srcset="/m.png 1x, /n.png 2x"><img src="http://www.a.cz/i.png" alt=y>
<a href="/k">k</a><a href="#">text</a><a>none</a><a href='javascript:;'></a><a href="https://b.cz/e.pdf">e</a></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://a.cz/", HTML), (2, "https://a.cz/d/e", "<p>x")], "page_id long, url string, html string")


def test_features(pages):
    r = {x["page_id"]: x for x in sp.page_features(pages).collect()}[1]
    assert (r["title"], r["h1_count"], r["h1_texts"], r["headings"]) == ("Shop", 2, ["One x", "Two"], [1, 3, 1])
    assert r["images_without_alt"] == ["/p.png", "q.png"]
    assert r["empty_links"] == ["text -> #", "none -> [no href]", "[no text] -> javascript:;"]
    assert (r["js_files"], r["css_files"], r["blocking_scripts"], r["webfonts"]) == (3, 1, 2, 1)
    assert r["lazy_loading"] and r["has_favicon"] and r["has_og"] and not r["has_twitter"] and r["has_meta_description"]
    assert r["mixed_content"] == ["http://www.a.cz/i.png", "http://a.cz/s.css"]
    assert r["external_scripts"] == ["https://cdn.jsdelivr.net/y.js", "https://evil.example/z.js"]


def test_issues(pages):
    got = {(r["page_id"], r["type"], r["details"]) for r in sr.page_issues(sp.page_features(pages)).collect()}
    assert {(1, "duplicate_h1", "2: One x, Two"), (1, "heading_hierarchy", "h1 -> h3"), (1, "missing_alt", "2 images"),
            (1, "empty_link", "3 links"), (1, "render_blocking_script", "2 blocking scripts"), (1, "missing_twitter_cards", ""),
            (1, "mixed_content", "http://a.cz/s.css"), (1, "untrusted_scripts", "evil.example"),
            (2, "missing_h1", ""), (2, "missing_title", ""), (2, "missing_meta_description", "")} <= got
    assert not any(t == "missing_og_tags" for _, t, _ in got)


def test_links_and_images(pages):
    assert {r["link"] for r in sp.page_links(pages).collect()} == {"https://a.cz/k", "https://b.cz/e.pdf"}
    assert {r["image"] for r in sp.page_images(pages).collect()} == {
        "https://a.cz/p.png", "https://a.cz/q.png", "https://a.cz/m.png", "https://a.cz/n.png", "http://www.a.cz/i.png"}
    assert [r["link"] for r in sp.crawlable(sp.page_links(pages)).collect()] == ["https://a.cz/k"]


def test_link_checks(spark, pages):
    fetches = spark.createDataFrame([("https://a.cz/k", 404), ("https://b.cz/e.pdf", 0), ("https://a.cz/p.png", 404), ("https://a.cz/q.png", 200),
                                     ("https://a.cz/", 404)], "url string, status int")
    rows = sr.link_checks(sp.page_links(pages), sp.page_images(pages), pages, fetches).collect()
    assert {(r["type"], r["url"], r["details"]) for r in rows} == {
        ("page_404", "https://a.cz/", "404"), ("internal_link_404", "https://a.cz/k", "404"),
        ("external_link_404", "https://b.cz/e.pdf", "404"), ("broken_image", "https://a.cz/p.png", "404")}


def test_link_checks_of_targets_that_all_sites_share(spark, monkeypatch):
    """A url named by each of 200 sites is dealt over tasks; every site gets its row."""
    monkeypatch.setattr(keyed, "MIN_HOT_ROWS", 20)
    shared = [(i, f"https://s{i}.cz/", "https://cdn.example/x") for i in range(200)]
    links = spark.createDataFrame([*shared, *shared, (7, "https://s7.cz/", "https://own.example/y")], "page_id long, page_url string, link string")
    images = spark.createDataFrame([(i, u, "https://cdn.example/i.png") for i, u, _ in shared], "page_id long, page_url string, image string")
    pages = spark.createDataFrame([(i, u) for i, u, _ in shared], "page_id long, url string")
    fetches = spark.createDataFrame([("https://cdn.example/x", 0), ("https://own.example/y", 404), ("https://cdn.example/i.png", 404)],
                                    "url string, status int")
    found = sr.link_checks(links, images, pages, fetches)
    assert sorted((r["type"], r["site"], r["url"], r["page_id"]) for r in found.collect()) == sorted(
        [("external_link_404", f"https://s{i}.cz", "https://cdn.example/x", i) for i in range(200)]
        + [("external_link_404", "https://s7.cz", "https://own.example/y", 7)]
        + [("broken_image", f"https://s{i}.cz", "https://cdn.example/i.png", i) for i in range(200)])
    assert "_salt" in found._jdf.queryExecution().executedPlan().toString()
    assert sr.link_checks(links.filter("false"), images.filter("false"), pages, fetches).count() == 0


def _issue_rows(spark, n, details=""):
    return spark.createDataFrame([("s", "html", "missing_h1", "error", f"http://s/{i}/", i, details, None) for i in range(n)] +
                                 [("s", "html", "missing_h1", "error", "http://s/0", 0, details, None)],
                                 "site string, family string, type string, severity string, url string, page_id long, details string, source string")


def test_collapse(spark):
    scanned = spark.createDataFrame([("s", 10)], "site string, pages long")
    once = sr.collapse_repeated(_issue_rows(spark, 8), scanned)
    assert [(r["page_id"], r["details"]) for r in once.collect()] == [(0, "[on 8 pages]")]
    assert sr.collapse_repeated(once, scanned).count() == 1
    assert sr.collapse_repeated(_issue_rows(spark, 7), scanned).count() == 7


def test_link_rows_are_not_collapsed(spark):
    links = spark.createDataFrame([("s", "links", "internal_link_404", "error", f"http://s/x{i}", i // 2, "404", f"http://s/{i // 2}") for i in range(6)],
                                  _issue_rows(spark, 1).schema)
    scanned = spark.createDataFrame([("s", 5)], "site string, pages long")
    kept = sr.collapse_repeated(links.unionByName(_issue_rows(spark, 5)), scanned)
    assert sorted(r["url"] for r in kept.filter("family = 'links'").collect()) == [f"http://s/x{i}" for i in range(6)]
    assert kept.filter("family = 'html'").count() == 1
    assert sr.site_scores(kept, scanned).first()["links"] == 70


def test_one_row_per_collapsed_signature(spark):
    rows = spark.createDataFrame([("s", "html", "t", "error", u, i, "", None) for i, u in ((1, "http://s/b"), (1, "http://s/a"), (2, "http://s/c"), (3, "http://s/d"))],
                                 _issue_rows(spark, 1).schema)
    got = sr.collapse_repeated(rows, spark.createDataFrame([("s", 4)], "site string, pages long")).collect()
    assert [(r["url"], r["details"]) for r in got] == [("http://s/a", "[on 4 pages]")]


def test_lists_are_complete(spark):
    html = "<h1>x</h1>" + "".join(f'<img src="/{i}-{"p" * 120}.png"><a href="#">{"t" * 60}{i}</a>' for i in range(40)) + "<img>"
    pages = spark.createDataFrame([(1, "https://a.cz/", html)], "page_id long, url string, html string")
    r = sp.page_features(pages).first()
    assert r["images_without_alt_count"] == 41 and len(r["images_without_alt"]) == 40 and len(r["empty_links"]) == 40
    assert r["images_without_alt"][39] == f"/39-{'p' * 120}.png" and r["empty_links"][39] == "t" * 60 + "39 -> #"
    details = {(x["type"], x["details"]) for x in sr.page_issues(sp.page_features(pages)).collect()}
    assert {("missing_alt", "41 images"), ("empty_link", "40 links")} <= details


def test_scores_and_summary(spark):
    issues = _issue_rows(spark, 8)
    sites = spark.createDataFrame([("s",), ("t",)], "site string")
    got = {r["site"]: r for r in sr.site_scores(issues, sites).collect()}
    assert got["s"]["html"] == 10 and got["s"]["overall"] == 82 and got["t"]["overall"] == 100
    s = sr.issue_summary(issues).first()
    assert s["issues"] == 9 and len(s["examples"]) == 5


def test_site_level_checks(spark):
    robots = spark.createDataFrame([("a", 404, None), ("b", 200, "User-Agent: *"), ("c", 200, "user-agent: *\nSitemap: x")], "site string, status int, content string")
    assert {(r["site"], r["type"], r["details"]) for r in sr.robots_issues(robots).collect()} == {
        ("a", "missing_robots", "status 404"), ("b", "invalid_robots", "no sitemap line")}
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site string")
    files = spark.createDataFrame([
        ("a", 200, "<urlset><url><lastmod>2024-01-25</lastmod></url></urlset>"), ("b", 200, "<urlset><lastmod> 2024-01-20 </lastmod><lastmod>2024-01-01</lastmod></urlset>"),
        ("c", 404, "<urlset/>"), ("d", 200, "<urlset></urlset>"), ("e", 200, "<sitemapindex><sitemap><lastmod>2024-01-11</lastmod></sitemap></sitemapindex>")],
        "site string, status int, xml string")
    sites = spark.createDataFrame([(x,) for x in "abcdef"], "site string")
    assert {(r["site"], r["type"], r["details"]) for r in sr.sitemap_issues(sites, files, datetime(2024, 2, 1)).collect()} == {
        ("b", "outdated_sitemap", "12 days"), ("e", "outdated_sitemap", "21 days"), ("c", "missing_sitemap", ""), ("f", "missing_sitemap", "")}
    probes = spark.createDataFrame([("http://a", 200, None), ("https://b", 301, "https://b/"), ("https://c", 302, "http://c"), ("https://d", 0, None)],
                                   "site string, status int, location string")
    assert {(r["site"], r["severity"]) for r in sr.https_issues(probes).collect()} == {("http://a", "error"), ("https://c", "warning")}


def test_trust(spark):
    sites = spark.createDataFrame([("http://a",), ("http://b",)], "site string")
    fetches = spark.createDataFrame([("http://a/kontakt", 200), ("http://a/vop", 200), ("http://a/gdpr", 404)], "url string, status int")
    home = spark.createDataFrame([("http://a", "<footer>Copyright 2022</footer> me@x.cz IČO: 12345678")], "site string, html string")
    got = {r["site"]: r for r in sr.trust_analysis(sites, fetches, home, 2024).collect()}
    assert got["http://a"]["trust_score"] == 100 - 10 - 10 - 5 and got["http://a"]["copyright_year"] == 2022
    assert got["http://b"]["trust_score"] == 100 - 20 - 20 - 10 - 10 - 15 - 10
    issues = {(r["site"], r["type"]) for r in sr.trust_issues(sr.trust_analysis(sites, fetches, home, 2024)).collect()}
    assert ("http://a", "outdated_copyright") in issues and ("http://b", "missing_terms") in issues


def test_script_class_order(spark):
    df = spark.createDataFrame([("https://cdn.shoptet.cz/google.js",), ("x/user/a",), ("y",)], "s string")
    assert [r[0] for r in df.select(sr.script_class(F.col("s"))).collect()] == ["shoptet", "custom", "other"]


def test_page_sample(spark):
    urls = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"))
    picked = {r["url"] for r in sp.sample_pages(urls, "s").collect()}
    assert len(picked) == 500 and {f"u{i}" for i in range(100)} <= picked and {f"u{i}" for i in range(950, 1000)} <= picked
    assert picked == {r["url"] for r in sp.sample_pages(urls, "s").collect()}


def test_summary_finds_issues_once(spark):
    """The issues are counted and ranked from one written table, so what finds them does not run twice."""
    issues = spark.range(40).selectExpr("'s' as site", "if(id % 4 = 0, 'html', 'links') as family", "id as page_id", "'t' as type",
                                        "concat('u', id) as url", "'' as details", "'error' as severity")
    found = sr.issue_summary(issues)
    assert "Range" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["family"], r["issues"], tuple(r["examples"])) for r in found.collect()} == {
        ("html", 10, ("t u0", "t u4", "t u8", "t u12", "t u16")), ("links", 30, ("t u1", "t u2", "t u3", "t u5", "t u6"))}
