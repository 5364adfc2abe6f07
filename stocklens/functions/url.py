"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Links that are never fetched.
SKIPPED_SCHEMES = ["javascript:", "mailto:", "tel:", "#", "data:"]
# File endings that are not pages.
ASSET_PATTERN = r"\.(jpg|jpeg|png|gif|svg|pdf|zip|css|js|xml|ico|webp)$"


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` in lower case without a default port; '' when there is none."""
    raw = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#\\]+)", 1))
    return F.regexp_replace(F.regexp_replace(raw, "^(http://[^:]+):80$", "$1"),
                            "^(https://[^:]+):443$", "$1")


def host(url: Column) -> Column:
    """Host with a non-default port; '' when there is none."""
    return F.regexp_replace(origin(url), "^[a-z]+://([^@]*@)?", "")


def hostname(url: Column) -> Column:
    """Host without port."""
    return F.regexp_replace(host(url), ":[0-9]+$", "")


def _fold_dots(path: Column) -> Column:
    """Resolves ``.`` and ``..`` in an absolute path."""
    parts = F.split(path, "/")
    closing = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(p))))
    joined = F.array_join(kept, "/")
    return F.when(closing & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve_url(href: Column, page_url: Column) -> Column:
    """P25: absolute form of a link found on a page, NULL when it leads to no page."""
    skip = F.lit(False)
    for s in SKIPPED_SCHEMES:
        skip = skip | href.startswith(s)
    base = F.regexp_extract(page_url, r"^(.*/)", 1)  # greedy: up to the last slash
    base_path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+(/.*)$", 1)
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    relative = F.when(base_path == "", F.lit(None).cast("string")).when(
        target == "", F.concat(base, tail)).otherwise(
        F.concat(origin(page_url), _fold_dots(F.concat(base_path, target)),
                 F.replace(tail, F.lit(" "), F.lit("%20"))))
    return (F.when(skip, F.lit(None).cast("string"))
            .when(href.startswith("http://") | href.startswith("https://"), href)
            .when(href.startswith("//"), F.concat(F.lit("https:"), href))
            .when(href.startswith("/"), F.concat(origin(page_url), href))
            .otherwise(relative))


def is_external(url: Column, site_url: Column) -> Column:
    """Another host (port included); false when either has no host."""
    a, b = host(url), host(site_url)
    return F.when((a == "") | (b == ""), F.lit(False)).otherwise(a != b)


def is_asset(url: Column) -> Column:
    return F.lower(url).rlike(ASSET_PATTERN)


def normalize_page_url(url: Column) -> Column:
    """One spelling per page: no default port, no closing slash except at the root."""
    u = F.regexp_replace(url, r"^(https://[^/?#:]+):443([/?#].*)?$", "$1$2")
    u = F.regexp_replace(u, r"^(http://[^/?#:]+):80([/?#].*)?$", "$1$2")
    u = F.regexp_replace(u, r"^(https?://[^/?#]+)([?#].*)?$", "$1/$2")
    return F.regexp_replace(u, r"^(https?://[^/?#]+/[^?#]*)/([?#].*)?$", "$1$2")


def complete_site_url(typed: Column) -> Column:
    """A site name as typed becomes a URL with https and www."""
    t = F.trim(typed)
    has_scheme = t.startswith("http://") | t.startswith("https://")
    bare = F.concat(F.lit("https://"), F.when(t.startswith("www."), t).otherwise(F.concat(F.lit("www."), t)))
    name = hostname(t)
    two_labels = (F.size(F.split(name, r"\.")) == 2) & ~name.contains("localhost") & ~name.startswith("www.")
    with_www = normalize_root(F.regexp_replace(t, "^(https?://)", "$1www."))
    return F.when(~has_scheme, bare).when(two_labels, with_www).otherwise(t)


def normalize_root(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?://[^/?#]+)([?#].*)?$", "$1/$2")
