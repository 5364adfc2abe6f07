"""Sitemap documents that were fetched before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.text import trim_ws

c = F.col


def _plain(xml):
    """Without namespace declarations, so that element names can be addressed as they are."""
    return F.regexp_replace(xml, r"""\sxmlns(:[a-z]+)?\s*=\s*("[^"]*"|'[^']*')""", "")


def sitemap_entries(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Every url entry of each document: the document's columns plus loc and lastmod."""
    kept = [x for x in docs.columns if x != xml]
    rows = docs.select(*kept, _plain(c(xml)).alias("_x"))
    # one path per field; an entry without lastmod must not shift the others, hence per entry
    entries = F.regexp_extract_all("_x", F.lit(r"<url>([\s\S]*?)</url>"), F.lit(1))
    one = lambda e, tag: F.nullif(trim_ws(F.replace(F.regexp_extract(
        e, rf"<{tag}>([\s\S]*?)</{tag}>", 1), F.lit("&amp;"), F.lit("&"))), F.lit(""))
    found = rows.select(*kept, F.explode_outer(entries).alias("_e"))
    return found.select(*kept, one(c("_e"), "loc").alias("loc"), one(c("_e"), "lastmod").alias("lastmod")).filter(
        c("loc").isNotNull())


def index_entries(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """The sitemaps that index documents list."""
    kept = [x for x in docs.columns if x != xml]
    locs = F.xpath(_plain(c(xml)), F.lit("//sitemap/loc/text()"))
    return docs.select(*kept, F.explode(locs).alias("_l")).select(*kept, trim_ws(c("_l")).alias("sitemap_url"))


def expand_indexes(indexes: DataFrame, documents: DataFrame) -> DataFrame:
    """One level of index files: (site, xml) of the listed documents that were fetched.

    ``documents`` has (url, xml).
    """
    listed = index_entries(indexes)
    return listed.join(documents.select(c("url").alias("sitemap_url"), c("xml")), "sitemap_url").select(
        *[x for x in listed.columns if x != "sitemap_url"], "xml")
