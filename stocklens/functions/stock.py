"""Availability texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocklens.functions.text import text

# Phrases looked for in lower-cased availability texts.
IN_STOCK = ["skladem", "stock", "ihned", "dostupn", "k dispozici"]
OUT_OF_STOCK = ["vyprodán", "sold out", "nedostupn", "není skladem", "na objednávku"]
ON_INQUIRY = ["dotaz", "inquiry", "na objednávku"]
DELIVERABLE = ["skladem", "stock", "dostupn"]


def mentions(c: Column, phrases: list[str]) -> Column:
    low = F.lower(text(c))
    return reduce(or_, [low.contains(p) for p in phrases])


def says_in_stock(c: Column) -> Column:
    return mentions(c, IN_STOCK)


def says_out_of_stock(c: Column) -> Column:
    return mentions(c, OUT_OF_STOCK)
