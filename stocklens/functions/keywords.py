"""Keywords, light stemming and category predicates used by the category mapping."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocklens.functions.text import WS, naive_normalize, normalize_text, text

# Words without meaning for a category.
STOP_WORDS = ["pro", "pod", "nad", "pri", "pre", "the", "and", "for", "with", "von", "zur",
              "bio", "pure", "muud", "original", "premium", "new", "top", "best",
              "sale", "akce", "sleva", "novinka", "hit"]
# Words that count little.
WEAK_WORDS = ["set", "sada", "system", "systém", "komplet", "big", "boy", "flow",
              "series", "line", "typ", "type", "model", "edition", "verze", "version",
              "pack", "kit", "bundle", "collection", "kolekce"]
# Endings cut from a word, first match wins.
SUFFIXES = ["ova", "ove", "ovy", "ovou", "ky", "ka", "ek", "ko", "ku", "kem",
            "ami", "emi", "ach", "ich", "ech", "um", "em", "im", "ym",
            "ou", "ovi", "ni", "ny", "ne", "na"]
# Seasonal and marketing categories (on lower-cased text).
SEASONAL_PATTERNS = [
    "v[aá]no[cč]", "velikon", rf"black{WS}*friday", "v[yý]prodej", "akce([^a-z0-9_]|$)", "slev[ay]",
    "halloween", "valent[yý]n", "sez[oó]n", "novink", rf"tipy{WS}+na", rf"d[aá]rky{WS}+(pro|k)",
    "bestseller", "doporu[cč]",
]
SEASONAL_EMOJI = r"[\x{1F000}-\x{1FBFF}\x{2600}\x{2744}\x{FE0F}]"
# Names of services and vouchers.
NON_PRODUCT = ["dýško", "dysko", "spropitné", "tip", "seminář", "seminar", "workshop", "kurz",
               "školení", "skoleni", "poukaz", "voucher", "gift card", "dárková karta",
               "služba", "sluzba", "service", "servis", "konzultace", "poradenství"]
# Spare parts and accessories.
ACCESSORY = ["příslušenství", "prislusenstvi", "doplňky", "doplnky", "náhradní", "nahradni",
             "díl", "dil", "díly", "dily", "součást", "soucast", "adapter", "adaptér",
             "kabel", "obal", "pouzdro", "kryt", "holder", "accessories", "spare", "parts",
             "replacement"]


def _contains_any(c: Column, phrases: list[str]) -> Column:
    wanted = list(dict.fromkeys(naive_normalize(p) for p in phrases))
    return reduce(or_, [c.contains(p) for p in wanted])


def base_code(code: Column) -> Column:
    """P14 for the mapping: ``75/RUZ2`` gives ``75``; NULL without a variant part."""
    return F.nullif(F.regexp_extract(code, r"^([^/\-]+)[/\-].+$", 1), F.lit(""))


def audit_base_code(code: Column) -> Column:
    """P14 for the variant-group test: text before the first ``/ - _``."""
    return F.nullif(F.regexp_extract(code, r"^(.+?)[/\-_](.+)$", 1), F.lit(""))


def keyword_tokens(c: Column) -> Column:
    """All keywords of a text, duplicates kept."""
    return F.filter(F.split(normalize_text(c), " "),
                    lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))


def is_weak(word: Column) -> Column:
    return word.isin(WEAK_WORDS) | (F.length(word) < 3)


def strong_keywords(c: Column) -> Column:
    return F.filter(keyword_tokens(c), lambda w: ~is_weak(w))


def weak_keywords(c: Column) -> Column:
    return F.filter(keyword_tokens(c), is_weak)


def stem(word: Column) -> Column:
    """Cuts the first listed ending that leaves more than two letters."""
    out = None
    for s in SUFFIXES:
        hit = (F.length(word) > len(s) + 2) & word.endswith(s)
        cut = F.left(word, F.length(word) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(word)


def words_match(a: Column, b: Column, stem_a: Column, stem_b: Column) -> Column:
    """Equal, equal stems, or one long stem inside the other."""
    return ((a == b) | (stem_a == stem_b)
            | ((F.length(stem_a) >= 4) & (F.length(stem_b) >= 4)
               & (stem_a.contains(stem_b) | stem_b.contains(stem_a))))


def is_seasonal(path: Column) -> Column:
    """Seasonal or marketing category, never a mapping target."""
    low = F.lower(text(path))
    return text(path).rlike(SEASONAL_EMOJI) | low.rlike("|".join(f"({p})" for p in SEASONAL_PATTERNS))


def is_non_product(name: Column) -> Column:
    return _contains_any(normalize_text(name), NON_PRODUCT)


def is_accessory(normalized: Column) -> Column:
    return _contains_any(normalized, ACCESSORY)
