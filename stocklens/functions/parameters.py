"""Spelling rules for extracted product parameters (P29) and source texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocklens.functions.text import text, trim_ws

# Word endings of common Czech words (not names).
COMMON_ENDINGS = ["á", "é", "í", "ý", "ová", "ový", "ná", "ný", "ka", "ko", "na", "no"]
# Value beginnings that keep their capitals.
KEPT_BEGINNINGS = [
    "CD", "DVD", "BD", "Blu-ray", "VHS", "LP", "EP",
    "USB", "HDMI", "LED", "LCD", "OLED", "WiFi", "Bluetooth", "HD", "4K", "UHD", "MP3", "AAC", "FLAC",
    "BIO", "ISO", "CE", "EU", "USA", "ČR",
    "Česká republika", "Francie", "Itálie", "Španělsko", "Německo", "Rakousko", "Polsko",
    "Maďarsko", "Slovensko", "Morava", "Čechy", "Praha", "Brno",
]
# Spelling of acronyms, applied in this order.
ACRONYMS = {
    "dvd": "DVD", "cd": "CD", "bd": "BD", "usb": "USB", "hdmi": "HDMI", "led": "LED",
    "lcd": "LCD", "oled": "OLED", "4k": "4K", "hd": "HD", "uhd": "UHD", "mp3": "MP3",
    "aac": "AAC", "flac": "FLAC", "bio": "BIO", "wifi": "WiFi", "wi-fi": "WiFi",
    "bluetooth": "Bluetooth",
}
# Parameter names with one spelling.
NAME_SYNONYMS = {
    "typ média": "Typ produktu", "médium": "Typ produktu", "formát": "Typ produktu",
    "druh": "Typ produktu",
    "název": "Název produktu", "jméno": "Název produktu", "titul": "Název produktu",
    "výrobce": "Značka", "producent": "Značka", "brand": "Značka",
    "počet ks": "Počet kusů", "počet knůtů": "Počet knotů",
    "složení": "Materiál", "látka": "Materiál",
}
# Names that win over others with the same value.
PRIORITY_NAMES = ["Značka", "Typ produktu", "Materiál", "Počet kusů", "Počet knotů"]
# Separators of several values in one cell, first present one is used.
VALUE_SEPARATORS = [",", " a ", " i ", " + "]
# Labels of the source text.
SOURCE_LABELS = {
    "name": "Název produktu", "shortDescription": "Krátký popis", "description": "Popis",
    "weight": "Hmotnost", "warranty": "Záruka", "manufacturer": "Výrobce", "supplier": "Dodavatel",
}
TITLE_CASE = "^[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ][a-záčďéěíňóřšťúůýž]{2,}$"


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def lowercase_first(c: Column) -> Column:
    """First letter in lower case, unless the value starts with an acronym or a name."""
    first = F.regexp_extract(c, r"^([^\s,;\-]*)", 1)
    acronym = first.rlike("^[A-Z0-9]+$")
    common = F.lower(first).rlike(f"({'|'.join(COMMON_ENDINGS)})$")
    name = first.rlike(TITLE_CASE) & ~common
    kept = reduce(or_, [c.startswith(b) for b in KEPT_BEGINNINGS])
    lowered = F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    return F.when(acronym | name | kept, c).otherwise(lowered)


def fix_acronyms(c: Column) -> Column:
    edge = "[A-Za-z0-9_]"
    fixed = reduce(lambda acc, kv: F.regexp_replace(
        acc, f"(?i)(?<!{edge}){kv[0]}(?!{edge})", kv[1]), ACRONYMS.items(), c)
    # one cheap look first: few values hold an acronym
    return F.when(c.rlike(f"(?i){'|'.join(ACRONYMS)}"), fixed).otherwise(c)


def parameter_name(c: Column) -> Column:
    trimmed = trim_ws(c)
    pairs = [F.lit(x) for kv in NAME_SYNONYMS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(trimmed)), capitalize_first(trimmed))


def parameter_value(c: Column) -> Column:
    return fix_acronyms(lowercase_first(trim_ws(c)))


def split_values(c: Column) -> Column:
    """A cell with several values as an array; a single value stays as it is."""
    out = None
    for sep in VALUE_SEPARATORS:
        pattern = sep.replace("+", r"\+")
        parts = F.filter(F.transform(F.split(c, pattern), trim_ws), lambda x: x != "")
        out = F.when(c.contains(sep), parts) if out is None else out.when(c.contains(sep), parts)
    return out.otherwise(F.array(c))


def source_text(columns: dict[str, Column]) -> Column:
    """``Label: value`` blocks of the chosen, non-empty columns."""
    blocks = [F.when(text(columns[k]) != "", F.concat(F.lit(f"{label}: "), text(columns[k])))
              for k, label in SOURCE_LABELS.items() if k in columns]
    return F.concat_ws("\n\n", *blocks)
