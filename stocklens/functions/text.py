"""Text expressions: markup removal, normalisation, detectors."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the sense of the web platform (wider than Java's \s).
WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# The same class by Unicode property, which Java matches faster; only for patterns of its own.
_FAST_WS = r"(?U)[\s\x{FEFF}&&[^\x{85}]]"

# Entities decoded in this order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
ENTITIES_EXT = ENTITIES + [
    ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&hellip;", "..."), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
]

# Filler text and placeholder markers, matched on lower-cased text. The first item is
# a literal that every match contains, tested before the pattern because that is far cheaper.
LOREM_PATTERNS = [
    ("lorem", rf"lorem{WS}+ipsum"),
    ("dolor", rf"dolor{WS}+sit{WS}+amet"),
    ("consectetur", rf"consectetur{WS}+adipiscing"),
    ("eiusmod", rf"sed{WS}+do{WS}+eiusmod"),
]
PLACEHOLDER_PATTERNS = [
    ("test", rf"test{WS}*(popis|description|text)"),
    ("xxxx", r"xxx{2,}"),
    ("[todo]", r"\[todo\]"),
    ("[placeholder]", r"\[placeholder\]"),
    ("tbd", r"(^|[^a-z0-9_])tbd([^a-z0-9_]|$)"),
    ("asdf", r"(^|[^a-z0-9_])asdf+([^a-z0-9_]|$)"),
    ("qwerty", r"(^|[^a-z0-9_])qwerty([^a-z0-9_]|$)"),
    ("{{", r"\{\{[^}]*\}\}"),
    ("[[", r"\[\[[^\]]*\]\]"),
]
URL_PATTERN = r"https?://[^\s<]+"
EMOJI_PATTERN = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
INLINE_STYLE_PATTERN = rf"""style{WS}*={WS}*["'][^"']+["']"""

# Function words and letters per language.
LANGUAGE_WORDS = {
    "cs": ["a", "v", "na", "je", "se", "do", "pro", "jsou", "má", "jeho", "která", "který",
           "které", "při", "jako", "nebo", "také", "jen", "ale", "pak", "tak", "již", "být",
           "více", "pouze", "všech", "vám", "jejich"],
    "de": ["und", "der", "die", "das", "ist", "für", "mit", "auf", "des", "den", "von", "sind",
           "wird", "bei", "nach", "aus", "oder", "wie", "auch", "kann"],
    "en": ["the", "and", "is", "for", "with", "on", "of", "are", "will", "at", "from", "or",
           "as", "can", "be", "this", "that", "have", "has", "an", "by", "it", "not", "you", "we"],
}
LANGUAGE_LETTERS = {"cs": "[ěščřžýáíéůúďťň]", "de": "[äöüß]"}


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_FAST_WS}+|{_FAST_WS}+$", "")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank(c: Column) -> Column:
    """NULL, empty, or white space only."""
    return text(c).rlike(rf"\A{_FAST_WS}*\z")


def empty(c: Column) -> Column:
    """NULL or empty (white space counts as content)."""
    return text(c) == ""


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank. A single blank is no match, and ASCII texts take a class that is matched by a table."""
    ascii_only = F.regexp_replace(c, r"[\t-\r][\t-\r ]*| [\t-\r ]+", " ")
    return F.trim(F.when(is_ascii(c), ascii_only).otherwise(F.regexp_replace(
        c, rf"(?U)[\s\x{{FEFF}}&&[^\x{{85}} ]]{_FAST_WS}*| {_FAST_WS}+", " ")))


def _decode(c: Column, entities) -> Column:
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), entities, c)


def _without_tags(c: Column) -> Column:
    return F.when(text(c).contains("<"), F.regexp_replace(text(c), "<[^>]*>", " ")).otherwise(text(c))


def strip_html(c: Column) -> Column:
    """Tags become spaces, five entities decoded, white space collapsed."""
    return collapse_ws(_decode(_without_tags(c), ENTITIES))


def strip_html_ext(c: Column) -> Column:
    """As :func:`strip_html` with thirteen entities."""
    return collapse_ws(_decode(_without_tags(c), ENTITIES_EXT))


def review_text(description: Column, short: Column, limit: int | None = None) -> Column:
    """Plain text shown to a reviewer; a display may cut it to its first ``limit`` characters."""
    source = F.when(~empty(description), description).otherwise(text(short))
    plain = collapse_ws(F.regexp_replace(source, "<[^>]*>?", ""))
    return plain if limit is None else F.substring(plain, 1, limit)


def any_match(low: Column, patterns: list[tuple[str, str]]) -> Column:
    """Whether any (literal, pattern) matches the lower-cased text."""
    return reduce(lambda acc, p: acc | (low.contains(p[0]) & low.rlike(p[1])), patterns, F.lit(False))


def has_lorem(low: Column) -> Column:
    return any_match(low, LOREM_PATTERNS)


def has_placeholder(low: Column) -> Column:
    return any_match(low, PLACEHOLDER_PATTERNS)


def has_url(plain: Column) -> Column:
    low = F.lower(plain)
    return low.contains("://") & low.rlike(URL_PATTERN)


def emoji_count(c: Column) -> Column:
    # a text of one byte per character has none
    return F.when(is_ascii(text(c)), 0).otherwise(F.regexp_count(text(c), F.lit(EMOJI_PATTERN)))


def has_inline_style(c: Column) -> Column:
    low = F.lower(text(c))
    return low.contains("style") & low.rlike(INLINE_STYLE_PATTERN)


def words(c: Column) -> Column:
    return F.split(c, f"{_FAST_WS}+")


def plain_words(c: Column) -> Column:
    """:func:`words` of a text whose white space is single blanks, as :func:`strip_html` leaves it."""
    return F.split(c, " ")


def word_set(c: Column, plain: bool = False) -> Column:
    """Distinct lower-case words longer than two characters; ``plain`` as in :func:`plain_words`."""
    return F.array_distinct(F.filter((plain_words if plain else words)(F.lower(c)), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """P19 on two word sets; 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def word_hits(plain: Column, vocabulary: list[str]) -> Column:
    """How many words of a text with single spaces are in the vocabulary."""
    return F.size(F.filter(plain_words(plain), lambda w: w.isin(vocabulary)))


def function_words(plain: Column) -> Column:
    """The function words of any language in a text with single spaces, each as often as it stands there."""
    return F.filter(plain_words(plain), lambda w: w.isin(sorted({w for ws in LANGUAGE_WORDS.values() for w in ws})))


def language_scores(plain: Column, found: Column | None = None) -> Column:
    """P23 on plain lower-case text: +2 per function word, +10 for letters of one language.

    ``found``: a column of its own with the :func:`function_words`, so that the text is taken apart once for all languages.
    """
    found = function_words(plain) if found is None else found

    # letters of a language are never ASCII
    def score(lang: str) -> Column:
        s = F.size(F.filter(found, lambda w: w.isin(LANGUAGE_WORDS[lang]))) * 2
        if lang in LANGUAGE_LETTERS:
            s = s + F.when(~is_ascii(plain) & plain.rlike(LANGUAGE_LETTERS[lang]), 10).otherwise(0)
        return s.alias(lang)

    return F.struct(score("cs"), score("de"), score("en"))


def detect_language(c: Column) -> Column:
    """P23 as one expression (the audit computes the plain text as a column first)."""
    return language_of(language_scores(F.lower(strip_html(c))))


def language_of(scores: Column) -> Column:
    cs, de, en = scores["cs"], scores["de"], scores["en"]
    return F.when(F.greatest(cs, de, en) < 5, "unknown").when(
        (cs >= de) & (cs >= en), "cs").when(de >= en, "de").otherwise("en")


def _diacritics() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode data."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii() and base.islower():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _diacritics()


def normalize_text(c: Column) -> Column:
    """Lower case, no diacritics, only ``a-z0-9`` and single spaces."""
    flat = F.regexp_replace(F.translate(F.lower(text(c)), ACCENTED, PLAIN), r"[\x{300}-\x{36F}]", "")
    return F.trim(F.regexp_replace(flat, r"[^a-z0-9]+", " "))


def naive_normalize(s: str) -> str:
    """:func:`normalize_text` for literals known on the driver."""
    flat = s.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in flat).split())
