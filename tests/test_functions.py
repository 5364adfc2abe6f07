import pytest
from pyspark.sql import functions as F

from stocklens.functions import category as cg, keywords as kw, markup, parameters as pm, stock as st, text as tx, url as ur
from stocklens.functions import values as vl


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("html, plain", [
    ("<p>a&nbsp;b</p>", "a b"), ("a &amp;lt; b", "a < b"), (" x   y﻿", "x y"), (None, ""), ("<br>", "")])
def test_strip_html(spark, html, plain):
    assert one(spark, html, tx.strip_html) == plain


def test_strip_html_ext(spark):
    assert one(spark, "&copy; 1&ndash;2&hellip;", tx.strip_html_ext) == "© 1–2..."


@pytest.mark.parametrize("cell, number", [("1 234,50", 1234.5), ("12.5 Kč", 12.5), ("-3", -3.0), ("abc", None), ("", None),
                                          (".5x", 0.5), ("1,2,3", 1.2), ("1e3", 1000.0)])
def test_parse_number(spark, cell, number):
    assert one(spark, cell, vl.parse_number) == number


def test_parse_stock_date_bool(spark):
    assert one(spark, "", vl.parse_stock) == 0 and one(spark, "x", vl.parse_stock) == 0 and one(spark, "7", vl.parse_stock) == 7
    day = spark.createDataFrame([(45292.5,)], "x double").select(
        F.date_format(vl.parse_date(F.col("x"), spark.range(1).select(F.lit(1.0)).schema[0].dataType), "yyyy-MM-dd HH:mm")).first()[0]
    assert day == "2024-01-01 12:00"
    assert [one(spark, v, vl.parse_bool) for v in ("Ano", "1", "yes", "ne", None)] == [True, True, True, False, False]


def test_money_rounds_half_up(spark):
    r = spark.sql("select 2.5D a, -2.5D b, 1.005D c").select(
        vl.round_half_up(F.col("a")), vl.round_half_up(F.col("b")), vl.money(F.col("c"))).first()
    assert list(r) == [3, -2, 1.0]


@pytest.mark.parametrize("path, last", [("A | B | C", "C"), ("A > B", "B"), ("A/B", "B"), ("A \\ B", "B"), ("A > B | C", "A > B | C".split(" | ")[-1]), ("X", "X")])
def test_last_segment(spark, path, last):
    assert one(spark, path, cg.last_segment) == last


def test_category_parts(spark):
    assert one(spark, "A > B > C", cg.main_category) == "A"
    assert one(spark, "A > B > C", cg.sub_category) == "B > C"
    assert one(spark, "A", cg.sub_category) is None and one(spark, "", cg.main_category) is None
    assert one(spark, "A |B| C", cg.path_prefixes) == ["A", "A | B", "A | B | C"]


@pytest.mark.parametrize("text, lang", [
    ("Toto je dlouhý popis, který je určen pro všechny zákazníky", "cs"), ("the cat is on the mat and it is not you", "en"),
    ("der Hund und die Katze sind mit dem Auto", "de"), ("xyz foo", "unknown")])
def test_language(spark, text, lang):
    assert one(spark, text, tx.detect_language) == lang


@pytest.mark.parametrize("text, hit", [
    ("test popis", True), ("[TODO] x", True), ("tbd", True), ("tbdx", False), ("asdff", True), ("xxxx", True), ("xxx", False),
    ("{{name}}", True), ("[[x]]", True), ("best text", False), ("contest text", True)])
def test_placeholders(spark, text, hit):
    assert one(spark, text, lambda c: tx.has_placeholder(F.lower(c))) is hit


def test_emoji_and_lorem(spark):
    assert one(spark, "🎁🎁☀✂🚗🎉 ok", tx.emoji_count) == 6
    assert one(spark, "Lorem  Ipsum", lambda c: tx.has_lorem(F.lower(c)))


@pytest.mark.parametrize("html, error", [
    ("<p>a</p>", None), ("<div><b>x</div>", "close:div"), ("<div><p>", "open:div,p"), ("<br><img src=x>", None),
    ("a<hr/></p>", "close:p"), ("<up><p></p></up>", None)])
def test_balance(spark, html, error):
    assert one(spark, html, markup.balance_error) == error


def test_nesting(spark):
    assert one(spark, "<a>" * 9 + "</a>" * 9, markup.nesting_depth) == 9
    assert one(spark, "</a></a><b>", markup.nesting_depth) == 0
    assert one(spark, "<div> </div><span></span><p></p>", markup.empty_block_count) == 2
    assert one(spark, "<br><br/><br /> x <br><br>", markup.break_run_count) == 1


def test_normalize_and_keywords(spark):
    assert one(spark, "Příliš žluťoučký KŮŇ-x", tx.normalize_text) == "prilis zlutoucky kun x"
    assert one(spark, "Termoska pro set 1l akce", kw.strong_keywords) == ["termoska"]
    assert one(spark, "Termoska pro set 1l akce", kw.weak_keywords) == ["set", "1l"]
    assert [one(spark, w, kw.stem) for w in ("kabelka", "domova", "ky", "hrnek")] == ["kabel", "dom", "ky", "hrn"]
    assert one(spark, "75/RUZ2", kw.base_code) == "75" and one(spark, "75", kw.base_code) is None
    assert one(spark, "PROD_A", kw.audit_base_code) == "PROD"


@pytest.mark.parametrize("path, seasonal", [("Vánoce | Dárky", True), ("Akce", True), ("akcent", False), ("Slevy", True),
                                            ("Hrnky 🎄", True), ("Dárky pro ženy", True), ("Hrnky", False)])
def test_seasonal(spark, path, seasonal):
    assert one(spark, path, kw.is_seasonal) is seasonal


def test_stock_texts(spark):
    assert one(spark, "Není skladem", st.says_in_stock) and one(spark, "Není skladem", st.says_out_of_stock)
    assert not one(spark, "Na dotaz", st.says_in_stock)


@pytest.mark.parametrize("href, target", [
    ("/x", "https://a.cz/x"), ("//b.cz/y", "https://b.cz/y"), ("http://c.cz", "http://c.cz"), ("mailto:x", None), ("#t", None),
    ("img/p.png", "https://a.cz/d/img/p.png"), ("../p.png", "https://a.cz/p.png"), ("./q?a=../b", "https://a.cz/d/q?a=../b"),
    ("../../../r", "https://a.cz/r"), ("?p=2", "https://a.cz/d/?p=2")])
def test_resolve_url(spark, href, target):
    assert one(spark, href, lambda c: ur.resolve_url(c, F.lit("https://a.cz/d/e.html"))) == target


def test_urls(spark):
    norm = lambda u: one(spark, u, ur.normalize_page_url)
    assert norm("https://a.cz:443/x/") == "https://a.cz/x" and norm("http://a.cz") == "http://a.cz/"
    assert norm("http://a.cz/x/?q=1") == "http://a.cz/x?q=1" and norm("http://a.cz/") == "http://a.cz/"
    full = lambda u: one(spark, u, ur.complete_site_url)
    assert full("shop.cz") == "https://www.shop.cz" and full("https://shop.cz") == "https://www.shop.cz/"
    assert full("http://m.shop.cz") == "http://m.shop.cz" and full("www.a.cz") == "https://www.a.cz"
    assert one(spark, "https://a.cz:8080/x", lambda c: ur.is_external(c, F.lit("https://a.cz")))


@pytest.mark.parametrize("value, spelled", [
    ("Modrá", "modrá"), ("Sonberk", "Sonberk"), ("usb kabel", "USB kabel"), ("DVD box", "DVD box"), ("Bavlna", "bavlna"),
    ("Česká republika", "Česká republika"), ("Wi-fi", "WiFi"), ("ledová", "ledová")])
def test_parameter_value(spark, value, spelled):
    assert one(spark, value, pm.parameter_value) == spelled


def test_parameter_names_and_splits(spark):
    assert one(spark, " výrobce ", pm.parameter_name) == "Značka" and one(spark, "barva", pm.parameter_name) == "Barva"
    assert one(spark, "bavlna, len a x", pm.split_values) == ["bavlna", "len a x"]
    assert one(spark, "len a x", pm.split_values) == ["len", "x"] and one(spark, "a + b", pm.split_values) == ["a", "b"]


def test_plain_texts_equal_the_patterns(spark):
    """The cheap tests in front of the patterns change no value: all kinds of white space, tags, letters, empty texts."""
    from stocklens.functions import markup, text as tx
    blanks = [" ", "  ", "\t", "\n", "\x0b", "\f", "\r", "\x1c", "\x85", "\xa0", " ", " ", "﻿", "　"]
    texts = ["", None, "ž", "<b>a</b> <i", "a < b > c", "the  und\tje", "<div>  </div><DIV></DIV><span></span>", "<br> <br/>\n<BR>", "☀ x ☀☀"]
    texts += [x + y for x in blanks for y in ["", *blanks]]
    texts += [f"a{x}{y}the{y}b ž"[:n] for x in blanks for y in blanks for n in (5, 20)] + [f"a{x}{y}the{y}b" for x in blanks for y in blanks]
    ws = r"[\s\x0B\x{FEFF}&&[^\x{85}]]"
    old_collapse = lambda c: F.trim(F.regexp_replace(c, f"(?U){ws}+", " "))
    old_strip = old_collapse(tx._decode(F.regexp_replace(tx.text(F.col("t")), "<[^>]*>", " "), tx.ENTITIES))
    hits = lambda c, v: F.regexp_count(c, F.lit(f"(?<![^ ])(?:{'|'.join(v)})(?![^ ])"))
    low = F.lower(tx.text(F.col("t")))
    pairs = [(tx.strip_html(F.col("t")), old_strip),
             (tx.blank(F.col("t")), F.regexp_replace(tx.text(F.col("t")), f"(?U)^{ws}+|{ws}+$", "") == ""),
             (tx.emoji_count(F.col("t")), F.regexp_count(tx.text(F.col("t")), F.lit(tx.EMOJI_PATTERN))),
             (tx.word_hits(F.lower(tx.strip_html(F.col("t"))), tx.LANGUAGE_WORDS["en"]), hits(F.lower(tx.strip_html(F.col("t"))), tx.LANGUAGE_WORDS["en"])),
             (F.array_join(tx.word_set(tx.strip_html(F.col("t")), plain=True), "|"), F.array_join(tx.word_set(tx.strip_html(F.col("t"))), "|")),
             (markup.empty_block_count(F.col("t")), F.regexp_count(low, F.lit(rf"<div[^>]*>{tx.WS}*</div>")) + F.regexp_count(low, F.lit(rf"<span[^>]*>{tx.WS}*</span>"))),
             (markup.break_run_count(F.col("t")), F.regexp_count(low, F.lit(rf"(<br{tx.WS}*/?>{tx.WS}*){{3,}}")))]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs]).collect()
    assert len(rows) > 500 and not [r for r in rows for x in r[1:] if x["a"] != x["b"]]
