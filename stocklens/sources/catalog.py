"""Catalog and category feeds: CSV and XML files to canonical columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions import category as cg, text as tx, values as vl
from stocklens.session import materialise

c = F.col

# Header names of each canonical column, first non-empty cell wins.
PRODUCT_HEADERS = {
    "code": ["code", "CODE", "Kód"],
    "name": ["name", "NAME", "Název"],
    "short_description": ["shortDescription", "SHORT_DESCRIPTION", "Krátký popis", "perex"],
    "description": ["description", "DESCRIPTION", "Popis", "Dlouhý popis"],
    "meta_description": ["metaDescription", "META_DESCRIPTION", "Meta popis", "SEO popis", "seoDescription"],
    "meta_title": ["metaTitle", "META_TITLE", "Meta titulek", "SEO titulek", "seoTitle"],
    "default_category": ["defaultCategory", "DEFAULT_CATEGORY", "Kategorie", "Výchozí kategorie"],
    "category_text": ["categoryText", "CATEGORY_TEXT", "Cesta kategorie"],
    "price": ["price", "PRICE", "Cena", "Cena s DPH"],
    "price_before_discount": ["priceBeforeDiscount", "PRICE_BEFORE_DISCOUNT", "Cena před slevou", "Původní cena"],
    "purchase_price": ["purchasePrice", "PURCHASE_PRICE", "Nákupní cena"],
    "availability": ["availability", "AVAILABILITY", "Dostupnost"],
    "availability_in_stock": ["availabilityInStock", "AVAILABILITY_IN_STOCK", "Dostupnost skladem",
                              "Dostupnost při skladové zásobě"],
    "availability_out_of_stock": ["availabilityOutOfStock", "AVAILABILITY_OUT_OF_STOCK", "Dostupnost vyprodáno",
                                  "Dostupnost při vyprodání"],
    "delivery_days": ["deliveryDays", "DELIVERY_DAYS", "Dodací doba", "Doba dodání"],
    "stock": ["stock", "STOCK", "Sklad", "Skladem", "Množství"],
    "ean": ["ean", "EAN", "GTIN", "gtin"],
    "manufacturer": ["manufacturer", "MANUFACTURER", "Výrobce", "brand", "BRAND", "Značka"],
    "brand": ["brand", "BRAND", "Značka"],
    "warranty": ["warranty", "WARRANTY", "Záruka"],
    "weight": ["weight", "WEIGHT", "Váha", "Hmotnost"],
    "image": ["image", "IMAGE", "Obrázek", "Hlavní obrázek"],
    "is_action": ["isAction", "IS_ACTION", "Akce", "V akci"],
    "is_new": ["isNew", "IS_NEW", "Novinka"],
    "is_visible": ["visible", "VISIBLE", "Viditelný", "Aktivní"],
    "action_end_date": ["actionEndDate", "ACTION_END_DATE", "Konec akce"],
    "created_at": ["createdAt", "CREATED_AT", "Vytvořeno", "Datum vytvoření"],
    "updated_at": ["updatedAt", "UPDATED_AT", "Upraveno", "Datum úpravy"],
    "parent_code": ["parentCode", "PARENT_CODE", "Rodičovský kód", "Kód rodiče"],
}
NUMBERS = ["price", "price_before_discount", "purchase_price", "delivery_days", "stock", "weight"]
BOOLEANS = ["is_action", "is_new", "is_visible"]
DATES = ["action_end_date", "created_at", "updated_at"]
# Patterns of numbered columns.
IMAGE_HEADERS = ["image{i}", "IMAGE{i}", "Obrázek {i}", "additionalImage{i}"]
IMAGE_LISTS = ["additionalImages", "ADDITIONAL_IMAGES", "Další obrázky"]
FILTER_LISTS = ["filterParams", "FILTER_PARAMS", "Parametry pro filtr"]
PARAM_NAMES = ["paramName{i}", "PARAM_NAME_{i}", "Parametr {i} název"]
PARAM_VALUES = ["paramValue{i}", "PARAM_VALUE_{i}", "Parametr {i} hodnota"]

# Element names of each field in XML feeds (any case, without namespace), in order.
XML_TAGS = {
    "code": ["ITEM_ID", "CODE", "ID", "PRODUCT_ID"],
    "name": ["PRODUCTNAME", "PRODUCT", "NAME", "TITLE"],
    "shortDescription": ["SHORT_DESCRIPTION", "PEREX", "SUMMARY"],
    "description": ["DESCRIPTION", "LONG_DESCRIPTION"],
    "metaDescription": ["META_DESCRIPTION", "SEO_DESCRIPTION"],
    "categoryText": ["CATEGORYTEXT", "CATEGORY", "CATEGORY_TEXT", "PRODUCT_TYPE", "GOOGLE_PRODUCT_CATEGORY"],
    "price": ["PRICE_VAT", "PRICE"],
    "priceBeforeDiscount": ["PRICE_BEFORE_DISCOUNT", "STANDARD_PRICE", "SALE_PRICE"],
    "availability": ["DELIVERY_DATE", "AVAILABILITY"],
    "stock": ["STOCK", "AMOUNT", "QUANTITY"],
    "ean": ["EAN", "GTIN", "BARCODE"],
    "manufacturer": ["MANUFACTURER", "BRAND", "VENDOR"],
    "image": ["IMGURL", "IMAGE", "IMG", "IMAGE_LINK", "PICTURE"],
    "url": ["URL", "LINK"],
    "weight": ["WEIGHT", "SHIPPING_WEIGHT"],
    "warranty": ["WARRANTY", "GUARANTEE"],
    "parentCode": ["ITEMGROUP_ID", "ITEM_GROUP_ID", "PARENT_ID"],
}
XML_MORE_IMAGES = ["IMGURL_ALTERNATIVE", "ADDITIONAL_IMAGE", "ADDITIONAL_IMAGE_LINK"]
XML_ROW_TAGS = ["SHOPITEM", "item", "product", "entry"]
CATEGORY_HEADERS = {
    "name": ["name", "NAME", "Název", "nazev", "NAZEV", "Jméno", "jmeno", "CATEGORY_NAME", "categoryName", "CATEGORYNAME",
             "title", "TITLE", "Titul", "label", "LABEL", "text", "TEXT"],
    "code": ["code", "CODE", "Kód", "kod", "KOD", "guid", "GUID", "id", "ID", "CATEGORY_ID", "ITEM_ID", "item_id"],
    "path": ["path", "PATH", "Cesta", "cesta", "categoryText", "CATEGORY_TEXT", "CATEGORY_FULLNAME", "fullPath", "CATEGORYTEXT"],
    "parent_code": ["parentCode", "PARENT_CODE", "parentGuid", "PARENT_GUID", "Rodičovská kategorie", "Kód rodiče",
                    "parent", "PARENT", "parentId", "PARENT_ID", "nadrazena"],
    "description": ["description", "DESCRIPTION", "Popis", "popis", "desc", "DESC", "CONTENT", "content"],
    "image": ["image", "IMAGE", "Obrázek", "obrazek", "img", "IMG", "imgUrl", "IMGURL"],
    "is_active": ["active", "ACTIVE", "Aktivní", "aktivni", "visible", "VISIBLE", "isActive"],
    "product_count": ["productCount", "PRODUCT_COUNT", "Počet produktů", "pocetProduktu", "products", "count", "COUNT", "ITEM_COUNT"],
    "order": ["order", "ORDER", "Pořadí", "poradi", "priority", "PRIORITY"],
}
CATEGORY_ROW_TAGS = ["category", "CATEGORY", "item", "ITEM", "SHOPITEM"]


def read_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Header row; ``;`` as separator when the first line has one, else ``,``.

    Cells are trimmed, quoted separators are honoured, blank lines are skipped. With ``line_breaks`` quoted line
    breaks are honoured as well; Spark then reads each file in one task, so such feeds come in many files.
    """
    first = spark.read.text(path).filter(~tx.blank(c("value"))).limit(1).collect()
    sep = ";" if first and ";" in first[0][0] else ","
    return (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", line_breaks).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True).csv(path).fillna(""))


def with_row_index(df: DataFrame) -> DataFrame:
    """Adds ``row_idx``, the input position that breaks ties; increasing, not dense.

    The table is written once, so that a task that is run again cannot number its rows anew.
    """
    return materialise(df.withColumn("row_idx", F.monotonically_increasing_id()))


def _cell(columns: list[str], headers: list[str]) -> Column | None:
    present = [F.nullif(tx.text(c(f"`{h}`")), F.lit("")) for h in headers if h in columns]
    return F.coalesce(*present, F.lit("")) if present else None


def canonical_products(df: DataFrame) -> DataFrame:
    """Canonical names and types; rows without code are dropped."""
    out, types = {}, {f.name: f.dataType for f in df.schema}
    for name, headers in PRODUCT_HEADERS.items():
        cell = _cell(df.columns, headers)
        if name in NUMBERS:
            out[name] = vl.parse_number(cell) if cell is not None else F.lit(None).cast("double")
        elif name in BOOLEANS:
            value = cell if cell is not None else F.lit("")
            out[name] = vl.parse_bool(F.when(value == "", "true").otherwise(value) if name == "is_visible" else value)
        elif name in DATES:
            typed = [vl.parse_date(c(f"`{h}`"), types[h]) for h in headers if h in types]
            out[name] = F.coalesce(*typed) if typed else F.lit(None).cast("timestamp")
        else:
            out[name] = cell if cell is not None else F.lit("")
    out["image_count"] = image_count(df.columns)
    out["filter_parameters"] = filter_parameters(df.columns)
    texts = cg.category_text_columns(df.columns)
    extra = [tx.trim_ws(tx.text(c(f"`{x}`"))) for x in texts if x not in ("categoryText", "category_text")]
    out["additional_categories"] = (F.filter(F.array(*extra), lambda x: x != "") if extra
                                    else F.array().cast("array<string>"))
    kept = [c(x) for x in ("row_idx", "pairCode") if x in df.columns]
    return df.select(*kept, *[v.alias(k) for k, v in out.items()]).filter(c("code") != "")


def _numbers(columns: list[str], patterns: list[str]) -> list[int]:
    """Numbers that the columns carry in the place of ``{i}``, ascending; however many there are."""
    stems = [re.compile(re.escape(p).replace(r"\{i\}", r"([1-9][0-9]*)")) for p in patterns]
    found = {int(m[1]) for x in columns for stem in stems if (m := stem.fullmatch(x))}
    return sorted(found)


def image_count(columns: list[str]) -> Column:
    """Main image, numbered images from 2 on, listed images; an own count of the feed if greater."""
    def one(headers: list[str]) -> Column:
        cell = _cell(columns, headers)
        return F.lit(0) if cell is None else (cell != "").cast("int")

    total = one(PRODUCT_HEADERS["image"])
    for i in _numbers(columns, IMAGE_HEADERS):
        if i >= 2:
            total = total + one([h.format(i=i) for h in IMAGE_HEADERS])
    listed = _cell(columns, IMAGE_LISTS)
    if listed is not None:
        total = total + F.size(F.filter(F.split(listed, ","), lambda x: ~tx.blank(x)))
    if "imageCount" in columns:
        total = F.greatest(total, F.coalesce(c("imageCount").cast("int"), F.lit(0)))
    return total


def filter_parameters(columns: list[str]) -> Column:
    """Listed parameters, then numbered name and value pairs that are both set."""
    listed = _cell(columns, FILTER_LISTS)
    parts = [F.filter(F.transform(F.split(listed, ","), tx.trim_ws), lambda x: x != "") if listed is not None
             else F.array().cast("array<string>")]
    for i in _numbers(columns, PARAM_NAMES):
        name = _cell(columns, [h.format(i=i) for h in PARAM_NAMES])
        value = _cell(columns, [h.format(i=i) for h in PARAM_VALUES])
        if name is not None and value is not None:
            parts.append(F.when((name != "") & (value != ""), F.array(F.concat(name, F.lit(":"), value)))
                         .otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def xml_schema() -> T.StructType:
    """All element names a product may use, as text; parameters as name and value pairs.

    Spark matches element names in any case unless spark.sql.caseSensitive is set.
    """
    unique = {t: T.StructField(t, T.StringType()) for tags in XML_TAGS.values() for t in tags}
    for t in XML_MORE_IMAGES:
        unique[t] = T.StructField(t, T.ArrayType(T.StringType()))
    pair = T.StructType([T.StructField("PARAM_NAME", T.StringType()), T.StructField("VAL", T.StringType())])
    unique["PARAM"] = T.StructField("PARAM", T.ArrayType(pair))
    return T.StructType(list(unique.values()))


def xml_products(records: DataFrame, record: str) -> DataFrame:
    """One struct of :func:`xml_schema` per product to columns named as in sheets.

    Rows without code and name are dropped.
    """
    r = c(record)
    first = lambda tags: F.coalesce(*[F.nullif(tx.trim_ws(tx.text(r[t])), F.lit("")) for t in tags], F.lit(""))
    pairs = F.filter(F.coalesce(r["PARAM"], F.array().cast("array<struct<PARAM_NAME:string,VAL:string>>")),
                     lambda p: ~tx.blank(p["PARAM_NAME"]) & ~tx.blank(p["VAL"]))
    params = F.array_join(F.transform(pairs, lambda p: F.concat(
        tx.trim_ws(p["PARAM_NAME"]), F.lit(":"), tx.trim_ws(p["VAL"]))), ",")
    none = F.array().cast("array<string>")
    more = F.concat(*[F.coalesce(r[t], none) for t in XML_MORE_IMAGES])
    rest = [x for x in records.columns if x != record]
    out = records.select(*rest, *[first(tags).alias(k) for k, tags in XML_TAGS.items()], params.alias("filterParams"),
                         F.size(F.filter(more, lambda x: ~tx.blank(x))).alias("_more"))
    return out.withColumn("imageCount", (c("image") != "").cast("int") + c("_more")).drop("_more").filter(
        (c("code") != "") | (c("name") != ""))


def read_xml_products(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """An XML feed; without ``row_tag`` products of all usual row elements are read."""
    schema = xml_schema()
    tags = [row_tag] if row_tag else [v for t in XML_ROW_TAGS for v in dict.fromkeys((t, t.lower(), t.upper()))]
    found = []
    for tag in tags:
        df = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
        if row_tag or not df.isEmpty():
            found.append(df.select(F.struct(*[c(f"`{x}`") for x in df.columns]).alias("r")))
    records = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame(
        [], T.StructType([T.StructField("r", schema)]))
    return xml_products(records, "r")


def canonical_categories(df: DataFrame) -> DataFrame:
    """Canonical category columns; the name falls back to the path's end, then the code."""
    get = lambda k: _cell(df.columns, CATEGORY_HEADERS[k])
    text = lambda k: get(k) if get(k) is not None else F.lit("")
    number = lambda k: vl.parse_number(get(k)) if get(k) is not None else F.lit(None).cast("double")
    name = F.coalesce(F.nullif(text("name"), F.lit("")), F.nullif(cg.last_segment(text("path")), F.lit("")), text("code"))
    active = text("is_active")
    return df.select(
        text("code").alias("code"), name.alias("name"), text("parent_code").alias("parent_code"), text("path").alias("path"),
        text("description").alias("description"), text("image").alias("image"),
        vl.parse_bool(F.when(active == "", "true").otherwise(active)).alias("is_active"),
        number("product_count").cast("bigint").alias("product_count"), number("order").alias("order")).filter(
        (c("code") != "") | (c("name") != ""))


def read_categories(spark: SparkSession, path: str, row_tag: str | None = None, line_breaks: bool = False) -> DataFrame:
    """A category feed in CSV or (by file ending) XML. Without ``row_tag`` all usual row elements are read."""
    if not path.lower().endswith(".xml"):
        return canonical_categories(read_csv(spark, path, line_breaks))
    fields: dict[str, str] = {}
    for h in (h for hs in CATEGORY_HEADERS.values() for h in hs if " " not in h):
        fields.setdefault(h.lower(), h)  # element names match in any case
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields.values()])
    found = []
    for tag in [row_tag] if row_tag else CATEGORY_ROW_TAGS:
        df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        if row_tag or not df.isEmpty():
            found.append(df)
    return canonical_categories(reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema))
