"""Column lookup and schema checks before a job starts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.text import blank

# Column names by meaning.
IMAGE_COLUMNS = ["imgUrl", "image", "imageUrl", "img", "photo", "picture"]
PRICE_COLUMNS = ["price", "priceVat", "cena", "priceWithVat"]
NAME_COLUMNS = ["name", "productName", "title", "nazev", "název"]
CODE_COLUMNS = ["code", "sku", "productCode", "kod", "kód", "ean"]
LINKING_COLUMNS = ["code", "pairCode", "name", "defaultCategory", "categoryText"]
ENRICHMENT_REQUIRED = ["code", "name", "shortDescription", "description"]
ENRICHMENT_ALLOWED = ["code", "name", "shortDescription", "description", "adult", "metaDescription", "defaultCategory",
                      "defaultImage", "weight", "warranty", "manufacturer", "supplier", "ean", "price", "priceBefore",
                      "currency", "vat", "stock", "minStock", "unit", "visibility", "pairCode", "__EMPTY"]
NUMBERED_COLUMNS = ["image", "categoryText", "textProperty", "alternativeName", "video", "relatedProduct",
                    "alternativeProduct", "gift", "surcharge", "flag", "accessories", "parameter", "variant",
                    "availability", "priceList"]


@dataclass
class GateResult:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.errors


def find_column(columns: list[str], names: list[str]) -> str | None:
    """An exact name first, then any case and outer blanks."""
    for n in names:
        if n in columns:
            return n
    for n in names:
        for col in columns:
            if col.lower().strip() == n.lower():
                return col
    return None


def linking_gate(df: DataFrame) -> GateResult:
    """Required columns, only numbered category texts beside them, at least one row."""
    missing = [x for x in LINKING_COLUMNS if x not in df.columns]
    extra = [x for x in df.columns if x not in LINKING_COLUMNS and not re.match(r"^categoryText\d+$", x)]
    if df.isEmpty():
        return GateResult(["no data"])
    if missing:
        return GateResult([f"missing columns: {', '.join(missing)}"])
    if extra:
        return GateResult([f"columns not allowed: {', '.join(extra)}"])
    return GateResult()


def column_report(df: DataFrame) -> DataFrame:
    """S09 as a table: each column with its verdict for linking and its filled cells; missing ones have none."""
    numbered = re.compile(r"^categoryText\d+$")
    verdict = lambda x: "required" if x in LINKING_COLUMNS else "allowed" if numbered.match(x) else "not allowed"
    verdicts = [(x, verdict(x), _filled(x)) for x in df.columns]
    verdicts += [(x, "missing", F.lit(0).cast("bigint")) for x in LINKING_COLUMNS if x not in df.columns]
    return _as_rows(df, ["column", "verdict"], verdicts)


def meaning_report(df: DataFrame) -> DataFrame:
    """S08 as a table: the column found for each meaning (null if none) and its filled cells."""
    names = {"image": IMAGE_COLUMNS, "price": PRICE_COLUMNS, "name": NAME_COLUMNS, "code": CODE_COLUMNS}
    found = [(k, find_column(df.columns, v)) for k, v in names.items()]
    return _as_rows(df, ["meaning", "column"], [(k, x, _filled(x) if x else F.lit(0).cast("bigint")) for k, x in found])


def _filled(column: str) -> Column:
    return F.count_if(~blank(F.col(f"`{column}`").cast("string")))


def _as_rows(df: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """A row for each tuple of two texts and an aggregate, which becomes ``filled``; one pass over the table."""
    totals = df.agg(*[value.alias(f"v{i}") for i, (_, _, value) in enumerate(rows)])
    each = [F.struct(F.lit(a).cast("string").alias(names[0]), F.lit(b).cast("string").alias(names[1]), F.col(f"v{i}").alias("filled"))
            for i, (a, b, _) in enumerate(rows)]
    return totals.select(F.inline(F.array(*each)))


def enrichment_gate(df: DataFrame, coverage: DataFrame | None = None) -> GateResult:
    """Columns by metadata, text coverage by one aggregate over the whole table, or as counted before."""
    result, low = GateResult(), [x.lower() for x in df.columns]
    result.errors += [f"missing column: {x}" for x in ENRICHMENT_REQUIRED if x.lower() not in low]
    numbered = re.compile(rf"^({'|'.join(NUMBERED_COLUMNS)})\d*$", re.IGNORECASE)
    allowed = {x.lower() for x in ENRICHMENT_ALLOWED}
    unknown = [x for x in df.columns if x.lower() not in allowed and not x.startswith("filteringProperty:")
               and not x.lower().startswith("textproperty") and not numbered.match(x)]
    if unknown:
        result.errors.append(f"columns not allowed: {', '.join(unknown)}")
    rows, empty = (text_coverage(df) if coverage is None else coverage).first()
    if rows == 0:
        result.errors.append("no data rows")
    elif empty == rows:
        result.errors.append("no row has any text")
    elif int(empty / rows * 100 + 0.5) > 50:
        result.warnings.append(f"{empty} of {rows} rows have no text")
    for prefix in ("filteringProperty:", "textProperty"):
        if any(x.startswith(prefix) for x in df.columns):
            result.warnings.append(f"file already has {prefix} columns")
    return result


def text_coverage(df: DataFrame) -> DataFrame:
    """Rows, and rows without name, short description and description."""
    fields = [F.col(f"`{x}`") for x in ("shortDescription", "description", "name") if x in df.columns]
    none = F.lit(True)
    for x in fields:
        none = none & blank(x)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(none).alias("rows_without_text"))


def clean_cells(df: DataFrame) -> DataFrame:
    """Cells as text without spreadsheet carriage returns; column names trimmed."""
    def clean(x: str):
        v = F.replace(F.col(f"`{x}`").cast("string"), F.lit("_x000d_"), F.lit(""))
        return F.replace(F.replace(v, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias(x.strip())
    return df.select(*[clean(x) for x in df.columns])
