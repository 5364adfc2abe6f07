"""What a shop platform adapter offers to the enrichment; every method maps tables to tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from stocklens.operators import enrichment as en
from stocklens.sources import gates


class PlatformAdapter(Protocol):
    def validate(self, df: DataFrame) -> gates.GateResult: ...
    def parse(self, df: DataFrame) -> DataFrame: ...
    def requests(self, products: DataFrame, columns: list[str]) -> DataFrame: ...
    def output(self, products: DataFrame, params: DataFrame) -> DataFrame: ...
    def find(self, columns: list[str], meaning: str) -> str | None: ...


class ExportAdapter:
    """The one platform supported: product exports with filtering and text property columns."""

    names = {"image": gates.IMAGE_COLUMNS, "price": gates.PRICE_COLUMNS, "name": gates.NAME_COLUMNS, "code": gates.CODE_COLUMNS}

    def __init__(self, max_filtering: int = 5, max_text: int = 3, clear_existing: bool = False):
        self.max_filtering, self.max_text, self.clear_existing = max_filtering, max_text, clear_existing

    def validate(self, df: DataFrame) -> gates.GateResult:
        return gates.enrichment_gate(df)

    def parse(self, df: DataFrame) -> DataFrame:
        return gates.clean_cells(df)

    def requests(self, products: DataFrame, columns: list[str]) -> DataFrame:
        return en.enrichment_requests(products, columns)

    def output(self, products: DataFrame, params: DataFrame) -> DataFrame:
        return en.wide_output(products, params, self.max_filtering, self.max_text, self.clear_existing)

    def find(self, columns: list[str], meaning: str) -> str | None:
        return gates.find_column(columns, self.names[meaning])
