"""Writers of result tables. Files are written by the executors, one per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stocklens.operators.issues import issue_codes


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """A wide table as CSV with a header, quoted so that :func:`read_csv` gets it back."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("quoteAll", True).option(
        "escape", '"').csv(path)


def write_issue_codes(issues: DataFrame, issue_type: str, path: str) -> None:
    """Distinct codes of one issue type."""
    write_csv(issue_codes(issues, issue_type), path)


def write_price_lists(prices: DataFrame, path: str) -> None:
    """one folder per discount level."""
    prices.write.mode("overwrite").partitionBy("discountPercent").option("header", True).csv(path)
