"""Numbers, dates, flags, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions.text import WS, text

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def parse_number(c: Column) -> Column:
    """Leading number of a cell, decimal comma allowed; else NULL."""
    dotted = F.regexp_replace(text(c), "^([^,]*),", "$1.")
    lead = F.regexp_extract(F.regexp_replace(dotted, f"{WS}+", ""), _NUMBER, 0)
    return F.nullif(lead, F.lit("")).try_cast("double")


def parse_stock(c: Column) -> Column:
    """A stock cell; missing or unreadable is 0."""
    return F.coalesce(F.nullif(F.trim(text(c)), F.lit("")).try_cast("double"), F.lit(0.0))


def parse_date(c: Column, dtype: T.DataType) -> Column:
    """Numbers are spreadsheet days since 1899-12-30, text is a date; else NULL."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        epoch_days = F.lit(-25569)  # 1899-12-30 seen from 1970-01-01
        return F.timestamp_millis(((c.cast("double") + epoch_days) * 86400000).cast("bigint"))
    return F.nullif(text(c), F.lit("")).try_cast("timestamp")


def parse_bool(c: Column) -> Column:
    """True, 1, ano, yes."""
    return F.lower(text(c)).isin("true", "1", "ano", "yes")


def round_half_up(c: Column) -> Column:
    """Rounds .5 towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def money(c: Column) -> Column:
    """Two decimals, .5 towards plus infinity."""
    return F.floor(c * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def one_decimal(c: Column) -> Column:
    return F.floor(c * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def days_between(later: Column, earlier: Column) -> Column:
    """Exact (fractional) days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400000000.0)
