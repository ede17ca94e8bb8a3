"""Landed provider rows to typed bars."""

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import PRICE_INTERVAL, PRICE_SOURCE
from ..functions.numeric import finite_number, number

DATE_NAMES = ("Date", "Datetime", "date", "datetime")


def date_column(df: DataFrame) -> str:
    """The first known date name, else the first column."""
    exact = [c for c in DATE_NAMES if c in df.columns]
    return exact[0] if exact else df.columns[0]


def _date(c: Column) -> Column:
    # the local calendar day as written; a zone suffix does not move it
    return F.substring(F.trim(c.cast("string")), 1, 10).try_cast("date")


def _cell(df: DataFrame, name: str, parse) -> Column:
    return parse(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("double")


def normalize_bars(
    raw: DataFrame, interval: str = PRICE_INTERVAL, source: str = PRICE_SOURCE, strict: bool = False
) -> DataFrame:
    """Typed bars from provider rows with ticker, symbol, date and title-case price columns.

    Rows without a date or close drop out. The frame variant turns missing volume into zero;
    `strict` (the row variant) keeps it NULL and also turns infinite numbers into NULL.
    """
    parse = finite_number if strict else number
    volume = _cell(raw, "Volume", finite_number).cast("bigint")
    symbol = F.col("yfinance_symbol") if "yfinance_symbol" in raw.columns else F.concat("ticker", F.lit(".JK"))
    return raw.select(
        "ticker", symbol.alias("yfinance_symbol"), _date(F.col(date_column(raw))).alias("date"),
        *[_cell(raw, c, parse).alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        _cell(raw, "Adj Close", parse).alias("adj_close"),
        (volume if strict else F.coalesce(volume, F.lit(0))).alias("volume"),
        F.lit(source).alias("source"), F.lit(interval).alias("interval"),
    ).na.drop(subset=["date", "close"])
