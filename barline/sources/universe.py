"""Instrument lists: lenient and strict loading from CSV text columns."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import UNRANKED
from ..functions.text import default_symbol, non_empty, normalize_ticker
from ..schema import require_columns
from .files import read_table


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = read_table(spark, path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def _text(df: DataFrame, name: str) -> Column:
    return non_empty(F.col(name)) if name in df.columns else F.lit(None).cast("string")


def load_universe(raw: DataFrame, tickers=None, limit: int | None = None) -> DataFrame:
    """Typed universe ordered by rank (none or zero last), then by file order of the ticker."""
    require_columns(raw, ["ticker"], "CSV")
    ticker = normalize_ticker(_text(raw, "ticker"))

    def rank(name):
        return _text(raw, name).try_cast("double").cast("int")

    rows = raw.select(
        ticker.alias("ticker"),
        F.upper(F.coalesce(_text(raw, "yfinance_symbol"), default_symbol(ticker))).alias("yfinance_symbol"),
        F.coalesce(_text(raw, "name"), ticker).alias("name"),
        F.coalesce(_text(raw, "sector"), F.lit("UNKNOWN")).alias("sector"),
        F.coalesce(F.nullif(rank("market_cap_rank"), F.lit(0)), rank("universe_rank")).alias("market_cap_rank"),
        _text(raw, "beta").try_cast("double").alias("beta"),
    ).where("ticker is not null")
    if tickers:
        rows = rows.where(F.col("ticker").isin([t.strip().upper().removesuffix(".JK") for t in tickers]))
    ordered = rows.orderBy(F.coalesce(F.nullif("market_cap_rank", F.lit(0)), F.lit(UNRANKED)), "ticker")
    return ordered if limit is None else ordered.limit(limit)


def require_universe(universe: DataFrame) -> DataFrame:
    if universe.isEmpty():
        raise ValueError("No stock metadata records found")
    return universe


def check_stock_records(raw: DataFrame) -> DataFrame:
    """Strict typed records; bad rows carry a `reason` instead of stopping the job."""
    require_columns(raw, ["ticker", "name", "sector"], "CSV")
    ticker = normalize_ticker(_text(raw, "ticker"))
    rank = _text(raw, "universe_rank")
    required = [
        F.when(_text(raw, c).isNull(), F.lit(f"Missing required value for '{c}'")) for c in ("ticker", "name", "sector")
    ]
    bad_rank = F.when(
        rank.isNotNull() & rank.try_cast("int").isNull(),
        F.concat(F.lit("Invalid integer value for 'universe_rank': "), rank),
    )
    return raw.select(
        ticker.alias("ticker"), _text(raw, "name").alias("name"), _text(raw, "sector").alias("sector"),
        F.coalesce(_text(raw, "exchange"), F.lit("IDX")).alias("exchange"),
        F.coalesce(_text(raw, "yfinance_symbol"), default_symbol(ticker)).alias("yfinance_symbol"),
        rank.try_cast("int").alias("universe_rank"),
        F.coalesce(*required, bad_rank).alias("reason"),
    )


def load_stock_records(raw: DataFrame) -> DataFrame:
    """Strict loading: the first bad rows are named in the error."""
    checked = check_stock_records(raw)
    bad = checked.where("reason is not null").select("reason").limit(5).collect()
    if bad:
        raise ValueError("; ".join(r.reason for r in bad))
    good = checked.drop("reason")
    if good.isEmpty():
        raise ValueError("No stock records found in CSV")
    return good
