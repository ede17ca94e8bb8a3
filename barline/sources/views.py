"""Bars, universe and news tables derived from the star-schema and document tables.

Every view covers its whole input; nothing is sampled, capped or cut.
"""

import functools
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import PRICE_INTERVAL, PRICE_SOURCE, SYMBOL_SUFFIX
from ..session import written

#: Suppliers up to which their instrument is broadcast to the trades.
FEW_OWNERS = 1_000_000
#: Instruments up to which the ends of their days are broadcast; each has the days of a calendar at most.
FEW_TICKERS = 100
#: Tables stored so far for the query that is being built; none outside of a `shared` query.
_STORED: ContextVar[dict | None] = ContextVar("stored", default=None)


def shared(query):
    """A query within which every table marked with `once` is derived and stored a single time."""

    @functools.wraps(query)
    def run(*args, **kw):
        token = _STORED.set({})
        try:
            return query(*args, **kw)
        finally:
            _STORED.reset(token)

    return run


def once(derive):
    """Marks a small table that queries read several times; see `shared`."""

    @functools.wraps(derive)
    def get(spark, sf_dir, *args, **kw):
        held = _STORED.get()
        if held is None or args or kw:
            return derive(spark, sf_dir, *args, **kw)
        key = derive.__name__, sf_dir
        if key not in held:
            held[key] = written(derive(spark, sf_dir))
        return held[key]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _span() -> dict[str, Column]:
    """High, low and volume of a group of trades."""
    return {"high": F.max("price"), "low": F.min("price"), "volume": F.sum("l_quantity").cast("bigint")}


def _daily(trades: DataFrame, **span: Column) -> DataFrame:
    """Trades to one bar per ticker and day; open and close by the trades' full order."""
    order = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    price = F.col("price")
    return (
        trades.groupBy("ticker", "date")
        .agg(
            F.min(F.struct(order.alias("o"), price.alias("p"))).alias("first"),
            F.max(F.struct(order.alias("o"), price.alias("p"))).alias("last"),
            *[value.alias(name) for name, value in (span or _span()).items()],
        )
        .select(
            "ticker",
            F.concat("ticker", F.lit(SYMBOL_SUFFIX)).alias("yfinance_symbol"),
            "date",
            F.col("first.p").alias("open"),
            "high",
            "low",
            F.col("last.p").alias("close"),
            F.col("last.p").alias("adj_close"),
            "volume",
            F.lit(PRICE_SOURCE).alias("source"),
            F.lit(PRICE_INTERVAL).alias("interval"),
        )
    )


def _daily_of_few(trades: DataFrame) -> DataFrame:
    """`_daily` where few instruments share many trades, in two readings without a sort of them.

    The first folds days by hash to plain numbers, among them the order keys at the day's ends
    (null comes first). Only trades with these keys decide open and close, so only they reach
    the aggregate of whole orders, which has to sort.
    """
    key = F.col("l_orderkey")
    days = trades.groupBy("ticker", "date").agg(
        F.when(F.count(key) == F.count("*"), F.min(key)).alias("begin"), F.max(key).alias("end"),
        *[value.alias(name) for name, value in _span().items()],
    )
    ends = F.broadcast(days.withColumnsRenamed({"ticker": "_ticker", "date": "_date"}))
    same = F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("date").eqNullSafe(F.col("_date"))
    at_end = key.eqNullSafe(F.col("begin")) | key.eqNullSafe(F.col("end"))
    return _daily(trades.join(ends, same & at_end), **{c: F.any_value(c) for c in _span()})


def _trades(spark, sf_dir, condition=None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if condition is not None:
        lines = lines.where(condition)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        F.col("l_shipdate").cast("date").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
    )


@once
def bars(spark, sf_dir, condition=None) -> DataFrame:
    """One bar per nation and ship date."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    owners = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("ticker"))
    if suppliers.count() <= FEW_OWNERS:
        owners = F.broadcast(owners)
    trades = _trades(spark, sf_dir, condition).join(owners, F.col("l_suppkey") == F.col("s_suppkey"))
    return _daily_of_few(trades) if nations.count() <= FEW_TICKERS else _daily(trades)


def bars_wide(spark, sf_dir) -> DataFrame:
    """One bar per supplier and ship date: many instruments, sparse dates."""
    owners = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("ticker"))
    return _daily(_trades(spark, sf_dir).join(owners, F.col("l_suppkey") == F.col("s_suppkey")))


def universe(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("ticker"),
        F.concat("n_name", F.lit(SYMBOL_SUFFIX)).alias("yfinance_symbol"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("sector"),
        (F.col("n_nationkey") + 1).alias("market_cap_rank"),
        F.lit(None).cast("double").alias("beta"),
    )


def universe_wide(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_name").alias("ticker"),
            F.concat("s_name", F.lit(SYMBOL_SUFFIX)).alias("yfinance_symbol"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("sector"),
            F.col("s_suppkey").cast("int").alias("market_cap_rank"),
            F.lit(None).cast("double").alias("beta"),
        )
    )


def raw_universe(spark, sf_dir) -> DataFrame:
    """Untidy text rows as they would land in a CSV file."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(".jk ")).alias("ticker"),
        F.lit(" ").alias("yfinance_symbol"),
        F.concat(F.lit("  PT "), F.col("n_name"), F.lit(" (Persero) Tbk. ")).alias("name"),
        F.when(F.col("r_name") == "ASIA", F.lit("  ")).otherwise(F.col("r_name")).alias("sector"),
        F.col("n_nationkey").cast("string").alias("market_cap_rank"),
        F.concat(F.lit(" 1."), F.col("n_regionkey").cast("string")).alias("beta"),
    )


def news(spark, sf_dir) -> DataFrame:
    """Documents as instrument-tagged articles; copies share ticker and often the date."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    page_count = pages.agg(F.count("*").alias("n")).scalar()
    title = F.substring_index("text", "\n", 1)
    tagged = docs.select(
        F.col("doc_id").alias("ingest_order"),
        title.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("summary"),
        "source",
        (F.length(title) % 25).alias("nation_key"),
        F.date_add(
            F.lit("1995-01-02").cast("date"),
            (F.substring("source", 4, 10).cast("int") * 113 + 7 * (F.col("n_chars") % 3)).cast("int"),
        ).alias("date"),
        (F.col("doc_id") % page_count).alias("page_key"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    return (
        tagged.join(nation, F.col("nation_key") == F.col("n_nationkey"))
        .join(pages, F.col("page_key") == F.col("page_id"), "left")
        .select(
            "ingest_order", "ticker", "date", "title", "summary", "url", "source",
            F.lit(None).cast("string").alias("provider"),
            F.lit(None).cast("double").alias("sentiment_score"),
            F.lit(None).cast("string").alias("image_url"),
        )
    )
