"""Fuse prices, lagged news and metadata into one labelled dataset, without look-ahead."""

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import EMBEDDING_DIMENSIONS, NEWS_FEATURES, embedding_columns, news_feature_columns
from ..functions.calendar import temporal_columns
from ..functions.numeric import change
from ..functions.text import normalize_ticker
from ..schema import require_columns


def clean_prices(features: DataFrame) -> DataFrame:
    require_columns(features, ["ticker", "date", "close"], "price features")
    return features.withColumns(
        {
            "ticker": F.regexp_replace(F.upper("ticker"), r"\.JK$", ""),
            "date": F.col("date").cast("date"),
        }
    ).na.drop(subset=["ticker", "date", "close"])


def align_news_features(news: DataFrame | None, spark, dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """Fixed column order; absent columns become 0.0; no table gives an empty one."""
    columns = news_feature_columns(dimensions)
    if news is None:
        return spark.createDataFrame(
            [], "ticker string, date date, " + ", ".join(f"{c} double" for c in columns)
        )
    have = set(news.columns)
    return news.select(
        F.regexp_replace(F.upper("ticker"), r"\.JK$", "").alias("ticker"),
        F.col("date").cast("date").alias("date"),
        *[(F.col(c).cast("double") if c in have else F.lit(0.0)).alias(c) for c in columns],
    ).na.drop(subset=["ticker", "date"])


def lag_news(news: DataFrame, calendar: DataFrame, lag: int) -> DataFrame:
    """Move news to the first trading date on or after it, then `lag` trading rows on.

    News past the end of a ticker's calendar, or of a ticker without one, drops out. A lag of
    zero keeps the dates as they are. The look-ahead is a range frame, so news on a trading
    date finds that date itself. Both inputs hold at most a few rows per ticker and day, so a
    window partition is bounded by the calendar.
    """
    if lag < 0:
        raise ValueError("nlp_lag_trading_days must be zero or greater")
    if lag == 0:
        return news
    trading = calendar.select("ticker", F.col("date").cast("date").alias("date")).na.drop().distinct()
    w = W.partitionBy("ticker").orderBy("date")
    target = trading.withColumn("_to", F.lead("date", lag).over(w))
    # newest first, so the frame only grows; as a range frame it includes rows of the same date
    ahead = W.partitionBy("ticker").orderBy(F.desc("date")).rangeBetween(W.unboundedPreceding, 0)
    news_days = news.select("ticker", "date").distinct().select(
        "ticker", "date", F.lit(None).cast("date").alias("_to"), F.lit(True).alias("_news")
    )
    both = target.select("ticker", "date", "_to", F.lit(False).alias("_news")).unionByName(news_days)
    # the first calendar row ahead decides, even when its own target is past the end
    first = F.min(F.when(~F.col("_news"), F.struct("date", "_to"))).over(ahead)
    moved = (
        both.select("ticker", "date", "_news", first.alias("_first")).where("_news")
        .select("ticker", "date", F.col("_first._to").alias("_to")).where("_to is not null")
    )
    return (
        news.join(moved, ["ticker", "date"])
        .select(*[F.col("_to").alias(c) if c == "date" else F.col(c) for c in news.columns])
    )


def collapse_news(news: DataFrame, dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """Fold news rows that land on one date: counts add up, extremes stay, the rest averages."""
    # fixed values: how each daily column folds
    summed = ["news_count", "positive_news_count", "neutral_news_count", "negative_news_count", "source_count"]
    highest = ["sentiment_max", "provider_count"]
    lowest = ["sentiment_min"]

    def fold(c):
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        agg = F.sum if c in summed else F.max if c in highest else F.min if c in lowest else F.avg
        return agg(x).alias(c)

    columns = NEWS_FEATURES + embedding_columns(dimensions)
    return news.groupBy("ticker", "date").agg(*[fold(c) for c in columns])


def join_news(prices: DataFrame, news: DataFrame, dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """Left equi-join on ticker and date; days without news get zeros."""
    return prices.join(news, ["ticker", "date"], "left").fillna(0.0, news_feature_columns(dimensions))


def join_metadata(dataset: DataFrame, universe: DataFrame) -> DataFrame:
    """Sector from the universe, else the row's own, else UNKNOWN; beta defaults to one."""
    meta = universe.select(
        normalize_ticker(F.col("ticker")).alias("ticker"),
        F.col("name").alias("_name"), F.col("sector").alias("_sector"),
        F.col("market_cap_rank").cast("double").alias("market_cap_rank"),
        F.col("beta").cast("double").alias("_beta"),
    )
    own = [F.col("sector")] if "sector" in dataset.columns else []
    kept = [c for c in dataset.columns if c not in ("sector", "name", "market_cap_rank", "beta")]
    return dataset.select(*kept, *own).join(meta, "ticker", "left").select(
        *kept,
        F.coalesce("_name", "ticker").alias("name"),
        F.coalesce("_sector", *own, F.lit("UNKNOWN")).alias("sector"),
        "market_cap_rank",
        F.coalesce("_beta", F.lit(1.0)).alias("beta"),
        F.col("_beta").isNull().cast("int").alias("beta_missing"),
    )


def add_temporal(dataset: DataFrame) -> DataFrame:
    return dataset.select("*", *temporal_columns(F.col("date")))


def fit_encoders(dataset: DataFrame):
    """Alphabetical codes for ticker and sector; the fitted model is the stored encoder."""
    return StringIndexer(
        inputCols=["ticker", "sector"], outputCols=["_ticker_code", "_sector_code"],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(dataset)


def code_table(dataset: DataFrame, column: str) -> DataFrame:
    """Zero-based alphabetical code of each distinct value; one row per instrument or sector."""
    values = dataset.select(column).na.drop().distinct()
    return values.select(
        column, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(column)) - 1).alias(f"{column}_encoded")
    )


def add_encodings(dataset: DataFrame, instruments: DataFrame | None = None) -> DataFrame:
    """Dense codes and the market-cap score (rank 1 scores one, the last rank zero).

    `instruments` lists the ticker, sector and rank combinations of the dataset; with it the
    codes do not read the dataset itself.
    """
    listed = dataset if instruments is None else instruments
    top = listed.agg(F.max("market_cap_rank").alias("top")).scalar()
    rank = F.col("market_cap_rank").cast("double")
    score = (
        F.when(top <= 1, F.when(F.coalesce(rank, top) != 0, 1.0).otherwise(0.0))
        .otherwise(F.coalesce(1 - (rank - 1) / (top - 1), F.lit(0.0)))
    )
    coded = dataset
    for column in ("ticker", "sector"):
        coded = coded.join(code_table(listed, column), column, "left")
    return coded.select(
        *dataset.columns,
        *[F.coalesce(f"{c}_encoded", F.lit(-1)).alias(f"{c}_encoded") for c in ("ticker", "sector")],
        F.coalesce(score, F.lit(0.0)).alias("market_cap_encoded"),
    )


def add_labels(dataset: DataFrame) -> DataFrame:
    """Next close, next return and its direction; the last row of a ticker has none."""
    following = F.lead("close", 1).over(W.partitionBy("ticker").orderBy("date"))
    priced = dataset.withColumn("next_day_price", following)
    target = change(F.col("next_day_price"), F.col("close"))
    return priced.withColumn("target_return", target).withColumn(
        "direction", F.when(F.col("target_return").isNotNull(), (F.col("target_return") > 0).cast("bigint"))
    )


def add_cross_section_labels(dataset: DataFrame) -> DataFrame:
    """Market and sector means of the next return, the excess over them and its sign.

    The means are small partial aggregates joined back, not windows: one date may hold any
    share of the rows.
    """
    by_sector = dataset.groupBy("date", "sector").agg(
        F.sum("target_return").alias("_sum"), F.count("target_return").alias("_n")
    )
    market = by_sector.groupBy("date").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n").cast("double")).alias("market_next_return")
    )
    sector = by_sector.select(
        "date", "sector", F.try_divide("_sum", F.col("_n").cast("double")).alias("sector_next_return")
    )

    def flag(excess):
        return F.when(excess.isNotNull(), (excess > 0).cast("bigint"))

    joined = dataset.join(market, "date", "left").join(sector, ["date", "sector"], "left")
    market_excess = F.col("target_return") - F.col("market_next_return")
    sector_excess = F.col("target_return") - F.col("sector_next_return")
    return joined.select(
        *dataset.columns,
        "market_next_return", market_excess.alias("target_excess_return"),
        flag(market_excess).alias("outperform_market"),
        "sector_next_return", sector_excess.alias("target_sector_excess_return"),
        flag(sector_excess).alias("outperform_sector"),
    )


def final_dataset(
    price_features: DataFrame, news_features: DataFrame | None, universe: DataFrame,
    dimensions: int = EMBEDDING_DIMENSIONS, lag: int = 1, drop_unlabeled: bool = False,
) -> DataFrame:
    """The model-ready table: one row per ticker and date."""
    prices = clean_prices(price_features)
    news = align_news_features(news_features, prices.sparkSession, dimensions)
    arrived = collapse_news(lag_news(news, prices, lag), dimensions)
    fused = join_metadata(join_news(prices, arrived, dimensions), universe)
    own = ["sector"] if "sector" in prices.columns else []
    instruments = join_metadata(prices.select("ticker", *own).distinct(), universe)
    labelled = add_labels(add_encodings(add_temporal(fused), instruments))
    out = add_cross_section_labels(labelled)
    return out.na.drop(subset=["target_return", "next_day_price"]) if drop_unlabeled else out
