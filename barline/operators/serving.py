"""Latest-state queries: movers, watchlist, rankings, drivers, feeds, profiles.

Each answers for every ticker at once; a request for one ticker is a filter that pushes down.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import (
    DRIVER_LABELS, FULL_SIGNAL_TEXT, HISTORY_COLUMNS, INDEX_NAME, INDEX_SYMBOL, INDEX_TICKER,
    LIMITED_MODEL_NOTE, LIMITED_NEWS_NOTE, MIN_NEWS_CARDS, NO_NEWS_TEXT, NO_NEWS_THEME,
    NOT_IN_UNIVERSE_TEXT, UNRANKED,
)
from ..functions import labels as L
from ..functions.calendar import chart_interval, period_start
from ..functions.numeric import finite_number, number, safe_div, whole
from ..functions.text import default_symbol, non_empty, normalize_ticker, strip_every_suffix, text_or_empty
from ..functions.urls import logo_candidates, logo_service_url, profile_domain


# --- latest rows -------------------------------------------------------------------------------

def latest_rows(df: DataFrame, n: int = 1, key: str = "ticker", order=None) -> DataFrame:
    """The last n rows per key, newest first in `recency`; limited before the shuffle as well."""
    w = W.partitionBy(key).orderBy(*(order or [F.desc("date")]))
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def last_two(bars: DataFrame) -> DataFrame:
    """Latest and previous close per ticker."""
    recent = latest_rows(bars.na.drop(subset=["ticker", "date", "close"]), 2)

    def at(c, place):
        return F.max(F.when(F.col("recency") == place, F.col(c)))

    return recent.groupBy("ticker").agg(
        at("date", 1).alias("date"), at("close", 1).alias("close"),
        at("close", 2).alias("previous_close"), at("volume", 1).alias("volume"),
        at("yfinance_symbol", 1).alias("yfinance_symbol"),
    )


def movers(bars: DataFrame, universe: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Top gainers and losers by relative change; equal changes keep ticker order."""
    base = all_moves(bars, universe)

    def top(side, *order):
        place = F.row_number().over(W.partitionBy("side").orderBy(*order))
        ranked = base.orderBy(*order).limit(limit).withColumn("side", F.lit(side))
        return ranked.withColumn("place", place.cast("bigint"))

    up = top("gainers", F.desc("change_pct"), F.asc("ticker"))
    down = top("losers", F.asc("change_pct"), F.asc("ticker"))
    return up.unionByName(down).select(
        "side", "place", "ticker", "symbol", "name", "date", "close", "previous_close", "change", "change_pct"
    )


def all_moves(bars: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    pairs = last_two(bars).where("previous_close > 0")
    if universe is not None:
        names = universe.select("ticker", F.col("name").alias("_name"), F.col("yfinance_symbol").alias("_symbol"))
        pairs = pairs.join(names, "ticker", "left")
    else:
        pairs = pairs.select("*", F.lit(None).cast("string").alias("_name"), F.lit(None).cast("string").alias("_symbol"))
    return pairs.select(
        "ticker",
        F.coalesce("yfinance_symbol", "_symbol", default_symbol(F.col("ticker"))).alias("symbol"),
        F.coalesce("_name", "ticker").alias("name"),
        "date", "close", "previous_close",
        (F.col("close") - F.col("previous_close")).alias("change"),
        (F.col("close") / F.col("previous_close") - 1).alias("change_pct"),
    )


# --- bars of one symbol ------------------------------------------------------------------------

def period_filter(bars: DataFrame, period: str) -> DataFrame:
    """Rows from the start of the period back from the table's latest date."""
    latest = bars.agg(F.max("date").alias("latest")).scalar()
    start = period_start(latest, period)
    return bars if start is None else bars.where(F.col("date") >= start)


def ohlcv_slice(bars: DataFrame, symbol: str, period: str = "1y", interval: str = "1d") -> DataFrame:
    """Candles of one symbol by ticker or provider symbol; the interval never resamples."""
    chart_interval(interval)
    wanted = symbol.upper().strip()
    mine = (F.upper("ticker") == wanted.removesuffix(".JK")) | (F.upper("yfinance_symbol") == symbol.upper())
    rows = bars.where(mine).na.drop(subset=["date", "close"])
    return period_filter(rows, period).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume",
        F.coalesce("yfinance_symbol", F.lit(symbol)).alias("symbol"),
    )


def price_history(bars: DataFrame, ticker: str | None = None, source="yfinance", interval="1d") -> DataFrame:
    rows = bars.where((F.col("source") == source) & (F.col("interval") == interval))
    if ticker is not None:
        rows = rows.where(F.col("ticker") == ticker)
    return rows.select("ticker", "date", "open", "high", "low", "close", "volume")


def candles_valid(rows: DataFrame) -> DataFrame:
    """Rows with a date and finite prices; missing volume counts as zero."""
    prices = ("open", "high", "low", "close")
    typed = rows.withColumns(
        {**{c: finite_number(F.col(c)) for c in prices}, "volume": F.coalesce(finite_number(F.col("volume")), F.lit(0.0)),
         "date": F.col("date").cast("string").try_cast("date")}
    )
    return typed.na.drop(subset=["date", *prices])


def coverage(bars: DataFrame) -> DataFrame:
    """First and last date, bars and years per ticker."""
    return bars.where("date is not null").groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("bars"),
        (F.datediff(F.max("date"), F.min("date")) / F.lit(365.25)).alias("years"),
    )


def feature_history(features: DataFrame, limit: int = 260, ticker: str | None = None) -> DataFrame:
    """Last rows per ticker with those of the chart columns that exist."""
    rows = features if ticker is None else features.where(F.upper("ticker") == ticker.upper())
    have = [c for c in HISTORY_COLUMNS if c in features.columns]
    return latest_rows(rows.select("ticker", *have), limit).drop("recency")


# --- universe and profiles ---------------------------------------------------------------------

def symbol_lookup(universe: DataFrame, tickers=None, limit: int | None = None) -> DataFrame:
    """Ticker to provider symbol, by rank (unranked last), then ticker."""
    rows = universe
    if tickers:
        rows = rows.where(F.col("ticker").isin([t.strip().upper().removesuffix(".JK") for t in tickers]))
    ranked = rows.select(
        "ticker", F.coalesce("yfinance_symbol", default_symbol(F.col("ticker"))).alias("symbol"),
        F.coalesce("market_cap_rank", F.lit(UNRANKED)).alias("rank"),
    ).orderBy("rank", "ticker")
    return (ranked if limit is None else ranked.limit(limit)).select("ticker", "symbol", "rank")


def stock_options(stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Stocks with their bar count; priced ones first, then by rank and ticker."""
    counted = bars.where("source = 'yfinance' and interval = '1d'").groupBy("ticker").agg(
        F.count("*").alias("price_points")
    )
    return stocks.join(counted, "ticker", "left").select(
        "ticker", "name", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"),
        F.coalesce("market_cap_rank", F.lit(UNRANKED)).alias("universe_rank"),
        F.coalesce("price_points", F.lit(0)).alias("price_points"),
        (F.coalesce("price_points", F.lit(0)) > 0).alias("has_price"),
    ).orderBy(F.desc("has_price"), "universe_rank", "ticker")


def sector_counts(stocks: DataFrame) -> DataFrame:
    return (
        stocks.where("sector is not null").groupBy("sector").agg(F.count("*").alias("stocks"))
        .orderBy(F.desc("stocks"), "sector")
    )


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def static_profiles(raw: DataFrame) -> DataFrame:
    """Landed profile rows with domain, website and logo completed from each other."""
    rows = raw.withColumn("ticker", strip_every_suffix(text_or_empty(F.col("ticker")))).where("ticker <> ''")
    domain = F.nullif(profile_domain(F.col("domain"), F.col("website")), F.lit(""))
    return rows.select(
        "ticker", non_empty(F.col("company_name")).alias("name"),
        domain.alias("domain"),
        F.coalesce(
            F.when(F.trim("website").rlike("^https?://"), F.col("website")),
            F.concat(F.lit("https://"), domain), F.col("website"),
        ).alias("website"),
        F.coalesce(_filled("logo_url"), logo_service_url(domain)).alias("logo_url"),
        F.when(_filled("logo_url").isNull() & domain.isNotNull(), F.lit("Logo.dev domain lookup"))
        .otherwise(F.col("logo_source")).alias("logo_source"),
        F.col("metadata_source_url"),
    )


PROFILE_FIELDS = ["name", "sector", "domain", "website", "logo_url", "logo_source", "metadata_source_url"]


def merge_profiles(universe: DataFrame, static: DataFrame, cache: DataFrame) -> DataFrame:
    """Later non-empty values win: universe, then static file, then cache."""
    layers = [cache, static, universe]
    out = universe.select("ticker", "yfinance_symbol", "market_cap_rank")
    have = []
    for i, layer in enumerate(layers):
        fields = [c for c in PROFILE_FIELDS if c in layer.columns]
        out = out.join(layer.select("ticker", *[F.col(c).alias(f"_{i}_{c}") for c in fields]), "ticker", "left")
        have.append(fields)

    def pick(c, default=None):
        options = [_filled(f"_{i}_{c}") for i in range(len(layers)) if c in have[i]]
        return F.coalesce(*options, *([default] if default is not None else []), F.lit(None).cast("string"))

    merged = out.select(
        "ticker",
        F.coalesce(_filled("yfinance_symbol"), default_symbol(F.col("ticker"))).alias("symbol"),
        pick("name", F.col("ticker")).alias("name"), pick("sector", F.lit("UNKNOWN")).alias("sector"),
        *[pick(c).alias(c) for c in PROFILE_FIELDS[2:]],
        F.coalesce("market_cap_rank", F.lit(UNRANKED)).alias("rank"),
    )
    return with_logo_candidates(merged)


def with_logo_candidates(profiles: DataFrame) -> DataFrame:
    listed = profiles.withColumn(
        "logo_candidates", logo_candidates(F.col("logo_url"), F.col("domain"), F.col("website"))
    )
    first = F.get("logo_candidates", F.lit(0))
    return listed.withColumns(
        {
            "logo_source": F.when(
                _filled("logo_url").isNull() & first.isNotNull(),
                F.coalesce(_filled("logo_source"), F.lit("company website icon")),
            ).otherwise(F.col("logo_source")),
            "logo_url": F.coalesce(_filled("logo_url"), first),
        }
    )


def index_profile(spark) -> DataFrame:
    return spark.range(1).select(
        F.lit(INDEX_TICKER).alias("ticker"), F.lit(INDEX_SYMBOL).alias("symbol"),
        F.lit(INDEX_NAME).alias("name"), F.lit("Index").alias("sector"),
        F.lit("").alias("domain"), F.lit("").alias("website"),
        *[F.lit(None).cast("string").alias(c) for c in ("logo_url", "logo_source", "metadata_source_url")],
        F.lit(0).alias("rank"), F.array().cast("array<string>").alias("logo_candidates"),
    )


def company_profiles(universe: DataFrame, static: DataFrame, cache: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Profile per ticker plus the index row; requested tickers outside the universe get defaults."""
    known = merge_profiles(universe, static, cache)
    out = known.unionByName(index_profile(known.sparkSession))
    if requested is None:
        return out
    asked = requested.select(
        F.when(F.upper("ticker").isin(INDEX_TICKER, INDEX_SYMBOL), F.lit(INDEX_TICKER))
        .otherwise(strip_every_suffix(F.col("ticker"))).alias("ticker")
    ).distinct()
    full = asked.join(out, "ticker", "left")
    return full.select(
        "ticker", F.coalesce("symbol", default_symbol(F.col("ticker"))).alias("symbol"),
        F.coalesce("name", "ticker").alias("name"), F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"),
        *[c for c in out.columns if c not in ("ticker", "symbol", "name", "sector")],
    )


# --- predictions -------------------------------------------------------------------------------

def normalize_predictions(rows: DataFrame) -> DataFrame:
    """Typed view over text prediction rows."""
    have = set(rows.columns)

    def col(c):
        return F.col(c) if c in have else F.lit(None).cast("string")

    return rows.select(
        "ticker", F.substring(col("date").cast("string"), 1, 10).alias("date"),
        F.coalesce(F.nullif(col("sector"), F.lit("")), F.lit("UNKNOWN")).alias("sector"),
        number(col("close")).alias("close"),
        number(col("predicted_return")).alias("predicted_return"),
        whole(col("predicted_direction")).alias("predicted_direction"),
        number(col("probability_up")).alias("probability_up"),
        number(col("confidence")).alias("confidence"),
        F.coalesce(F.nullif(col("model_name"), F.lit("")), F.lit("global_model")).alias("model_name"),
        F.coalesce(F.nullif(col("model_type"), F.lit("")), F.lit("unknown")).alias("model_type"),
    )


def enrich_rankings(predictions: DataFrame, universe: DataFrame) -> DataFrame:
    """Predictions with score, direction, company name and sector; rows without a score drop out."""
    score = L.ranking_score(
        F.col("predicted_return"), F.col("probability_up"), F.col("confidence"), F.col("predicted_direction")
    )
    meta = universe.select(
        "ticker", F.col("name").alias("_name"), F.col("yfinance_symbol").alias("_symbol"), F.col("sector").alias("_sector")
    )
    return (
        predictions.withColumn("ticker", F.upper("ticker")).withColumn("ranking_score", score)
        .where("ranking_score is not null").join(meta, "ticker", "left")
        .select(
            "ticker", F.coalesce("_name", "ticker").alias("company_name"),
            F.coalesce("_symbol", default_symbol(F.col("ticker"))).alias("symbol"),
            F.coalesce(_filled("sector"), F.col("_sector"), F.lit("UNKNOWN")).alias("sector"),
            "predicted_return",
            L.ranking_direction(F.col("predicted_direction"), F.col("predicted_return")).alias("direction"),
            "confidence", "probability_up", F.col("close").alias("latest_close"),
            F.col("date").alias("prediction_date"), "ranking_score",
        )
    )


def prediction_rankings(predictions: DataFrame, universe: DataFrame, limit: int = 10) -> DataFrame:
    """Highest and lowest scores, `limit` each, ties by ticker."""
    ranked = enrich_rankings(predictions, universe)

    def top(side, *order):
        place = F.row_number().over(W.partitionBy("side").orderBy(*order))
        return ranked.orderBy(*order).limit(limit).withColumn("side", F.lit(side)).withColumn("place", place.cast("bigint"))

    return top("up", F.desc("ranking_score"), F.asc("ticker")).unionByName(
        top("down", F.asc("ranking_score"), F.asc("ticker"))
    )


def watchlist_rows(universe: DataFrame, bars: DataFrame, predictions: DataFrame) -> DataFrame:
    """Universe with latest prices and predictions."""
    prices = last_two(bars)
    guesses = predictions.select(
        "ticker", F.col("predicted_direction").alias("_direction"),
        F.col("predicted_return").alias("prediction_return"),
        F.col("confidence").alias("prediction_confidence"),
        F.col("probability_up").alias("prediction_probability_up"),
    )
    last, before = F.col("p.close"), F.col("p.previous_close")
    return (
        universe.alias("u").join(prices.alias("p"), "ticker", "left").join(guesses, "ticker", "left")
        .select(
            "ticker",
            F.coalesce("p.yfinance_symbol", "u.yfinance_symbol", default_symbol(F.col("ticker"))).alias("symbol"),
            F.coalesce("u.name", "ticker").alias("company_name"),
            F.coalesce("u.sector", F.lit("UNKNOWN")).alias("sector"),
            F.coalesce("u.market_cap_rank", F.lit(UNRANKED)).alias("rank"),
            F.col("p.date").alias("date"), last.alias("last_price"), before.alias("previous_close"),
            (last - before).alias("daily_change"),
            F.when(before > 0, last / before - 1).alias("daily_change_pct"),
            F.col("p.volume").alias("volume"),
            L.watchlist_direction(F.col("_direction"), F.col("prediction_return")).alias("prediction_direction"),
            "prediction_return", "prediction_confidence", "prediction_probability_up",
        )
    )


def watchlist(universe: DataFrame, bars: DataFrame, predictions: DataFrame, limit: int = 100) -> DataFrame:
    """Priced stocks first, then rank, then ticker; every row knows how many are priced."""
    rows = watchlist_rows(universe, bars, predictions)
    available = rows.agg(F.count("last_price")).scalar()
    return (
        rows.withColumn("available_tickers", available)
        .orderBy(F.col("last_price").isNull(), "rank", "ticker").limit(limit)
    )


def watchlist_filter(rows: DataFrame, query: str = "", keep: str = "all", sort: str = "change") -> DataFrame:
    """Search, one filter and one sort order over watchlist rows (one row per instrument)."""
    change = F.coalesce("daily_change_pct", F.lit(0.0))
    median = rows.agg(F.percentile("volume", 0.5)).scalar()
    filters = {
        "all": F.lit(True), "gainers": change > 0, "losers": change < 0,
        "up": F.col("prediction_direction") == "UP", "down": F.col("prediction_direction") == "DOWN",
        "volume": F.coalesce(F.col("volume") >= median, F.lit(False)),
    }
    orders = {
        "ticker": [F.asc("ticker")], "volume": [F.desc(F.coalesce("volume", F.lit(0)))],
        "active": [F.desc(F.coalesce("volume", F.lit(0)))],
        "confidence": [F.desc(F.coalesce("prediction_confidence", F.lit(0.0)))],
    }
    kept = rows.where(filters.get(keep, F.lit(False)))
    needle = query.strip().lower()
    if needle:
        kept = kept.where(F.lower("ticker").contains(needle) | F.lower("company_name").contains(needle))
    return kept.orderBy(*orders.get(sort, [F.desc(F.abs(change))]), "ticker")


# --- news --------------------------------------------------------------------------------------

def merge_sentiment(news: DataFrame, daily: DataFrame) -> DataFrame:
    """Article score first, then the day's mean."""
    means = daily.select("ticker", "date", "sentiment_mean")
    return news.join(means, ["ticker", "date"], "left").withColumn(
        "score", F.coalesce("sentiment_score", "sentiment_mean")
    )


def _feed_columns(scope: str, place: Column) -> list:
    return [
        "date", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("source", F.lit("")).alias("source"), "ingest_order",
        F.col("score").alias("sentiment_score"), L.sentiment_label(F.col("score")).alias("sentiment_label"),
        F.lit(scope).alias("scope"), place.alias("place"),
    ]


def market_news(scored: DataFrame, limit: int = 5) -> DataFrame:
    """Latest articles over the whole market, newest first, ties in arrival order."""
    head = scored.orderBy(F.desc("date"), "ingest_order").limit(limit)
    place = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("date"), "ingest_order"))
    listed = head.select("ticker", *_feed_columns("market", F.lit(0)))
    return listed.withColumn("place", place)


def _identity() -> Column:
    return F.lower(F.trim(F.coalesce(_filled("url"), _filled("title"), F.col("date").cast("string"), F.lit(""))))


def news_feed(scored: DataFrame, tickers: DataFrame, limit: int = 5, fallback: bool = True) -> DataFrame:
    """Latest articles of every requested ticker.

    A ticker with fewer than min(limit, 6) articles is topped up with market-wide ones it does
    not show yet. The market list holds at most `limit` rows and reaches each short ticker as
    one array value.
    """
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    own = latest_rows(
        scored.withColumn("ticker", F.upper("ticker")).join(wanted, "ticker", "left_semi"),
        limit, order=[F.desc("date"), "ingest_order"],
    ).select("ticker", *_feed_columns("ticker", F.col("recency")))
    own = own.withColumn("identity", _identity())
    if not fallback:
        return own.drop("identity")
    fields = [c for c in own.columns if c not in ("ticker",)]
    market = market_news(scored, limit).withColumn("identity", _identity())
    bundle = market.agg(F.collect_list(F.struct(*fields)).alias("rows")).scalar()
    shown = own.groupBy("ticker").agg(
        F.count("*").alias("n"), F.collect_set("identity").alias("seen")
    )
    short = (
        wanted.join(shown, "ticker", "left")
        .where(F.coalesce("n", F.lit(0)) < min(limit, MIN_NEWS_CARDS))
        .select("ticker", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"), F.explode(bundle).alias("m"))
        .where(~F.array_contains("seen", F.col("m.identity")))
        .select("ticker", "m.*")
    )
    once = latest_rows(short.withColumn("_key", F.struct("ticker", "identity")), 1, "_key", ["place"]).drop("recency", "_key")
    order = W.partitionBy("ticker").orderBy(F.desc("scope"), "place")
    merged = own.unionByName(once).withColumn("place", F.row_number().over(order))
    return merged.where(F.col("place") <= limit).drop("identity")


def feed_context(feed: DataFrame, requested: DataFrame) -> DataFrame:
    """Message per requested ticker by the scope of its rows."""
    scopes = feed.groupBy("ticker").agg(F.bool_or(F.col("scope") == "market").alias("_market"))
    return requested.select(F.upper("ticker").alias("ticker")).distinct().join(scopes, "ticker", "left").select(
        "ticker", L.news_context(F.lit(True), F.col("_market")).alias("message")
    )


def news_bucket_filter(feed: DataFrame, bucket: str) -> DataFrame:
    """Rows of one sentiment bucket; all rows when there are none."""
    if bucket == "all":
        return feed
    rows = feed.withColumn("bucket", L.news_bucket(F.col("sentiment_label"), F.col("sentiment_score")))
    hits = rows.agg(F.count_if(F.col("bucket") == bucket)).scalar()
    return rows.where((F.col("bucket") == bucket) | (hits == 0)).drop("bucket")


def news_summary(daily: DataFrame, scored: DataFrame, tickers: DataFrame, limit: int = 50) -> DataFrame:
    """Latest daily features and the latest articles of every ticker, with neutral defaults."""
    latest = latest_rows(daily, 1).drop("recency")
    recent = latest_rows(scored, limit, order=[F.desc("date"), "ingest_order"])
    # arrival place decides ties, so keys negate it where the maximum is taken
    counted = recent.where("coalesce(source,'') <> ''").groupBy("ticker", "source").agg(
        F.count("*").alias("n"), F.min("recency").alias("at")
    ).groupBy("ticker").agg(F.max_by("source", F.struct("n", -F.col("at"))).alias("main_source"))
    has_score = F.col("score").isNotNull() & (F.coalesce("title", F.lit("")) != "")
    heads = recent.groupBy("ticker").agg(
        F.count("*").alias("articles"),
        F.min_by("date", "recency").alias("latest_news_date"),
        F.max_by("title", F.when(has_score, F.struct("score", -F.col("recency")))).alias("best"),
        F.min_by("title", F.when(has_score, F.struct("score", "recency"))).alias("worst"),
        F.min_by(F.coalesce("title", F.lit("")), "recency").alias("newest"),
    )
    base = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    joined = base.join(latest, "ticker", "left").join(heads, "ticker", "left").join(counted, "ticker", "left")
    known = F.col("news_count").isNotNull()
    label = L.sentiment_label(F.col("sentiment_mean"))
    some = F.coalesce("articles", F.lit(0)) > 0
    theme = F.concat(F.col("ticker"), F.lit(" coverage from "), F.coalesce("main_source", F.lit("market news")))
    text = F.concat(
        F.lit("Recent news around "), F.col("ticker"), F.lit(" is mostly "), F.lower(label),
        F.lit(", based on "), F.col("articles").cast("string"), F.lit(" matched article rows in the local news artifact."),
    )
    return joined.select(
        "ticker", "date",
        F.when(known, F.col("sentiment_mean")).otherwise(F.lit(0.0)).alias("sentiment_mean"),
        F.when(known, F.col("sentiment_std")).otherwise(F.lit(0.0)).alias("sentiment_std"),
        F.coalesce(F.col("news_count").cast("bigint"), F.lit(0)).alias("news_count"),
        F.when(known, F.col("sentiment_momentum")).otherwise(F.lit(0.0)).alias("sentiment_momentum"),
        F.when(known, label).otherwise("Neutral").alias("overall_sentiment"),
        F.when(known, F.col("latest_news_date")).alias("latest_news_date"),
        F.when(known & some, F.coalesce("best", "newest")).alias("top_positive_headline"),
        F.when(known & some, F.coalesce("worst", "newest")).alias("top_negative_headline"),
        F.when(~known, F.lit(NO_NEWS_THEME)).otherwise(F.when(some, theme)).alias("main_theme"),
        F.when(known & some, text).otherwise(F.lit(NO_NEWS_TEXT)).alias("summary_text"),
    )


# --- overview and model summary ----------------------------------------------------------------

def market_overview(index_bars: DataFrame, predictions: DataFrame, scored_news: DataFrame, bars: DataFrame) -> DataFrame:
    """One row: index move, prediction mix, news mood, leading and trailing stock."""
    recent = latest_rows(index_bars.na.drop(subset=["date", "close"]).withColumn("_one", F.lit(1)), 2, "_one")
    index = recent.agg(
        F.max(F.when(F.col("recency") == 1, F.col("date"))).alias("date"),
        F.max(F.when(F.col("recency") == 1, F.col("close"))).alias("close"),
        F.max(F.when(F.col("recency") == 2, F.col("close"))).alias("previous_close"),
    )
    change = F.when(F.col("previous_close") > 0, F.col("close") / F.col("previous_close") - 1)
    guess = predictions.agg(
        F.count("*").alias("covered_stocks"),
        F.count_if(F.col("predicted_direction") == 1).alias("bullish_count"),
        F.avg("confidence").alias("avg_confidence"), F.avg("predicted_return").alias("avg_predicted_return"),
    )
    mood = market_news(scored_news, 100).agg(
        F.avg("sentiment_score").alias("sentiment_score"), F.count("*").alias("news_count")
    )
    moves = all_moves(bars).agg(
        F.count("*").alias("available_tickers"),
        F.min(F.struct(-F.col("change_pct"), F.col("ticker"))).getField("ticker").alias("top_gainer"),
        F.min(F.struct("change_pct", "ticker")).getField("ticker").alias("top_loser"),
    )
    # every part is one row; scalar subqueries put them side by side
    def part(df):
        return df.select(F.struct(*df.columns)).scalar()

    wide = index.select(
        "*", part(guess).alias("g"), part(mood).alias("m"), part(moves).alias("v")
    )
    total, up = F.col("g.covered_stocks"), F.col("g.bullish_count")
    return wide.select(
        F.lit(INDEX_SYMBOL).alias("symbol"), "date", "close", "previous_close", change.alias("daily_change"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("neutral").alias("direction"),
        total.alias("covered_stocks"), up.alias("bullish_count"), (total - up).alias("bearish_count"),
        safe_div(up.cast("double"), total.cast("double")).alias("bullish_ratio"),
        "g.avg_confidence", "g.avg_predicted_return", L.market_bias(up, total).alias("bias"),
        "m.sentiment_score", L.sentiment_label(F.col("m.sentiment_score")).alias("sentiment_label"),
        "m.news_count", "v.available_tickers", "v.top_gainer", "v.top_loser",
    )


def dataset_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct tickers and latest date of every table."""
    out = None
    for name, df in tables.items():
        date = F.max(F.col("date").cast("date")) if "date" in df.columns else F.lit(None).cast("date")
        names = F.count_distinct("ticker") if "ticker" in df.columns else F.lit(0).cast("bigint")
        row = df.agg(F.count("*").alias("rows"), names.alias("stocks"), date.alias("latest_date")).select(
            F.lit(name).alias("table_name"), "rows", "stocks", "latest_date"
        )
        out = row if out is None else out.unionByName(row)
    return out


def model_summary(comparison: DataFrame, dataset: DataFrame, news: DataFrame) -> DataFrame:
    """Comparison metrics with table sizes and a short narrative, one row."""
    data = dataset.agg(F.count("*").alias("data_rows"), F.count_distinct("ticker").alias("stocks_covered"))
    articles = news.agg(F.count("*").alias("news_articles"), F.max("date").alias("latest_news_date"))

    def part(df):
        return df.select(F.struct(*df.columns)).scalar()

    wide = comparison.select("*", part(data).alias("d"), part(articles).alias("a"))
    accuracy, gain = F.col("nlp_direction_classifier_accuracy"), F.col("mape_improvement_pct")
    # fixed values: narrative sentences
    notes = F.concat_ws(
        " ",
        F.when(accuracy >= 0.53, "Direction classifier shows a modest predictive signal."),
        F.when(gain > 0, "NLP features improved return error in the latest evaluation run.")
        .when(gain <= 0, "NLP model currently performs in line with the technical baseline."),
        F.when(F.col("a.news_articles") < 250,
               "News coverage is limited in the latest artifact, so NLP lift may be muted."),
    )
    return wide.select(
        "baseline_mape", "nlp_model_mape", gain.alias("improvement_pct"),
        F.col("nlp_directional_accuracy").alias("directional_accuracy"),
        accuracy.alias("direction_classifier_accuracy"), F.col("nlp_rank_ic").alias("rank_ic"),
        F.col("nlp_top_n_excess_return").alias("top_n_excess_return"),
        "d.stocks_covered", "d.data_rows", "a.news_articles", "a.latest_news_date",
        F.coalesce(F.nullif(notes, F.lit("")), F.lit("Latest evaluation available from the local model artifact.")).alias("narrative"),
        L.model_health(
            F.coalesce("nlp_directional_accuracy", accuracy), F.col("nlp_model_mape"), F.col("baseline_mape"), gain
        ).alias("health"),
    )


# --- snapshots and drivers ---------------------------------------------------------------------

def driver_volatility(bars: DataFrame) -> DataFrame:
    """Deviation of the returns between the positive closes of the last 21 rows."""
    recent = latest_rows(bars, 21).where("close > 0")
    w = W.partitionBy("ticker").orderBy(F.desc("recency"))
    r = recent.select("ticker", (F.col("close") / F.lag("close", 1).over(w) - 1).alias("r"))
    return r.groupBy("ticker").agg(F.stddev_samp("r").alias("fallback_volatility"))


def technical_snapshot(features: DataFrame) -> DataFrame:
    """Latest features per ticker, with fall-backs from the recent rows."""
    recent = latest_rows(
        features.select("ticker", *[c for c in HISTORY_COLUMNS if c in features.columns]), 21
    )

    def at(c, place=1):
        return F.max(F.when(F.col("recency") == place, F.col(c)))

    rows = recent.groupBy("ticker").agg(
        *[at(c).alias(c) for c in ("date", "close", "SMA_20", "SMA_50", "volume", "return_5d", "volume_ratio_20", "volatility_20d")],
        at("close", 6).alias("_close_6"),
        F.avg(F.when(F.col("recency") <= 20, F.col("volume"))).alias("_volume_20"),
    ).join(driver_volatility(features.select("ticker", "date", "close")), "ticker", "left")
    close = F.col("close")
    momentum = F.coalesce("return_5d", safe_div(close, F.col("_close_6")) - 1)
    ratio = F.coalesce("volume_ratio_20", safe_div(F.col("volume").cast("double"), F.col("_volume_20")))
    volatility = F.coalesce("volatility_20d", "fallback_volatility")
    return rows.select(
        "ticker", "date", "close", F.col("SMA_20").alias("sma20"), F.col("SMA_50").alias("sma50"),
        L.trend_label(close, F.col("SMA_20"), F.col("SMA_50")).alias("trend"),
        momentum.alias("momentum_return"), L.momentum_label(momentum).alias("momentum"),
        ratio.alias("volume_ratio"), L.volume_label(ratio).alias("volume"),
        volatility.alias("volatility"), L.volatility_label(volatility).alias("volatility_label"),
    )


def ticker_predictions(universe: DataFrame, model_output: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One answer per ticker: the model's, else a technical snapshot, else nothing known.

    `model_output` holds one latest row per ticker with predicted_return, predicted_direction,
    probability_up, volatility_20d, news_count, sentiment_mean, neutralized and model_type.
    """
    m = model_output.select(
        "ticker", F.col("date").alias("m_date"), F.col("close").alias("m_close"), F.col("sector").alias("m_sector"),
        "predicted_return", "predicted_direction", "probability_up", F.col("volatility_20d").alias("m_vol"),
        F.col("news_count").alias("m_news"), F.col("sentiment_mean").alias("m_mood"), "neutralized", "model_type",
    )
    s = snapshot.select("ticker", F.col("date").alias("s_date"), F.col("close").alias("s_close"))
    names = universe.select("ticker", F.col("sector").alias("u_sector")).unionByName(
        model_output.select("ticker", F.lit(None).cast("string").alias("u_sector"))
    ).groupBy("ticker").agg(F.max("u_sector").alias("u_sector"))
    rows = names.join(m, "ticker", "left").join(s, "ticker", "left")
    ok = F.col("predicted_return").isNotNull()
    shot = ~ok & F.col("s_date").isNotNull()
    with_news = ok & (F.coalesce("m_news", F.lit(0.0)) > 0)
    full = with_news & ~F.coalesce("neutralized", F.lit(False))
    confidence = F.coalesce(
        L.confidence_from_probability(F.col("probability_up")),
        L.confidence_from_return(F.col("predicted_return"), F.coalesce("m_vol", F.lit(0.0))),
    )
    mode = F.when(full, "full").when(ok, "technical_only").when(shot, "technical_snapshot")
    return rows.select(
        "ticker",
        F.when(ok, "ok").when(shot, "technical_snapshot").otherwise("missing_ticker").alias("status"),
        F.when(ok, F.col("m_date")).otherwise(F.col("s_date")).alias("date"),
        F.when(ok, F.coalesce(_filled("m_sector"), F.lit("UNKNOWN"))).otherwise(F.coalesce("u_sector", F.lit("UNKNOWN"))).alias("sector"),
        F.when(ok, F.col("m_close")).otherwise(F.col("s_close")).alias("close"),
        "predicted_return", "predicted_direction", "probability_up",
        F.when(ok, confidence).alias("confidence"), mode.alias("prediction_mode"),
        with_news.alias("nlp_available"),
        F.when(ok, F.coalesce(F.col("m_news").cast("bigint"), F.lit(0))).otherwise(F.lit(0)).alias("news_count"),
        F.when(ok, F.coalesce("m_mood", F.lit(0.0))).otherwise(F.lit(0.0)).alias("sentiment_score"),
        F.when(with_news, L.sentiment_label(F.col("m_mood"))).otherwise("Neutral").alias("overall_sentiment"),
        F.when(full, FULL_SIGNAL_TEXT).when(
            ok, "Prediction is based on technical market features. News sentiment is not available for this ticker yet."
        ).otherwise(NOT_IN_UNIVERSE_TEXT).alias("message"),
        F.when(full, F.lit(None).cast("string")).when(ok, LIMITED_NEWS_NOTE).when(shot, LIMITED_MODEL_NOTE).alias("confidence_note"),
        "model_type",
    )


def prediction_drivers(snapshot: DataFrame, predictions: DataFrame, summary: DataFrame) -> DataFrame:
    """Six drivers per ticker with value, status and score, and one summary text."""
    s = snapshot.alias("s")
    p = predictions.select(
        "ticker", F.col("status").alias("p_status"), F.when(F.col("status") == "ok", F.col("confidence")).alias("p_conf"),
        F.col("confidence").alias("p_raw"), F.col("predicted_direction").alias("p_dir"),
    )
    n = summary.select("ticker", F.col("news_count").alias("n_count"), F.col("sentiment_mean").alias("n_mood"), F.col("overall_sentiment").alias("n_label"))
    rows = p.join(s, "ticker", "left").join(n, "ticker", "left")
    has_news = F.coalesce("n_count", F.lit(0)) > 0
    mood = F.when(has_news, F.col("n_mood"))
    trend = L.bounded_score(L.relative_position(F.col("close"), F.col("sma50")))
    momentum = L.bounded_score(F.col("momentum_return"))
    volume = L.bounded_score((F.col("volume_ratio") - 1) / 2)
    swing = F.least(F.coalesce("volatility", F.lit(0.0)) / F.lit(0.08), F.lit(1.0))
    conf = F.col("p_conf")
    scored = rows.select(
        "ticker", "date", "p_status", "p_raw", "p_dir", has_news.alias("has_news"), F.coalesce("n_label", F.lit("Neutral")).alias("n_label"),
        *[e.alias(c) for c, e in {
            "v1": F.coalesce("trend", F.lit("No price signal")), "s1": trend, "t1": L.score_status(trend),
            "v2": L.momentum_label(F.col("momentum_return")), "s2": momentum, "t2": L.score_status(momentum),
            "v3": L.volume_label(F.col("volume_ratio")), "s3": F.abs(volume),
            "t3": F.when(F.col("volume_ratio") >= 1, "positive").otherwise("neutral"),
            "v4": F.when(has_news, L.sentiment_label(F.col("n_mood"))).otherwise(NO_NEWS_THEME),
            "s4": F.abs(L.bounded_score(mood)), "t4": L.signed_status(mood),
            "v5": L.volatility_label(F.col("volatility")), "s5": swing,
            "t5": F.when(swing > 0.65, "negative").otherwise("neutral"),
            "v6": L.confidence_label(conf), "s6": F.coalesce(conf, F.lit(0.0)),
            "t6": F.when(F.coalesce(conf, F.lit(0.0)) >= 0.5, "positive").otherwise("neutral"),
        }.items()],
    )
    items = F.array(*[
        F.struct(
            F.lit(i).alias("place"), F.lit(key).alias("driver"), F.lit(label).alias("label"),
            F.col(f"v{i}").alias("value"), F.col(f"t{i}").alias("status"), F.col(f"s{i}").alias("score"),
        )
        for i, (key, label) in enumerate(DRIVER_LABELS, start=1)
    ])
    best = F.array_max(F.transform(items, lambda d: F.struct(F.abs(d["score"]).alias("a"), (-d["place"]).alias("b"), d["label"].alias("label"))))["label"]
    listed = scored.withColumn("strongest", best).withColumn("summary", _driver_text())
    return listed.select("ticker", "date", "strongest", "summary", F.inline(items))


def _driver_text() -> Column:
    t, strongest = F.col("ticker"), F.col("strongest")
    side = F.when(F.col("p_dir") == 1, "up").otherwise("down")
    level = F.lower(L.confidence_label(F.col("p_raw")))
    modeled = F.concat(t, F.lit(" is currently modeled "), side, F.lit(" with "), level, F.lit(" confidence"))
    return (
        F.when(
            F.col("p_status") == "technical_snapshot",
            F.concat(
                t, F.lit(" is shown in technical snapshot mode because model confidence is limited. The strongest available driver is "),
                strongest, F.lit(", while news sentiment is unavailable."),
            ),
        )
        .when(
            F.col("p_status") != "ok",
            F.concat(
                F.lit("Technical signals are limited for "), t,
                F.lit(", but latest price movement and volatility are still available when price features exist."),
            ),
        )
        .when(
            ~F.col("has_news"),
            F.concat(
                modeled, F.lit(" in technical-only mode. The strongest available driver is "), strongest,
                F.lit(". News sentiment is unavailable for this ticker."),
            ),
        )
        .otherwise(
            F.concat(
                modeled, F.lit(". The strongest available driver is "), strongest,
                F.lit(", while latest news sentiment is "), F.lower("n_label"), F.lit("."),
            )
        )
    )
