"""Registered queries of the latest-state views, labels, profiles and positions."""

from pyspark.sql import functions as F

from ..constants import PRICE_FEATURES
from ..functions import labels as L, urls as U
from ..functions.numeric import finite_number, number, text10, whole
from ..operators import correlation, serving, technical, upsert, valuation
from ..sources import files, views
from . import derived, price_queries
from .derived import rounded
from .sqlkit import rnd, sql

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# --- movers, slices, history -------------------------------------------------------------------

MOVE = f"ticker, symbol, name, date, {rnd('close', 4)} AS close, {rnd('previous_close', 4)} AS previous_close, {rnd('change', 4)} AS change, {rnd('change_pct')} AS change_pct"


@query("movers", sql(f"""SELECT * FROM (SELECT 'gainers' AS side, row_number() OVER (ORDER BY change_pct DESC, ticker) AS place, {MOVE} FROM moves
    UNION ALL SELECT 'losers', row_number() OVER (ORDER BY change_pct, ticker), {MOVE} FROM moves) WHERE place <= 10"""))
def movers(spark, sf):
    return rounded(serving.movers(views.bars(spark, sf), views.universe(spark, sf), 10), 4, change_pct=6)


WIDE_TWO = """SELECT ticker, max(close) FILTER (k = 1) AS close, max(close) FILTER (k = 2) AS previous_close FROM
    (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars_wide) WHERE k <= 2 GROUP BY ticker"""


@query("movers_wide", sql(f"""SELECT side, place, ticker, {rnd('close / previous_close - 1')} AS change_pct FROM (
    SELECT 'gainers' AS side, row_number() OVER (ORDER BY close / previous_close DESC, ticker) AS place, * FROM w2 WHERE previous_close > 0
    UNION ALL SELECT 'losers', row_number() OVER (ORDER BY close / previous_close, ticker), * FROM w2 WHERE previous_close > 0) WHERE place <= 20""", w2=WIDE_TWO))
def movers_wide(spark, sf):
    out = serving.movers(views.bars_wide(spark, sf), views.universe_wide(spark, sf), 20)
    return rounded(out.select("side", "place", "ticker", "change_pct"))


@query("period_filter", sql("SELECT ticker, date, volume FROM bars WHERE date >= (SELECT max(date) - INTERVAL 6 MONTH FROM bars)"))
def period_filter(spark, sf):
    return serving.period_filter(views.bars(spark, sf), "6mo").select("ticker", "date", "volume")


@query("ohlcv_slice", sql(f"""SELECT CAST(date AS VARCHAR) AS date, {rnd('open', 4)} AS open, {rnd('high', 4)} AS high, {rnd('low', 4)} AS low, {rnd('close', 4)} AS close,
    volume, yfinance_symbol AS symbol FROM bars WHERE ticker = 'NATION_12' AND date >= (SELECT date_trunc('year', max(date)) FROM bars WHERE ticker = 'NATION_12')"""))
def ohlcv_slice(spark, sf):
    return rounded(serving.ohlcv_slice(views.bars(spark, sf), "nation_12.jk", "ytd"), 4)


HISTORY = f"SELECT ticker, date, {rnd('open', 4)} AS open, {rnd('high', 4)} AS high, {rnd('low', 4)} AS low, {rnd('close', 4)} AS close, volume"


@query("price_history", sql(HISTORY + " FROM bars"))
def price_history(spark, sf):
    return rounded(serving.price_history(views.bars(spark, sf)), 4)


CHART = [c for c in serving.HISTORY_COLUMNS if c in PRICE_FEATURES]


@query("feature_history", sql(
    f"""SELECT b.ticker, b.date, {", ".join(f"{rnd(f'b.{c}', 4)} AS {c}" for c in ("open", "high", "low", "close"))}, b.volume, {", ".join(f"p.{c}" for c in CHART)}
        FROM bars b JOIN features p ON p.ticker = b.ticker AND p.date = b.date QUALIFY row_number() OVER (PARTITION BY b.ticker ORDER BY b.date DESC) <= 260""",
    True, **price_queries.FEATURE_STEPS, features=price_queries.ALL_FEATURES))
def feature_history(spark, sf):
    features = technical.price_features(views.bars(spark, sf))
    return rounded(serving.feature_history(features), 6, **{**price_queries.LEVELS, **dict.fromkeys(("open", "high", "low", "close"), 4)})


CANDLES = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END AS c, CASE WHEN o_orderpriority LIKE '2%' THEN 0 ELSE o_custkey END AS v FROM orders"""


@query("candles_valid", sql(f"SELECT o_orderkey, date, {rnd('c', 4)} AS close, CAST(v AS DOUBLE) AS volume FROM raw WHERE date IS NOT NULL AND c IS NOT NULL", raw=CANDLES))
def candles_valid(spark, sf):
    price = F.col("o_totalprice").cast("string")
    rows = views.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date"),
        price.alias("open"), price.alias("high"), price.alias("low"),
        F.when(F.col("o_orderpriority").startswith("1"), "NaN").otherwise(price).alias("close"),
        F.when(F.col("o_orderpriority").startswith("2"), None).otherwise(F.col("o_custkey").cast("string")).alias("volume"),
    )
    return rounded(serving.candles_valid(rows).select("o_orderkey", "date", "close", "volume"), 4)


# --- universe ----------------------------------------------------------------------------------

@query("symbol_lookup", sql("SELECT ticker, yfinance_symbol AS symbol, market_cap_rank AS rank FROM wide_universe"))
def symbol_lookup(spark, sf):
    return serving.symbol_lookup(views.universe_wide(spark, sf))


@query("stock_options", sql("""SELECT u.ticker, name, sector, market_cap_rank AS universe_rank, coalesce(n, 0) AS price_points, coalesce(n, 0) > 0 AS has_price
    FROM universe u LEFT JOIN (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) b USING (ticker)"""))
def stock_options(spark, sf):
    return serving.stock_options(views.universe(spark, sf), views.bars(spark, sf))


@query("sector_counts", sql("SELECT sector, count(*) AS stocks FROM wide_universe GROUP BY sector"))
def sector_counts(spark, sf):
    return serving.sector_counts(views.universe_wide(spark, sf))


@query("upsert_universe", sql("""SELECT ticker, CASE WHEN sector = 'ASIA' THEN ticker || ' new' ELSE name END AS name, sector FROM wide_universe"""))
def upsert_universe(spark, sf):
    u = views.universe_wide(spark, sf)
    old = u.where("sector <> 'EUROPE'")
    new = u.where(F.col("sector").isin("ASIA", "EUROPE")).withColumn("name", F.when(F.col("sector") == "ASIA", F.concat("ticker", F.lit(" new"))).otherwise(F.col("name")))
    return upsert.merge_universe(old, new).select("ticker", "name", "sector")


def _profiles(spark, sf):
    """Universe, static profiles (every nation with a site) and cache (one region renamed)."""
    u = views.universe_wide(spark, sf)
    key = F.col("market_cap_rank")
    static = u.select(
        F.concat("ticker", F.lit(".JK")).alias("ticker"), F.concat(F.lit("Company "), key.cast("string")).alias("company_name"),
        F.when(key % 3 == 0, F.concat(F.lit("www.site"), key.cast("string"), F.lit(".example"))).alias("domain"),
        F.when(key % 3 == 1, F.concat(F.lit("https://www.shop"), key.cast("string"), F.lit(".example/about"))).alias("website"),
        F.when(key % 5 == 0, F.lit("https://logo.example/x.png")).alias("logo_url"),
        F.when(key % 5 == 0, F.lit("file")).alias("logo_source"), F.lit("").alias("metadata_source_url"),
    )
    cache = u.where("sector = 'ASIA'").select(F.upper("ticker").alias("ticker"), F.lit("Cached").alias("name"), F.lit("").alias("sector"))
    return u.withColumn("ticker", F.upper("ticker")), serving.static_profiles(static), cache


PROFILE = """
  SELECT *, CASE WHEN lk IS NOT NULL THEN lk WHEN domain IS NOT NULL THEN 'https://img.logo.dev/' || domain || '?size=128&format=png&fallback=404' END AS logo_url,
         CASE WHEN lk IS NOT NULL THEN 'file' WHEN domain IS NOT NULL THEN 'Logo.dev domain lookup' END AS logo_source
  FROM (SELECT upper(ticker) AS ticker, ticker || '.JK' AS symbol, CASE WHEN sector = 'ASIA' THEN 'Cached' ELSE 'Company ' || market_cap_rank END AS name, sector,
        CASE market_cap_rank % 3 WHEN 0 THEN 'site' || market_cap_rank || '.example' WHEN 1 THEN 'shop' || market_cap_rank || '.example' END AS domain,
        CASE market_cap_rank % 3 WHEN 0 THEN 'https://site' || market_cap_rank || '.example' WHEN 1 THEN 'https://www.shop' || market_cap_rank || '.example/about' END AS website,
        CASE WHEN market_cap_rank % 5 = 0 THEN 'https://logo.example/x.png' END AS lk, market_cap_rank AS rank FROM wide_universe)"""


@query("profile_merge", sql("SELECT ticker, symbol, name, sector, domain, website, logo_url, logo_source, rank FROM p", p=PROFILE))
def profile_merge(spark, sf):
    out = serving.merge_profiles(*_profiles(spark, sf))
    return out.select("ticker", "symbol", "name", "sector", "domain", "website", "logo_url", "logo_source", "rank")


@query("company_profile", sql("""SELECT ticker, symbol, name, sector, website FROM p UNION ALL SELECT 'IHSG', '^JKSE', 'IDX Composite', 'Index', ''
    UNION ALL SELECT upper(s_name) || 'X', upper(s_name) || 'X.JK', upper(s_name) || 'X', 'UNKNOWN', NULL FROM supplier""", p=PROFILE))
def company_profile(spark, sf):
    u, static, cache = _profiles(spark, sf)
    asked = u.select("ticker").unionByName(u.select(F.concat("ticker", F.lit("X.jk")).alias("ticker"))).unionByName(
        u.select(F.when(F.col("market_cap_rank") % 2 == 0, "ihsg").otherwise("^JKSE").alias("ticker")))
    return serving.company_profiles(u, static, cache, asked).select("ticker", "symbol", "name", "sector", "website")


@query("logo_candidates", """SELECT page_id, CASE WHEN h <> '' THEN 'https://img.logo.dev/' || regexp_replace(h, '^www\\.', '') || '?size=128&format=png&fallback=404' END AS first,
    CASE WHEN h <> '' THEN CAST(4 AS INTEGER) ELSE 0 END AS n, regexp_replace(h, '^www\\.', '') AS domain FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS h FROM pages)""")
def logo_candidates(spark, sf):
    none = F.lit(None).cast("string")
    listed = U.logo_candidates(none, none, F.col("url"))
    return views.table(spark, sf, "pages").select(
        "page_id", F.get(listed, F.lit(0)).alias("first"), F.size(listed).alias("n"), U.profile_domain(none, F.col("url")).alias("domain")
    )


# --- predictions -------------------------------------------------------------------------------

@query("normalize_prediction_rows", sql(f"""SELECT ticker, date, sector, {rnd('close', 4)} AS close, {rnd('predicted_return')} AS predicted_return, predicted_direction,
    {rnd('probability_up')} AS probability_up, {rnd('confidence')} AS confidence, 'formula' AS model_name, 'unknown' AS model_type FROM predictions"""))
def normalize_prediction_rows(spark, sf):
    return rounded(derived.predictions(spark, sf), 6, close=4)


SCORE = """coalesce(predicted_return, probability_up - 0.5, CASE WHEN predicted_direction = 1 THEN confidence WHEN predicted_direction = 0 THEN -confidence END)"""
BAND = "CASE WHEN predicted_return > 0.001 THEN 'UP' WHEN predicted_return < -0.001 THEN 'DOWN' ELSE 'NEUTRAL' END"
WATCH_DIR = f"CASE WHEN predicted_direction = 1 THEN 'UP' WHEN predicted_direction = 0 THEN 'DOWN' ELSE {BAND} END"
RANK_DIR = f"CASE WHEN predicted_return IS NOT NULL THEN {BAND} ELSE {WATCH_DIR} END"


@query("rank_enrich", sql(f"SELECT ticker, ticker AS company_name, ticker || '.JK' AS symbol, sector, {RANK_DIR} AS direction, {rnd('s')} AS ranking_score FROM r WHERE s IS NOT NULL",
                          r=f"SELECT *, {SCORE} AS s FROM predictions"))
def rank_enrich(spark, sf):
    out = serving.enrich_rankings(derived.predictions(spark, sf), views.universe(spark, sf))
    return rounded(out.select("ticker", "company_name", "symbol", "sector", "direction", "ranking_score"))


@query("prediction_rankings", sql(
    f"""SELECT * FROM (SELECT 'up' AS side, row_number() OVER (ORDER BY s DESC, ticker) AS place, ticker, {rnd('s')} AS ranking_score FROM r
        UNION ALL SELECT 'down', row_number() OVER (ORDER BY s, ticker), ticker, {rnd('s')} FROM r) WHERE place <= 7""",
    r=f"SELECT * FROM (SELECT *, {SCORE} AS s FROM predictions) WHERE s IS NOT NULL"))
def prediction_rankings(spark, sf):
    out = serving.prediction_rankings(derived.predictions(spark, sf), views.universe(spark, sf), 7)
    return rounded(out.select("side", "place", "ticker", "ranking_score"))


@query("prediction_direction", sql(f"""SELECT ticker, {WATCH_DIR} AS watch, {RANK_DIR} AS ranking,
    CASE predicted_direction WHEN 1 THEN 'Up' WHEN 0 THEN 'Down' ELSE 'Unknown' END AS label FROM predictions"""))
def prediction_direction(spark, sf):
    d, r = F.col("predicted_direction"), F.col("predicted_return")
    return derived.predictions(spark, sf).select(
        "ticker", L.watchlist_direction(d, r).alias("watch"), L.ranking_direction(d, r).alias("ranking"), L.direction_label(d).alias("label")
    )


@query("confidence", sql(f"""SELECT ticker, date, {rnd('least(abs(probability_up - 0.5) * 2, 1.0)')} AS from_probability,
    {rnd('least(abs(predicted_return) / CASE WHEN coalesce(v, 0) = 0 THEN 0.02 ELSE abs(v) END, 1.0)')} AS from_return,
    {rnd('CASE WHEN predicted_direction = 1 THEN 0.5 + c * 0.5 ELSE 0.5 - c * 0.5 END')} AS implied
    FROM (SELECT *, CASE WHEN direction = 1 THEN 0.0 ELSE other_return END AS v, least(abs(probability_up - 0.5) * 2, 1.0) AS c FROM scored)"""))
def confidence(spark, sf):
    v = F.when(F.col("direction") == 1, 0.0).otherwise(F.col("other_return"))
    p = F.col("probability_up")
    return rounded(derived.scored(spark, sf).select(
        "ticker", "date", L.confidence_from_probability(p).alias("from_probability"),
        L.confidence_from_return(F.col("predicted_return"), v).alias("from_return"),
        L.probability_from_prediction(F.col("predicted_direction"), L.confidence_from_probability(p)).alias("implied"),
    ))


# --- watchlist ---------------------------------------------------------------------------------

WATCH = {
    "wl": f"""SELECT u.ticker, u.ticker AS company_name, u.sector, u.market_cap_rank AS rank, t.date, t.close AS last_price, t.close - t.previous_close AS daily_change,
        t.close / t.previous_close - 1 AS daily_change_pct, t.volume, {WATCH_DIR} AS prediction_direction, predicted_return AS prediction_return, confidence AS prediction_confidence
        FROM universe u LEFT JOIN two t USING (ticker) LEFT JOIN (SELECT ticker, predicted_return, predicted_direction, confidence FROM predictions) p USING (ticker)""",
}


def _watch(spark, sf):
    return serving.watchlist_rows(views.universe(spark, sf), views.bars(spark, sf), derived.predictions(spark, sf))


WL_COLS = f"ticker, sector, rank, date, {rnd('last_price', 4)} AS last_price, {rnd('daily_change', 4)} AS daily_change, {rnd('daily_change_pct')} AS daily_change_pct, volume, prediction_direction, {rnd('prediction_return')} AS prediction_return"
WL_NAMES = ["ticker", "sector", "rank", "date", "last_price", "daily_change", "daily_change_pct", "volume", "prediction_direction", "prediction_return"]


@query("watchlist_join", sql(f"SELECT {WL_COLS} FROM wl", **WATCH))
def watchlist_join(spark, sf):
    return rounded(_watch(spark, sf).select(*WL_NAMES), 6, last_price=4, daily_change=4)


@query("watchlist", sql(f"SELECT {WL_COLS}, (SELECT count(last_price) FROM wl) AS available_tickers FROM wl ORDER BY last_price IS NULL, rank, ticker LIMIT 100", **WATCH))
def watchlist(spark, sf):
    out = serving.watchlist(views.universe(spark, sf), views.bars(spark, sf), derived.predictions(spark, sf), 100)
    return rounded(out.select(*WL_NAMES, "available_tickers"), 6, last_price=4, daily_change=4)


@query("watchlist_filter", sql("SELECT 'volume' AS kept, ticker FROM wl WHERE volume >= (SELECT median(volume) FROM wl) UNION ALL SELECT 'gainers', ticker FROM wl WHERE daily_change_pct > 0 AND ticker LIKE '%1%' UNION ALL SELECT 'down', ticker FROM wl WHERE prediction_direction = 'DOWN'", **WATCH))
def watchlist_filter(spark, sf):
    rows = _watch(spark, sf)
    parts = [
        serving.watchlist_filter(rows, query, keep, sort).select(F.lit(keep).alias("kept"), "ticker")
        for query, keep, sort in (("", "volume", "volume"), ("1", "gainers", "change"), ("nation", "down", "confidence"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- news views --------------------------------------------------------------------------------

OWN = """SELECT ticker, ingest_order, date, score, identity, 'ticker' AS scope, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ingest_order) AS place FROM scored_news"""
MARKET = "SELECT ingest_order, date, score, identity, row_number() OVER (ORDER BY date DESC, ingest_order) AS place FROM scored_news QUALIFY place <= 8"
FEED = {
    "own_all": OWN, "own": "SELECT * FROM own_all WHERE place <= 8", "market_rows": MARKET,
    "few": "SELECT u.ticker FROM asked u LEFT JOIN (SELECT ticker, count(*) AS n FROM own GROUP BY ticker) o USING (ticker) WHERE coalesce(n, 0) < 6",
    "extra": """SELECT ticker, ingest_order, date, score, identity, 'market' AS scope, place FROM few JOIN market_rows m ON true
                WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.ticker = few.ticker AND own.identity = m.identity)
                QUALIFY row_number() OVER (PARTITION BY ticker, identity ORDER BY place) = 1""",
    "merged": """SELECT ticker, ingest_order, date, score, scope, row_number() OVER (PARTITION BY ticker ORDER BY scope DESC, place) AS pos
                 FROM (SELECT * FROM own WHERE ticker IN (SELECT ticker FROM asked) UNION ALL SELECT * FROM extra)""",
    "feed": "SELECT ticker, ingest_order, date, score, scope, pos AS place FROM merged WHERE pos <= 8",
}
FEED = {"asked": "SELECT ticker FROM universe UNION ALL SELECT upper(s_name) FROM supplier", **FEED}
LABEL = "CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} > 0.05 THEN 'Positive' WHEN {0} < -0.05 THEN 'Negative' ELSE 'Neutral' END"


def _asked(spark, sf):
    """Every nation (with news) and every supplier (without any)."""
    return views.universe(spark, sf).select("ticker").unionByName(views.universe_wide(spark, sf).select("ticker"))


def _feed(spark, sf):
    return serving.news_feed(derived.scored_news(spark, sf), _asked(spark, sf), 8)


@query("news_feed", sql(f"SELECT ticker, place, scope, ingest_order, date, {rnd('score')} AS sentiment_score, {LABEL.format('score')} AS sentiment_label FROM feed", **FEED))
@views.shared
def news_feed(spark, sf):
    out = _feed(spark, sf).select("ticker", F.col("place").cast("bigint").alias("place"), "scope", "ingest_order", "date", "sentiment_score", "sentiment_label")
    return rounded(out)


@query("context_message", sql("""SELECT asked.ticker, CASE WHEN bool_or(coalesce(scope, '') = 'market') THEN 'Showing recent market news when ticker-specific news is limited'
    ELSE 'Using latest available market news' END AS message FROM asked LEFT JOIN feed USING (ticker) GROUP BY asked.ticker""", **FEED))
def context_message(spark, sf):
    return serving.feed_context(_feed(spark, sf), _asked(spark, sf))


@query("sentiment_label", sql(f"""SELECT ingest_order, {LABEL.format('score')} AS label, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS status FROM scored_news"""))
def sentiment_label(spark, sf):
    s = F.col("score")
    return derived.scored_news(spark, sf).select("ingest_order", L.sentiment_label(s).alias("label"), L.signed_status(s).alias("status"))


@query("classifier_label_to_score", f"""SELECT doc_id, {rnd("CASE WHEN lang IN ('en', 'fr') THEN -s WHEN lang = 'de' THEN s ELSE 0.0 END", 6)} AS score
    FROM (SELECT doc_id, lang, n_chars / 1000.0 AS s FROM documents)""")
def classifier_label_to_score(spark, sf):
    lang = F.col("lang")
    label = F.when(lang == "en", "NEGATIVE").when(lang == "fr", "LABEL_0").when(lang == "de", "LABEL_2").otherwise("neutral")
    return rounded(views.table(spark, sf, "documents").select("doc_id", L.classifier_score(label, F.col("n_chars") / 1000.0).alias("score")))


@query("news_bucket_filter", sql(f"""SELECT 'negative' AS bucket, ingest_order FROM scored_news WHERE score < -0.05 UNION ALL SELECT 'none', ingest_order FROM scored_news"""))
def news_bucket_filter(spark, sf):
    rows = derived.scored_news(spark, sf).select(
        "ingest_order", F.col("score").alias("sentiment_score"), L.sentiment_label(F.col("score")).alias("sentiment_label")
    )
    hit = serving.news_bucket_filter(rows, "negative").select(F.lit("negative").alias("bucket"), "ingest_order")
    # no row ever has this bucket, so everything stays
    miss = serving.news_bucket_filter(rows, "mixed").select(F.lit("none").alias("bucket"), "ingest_order")
    return hit.unionByName(miss)


SUMMARY = {
    "last_day": "SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1",
    "recent": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ingest_order) AS place FROM scored_news QUALIFY place <= 50",
    "src": """SELECT ticker, source AS main_source FROM (SELECT ticker, source, count(*) AS n, min(place) AS p FROM recent WHERE source <> '' GROUP BY ALL)
              QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, p) = 1""",
    "heads": """SELECT ticker, count(*) AS articles, max(date) AS latest_news_date,
                first(title ORDER BY score DESC NULLS LAST, place) FILTER (score IS NOT NULL AND title <> '') AS best,
                first(title ORDER BY score ASC NULLS LAST, place) FILTER (score IS NOT NULL AND title <> '') AS worst FROM recent GROUP BY ticker""",
}


def _summary(spark, sf):
    scored = derived.scored_news(spark, sf)
    return serving.news_summary(derived.daily(spark, sf), scored, _asked(spark, sf))


@query("nlp_summary", sql(
    f"""SELECT a.ticker, d.date, {rnd('coalesce(sentiment_mean, 0.0)')} AS sentiment_mean, coalesce(news_count, 0) AS news_count,
        {rnd('coalesce(sentiment_momentum, 0.0)')} AS sentiment_momentum, CASE WHEN d.ticker IS NULL THEN 'Neutral' ELSE {LABEL.format('sentiment_mean')} END AS overall_sentiment,
        latest_news_date, md5(best) AS best, md5(worst) AS worst,
        CASE WHEN d.ticker IS NULL THEN 'News sentiment unavailable' ELSE a.ticker || ' coverage from ' || main_source END AS main_theme,
        CASE WHEN d.ticker IS NULL THEN 'Prediction is based on technical market features. News sentiment is not available for this ticker yet.'
             ELSE 'Recent news around ' || a.ticker || ' is mostly ' || lower({LABEL.format('sentiment_mean')}) || ', based on ' || articles || ' matched article rows in the local news artifact.' END AS summary_text
        FROM asked a LEFT JOIN last_day d USING (ticker) LEFT JOIN heads USING (ticker) LEFT JOIN src USING (ticker)""",
    asked=FEED["asked"], **SUMMARY))
@views.shared
def nlp_summary(spark, sf):
    out = _summary(spark, sf).select(
        "ticker", "date", "sentiment_mean", "news_count", "sentiment_momentum", "overall_sentiment", "latest_news_date",
        F.md5("top_positive_headline").alias("best"), F.md5("top_negative_headline").alias("worst"), "main_theme", "summary_text",
    )
    return rounded(out)


# --- overview, stats, model summary ------------------------------------------------------------

INDEX = "SELECT date, sum(close) AS close FROM bars GROUP BY date"


def index_bars(spark, sf):
    """Index level: sum of the closes of the day."""
    return views.bars(spark, sf).groupBy("date").agg(F.sum("close").alias("close"))


@query("market_overview", sql(
    f"""SELECT '^JKSE' AS symbol, i1.date, {rnd('i1.close', 3)} AS close, {rnd('i2.close', 3)} AS previous_close, {rnd('i1.close / i2.close - 1')} AS daily_change,
        CASE WHEN i1.close > i2.close THEN 'up' WHEN i1.close < i2.close THEN 'down' ELSE 'neutral' END AS direction,
        n AS covered_stocks, b AS bullish_count, n - b AS bearish_count, {rnd('b / n')} AS bullish_ratio, {rnd('c')} AS avg_confidence, {rnd('r')} AS avg_predicted_return,
        CASE WHEN b / n >= 0.58 THEN 'bullish' WHEN b / n <= 0.42 THEN 'bearish' ELSE 'neutral' END AS bias,
        {rnd('m')} AS sentiment_score, {LABEL.format('m')} AS sentiment_label, k AS news_count,
        (SELECT count(*) FROM moves) AS available_tickers, (SELECT ticker FROM moves ORDER BY change_pct DESC, ticker LIMIT 1) AS top_gainer,
        (SELECT ticker FROM moves ORDER BY change_pct, ticker LIMIT 1) AS top_loser
        FROM idx i1 JOIN idx i2 ON i1.p = 1 AND i2.p = 2
        JOIN (SELECT count(*) AS n, count(*) FILTER (predicted_direction = 1) AS b, avg(confidence) AS c, avg(predicted_return) AS r FROM predictions) ON true
        JOIN (SELECT avg(score) AS m, count(*) AS k FROM (SELECT score FROM scored_news ORDER BY date DESC, ingest_order LIMIT 100)) ON true""",
    idx=f"SELECT *, row_number() OVER (ORDER BY date DESC) AS p FROM ({INDEX})"))
@views.shared
def market_overview(spark, sf):
    out = serving.market_overview(index_bars(spark, sf), derived.predictions(spark, sf), derived.scored_news(spark, sf), views.bars(spark, sf))
    return rounded(out, 6, close=3, previous_close=3)


@query("dataset_stats", sql("""SELECT 'bars' AS table_name, count(*) AS rows, count(DISTINCT ticker) AS stocks, max(date) AS latest_date FROM bars
    UNION ALL SELECT 'news', count(*), count(DISTINCT ticker), max(date) FROM news UNION ALL SELECT 'universe', count(*), count(DISTINCT ticker), NULL FROM universe"""))
def dataset_stats(spark, sf):
    return serving.dataset_stats({"bars": views.bars(spark, sf), "news": views.news(spark, sf), "universe": views.universe(spark, sf)})


LANDED = {"lineitem": "l_shipdate", "orders": "o_orderdate", "documents": None, "pages": None, "absent": None}


@query("artifact_status", sql(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, true AS exists, true AS has_bytes, count(*) AS rows, {f'CAST(max({d}) AS DATE)' if d else 'CAST(NULL AS DATE)'} AS latest_date FROM {t}"
    for t, d in LANDED.items() if t != "absent") + " UNION ALL SELECT 'absent', false, false, 0, NULL"))
def artifact_status(spark, sf):
    """Landed tables by listing and footers; of data only the timestamps are read."""
    return files.table_status(spark, sf, LANDED).select(
        "table_name", "exists", F.coalesce(F.col("size_bytes") > 0, F.lit(False)).alias("has_bytes"), "rows", "latest_date")


@query("artifact_validate", sql("""SELECT 'bars' AS table_name, true AS exists, count(*) AS rows, max(date) AS latest_date, '' AS missing_columns, 'ok' AS verdict FROM bars
    UNION ALL SELECT 'news', true, count(*), max(date), 'language', 'missing columns' FROM news UNION ALL SELECT 'predictions', true, count(*), max(CAST(date AS DATE)), '', 'ok' FROM predictions
    UNION ALL SELECT 'report', false, 0, NULL, 'comparison', 'missing'"""))
def artifact_validate(spark, sf):
    tables = {"bars": views.bars(spark, sf), "news": views.news(spark, sf), "predictions": derived.predictions(spark, sf), "report": None}
    needed = {"bars": ["ticker", "close"], "news": ["ticker", "language"], "predictions": ["ticker"], "report": ["comparison"]}
    return upsert.validate_tables(tables, needed, spark)


@query("model_summary", sql(
    f"""SELECT {rnd('b.mape', 4)} AS baseline_mape, {rnd('n.mape', 4)} AS nlp_model_mape, {rnd('g', 2)} AS improvement_pct,
        {rnd('n.directional_accuracy', 4)} AS directional_accuracy, CAST(NULL AS DOUBLE) AS direction_classifier_accuracy, {rnd('n.rank_ic', 4)} AS rank_ic,
        {rnd('n.top_n_excess_return', 4)} AS top_n_excess_return, (SELECT count(DISTINCT ticker) FROM scored) AS stocks_covered, (SELECT count(*) FROM scored) AS data_rows,
        (SELECT count(*) FROM news) AS news_articles, (SELECT max(date) FROM news) AS latest_news_date,
        CASE WHEN g > 0 THEN 'NLP features improved return error in the latest evaluation run.' ELSE 'NLP model currently performs in line with the technical baseline.' END
          || CASE WHEN (SELECT count(*) FROM news) < 250 THEN ' News coverage is limited in the latest artifact, so NLP lift may be muted.' ELSE '' END AS narrative,
        CASE WHEN (n.directional_accuracy >= 0.53 AND n.mape <= b.mape) OR n.mape <= 0.08 THEN 'Operational' WHEN g <= 0 THEN 'Technical Baseline Stable' ELSE 'Model Active' END AS health
        FROM (SELECT *, (SELECT mape FROM mean_a) AS bm FROM mean_b) n JOIN mean_a b ON true JOIN (SELECT round((x.mape - y.mape) / x.mape * 100, 6) AS g FROM mean_a x JOIN mean_b y ON true) ON true""",
    **price_queries.COMPARED))
@views.shared
def model_summary(spark, sf):
    compared = price_queries.comparison(spark, sf)
    return rounded(serving.model_summary(compared, derived.scored(spark, sf), views.news(spark, sf)), 4, improvement_pct=2)


@query("model_health", sql("""SELECT ticker, date, CASE WHEN (abs(predicted_return) >= 0.53 AND coalesce(abs(other_return) <= abs(target_return), true)) OR abs(other_return) <= 0.08 THEN 'Operational'
    WHEN predicted_return <= 0 THEN 'Technical Baseline Stable' ELSE 'Model Active' END AS health FROM scored"""))
def model_health(spark, sf):
    return derived.scored(spark, sf).select("ticker", "date", L.model_health(
        F.abs("predicted_return"), F.abs("other_return"), F.abs("target_return"), F.col("predicted_return")).alias("health"))


# --- labels, snapshot, drivers -----------------------------------------------------------------

MOMENTUM = "CASE WHEN {0} IS NULL THEN 'No recent momentum' WHEN {0} > 0.03 THEN 'Strong bullish' WHEN {0} > 0.005 THEN 'Mild bullish' WHEN {0} < -0.03 THEN 'Strong bearish' WHEN {0} < -0.005 THEN 'Mild bearish' ELSE 'Sideways' END"
VOLUME = "CASE WHEN {0} IS NULL THEN 'No volume signal' WHEN {0} >= 1.5 THEN 'High activity' WHEN {0} >= 1.05 THEN 'Moderate activity' WHEN {0} <= 0.65 THEN 'Quiet trading' ELSE 'Normal activity' END"
VOLATILITY = "CASE WHEN {0} IS NULL THEN 'No volatility signal' WHEN {0} >= 0.05 THEN 'High' WHEN {0} >= 0.025 THEN 'Moderate' ELSE 'Low' END"
CONFIDENCE = "CASE WHEN {0} IS NULL THEN 'No model signal' WHEN {0} >= 0.65 THEN 'High' WHEN {0} >= 0.35 THEN 'Moderate' ELSE 'Low' END"
TREND = "CASE WHEN close IS NULL THEN 'No price signal' WHEN close > s20 AND close > s50 THEN 'Above key moving averages' WHEN close < s50 THEN 'Below SMA 50' WHEN close < s20 THEN 'Below SMA 20' ELSE 'Mixed trend' END"


@query("labels_by_threshold", sql(f"""SELECT ticker, date, {MOMENTUM.format('r5')} AS momentum, {VOLUME.format('abs(r1)')} AS volume, {VOLATILITY.format('abs(r5)')} AS volatility,
    {CONFIDENCE.format('abs(r5)')} AS confidence, CASE WHEN coalesce(r1, 0) / 0.08 > 0.1 THEN 'positive' WHEN coalesce(r1, 0) / 0.08 < -0.1 THEN 'negative' ELSE 'neutral' END AS status FROM labelled"""))
def labels_by_threshold(spark, sf):
    r1, r5 = F.col("r1"), F.col("r5")
    return derived.labelled(spark, sf).select(
        "ticker", "date", L.momentum_label(r5).alias("momentum"), L.volume_label(F.abs(r1)).alias("volume"),
        L.volatility_label(F.abs(r5)).alias("volatility"), L.confidence_label(F.abs(r5)).alias("confidence"),
        L.score_status(L.bounded_score(r1)).alias("status"),
    )


SNAP = {
    "win": """SELECT *, avg(close) OVER (w ROWS 19 PRECEDING) AS s20a, count(*) OVER (w ROWS 19 PRECEDING) AS c20, avg(close) OVER (w ROWS 49 PRECEDING) AS s50a,
        count(*) OVER (w ROWS 49 PRECEDING) AS c50, avg(volume) OVER (w ROWS 19 PRECEDING) AS v20, stddev_samp(r1) OVER (w ROWS 19 PRECEDING) AS sd, count(r1) OVER (w ROWS 19 PRECEDING) AS cr
        FROM labelled WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "snap": f"""SELECT ticker, date, close, s20, s50, {TREND} AS trend, r5 AS m, ratio, sd FROM (SELECT *, CASE WHEN c20 = 20 THEN s20a END AS s20, CASE WHEN c50 = 50 THEN s50a END AS s50,
        volume / nullif(v20, 0) AS ratio FROM win QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)""",
}


def _snapshot(spark, sf):
    return serving.technical_snapshot(technical.price_features(views.bars(spark, sf)))


@query("technical_snapshot", sql(f"""SELECT ticker, date, {rnd('close', 4)} AS close, {rnd('s20', 4)} AS sma20, {rnd('s50', 4)} AS sma50, trend, {rnd('m')} AS momentum_return,
    {MOMENTUM.format('m')} AS momentum, {rnd('ratio')} AS volume_ratio, {VOLUME.format('ratio')} AS volume, {rnd('sd')} AS volatility, {VOLATILITY.format('sd')} AS volatility_label FROM snap""", **SNAP))
def technical_snapshot(spark, sf):
    return rounded(_snapshot(spark, sf), 6, close=4, sma20=4, sma50=4)


@query("driver_volatility", sql(
    f"""SELECT ticker, {rnd('stddev_samp(r)')} AS fallback_volatility FROM (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r
        FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 21)) GROUP BY ticker"""))
def driver_volatility(spark, sf):
    return rounded(serving.driver_volatility(views.bars(spark, sf)))


def _model_output(spark, sf):
    """Formula predictions in the shape of a model's latest rows; one sector has no model row."""
    p = derived.predictions(spark, sf)
    d = derived.daily(spark, sf)
    mood = serving.latest_rows(d, 1).select("ticker", F.col("news_count").cast("double").alias("news_count"), "sentiment_mean")
    return p.where("sector <> 'AFRICA'").join(mood, "ticker", "left").select(
        "ticker", F.col("date").cast("date").alias("date"), "close", "sector", "predicted_return", "predicted_direction", "probability_up",
        F.lit(0.04).alias("volatility_20d"), "news_count", "sentiment_mean", (F.col("sector") == "ASIA").alias("neutralized"), "model_type",
    )


def _answers(spark, sf, snapshot=None):
    shot = snapshot if snapshot is not None else _snapshot(spark, sf)
    return serving.ticker_predictions(views.universe(spark, sf), _model_output(spark, sf), shot)


ANSWER = {
    **SNAP, "last_day": SUMMARY["last_day"],
    "answer": """SELECT u.ticker, CASE WHEN ok THEN 'ok' WHEN known THEN 'technical_snapshot' ELSE 'missing_ticker' END AS status, u.sector, CASE WHEN ok THEN p.predicted_return END AS predicted_return,
        CASE WHEN has THEN p.predicted_direction END AS predicted_direction, CASE WHEN has THEN p.probability_up END AS probability_up,
        CASE WHEN ok THEN coalesce(least(abs(p.probability_up - 0.5) * 2, 1.0), least(abs(p.predicted_return) / 0.04, 1.0)) END AS confidence,
        CASE WHEN ok AND coalesce(d.news_count, 0) > 0 AND u.sector <> 'ASIA' THEN 'full' WHEN ok THEN 'technical_only' WHEN known THEN 'technical_snapshot' END AS prediction_mode,
        ok AND coalesce(d.news_count, 0) > 0 AS nlp_available, CASE WHEN ok THEN coalesce(d.news_count, 0) ELSE 0 END AS news_count,
        CASE WHEN ok THEN coalesce(d.sentiment_mean, 0.0) ELSE 0.0 END AS sentiment_score, d.news_count AS day_count, d.sentiment_mean AS day_mood
        FROM (SELECT u.*, p.ticker IS NOT NULL AS known, u.sector <> 'AFRICA' AND p.ticker IS NOT NULL AS has, coalesce(p.sector <> 'AFRICA' AND predicted_return IS NOT NULL, false) AS ok
              FROM universe u LEFT JOIN predictions p USING (ticker)) u LEFT JOIN predictions p USING (ticker)
        LEFT JOIN last_day d USING (ticker)""",
}


@query("predict_ticker", sql(f"""SELECT ticker, status, sector, {rnd('predicted_return')} AS predicted_return, predicted_direction, {rnd('probability_up')} AS probability_up,
    {rnd('confidence')} AS confidence, prediction_mode, nlp_available, news_count, {rnd('sentiment_score')} AS sentiment_score FROM answer""", **ANSWER))
@views.shared
def predict_ticker(spark, sf):
    out = _answers(spark, sf)
    return rounded(out.select(
        "ticker", "status", "sector", "predicted_return", "predicted_direction", "probability_up", "confidence", "prediction_mode", "nlp_available", "news_count", "sentiment_score"))


@query("prediction_mode", sql("""SELECT ticker, prediction_mode, CASE prediction_mode WHEN 'full' THEN 'Prediction uses the latest available technical and NLP market features.'
    WHEN 'technical_only' THEN 'Prediction is based on technical market features. News sentiment is not available for this ticker yet.'
    ELSE 'Model prediction is not available for this ticker in the current training universe. Technical signals are shown from latest price features.' END AS message,
    CASE prediction_mode WHEN 'technical_only' THEN 'Limited confidence because recent NLP/news signal is unavailable.'
    WHEN 'technical_snapshot' THEN 'Limited confidence because the trained model signal is unavailable for this ticker.' END AS confidence_note FROM answer""", **ANSWER))
@views.shared
def prediction_mode(spark, sf):
    out = _answers(spark, sf)
    return out.select("ticker", "prediction_mode", "message", "confidence_note")


CLAMP = "greatest(-1.0, least(1.0, coalesce({0}, 0.0) / 0.08))"
DRIVERS = {
    **ANSWER,
    "base": f"""SELECT a.*, s.date, coalesce(s.trend, 'No price signal') AS trend, s.m, s.ratio, s.sd, coalesce(day_count, 0) > 0 AS has_news, {CLAMP.format('s.close / nullif(s.s50, 0) - 1')} AS x1, {CLAMP.format('s.m')} AS x2,
        abs({CLAMP.format('(s.ratio - 1) / 2')}) AS x3, CASE WHEN coalesce(day_count, 0) > 0 THEN abs({CLAMP.format('day_mood')}) ELSE 0.0 END AS x4,
        least(coalesce(s.sd, 0.0) / 0.08, 1.0) AS x5, coalesce(confidence, 0.0) AS x6 FROM answer a LEFT JOIN snap s USING (ticker)""",
    "long": " UNION ALL ".join(
        f"SELECT ticker, {i} AS place, '{k}' AS driver, '{label}' AS label, {value} AS value, {status} AS status, x{i} AS score FROM base"
        for i, (k, label, value, status) in enumerate([
            ("trend", "Technical trend", "trend", "CASE WHEN x1 > 0.1 THEN 'positive' WHEN x1 < -0.1 THEN 'negative' ELSE 'neutral' END"),
            ("momentum", "Market momentum", MOMENTUM.format("m"), "CASE WHEN x2 > 0.1 THEN 'positive' WHEN x2 < -0.1 THEN 'negative' ELSE 'neutral' END"),
            ("volume", "Volume pressure", VOLUME.format("ratio"), "CASE WHEN ratio >= 1 THEN 'positive' ELSE 'neutral' END"),
            ("sentiment", "News sentiment", f"CASE WHEN has_news THEN {LABEL.format('day_mood')} ELSE 'News sentiment unavailable' END",
             "CASE WHEN has_news AND day_mood > 0.05 THEN 'positive' WHEN has_news AND day_mood < -0.05 THEN 'negative' ELSE 'neutral' END"),
            ("volatility", "Volatility", VOLATILITY.format("sd"), "CASE WHEN x5 > 0.65 THEN 'negative' ELSE 'neutral' END"),
            ("model", "Model confidence", CONFIDENCE.format("confidence"), "CASE WHEN x6 >= 0.5 THEN 'positive' ELSE 'neutral' END"),
        ], start=1)
    ),
    "best": "SELECT ticker, label AS strongest FROM long QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY abs(score) DESC, place) = 1",
    "said": f"""SELECT ticker, ticker || ' is currently modeled ' || CASE WHEN predicted_direction = 1 THEN 'up' ELSE 'down' END || ' with ' || lower({CONFIDENCE.format('confidence')}) || ' confidence' AS modeled,
        strongest, status AS st, has_news, {LABEL.format('day_mood')} AS mood FROM base JOIN best USING (ticker)""",
}


@query("prediction_drivers", sql(
    f"""SELECT l.ticker, place, driver, label, value, status, {rnd('score')} AS score, s.strongest,
        CASE WHEN st = 'technical_snapshot' THEN l.ticker || ' is shown in technical snapshot mode because model confidence is limited. The strongest available driver is ' || strongest || ', while news sentiment is unavailable.'
             WHEN st = 'missing_ticker' THEN 'Technical signals are limited for ' || l.ticker || ', but latest price movement and volatility are still available when price features exist.'
             WHEN NOT has_news THEN modeled || ' in technical-only mode. The strongest available driver is ' || strongest || '. News sentiment is unavailable for this ticker.'
             ELSE modeled || '. The strongest available driver is ' || strongest || ', while latest news sentiment is ' || lower(mood) || '.' END AS summary
        FROM long l JOIN said s USING (ticker)""", **DRIVERS))
@views.shared
def prediction_drivers(spark, sf):
    snapshot = _snapshot(spark, sf)
    answers = _answers(spark, sf, snapshot)
    out = serving.prediction_drivers(snapshot, answers, _summary(spark, sf))
    return rounded(out.select("ticker", "place", "driver", "label", "value", "status", "score", "strongest", "summary"))


@query("coercions", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS number, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(trunc(value) AS BIGINT) END AS whole,
    strftime(ts, '%Y-%m-%d') AS day FROM events""")
def coercions(spark, sf):
    raw = F.when(F.col("event_type") == "error", "NaN").otherwise(F.col("value").cast("string"))
    return views.table(spark, sf, "events").select(
        "event_id", number(raw).alias("number"), whole(raw).alias("whole"), text10(F.col("ts")).alias("day")
    )


# --- positions ---------------------------------------------------------------------------------

POSITION = {
    "pos": """SELECT o_orderkey AS position_id, n_name AS ticker, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS amount,
        CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS DATE) AS entry_date,
        CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) + CAST(o_custkey % 60 - 3 AS INTEGER) AS DATE) AS exit_date, round((o_custkey % 100) / 99.0, 4) AS p
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "span": "SELECT ticker, min(date) AS first_bar, max(date) AS last_bar FROM bars GROUP BY ticker",
    "entry": """SELECT pos.*, last_bar, (SELECT min(date) FROM bars b WHERE b.ticker = pos.ticker AND b.date >= pos.entry_date) AS bar_date,
        (SELECT max(date) FROM bars b WHERE b.ticker = pos.ticker AND b.date <= pos.exit_date) AS held_bar FROM pos LEFT JOIN span USING (ticker)""",
    "placed": """SELECT entry.*, b.close AS entry_close, CASE WHEN NOT amount > 0 THEN 'amount must be greater than zero' WHEN exit_date < entry_date THEN 'exit_date must be greater than or equal to entry_date'
        WHEN last_bar IS NULL THEN 'price_history must contain at least one close price' WHEN entry_date > last_bar THEN 'entry_date is after the latest available price'
        WHEN bar_date > exit_date THEN 'no price rows are available for the selected date range' END AS reason
        FROM entry LEFT JOIN bars b ON b.ticker = entry.ticker AND b.date = entry.bar_date""",
    "good": "SELECT *, amount / entry_close AS shares FROM placed WHERE reason IS NULL",
    "drift": """SELECT ticker, coalesce(avg(r), 0.0) AS mean_return, coalesce(stddev_samp(r), 0.0) AS vol, any_value(lc) AS last_close FROM (
        SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, last_value(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc
        FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 21)) GROUP BY ticker""",
    "hist": """SELECT position_id, ticker, g.amount, b.date, b.close, shares * b.close AS value, shares * b.close AS lower_value, shares * b.close AS upper_value, 'historical' AS kind
        FROM good g JOIN bars b USING (ticker) WHERE b.date >= bar_date AND b.date <= exit_date""",
    "days": """SELECT g.*, d, row_number() OVER (PARTITION BY position_id ORDER BY d) AS h, greatest(-0.1, least(0.1, mean_return + (p - 0.5) * vol)) AS dr, vol, last_close
        FROM (SELECT *, CAST(unnest(generate_series(held_bar + 1, exit_date, INTERVAL 1 DAY)) AS DATE) AS d FROM good WHERE exit_date > held_bar) g JOIN drift USING (ticker) WHERE isodow(d) < 6""",
    "proj": """SELECT position_id, ticker, amount, d AS date, last_close * pow(1 + dr, h) AS close, shares * last_close * pow(1 + dr, h) AS value,
        shares * last_close * pow(1 + dr, h) * greatest(0.01, 1 - vol * sqrt(h)) AS lower_value, shares * last_close * pow(1 + dr, h) * (1 + vol * sqrt(h)) AS upper_value, 'projected' AS kind FROM days""",
}
VALUE_COLS = f"position_id, ticker, date, kind, {rnd('close', 3)} AS close, {rnd('value', 2)} AS value, {rnd('lower_value', 2)} AS lower_value, {rnd('upper_value', 2)} AS upper_value"


@query("position_value", sql(f"SELECT {VALUE_COLS} FROM hist", **{k: POSITION[k] for k in ("pos", "span", "entry", "placed", "good", "hist")}))
def position_value(spark, sf):
    out = valuation.position_values(derived.positions(spark, sf), views.bars(spark, sf)).where("kind = 'historical'")
    return rounded(out.select("position_id", "ticker", "date", "kind", "close", "value", "lower_value", "upper_value"), 2, close=3)


@query("position_projection", sql(f"SELECT {VALUE_COLS} FROM proj", **{k: v for k, v in POSITION.items() if k != "hist"}))
def position_projection(spark, sf):
    out = valuation.position_values(derived.positions(spark, sf), views.bars(spark, sf)).where("kind = 'projected'")
    return rounded(out.select("position_id", "ticker", "date", "kind", "close", "value", "lower_value", "upper_value"), 2, close=3)


@query("position_errors", sql("SELECT position_id, ticker, reason FROM placed", **{k: POSITION[k] for k in ("pos", "span", "entry", "placed")}))
def position_errors(spark, sf):
    return valuation.check_positions(derived.positions(spark, sf), views.bars(spark, sf)).select("position_id", "ticker", "reason")


@query("position_summary", sql(
    f"""SELECT position_id, {rnd('max_by(value, date)', 2)} AS exit_value, {rnd('max_by(value, date) / any_value(amount) - 1', 5)} AS profit_loss_pct,
        CASE WHEN bool_or(kind = 'projected') THEN 'projected' ELSE 'historical' END AS mode, count(*) AS rows, max(date) AS last_date
        FROM (SELECT * FROM hist UNION ALL SELECT * FROM proj) GROUP BY position_id""", **POSITION))
def position_summary(spark, sf):
    values = valuation.position_values(derived.positions(spark, sf), views.bars(spark, sf))
    out = valuation.position_summary(values).select("position_id", "exit_value", "profit_loss_pct", "mode", "rows", "last_date")
    return rounded(out, 2, profit_loss_pct=5)


@query("position_with_signal", sql(
    f"""SELECT position_id, pos.ticker, {rnd("CASE WHEN status = 'ok' THEN CASE predicted_direction WHEN 1 THEN 0.5 + confidence * 0.5 WHEN 0 THEN 0.5 - confidence * 0.5 END END")} AS probability_up
        FROM pos LEFT JOIN answer USING (ticker)""", **ANSWER, pos=POSITION["pos"]))
def position_with_signal(spark, sf):
    held = derived.positions(spark, sf).drop("probability_up")
    answers = _answers(spark, sf)
    return rounded(valuation.positions_with_signal(held, answers).select("position_id", "ticker", "probability_up"))
