"""Registered queries over bars: scans, features, labels, folds and graph."""

from pyspark.sql import Window as W, functions as F

from ..constants import PRICE_FEATURES
from ..functions.calendar import session_open, temporal_columns
from ..operators import backtest, correlation, fusion, serving, technical, training, upsert
from ..sources import files, prices, views
from . import derived
from .derived import rounded
from .sqlkit import div, lag, rnd, roll, sql

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


BAR_COLUMNS = "ticker, yfinance_symbol, date, " + ", ".join(
    f"{rnd(c, 4)} AS {c}" for c in ("open", "high", "low", "close", "adj_close")
) + ", volume, source, interval"


@query("parquet_scan_bars", sql(f"SELECT {BAR_COLUMNS} FROM bars"))
def parquet_scan_bars(spark, sf):
    return rounded(views.bars(spark, sf), 4)


@query("concat_bars", sql(
    f"SELECT {BAR_COLUMNS} FROM (SELECT * FROM bars_f UNION ALL SELECT * FROM bars_o)"))
def concat_bars(spark, sf):
    parts = [views.bars(spark, sf, c) for c in ("l_linestatus = 'F'", "l_linestatus <> 'F'")]
    return rounded(files.concat_bars(parts), 4)


# --- provider rows -----------------------------------------------------------------------------

RAW_SQL = """
  SELECT o_orderkey, n_name AS ticker, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 00:00:00+07:00' AS d,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS c,
         CASE WHEN o_orderstatus = 'P' THEN 'inf' ELSE CAST(o_totalprice AS VARCHAR) END AS h,
         CASE WHEN o_orderpriority LIKE '2%' THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '.0' END AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _provider_rows(spark, sf):
    order = views.table(spark, sf, "orders")
    owner = views.table(spark, sf, "customer").join(
        views.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_name").alias("ticker"))
    price = F.col("o_totalprice").cast("string")
    return order.join(owner, F.col("o_custkey") == F.col("c_custkey")).select(
        "ticker", F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 00:00:00+07:00")).alias("Date"),
        price.alias("Open"), F.when(F.col("o_orderstatus") == "P", "inf").otherwise(price).alias("High"),
        price.alias("Low"), F.when(F.col("o_orderpriority").startswith("1"), "n/a").otherwise(price).alias("Close"),
        price.alias("Adj Close"),
        F.when(F.col("o_orderpriority").startswith("2"), None).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("Volume"),
    )


def _normalised_sql(volume, high):
    return sql(
        f"""SELECT ticker, ticker || '.JK' AS yfinance_symbol, CAST(d[1:10] AS DATE) AS date, {rnd("CAST(c AS DOUBLE)", 4)} AS open,
            {high} AS high, {rnd("CAST(c AS DOUBLE)", 4)} AS low, {rnd("CAST(c AS DOUBLE)", 4)} AS close,
            {rnd("CAST(c AS DOUBLE)", 4)} AS adj_close, {volume} AS volume, 'yfinance' AS source, '1d' AS interval
            FROM raw WHERE c <> 'n/a'""", raw=RAW_SQL)


FRAME_HIGH = f"CASE WHEN h = 'inf' THEN -1.0 ELSE {rnd('TRY_CAST(h AS DOUBLE)', 4)} END"
STRICT_HIGH = f"CASE WHEN h <> 'inf' THEN {rnd('TRY_CAST(h AS DOUBLE)', 4)} END"


@query("price_bar_normalise", _normalised_sql("CAST(coalesce(TRY_CAST(v AS DOUBLE), 0) AS BIGINT)", FRAME_HIGH))
def price_bar_normalise(spark, sf):
    out = prices.normalize_bars(_provider_rows(spark, sf))
    # infinity is shown as -1 so that the comparison does not depend on how engines print it
    shown = F.when(F.col("high") == float("inf"), -1.0).otherwise(F.col("high"))
    return rounded(out.withColumn("high", shown), 4)


@query("price_bar_normalise_strict", _normalised_sql("CAST(TRY_CAST(v AS DOUBLE) AS BIGINT)", STRICT_HIGH))
def price_bar_normalise_strict(spark, sf):
    return rounded(prices.normalize_bars(_provider_rows(spark, sf), strict=True), 4)


@query("required_field_filter", sql(
    f"SELECT ticker, d AS date, {rnd('TRY_CAST(c AS DOUBLE)', 4)} AS close FROM raw WHERE TRY_CAST(c AS DOUBLE) IS NOT NULL", raw=RAW_SQL))
def required_field_filter(spark, sf):
    rows = _provider_rows(spark, sf).select("ticker", F.col("Date").alias("date"), F.col("Close").try_cast("double").alias("close"))
    return rounded(rows.na.drop(subset=["ticker", "date", "close"]), 4)


# --- technical features ------------------------------------------------------------------------

R = {f"return_{n}d": div("close", lag("close", n)) + " - 1" for n in (1, 5, 10, 20)}
R |= {f"momentum_{n}d": div("close", lag("close", n)) + " - 1" for n in (5, 10, 20, 60)}
R["log_return_1d"] = f"ln({div('close', lag('close', 1))})"
VOL = {f"volatility_{n}d": roll("stddev_samp", "return_1d", n) for n in (5, 10, 20, 60)}
SMA = {f"SMA_{n}": roll("avg", "close", n) for n in (20, 50, 200)}
BOLL = {
    "BB_middle": "m", "BB_upper": "m + 2 * s", "BB_lower": "m - 2 * s", "BB_width": div("4 * s", "m"),
    "BB_percent_b": div("close - (m - 2 * s)", "(m + 2 * s) - (m - 2 * s)"),
}
VOLUME = {
    "volume_sma_20": "v20", "volume_sma_50": "v50", "volume_ratio_20": div("v", "v20"), "volume_ratio_50": div("v", "v50"),
    "volume_change_1d": div("v", "vp") + " - 1", "volume_zscore_20": div("v - v20", "vs"),
}
RATIOS = {f"close_to_sma_{n}": div("close", f"SMA_{n}") + " - 1" for n in (20, 50, 200)}
RATIOS |= {"sma20_to_sma50": div("SMA_20", "SMA_50") + " - 1", "sma50_to_sma200": div("SMA_50", "SMA_200") + " - 1"}
RANGE = {}
for _n in (20, 60):
    RANGE |= {
        f"drawdown_{_n}d": div("close", f"hi{_n}") + " - 1",
        f"price_position_{_n}d": div(f"close - lo{_n}", f"hi{_n} - lo{_n}"),
        f"rolling_max_{_n}d_ratio": div("close", f"hi{_n}") + " - 1",
        f"rolling_min_{_n}d_ratio": div("close", f"lo{_n}") + " - 1",
    }
SHAPE = {
    "high_low_range": div("high - low", "close"), "close_open_return": div("close", "open") + " - 1",
    "gap_return": div("open", "prev") + " - 1",
}
PRICE_LEVEL = 4
LEVELS = {c: PRICE_LEVEL for c in (
    "SMA_20", "SMA_50", "SMA_200", "EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist", "RSI",
    "BB_middle", "BB_upper", "BB_lower", "ATR", "volume_sma_20", "volume_sma_50", "obv",
    "dollar_volume", "dollar_volume_sma_20")}


def _pick(exprs):
    return ", ".join(f"{rnd(e, LEVELS.get(n, 6))} AS {n}" for n, e in exprs.items())


EXTRA = {
    "f1": "SELECT *, close / nullif(" + lag("close", 1) + ", 0) - 1 AS return_1d, " + lag("close", 1) + " AS prev, "
          + "CAST(volume AS DOUBLE) AS v, " + lag("CAST(volume AS DOUBLE)", 1) + " AS vp, close * volume AS dv, "
          + "row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM bars",
    "f2": "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in SMA.items()) + ", "
          + roll("avg", "close", 20) + " AS m, " + roll("stddev_samp", "close", 20) + " AS s, "
          + roll("avg", "v", 20) + " AS v20, " + roll("avg", "v", 50) + " AS v50, " + roll("stddev_samp", "v", 20) + " AS vs, "
          + ", ".join(f"{roll('max', 'close', n)} AS hi{n}, {roll('min', 'close', n)} AS lo{n}" for n in (20, 60)) + ", "
          + "greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, "
          + "coalesce(sign(close - prev), 0) * v AS sv FROM f1",
    "f3": "SELECT *, sum(sv) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv, " + roll("avg", "tr", 14) + " AS ATR FROM f2",
}
RECURSION = {
    "ema": f"""
      SELECT ticker, date, k, close, close AS EMA_12, close AS EMA_26, CAST(0 AS DOUBLE) AS MACD_signal,
             CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM f1 WHERE k = 1
      UNION ALL
      SELECT f1.ticker, f1.date, f1.k, f1.close,
             f1.close * 2 / 13 + EMA_12 * 11 / 13, f1.close * 2 / 27 + EMA_26 * 25 / 27,
             ((f1.close * 2 / 13 + EMA_12 * 11 / 13) - (f1.close * 2 / 27 + EMA_26 * 25 / 27)) * 2 / 10 + MACD_signal * 8 / 10,
             CASE WHEN f1.k = 2 THEN greatest(f1.close - ema.close, 0) ELSE greatest(f1.close - ema.close, 0) / 14 + g * 13 / 14 END,
             CASE WHEN f1.k = 2 THEN greatest(ema.close - f1.close, 0) ELSE greatest(ema.close - f1.close, 0) / 14 + l * 13 / 14 END
      FROM ema JOIN f1 ON f1.ticker = ema.ticker AND f1.k = ema.k + 1"""
}
EMA = {
    "EMA_12": "EMA_12", "EMA_26": "EMA_26", "MACD": "EMA_12 - EMA_26", "MACD_signal": "MACD_signal",
    "MACD_hist": "EMA_12 - EMA_26 - MACD_signal",
}
RSI = {"RSI": "CASE WHEN k > 14 AND l <> 0 THEN 100 - 100 / (1 + g / l) END"}
ATR = {"ATR": "ATR", "atr_pct": div("ATR", "close"), "true_range_pct": div("tr", "close")}
OBV = {"obv": "obv", "obv_20d_change": div("obv", lag("obv", 20)) + " - 1"}
DOLLAR = {"dollar_volume": "dv", "dollar_volume_sma_20": roll("avg", "dv", 20)}


def _features_sql(exprs, table, recursive=False):
    own = EXTRA | RECURSION if recursive else EXTRA
    keep = ["f1", "ema"] if recursive else {"f1": ["f1"], "f2": ["f1", "f2"], "f3": ["f1", "f2", "f3"]}[table]
    return sql(f"SELECT ticker, date, {_pick(exprs)} FROM {table}", recursive, **{k: own[k] for k in keep})


def _feature_query(name, fn, exprs, table, recursive=False):
    def run(spark, sf):
        return rounded(fn(views.bars(spark, sf)), 6, **LEVELS)

    QUERIES[name] = run
    ORACLES[name] = _features_sql(exprs, table, recursive)


_feature_query("returns", technical.returns, R, "f1")
_feature_query("volatility", technical.volatility, VOL, "f1")
_feature_query("sma", technical.moving_averages, SMA, "f1")
_feature_query("ema_macd", technical.ema_macd, EMA, "ema", True)
_feature_query("rsi", technical.rsi, RSI, "ema", True)
_feature_query("bollinger", technical.bollinger, BOLL, "f2")
_feature_query("atr", technical.atr, ATR, "f3")
_feature_query("volume_features", technical.volume_features, VOLUME, "f2")
_feature_query("ma_ratios", technical.ma_ratios, RATIOS, "f2")
_feature_query("drawdown_position", technical.drawdown_position, RANGE, "f2")
_feature_query("bar_shape", technical.bar_shape, SHAPE, "f1")
_feature_query("obv", technical.obv, OBV, "f3")
_feature_query("dollar_volume", technical.dollar_volume, DOLLAR, "f1")

ALL = R | VOL | SMA | EMA | RSI | BOLL | ATR | VOLUME | RATIOS | RANGE | SHAPE | OBV | DOLLAR
ALL = {c: ALL[c] for c in PRICE_FEATURES}
ALL_FEATURES = "SELECT ticker, date, " + _pick(ALL) + " FROM (SELECT f3.*, EMA_12, EMA_26, MACD_signal, g, l FROM f3 JOIN ema USING (ticker, date))"
FEATURE_STEPS = {k: (EXTRA | RECURSION)[k] for k in ("f1", "f2", "f3", "ema")}
FEATURES_SQL = sql(ALL_FEATURES, True, **FEATURE_STEPS)


@query("price_features", FEATURES_SQL)
def price_features(spark, sf):
    out = technical.price_features(views.bars(spark, sf)).select("ticker", "date", *PRICE_FEATURES)
    return rounded(out, 6, **LEVELS)


# --- labels ------------------------------------------------------------------------------------

@query("labels", sql(f"""SELECT ticker, date, {rnd('next_day_price', 4)} AS next_day_price, {rnd('target_return')} AS target_return,
    CAST(target_return > 0 AS BIGINT) AS direction FROM labelled"""))
def labels(spark, sf):
    out = fusion.add_labels(views.bars(spark, sf)).select("ticker", "date", "next_day_price", "target_return", "direction")
    return rounded(out, 6, next_day_price=4)


CROSS = """
  SELECT ticker, date, target_return, avg(target_return) OVER (PARTITION BY date) AS m,
         avg(target_return) OVER (PARTITION BY date, sector) AS s
  FROM labelled JOIN universe USING (ticker)"""


@query("cross_section_labels", sql(f"""
    SELECT ticker, date, {rnd('m')} AS market_next_return, {rnd('target_return - m')} AS target_excess_return,
           CAST(round(target_return - m, 9) > 0 AS BIGINT) AS outperform_market, {rnd('s')} AS sector_next_return,
           {rnd('target_return - s')} AS target_sector_excess_return, CAST(round(target_return - s, 9) > 0 AS BIGINT) AS outperform_sector
    FROM x""", x=CROSS))
def cross_section_labels(spark, sf):
    rows = fusion.add_labels(views.bars(spark, sf)).join(views.universe(spark, sf).select("ticker", "sector"), "ticker")
    out = fusion.add_cross_section_labels(rows.select("ticker", "date", "sector", "target_return"))
    return rounded(out.drop("sector", "target_return").withColumns({
        # a date with one row has no excess beyond rounding noise
        "outperform_market": (F.round("target_excess_return", 9) > 0).cast("bigint"),
        "outperform_sector": (F.round("target_sector_excess_return", 9) > 0).cast("bigint"),
    }))


@query("sector_return", sql(f"""SELECT sector, date, {rnd('avg(r)')} AS sector_r FROM returns_1d JOIN universe USING (ticker) GROUP BY sector, date"""))
def sector_return(spark, sf):
    rows = correlation.close_returns(views.bars(spark, sf)).join(views.universe(spark, sf).select("ticker", "sector"), "ticker")
    return rounded(training.sector_returns(rows))


@query("close_returns", sql(f"SELECT ticker, date, {rnd('r')} AS r FROM returns_1d"))
def close_returns(spark, sf):
    return rounded(correlation.close_returns(views.bars(spark, sf)))


@query("temporal", sql("""SELECT ticker, date, CAST(day(date) AS INTEGER) AS day, CAST(weekofyear(date) AS INTEGER) AS week,
    CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM bars"""))
def temporal(spark, sf):
    return views.bars(spark, sf).select("ticker", "date", *temporal_columns(F.col("date")))


@query("coverage", sql(f"""SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS bars,
    {rnd("date_diff('day', min(date), max(date)) / 365.25")} AS years FROM bars GROUP BY ticker"""))
def coverage(spark, sf):
    return rounded(serving.coverage(views.bars(spark, sf)))


@query("session_flag", """SELECT event_id, isodow(t) <= 5 AND hour(t) * 60 + minute(t) BETWEEN 540 AND 960 AS session_open
    FROM (SELECT event_id, ts + INTERVAL 7 HOUR AS t FROM events)""")
def session_flag(spark, sf):
    events = views.table(spark, sf, "events")
    return events.select("event_id", session_open(F.col("ts").cast("timestamp")).alias("session_open"))


# --- correlation graph -------------------------------------------------------------------------

@views.once
def _edges(spark, sf, bars=None, minimum=20, threshold=0.02):
    observed = correlation.price_observations(bars if bars is not None else views.bars(spark, sf))
    return correlation.return_correlations(observed, minimum, threshold)


EDGE_SQL = f"source_ticker, target_ticker, {rnd('coefficient', 5)} AS coefficient, observations, first_date, last_date"


@query("return_correlation", sql(f"SELECT {EDGE_SQL} FROM edges"))
def return_correlation(spark, sf):
    out = _edges(spark, sf).select("source_ticker", "target_ticker", "coefficient", "observations", "first_date", "last_date")
    return rounded(out, 5)


@query("return_correlation_wide", sql(
    f"SELECT {EDGE_SQL} FROM wide",
    wret=f"SELECT ticker, date, close / prev - 1 AS r FROM (SELECT ticker, date, close, {lag('close', 1)} AS prev FROM bars_wide) WHERE prev > 0",
    wide="""SELECT a.ticker AS source_ticker, b.ticker AS target_ticker, round(corr(a.r, b.r), 6) AS coefficient, count(*) AS observations,
            min(a.date) AS first_date, max(a.date) AS last_date FROM wret a JOIN wret b ON a.date = b.date AND a.ticker < b.ticker
            GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(corr(a.r, b.r)) >= 0.1"""))
def return_correlation_wide(spark, sf):
    out = _edges(spark, sf, views.bars_wide(spark, sf), threshold=0.1)
    return rounded(out.select("source_ticker", "target_ticker", "coefficient", "observations", "first_date", "last_date"), 5)


@query("return_pairs", sql(f"""SELECT e.source_ticker, e.target_ticker, a.date, {rnd('a.r')} AS source_return, {rnd('b.r')} AS target_return
    FROM edges e JOIN returns_1d a ON a.ticker = e.source_ticker JOIN returns_1d b ON b.ticker = e.target_ticker AND b.date = a.date"""))
def return_pairs(spark, sf):
    r = correlation.close_returns(views.bars(spark, sf))
    return rounded(correlation.align_pairs(r, _edges(spark, sf)))


@query("edge_replace", sql("""
    SELECT source_ticker, target_ticker, CAST(count(*) AS BIGINT) AS edges, CAST(sum(fresh) AS BIGINT) AS fresh
    FROM (SELECT source_ticker, target_ticker, 0 AS fresh FROM old WHERE NOT (source_ticker IN (SELECT ticker FROM scope) AND target_ticker IN (SELECT ticker FROM scope))
          AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_ticker = old.source_ticker AND e.target_ticker = old.target_ticker)
          UNION ALL SELECT source_ticker, target_ticker, 1 FROM edges)
    GROUP BY ALL""",
    old="""SELECT a.ticker AS source_ticker, b.ticker AS target_ticker FROM universe a JOIN universe b ON a.sector = b.sector AND a.ticker < b.ticker""",
    scope="SELECT ticker FROM universe WHERE sector IN ('ASIA', 'EUROPE')"))
def edge_replace(spark, sf):
    u = views.universe(spark, sf)
    fresh = _edges(spark, sf)
    peers = u.select(F.col("ticker").alias("target_ticker"), "sector")
    old = u.select(F.col("ticker").alias("source_ticker"), "sector").join(peers, "sector").where("source_ticker < target_ticker")
    stored = old.select(
        "source_ticker", "target_ticker", F.lit(0.0).alias("coefficient"), F.lit(0.0).alias("abs_coefficient"),
        F.lit(0).cast("bigint").alias("observations"), F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"),
        F.lit("pearson_close_return").alias("method"), F.lit("yfinance").alias("price_source"), F.lit("1d").alias("interval"),
    )
    scope = u.where(F.col("sector").isin("ASIA", "EUROPE"))
    out = correlation.replace_edges(stored, fresh, scope, stocks=u)
    return out.groupBy("source_ticker", "target_ticker").agg(
        F.count("*").alias("edges"), F.sum((F.col("observations") > 0).cast("bigint")).alias("fresh")
    )


@query("peers_of", sql(f"""SELECT ticker, peer_ticker, peer_ticker AS peer_name, {rnd('coefficient', 5)} AS coefficient, observations, first_date, last_date,
    row_number() OVER (PARTITION BY ticker ORDER BY abs(coefficient) DESC, peer_ticker) AS place FROM sides"""))
def peers_of(spark, sf):
    return rounded(correlation.peers(_edges(spark, sf), views.universe(spark, sf)), 5)


@query("graph_feature_source", sql(f"""SELECT ticker, date, sector, {rnd('close', 4)} AS close, volume, correlated_peer_count,
    {rnd('correlation_avg_abs', 5)} AS correlation_avg_abs FROM graph_rows"""))
@views.shared
def graph_feature_source(spark, sf):
    out = correlation.graph_feature_source(views.bars(spark, sf), views.universe(spark, sf), _edges(spark, sf))
    return rounded(out, 4, correlation_avg_abs=5)


def _training_sql():
    def over(fn, c, n):
        return f"{fn}({c}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    auto = {"volume_change_1d": "v / nullif(pv, 0) - 1"}
    cols = []
    for n in (3, 5, 10, 20):
        cols += [
            f"{lag('close', n)} AS c{n}", f"{over('avg', 'r', n)} AS m{n}", f"{over('stddev_samp', 'r', n)} AS s{n}",
            f"{over('min', 'r', n)} AS lo{n}", f"{over('max', 'r', n)} AS hi{n}", f"{over('max', 'close', n)} AS top{n}",
            f"{over('min', 'close', n)} AS low{n}", f"{over('avg', 'v', n)} AS vol{n}",
        ]
        auto |= {
            f"return_{n}d": f"close / c{n} - 1", f"rolling_mean_{n}d": f"m{n}", f"rolling_vol_{n}d": f"s{n}",
            f"rolling_min_return_{n}d": f"lo{n}", f"rolling_max_return_{n}d": f"hi{n}", f"drawdown_{n}d": f"close / top{n} - 1",
            f"price_position_{n}d": f"CASE WHEN top{n} = low{n} THEN 0.5 ELSE (close - low{n}) / (top{n} - low{n}) END",
            f"volume_ratio_{n}d": f"v / nullif(vol{n}, 0)",
        }
    g1 = f"""SELECT *, CAST(volume AS DOUBLE) AS v, {lag('CAST(volume AS DOUBLE)', 1)} AS pv, {lag('close', 1)} AS p,
             lead(close) OVER (PARTITION BY ticker ORDER BY date) AS nx, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM graph_rows"""
    g2 = "SELECT *, CASE WHEN p > 0 THEN close / p - 1 END AS r FROM g1"
    g3 = f"SELECT *, {over('count', 'r', 10)} AS seen, avg(r) OVER (PARTITION BY sector, date) AS sr, {', '.join(cols)} FROM g2"
    fixed = {"return_1d": "r", "sector_return_1d": "coalesce(sr, 0.0)", "correlation_avg_abs": "correlation_avg_abs"}
    # the features themselves are defined to eight places
    picks = ", ".join(f"{rnd(e, 5, 8)} AS {n}" for n, e in (fixed | auto).items())
    base = f"SELECT ticker, date, sector, {rnd('close', 4)} AS close, volume, correlated_peer_count, {picks}"
    full = "FROM g3 WHERE i >= 20 AND r IS NOT NULL AND seen = 10"
    ctes = {"g1": g1, "g2": g2, "g3": g3}
    train = sql(f"{base}, {rnd('nx / close - 1', 5, 8)} AS target_next_return, CASE WHEN nx / close - 1 > 0 THEN 1 ELSE 0 END AS target_next_direction {full} AND nx IS NOT NULL", **ctes)
    return train, sql(f"{base} {full} AND nx IS NULL", **ctes)


TRAIN_SQL, LATEST_SQL = _training_sql()


def graph_source(spark, sf):
    return correlation.graph_feature_source(views.bars(spark, sf), views.universe(spark, sf), _edges(spark, sf))


@query("training_features", TRAIN_SQL)
@views.shared
def training_features(spark, sf):
    return rounded(training.training_features(graph_source(spark, sf)), 5, close=4)


@query("latest_inference_features", LATEST_SQL)
@views.shared
def latest_inference_features(spark, sf):
    return rounded(training.latest_inference_features(graph_source(spark, sf)), 5, close=4)


# --- latest rows, upserts ----------------------------------------------------------------------

@query("latest_per_ticker", sql(f"SELECT ticker, date, {rnd('close', 4)} AS close FROM latest_bar"))
def latest_per_ticker(spark, sf):
    return rounded(serving.latest_rows(views.bars(spark, sf), 1).select("ticker", "date", "close"), 4)


@query("last_two", sql(f"SELECT ticker, date, {rnd('close', 4)} AS close, {rnd('previous_close', 4)} AS previous_close, volume FROM two"))
def last_two(spark, sf):
    return rounded(serving.last_two(views.bars(spark, sf)).drop("yfinance_symbol"), 4)


KNOWN = "SELECT ticker FROM universe WHERE sector <> 'AFRICA'"


@query("known_stock_semi", sql("SELECT ticker, date, volume FROM bars WHERE ticker IN (SELECT ticker FROM known)", known=KNOWN))
def known_stock_semi(spark, sf):
    known = views.universe(spark, sf).where("sector <> 'AFRICA'").select("ticker")
    return views.bars(spark, sf).join(known, "ticker", "left_semi").select("ticker", "date", "volume")


@query("upsert_price_bars", sql(
    f"""SELECT ticker, date, {rnd('close', 4)} AS close, volume FROM bars_f WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.ticker = bars_f.ticker AND good.date = bars_f.date)
        UNION ALL SELECT ticker, date, {rnd('close', 4)}, volume FROM good""",
    known=KNOWN, good="SELECT * FROM bars_o WHERE ticker IN (SELECT ticker FROM known)"))
def upsert_price_bars(spark, sf):
    old, new = (views.bars(spark, sf, c) for c in ("l_linestatus = 'F'", "l_linestatus <> 'F'"))
    known = views.universe(spark, sf).where("sector <> 'AFRICA'")
    return rounded(upsert.merge_bars(old, new, known).select("ticker", "date", "close", "volume"), 4)


@query("upsert_counts", sql(
    """SELECT (SELECT count(*) FROM bars_o) AS rows_read, (SELECT count(*) FROM bars_o WHERE ticker IN (SELECT ticker FROM known)) AS rows_processed,
       (SELECT count(DISTINCT sector) FROM universe) AS sectors_processed""", known=KNOWN))
def upsert_counts(spark, sf):
    u = views.universe(spark, sf)
    counts = upsert.bar_counts(views.bars(spark, sf, "l_linestatus <> 'F'"), u.where("sector <> 'AFRICA'"))
    return counts.withColumn("sectors_processed", upsert.universe_counts(u).select("sectors_processed").scalar())


# --- folds and metrics on fixed predictions ----------------------------------------------------

@query("training_rows", sql("SELECT ticker, count(*) AS rows FROM labelled WHERE target_return IS NOT NULL AND next_day_price IS NOT NULL GROUP BY ticker"))
def training_rows(spark, sf):
    return backtest.training_rows(derived.labelled(spark, sf)).groupBy("ticker").agg(F.count("*").alias("rows"))


@query("float_features", sql(f"""SELECT ticker, date, {rnd('CAST(CAST(close AS REAL) AS DOUBLE)', 2)} AS close, {rnd('CAST(CAST(r1 AS REAL) AS DOUBLE)', 5)} AS r1,
    coalesce(sector, 'UNKNOWN') AS sector FROM labelled LEFT JOIN (SELECT ticker, nullif(sector, 'ASIA') AS sector FROM universe) USING (ticker)"""))
def float_features(spark, sf):
    u = views.universe(spark, sf).select("ticker", F.nullif("sector", F.lit("ASIA")).alias("sector"))
    out = backtest.model_features(derived.labelled(spark, sf).join(u, "ticker", "left"), ["close", "r1", "sector"])
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in ("close", "r1")}), 5, close=2)


DATES = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM scored)"


@query("split_by_date", sql(
    """SELECT ticker, date, CASE WHEN date < (SELECT date FROM d WHERE pos = CAST(floor(n * 0.8) AS BIGINT)) THEN 'train' ELSE 'test' END AS part FROM scored""", d=DATES))
def split_by_date(spark, sf):
    return backtest.split_by_date(derived.scored(spark, sf), 0.2).select("ticker", "date", "part")


FOLDS = """SELECT f.i AS fold, d.date, CASE WHEN pos < n - (6 - f.i) * (n // 6) - 1 THEN 'train'
             WHEN pos >= n - (6 - f.i) * (n // 6) AND pos < n - (5 - f.i) * (n // 6) THEN 'test' END AS role
           FROM d JOIN (SELECT unnest(range(1, 6)) AS i) f ON true"""


@query("purged_folds", sql(
    "SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM scored JOIN folds USING (date) WHERE role IS NOT NULL GROUP BY fold, role",
    d=DATES, folds=FOLDS))
def purged_folds(spark, sf):
    return backtest.purged_folds(derived.scored(spark, sf), 5, 1).groupBy("fold", "role").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def test_folds(spark, sf):
    return backtest.purged_folds(derived.scored(spark, sf), 5, 1).where("role = 'test'")


TESTS = "SELECT * FROM scored JOIN folds USING (date) WHERE role = 'test'"


@query("avg_rank", sql(
    """SELECT ticker, date, CAST(rank() OVER (PARTITION BY date ORDER BY predicted_return) + (count(*) OVER (PARTITION BY date, predicted_return) - 1) / 2.0 AS DOUBLE) AS rank_predicted FROM scored"""))
def avg_rank(spark, sf):
    return backtest.average_ranks(derived.scored(spark, sf), "predicted_return", ["date"], "rank_predicted").select("ticker", "date", "rank_predicted")


@query("top_n_selection", sql(
    """SELECT side, place, ticker, date FROM (
       SELECT 'top' AS side, row_number() OVER (PARTITION BY date ORDER BY predicted_return DESC, ticker) AS place, ticker, date FROM scored
       UNION ALL SELECT 'bottom', row_number() OVER (PARTITION BY date ORDER BY predicted_return, ticker), ticker, date FROM scored) WHERE place <= 3"""))
def top_n_selection(spark, sf):
    return backtest.top_n_selection(derived.scored(spark, sf), 3).select("side", F.col("place").cast("bigint").alias("place"), "ticker", "date")


def _regression_sql(p):
    e = f"(next_day_price - close * (1 + {p}))"
    return f"""SELECT fold, avg(abs({e} / nullif(next_day_price, 0))) AS mape, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae,
      sqrt(avg((target_return - {p}) * (target_return - {p}))) AS target_rmse, avg(abs(target_return - {p})) AS target_mae,
      avg(CAST(({p} > 0) = (target_return > 0) AS INTEGER)) AS directional_accuracy,
      coalesce(avg(CAST(target_return > 0 AS INTEGER)) FILTER ({p} > 0), 0.0) AS up_precision,
      coalesce(avg(CAST(target_return <= 0 AS INTEGER)) FILTER ({p} <= 0), 0.0) AS down_precision, count(*) AS rows FROM tests GROUP BY fold"""


def _selection_sql(p):
    return {
        "ranked": f"""SELECT fold, date, target_return AS r, {p} AS p, ticker, count(*) OVER g AS n, avg(target_return) OVER g AS m,
            rank() OVER (PARTITION BY fold, date ORDER BY {p}) + (count(*) OVER (PARTITION BY fold, date, {p}) - 1) / 2.0 AS rp,
            rank() OVER (PARTITION BY fold, date ORDER BY target_return) + (count(*) OVER (PARTITION BY fold, date, target_return) - 1) / 2.0 AS ra,
            row_number() OVER (PARTITION BY fold, date ORDER BY {p} DESC, ticker) AS t, row_number() OVER (PARTITION BY fold, date ORDER BY {p}, ticker) AS b
            FROM tests WINDOW g AS (PARTITION BY fold, date)""",
        "by_day": """SELECT fold, date, CASE WHEN count(DISTINCT p) > 1 AND count(DISTINCT r) > 1 THEN corr(rp, ra) END AS rank_ic,
            avg(r) FILTER (t <= 5) AS top_n_avg_return, avg(CAST(r > 0 AS INTEGER)) FILTER (t <= 5) AS top_n_hit_rate,
            avg(r) FILTER (t <= 5) - any_value(m) AS top_n_excess_return, avg(CAST(r > m AS INTEGER)) FILTER (t <= 5) AS top_n_outperform_rate,
            avg(r) FILTER (t <= 5) - avg(r) FILTER (b <= 5) AS long_short_return FROM ranked WHERE n >= 2 GROUP BY fold, date""",
        "selected": "SELECT fold, " + ", ".join(f"coalesce(avg({c}), 0.0) AS {c}" for c in backtest.SELECTION) + ", count(*) AS selection_dates FROM by_day GROUP BY fold",
    }


BASE = {"d": DATES, "folds": FOLDS, "tests": TESTS}
BY_FOLD = {"rmse": 4, "mae": 4}


@query("regression_metrics", sql(
    "SELECT CAST(fold AS INTEGER) AS fold, " + ", ".join(f"{rnd(c, BY_FOLD.get(c, 6))} AS {c}" for c in backtest.ERRORS) + ", rows FROM reg",
    **BASE, reg=_regression_sql("predicted_return")))
def regression_metrics(spark, sf):
    return rounded(backtest.regression_metrics(test_folds(spark, sf)), 6, **BY_FOLD)


@query("selection_metrics", sql(
    "SELECT CAST(fold AS INTEGER) AS fold, " + ", ".join(f"{rnd(c)} AS {c}" for c in backtest.SELECTION) + ", selection_dates FROM selected",
    **BASE, **_selection_sql("predicted_return")))
def selection_metrics(spark, sf):
    return rounded(backtest.selection_metrics(test_folds(spark, sf), 5))


def _mean_sql(p):
    return {
        "reg": _regression_sql(p), **_selection_sql(p),
        "mean": "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in backtest.ERRORS + backtest.SELECTION)
                + ", count(*) AS folds, CAST(sum(rows) AS BIGINT) AS evaluation_rows, CAST(sum(selection_dates) AS BIGINT) AS selection_dates FROM reg JOIN selected USING (fold)",
    }


MEAN_DIGITS = {c: 4 for c in backtest.ERRORS + backtest.SELECTION} | {"rmse": 3, "mae": 3}


def mean_metrics(spark, sf, predicted="predicted_return"):
    return backtest.fold_mean(backtest.fold_metrics(test_folds(spark, sf), 5, predicted))


@query("fold_mean", sql(
    "SELECT " + ", ".join(f"{rnd(c, d)} AS {c}" for c, d in MEAN_DIGITS.items()) + ", folds, evaluation_rows, selection_dates FROM mean",
    **BASE, **_mean_sql("predicted_return")))
@views.shared
def fold_mean(spark, sf):
    return rounded(mean_metrics(spark, sf), 4, **MEAN_DIGITS)


AUC = """SELECT fold, CASE WHEN sum(direction) > 0 AND sum(1 - direction) > 0 THEN
           (sum(rk) FILTER (direction = 1) - sum(direction) * (sum(direction) + 1) / 2.0) / (sum(direction) * CAST(sum(1 - direction) AS DOUBLE)) END AS roc_auc
         FROM (SELECT fold, direction, rank() OVER (PARTITION BY fold ORDER BY probability_up) + (count(*) OVER (PARTITION BY fold, probability_up) - 1) / 2.0 AS rk FROM tests)
         GROUP BY fold"""
CONFUSION = """SELECT fold, avg(CAST(direction = predicted_direction AS INTEGER)) AS accuracy,
    coalesce(count(*) FILTER (direction = 1 AND predicted_direction = 1) / nullif(count(*) FILTER (predicted_direction = 1), 0), 0.0) AS precision,
    coalesce(count(*) FILTER (direction = 1 AND predicted_direction = 1) / nullif(count(*) FILTER (direction = 1), 0), 0.0) AS recall,
    coalesce(2.0 * count(*) FILTER (direction = 1 AND predicted_direction = 1) / nullif(count(*) FILTER (direction = 1) + count(*) FILTER (predicted_direction = 1), 0), 0.0) AS f1,
    count(*) AS rows FROM tests GROUP BY fold"""


@query("classifier_metrics", sql(
    "SELECT CAST(fold AS INTEGER) AS fold, " + ", ".join(f"{rnd(c)} AS {c}" for c in ("accuracy", "precision", "recall", "f1", "roc_auc")) + ", rows FROM conf JOIN auc USING (fold)",
    **BASE, conf=CONFUSION, auc=AUC))
def classifier_metrics(spark, sf):
    return rounded(backtest.classifier_metrics(test_folds(spark, sf)))


def comparison(spark, sf):
    return backtest.compare_models(mean_metrics(spark, sf), mean_metrics(spark, sf, "other_return"))


def _compared():
    a = {f"{k}_a": v for k, v in _mean_sql("predicted_return").items()}
    b = {f"{k}_b": v for k, v in _mean_sql("other_return").items()}
    for suffix, group in (("a", a), ("b", b)):
        for k in group:
            for name in ("reg", "ranked", "by_day", "selected"):
                group[k] = group[k].replace(f"FROM {name} ", f"FROM {name}_{suffix} ").replace(f"JOIN {name} ", f"JOIN {name}_{suffix} ")
    return {**BASE, **a, **b}


COMPARED = _compared()
COMPARISON_SQL = sql(
    f"""SELECT {rnd('b.mape', 4)} AS baseline_mape, {rnd('n.mape', 4)} AS nlp_model_mape, {rnd('(b.mape - n.mape) / b.mape * 100', 2)} AS mape_improvement_pct,
      {rnd('n.directional_accuracy - b.directional_accuracy', 4)} AS directional_accuracy_delta, {rnd('n.rank_ic - b.rank_ic', 4)} AS rank_ic_delta,
      {rnd('n.top_n_excess_return - b.top_n_excess_return', 4)} AS top_n_excess_return_delta, n.mape < b.mape AS nlp_helped FROM mean_a b JOIN mean_b n ON true""",
    **COMPARED,
)


@query("model_comparison", COMPARISON_SQL)
@views.shared
def model_comparison(spark, sf):
    out = comparison(spark, sf).select(
        "baseline_mape", "nlp_model_mape", "mape_improvement_pct", "directional_accuracy_delta", "rank_ic_delta", "top_n_excess_return_delta", "nlp_helped"
    )
    return rounded(out, 4, mape_improvement_pct=2)
