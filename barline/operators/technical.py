"""Technical features of daily bars.

All windows share one `ticker` partitioning, so a whole feature table costs one exchange. A
bar table holds one row per ticker and date, so a window partition is bounded by the calendar
(about 260 rows a year), however many trades were folded into the bars before.

Exponential averages run as window sums too: inside blocks of `BLOCK` rows the recursion is a
weighted prefix sum. What earlier blocks leave is an affine carry, their end values times powers
of what a whole block keeps; after a few blocks (six for the slowest average used here) that
power is below the smallest double, so a few look-backs at each block's first row give the whole
carry. No row holds a list, and nothing is joined.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import PRICE_FEATURES
from ..functions.numeric import change, finite, rolling, rolling_dense, safe_div
from ..schema import require_columns

BLOCK = 2048
#: Decimal exponent below which there is no double.
LEAST_EXPONENT = 324


def clean_bars(bars: DataFrame) -> DataFrame:
    require_columns(bars, ["ticker", "date", "open", "high", "low", "close", "volume"], "price data")
    return bars.withColumn("date", F.col("date").cast("date")).na.drop(
        subset=["ticker", "date", "close"]
    )


def series_window():
    return W.partitionBy("ticker").orderBy("date")


def position_columns() -> list[Column]:
    """Row position in the series, its block, and the offset inside the block."""
    pos = F.row_number().over(series_window()) - 1
    return [
        pos.alias("_pos"),
        F.floor(pos / BLOCK).cast("int").alias("_block"),
        (pos % BLOCK).alias("_k"),
    ]


def _block_series():
    # same partitioning and one sort order for prefix sums per block and for look-backs
    return W.partitionBy("ticker").orderBy("_block", "date")


def ema_prefix(x: Column, alpha: float, seed_pos: int) -> Column:
    """Recursive average restarted at zero in every block (the first row of a series seeds it)."""
    keep = 1.0 - alpha
    weight = F.when(F.col("_pos") == seed_pos, F.lit(1.0)).otherwise(F.lit(alpha))
    term = x * weight * F.pow(F.lit(keep), -F.col("_k"))
    frame = (
        W.partitionBy("ticker", "_block").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    )
    return F.sum(term).over(frame) * F.pow(F.lit(keep), F.col("_k"))


def _look_backs(alpha: float) -> int:
    """Blocks until what is left of one, times 1e16, is below the smallest double."""
    kept = BLOCK * math.log10(1.0 - alpha)
    if kept < -250:
        raise ValueError(f"an average with weight {alpha} needs shorter blocks than {BLOCK} rows")
    return math.ceil(-(LEAST_EXPONENT + 16) / kept) + 1


def block_carry(prefix: Column, alpha: float) -> Column:
    """At a block's first row: what all earlier blocks leave of the average, at the last one's end."""
    w, keep = _block_series(), (1.0 - alpha) ** BLOCK
    ends = [F.coalesce(F.lag(prefix, 1 + BLOCK * back).over(w), F.lit(0.0)) for back in range(_look_backs(alpha))]
    total = ends[-1]
    for end in reversed(ends[:-1]):
        total = end + total * F.lit(keep)
    return F.when(F.col("_k") == 0, total)


def ema_total(prefix: Column, carry: Column, alpha: float) -> Column:
    """The block's own average and what is left of the carry at its first row."""
    in_block = W.partitionBy("ticker", "_block").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return prefix + F.first(carry).over(in_block) * F.pow(F.lit(1.0 - alpha), F.col("_k") + 1)


def with_emas(df: DataFrame, specs) -> DataFrame:
    """Add exponential averages; `specs` holds (output, input column, alpha, seed position)."""
    first = df.select("*", *[ema_prefix(F.col(x), a, s).alias(f"_p_{out}") for out, x, a, s in specs])
    second = first.select("*", *[block_carry(F.col(f"_p_{out}"), a).alias(f"_c_{out}") for out, _, a, _ in specs])
    third = second.select(
        "*", *[ema_total(F.col(f"_p_{out}"), F.col(f"_c_{out}"), a).alias(out) for out, _, a, _ in specs]
    )
    return third.drop(*[f"_{tag}_{out}" for out, *_ in specs for tag in "pc"])


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def returns(bars: DataFrame) -> DataFrame:
    """Close-to-close returns, momentum and log return."""
    w = series_window()
    close = F.col("close")
    out = [change(close, F.lag(close, n).over(w)).alias(f"return_{n}d") for n in (1, 5, 10, 20)]
    out += [change(close, F.lag(close, n).over(w)).alias(f"momentum_{n}d") for n in (5, 10, 20, 60)]
    log = F.ln(safe_div(close, F.lag(close, 1).over(w))).alias("log_return_1d")
    return clean_bars(bars).select("ticker", "date", *out, log)


def volatility(bars: DataFrame, windows=(5, 10, 20, 60)) -> DataFrame:
    """Sample deviation of daily returns; first value once the window is full."""
    w = series_window()
    r = clean_bars(bars).select(
        "ticker", "date", change(F.col("close"), F.lag("close", 1).over(w)).alias("r")
    )
    return r.select(
        "ticker", "date",
        *[rolling(w, n)(F.stddev_samp, F.col("r")).alias(f"volatility_{n}d") for n in windows],
    )


def moving_averages(bars: DataFrame, windows=(20, 50, 200)) -> DataFrame:
    w = series_window()
    return clean_bars(bars).select(
        "ticker", "date",
        *[rolling_dense(w, n)(F.avg, F.col("close")).alias(f"SMA_{n}") for n in windows],
    )


def ema_macd(bars: DataFrame) -> DataFrame:
    """EMA 12/26, MACD, its 9-span signal and the histogram, without warm-up nulls."""
    base = clean_bars(bars).select("ticker", "date", F.col("close").alias("_x"), *position_columns())
    averages = with_emas(base, [("EMA_12", "_x", span_alpha(12), 0), ("EMA_26", "_x", span_alpha(26), 0)])
    macd = averages.withColumn("MACD", F.col("EMA_12") - F.col("EMA_26"))
    signal = with_emas(macd, [("MACD_signal", "MACD", span_alpha(9), 0)])
    return signal.select(
        "ticker", "date", "EMA_12", "EMA_26", "MACD", "MACD_signal",
        (F.col("MACD") - F.col("MACD_signal")).alias("MACD_hist"),
    )


def _gain_loss(close: Column, previous: Column) -> list[Column]:
    delta = close - previous
    return [
        F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))).alias("_gain"),
        F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))).alias("_loss"),
    ]


def _rsi_value(n: int) -> Column:
    """NULL before n changes and while no loss has ever been seen."""
    had_loss = F.max("_loss").over(_block_series().rowsBetween(W.unboundedPreceding, 0)) > 0
    value = 100 - 100 / (1 + safe_div(F.col("_avg_gain"), F.col("_avg_loss")))
    return F.when((F.col("_pos") >= n) & had_loss, F.coalesce(value, F.lit(100.0)))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's relative strength; the average is seeded by the first change."""
    base = clean_bars(bars).select(
        "ticker", "date", *position_columns(),
        *_gain_loss(F.col("close"), F.lag("close", 1).over(series_window())),
    )
    averaged = with_emas(base, [("_avg_gain", "_gain", 1 / n, 1), ("_avg_loss", "_loss", 1 / n, 1)])
    return averaged.select("ticker", "date", _rsi_value(n).alias("RSI"))


def _bollinger_columns(close, middle, std) -> list[Column]:
    upper, lower = middle + 2 * std, middle - 2 * std
    return [
        middle.alias("BB_middle"), upper.alias("BB_upper"), lower.alias("BB_lower"),
        safe_div(upper - lower, middle).alias("BB_width"),
        safe_div(close - lower, upper - lower).alias("BB_percent_b"),
    ]


def bollinger(bars: DataFrame) -> DataFrame:
    r20 = rolling_dense(series_window(), 20)
    base = clean_bars(bars).select(
        "ticker", "date", "close",
        r20(F.avg, F.col("close")).alias("m"), r20(F.stddev_samp, F.col("close")).alias("s"),
    )
    return base.select(
        "ticker", "date", *_bollinger_columns(F.col("close"), F.col("m"), F.col("s"))
    )


def _true_range(high, low, previous) -> Column:
    # greatest() skips the NULL previous close of the first row
    return F.greatest(high - low, F.abs(high - previous), F.abs(low - previous))


def atr(bars: DataFrame) -> DataFrame:
    """True range and its plain 14-row mean."""
    w = series_window()
    base = clean_bars(bars).select(
        "ticker", "date", "close",
        _true_range(F.col("high"), F.col("low"), F.lag("close", 1).over(w)).alias("tr"),
    )
    mean = rolling(w, 14)(F.avg, F.col("tr"))
    return base.select(
        "ticker", "date", mean.alias("ATR"), safe_div(mean, F.col("close")).alias("atr_pct"),
        safe_div(F.col("tr"), F.col("close")).alias("true_range_pct"),
    )


def _volume(c: str = "volume") -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("double")


def volume_features(bars: DataFrame) -> DataFrame:
    w = series_window()
    v = F.col("v")
    base = clean_bars(bars).select("ticker", "date", _volume().alias("v"))
    m20, m50 = rolling_dense(w, 20)(F.avg, v), rolling_dense(w, 50)(F.avg, v)
    return base.select(
        "ticker", "date", m20.alias("volume_sma_20"), m50.alias("volume_sma_50"),
        safe_div(v, m20).alias("volume_ratio_20"), safe_div(v, m50).alias("volume_ratio_50"),
        change(v, F.lag(v, 1).over(w)).alias("volume_change_1d"),
        safe_div(v - m20, rolling_dense(w, 20)(F.stddev_samp, v)).alias("volume_zscore_20"),
    )


def ma_ratios(bars: DataFrame) -> DataFrame:
    base = clean_bars(bars)
    w = series_window()
    s = base.select(
        "ticker", "date", "close",
        *[rolling_dense(w, n)(F.avg, F.col("close")).alias(f"SMA_{n}") for n in (20, 50, 200)],
    )
    return s.select("ticker", "date", *_ma_ratio_columns())


def _ma_ratio_columns() -> list[Column]:
    out = [change(F.col("close"), F.col(f"SMA_{n}")).alias(f"close_to_sma_{n}") for n in (20, 50, 200)]
    out.append(change(F.col("SMA_20"), F.col("SMA_50")).alias("sma20_to_sma50"))
    out.append(change(F.col("SMA_50"), F.col("SMA_200")).alias("sma50_to_sma200"))
    return out


def _range_columns(n: int) -> list[Column]:
    close, high, low = F.col("close"), F.col(f"_max{n}"), F.col(f"_min{n}")
    return [
        change(close, high).alias(f"drawdown_{n}d"),
        safe_div(close - low, high - low).alias(f"price_position_{n}d"),
        change(close, high).alias(f"rolling_max_{n}d_ratio"),
        change(close, low).alias(f"rolling_min_{n}d_ratio"),
    ]


def _extremes(w, n: int) -> list[Column]:
    return [
        rolling_dense(w, n)(F.max, F.col("close")).alias(f"_max{n}"),
        rolling_dense(w, n)(F.min, F.col("close")).alias(f"_min{n}"),
    ]


def drawdown_position(bars: DataFrame) -> DataFrame:
    """Close against its rolling extremes; a flat range gives NULL."""
    w = series_window()
    base = clean_bars(bars).select("ticker", "date", "close", *_extremes(w, 20), *_extremes(w, 60))
    return base.select("ticker", "date", *_range_columns(20), *_range_columns(60))


def _shape_columns(previous: Column) -> list[Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return [
        safe_div(h - l, c).alias("high_low_range"),
        change(c, o).alias("close_open_return"),
        change(o, previous).alias("gap_return"),
    ]


def bar_shape(bars: DataFrame) -> DataFrame:
    return clean_bars(bars).select(
        "ticker", "date", *_shape_columns(F.lag("close", 1).over(series_window()))
    )


def obv(bars: DataFrame) -> DataFrame:
    """On-balance volume and its 20-row relative change."""
    w = series_window()
    signed = clean_bars(bars).select(
        "ticker", "date",
        (F.coalesce(F.signum(F.col("close") - F.lag("close", 1).over(w)), F.lit(0.0)) * _volume()).alias("s"),
    )
    total = signed.select(
        "ticker", "date", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("obv")
    )
    return total.select("*", change(F.col("obv"), F.lag("obv", 20).over(w)).alias("obv_20d_change"))


def dollar_volume(bars: DataFrame) -> DataFrame:
    base = clean_bars(bars).select("ticker", "date", (F.col("close") * _volume()).alias("dollar_volume"))
    return base.select(
        "*", rolling_dense(series_window(), 20)(F.avg, F.col("dollar_volume")).alias("dollar_volume_sma_20")
    )


def price_features(bars: DataFrame) -> DataFrame:
    """The bar columns plus all 56 features in one exchange."""
    w = series_window()
    kept = clean_bars(bars)
    bar_columns = kept.columns
    close = F.col("close")

    # look-backs and frames over the raw columns
    raw = kept.select(
        *bar_columns, *position_columns(),
        F.lag(close, 1).over(w).alias("_prev"),
        *[change(close, F.lag(close, n).over(w)).alias(f"return_{n}d") for n in (1, 5, 10, 20)],
        *[change(close, F.lag(close, n).over(w)).alias(f"momentum_{n}d") for n in (5, 10, 20, 60)],
        *[rolling_dense(w, n)(F.avg, close).alias(f"SMA_{n}") for n in (20, 50, 200)],
        rolling_dense(w, 20)(F.stddev_samp, close).alias("_std20"),
        *_extremes(w, 20), *_extremes(w, 60),
        _volume().alias("_v"),
        *[rolling_dense(w, n)(F.avg, _volume()).alias(f"volume_sma_{n}") for n in (20, 50)],
        rolling_dense(w, 20)(F.stddev_samp, _volume()).alias("_vstd"),
        F.lag(_volume(), 1).over(w).alias("_vprev"),
        rolling_dense(w, 20)(F.avg, close * _volume()).alias("dollar_volume_sma_20"),
    )
    rows = raw.select(
        "*", close.alias("_x"),
        F.ln(safe_div(close, F.col("_prev"))).alias("log_return_1d"),
        _true_range(F.col("high"), F.col("low"), F.col("_prev")).alias("_tr"),
        (F.coalesce(F.signum(close - F.col("_prev")), F.lit(0.0)) * F.col("_v")).alias("_sv"),
        *_gain_loss(close, F.col("_prev")),
    )
    # from here every window sorts by (block, date), which is the date order again
    b = _block_series()
    second = with_emas(
        rows,
        [
            ("EMA_12", "_x", span_alpha(12), 0), ("EMA_26", "_x", span_alpha(26), 0),
            ("_avg_gain", "_gain", 1 / 14, 1), ("_avg_loss", "_loss", 1 / 14, 1),
        ],
    ).select(
        "*", (F.col("EMA_12") - F.col("EMA_26")).alias("MACD"),
        *[
            rolling(b, n)(F.stddev_samp, F.col("return_1d")).alias(f"volatility_{n}d")
            for n in (5, 10, 20, 60)
        ],
        rolling(b, 14)(F.avg, F.col("_tr")).alias("ATR"),
        F.sum("_sv").over(b.rowsBetween(W.unboundedPreceding, 0)).alias("obv"),
        _rsi_value(14).alias("RSI"),
    )
    third = with_emas(second, [("MACD_signal", "MACD", span_alpha(9), 0)])
    done = third.select(
        "*",
        F.lag("obv", 20).over(b).alias("_obv20"),
    ).select(
        "*",
        (F.col("MACD") - F.col("MACD_signal")).alias("MACD_hist"),
        *_bollinger_columns(close, F.col("SMA_20"), F.col("_std20")),
        safe_div(F.col("ATR"), close).alias("atr_pct"),
        safe_div(F.col("_tr"), close).alias("true_range_pct"),
        safe_div(F.col("_v"), F.col("volume_sma_20")).alias("volume_ratio_20"),
        safe_div(F.col("_v"), F.col("volume_sma_50")).alias("volume_ratio_50"),
        change(F.col("_v"), F.col("_vprev")).alias("volume_change_1d"),
        safe_div(F.col("_v") - F.col("volume_sma_20"), F.col("_vstd")).alias("volume_zscore_20"),
        *_ma_ratio_columns(), *_range_columns(20), *_range_columns(60),
        *_shape_columns(F.col("_prev")),
        change(F.col("obv"), F.col("_obv20")).alias("obv_20d_change"),
        (close * F.col("_v")).alias("dollar_volume"),
    )
    return done.select(*bar_columns, *[finite(F.col(c)).alias(c) for c in PRICE_FEATURES])
