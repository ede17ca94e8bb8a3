"""Threshold tables: scores to readable labels."""

from pyspark.sql import Column, functions as F

from ..constants import LATEST_NEWS_TEXT, LIMITED_NEWS_TEXT, SENTIMENT_BAND
from .numeric import safe_div


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score.isNull(), "Unknown")
        .when(score > SENTIMENT_BAND, "Positive")
        .when(score < -SENTIMENT_BAND, "Negative")
        .otherwise("Neutral")
    )


def signed_status(score: Column) -> Column:
    return (
        F.when(score > SENTIMENT_BAND, "positive")
        .when(score < -SENTIMENT_BAND, "negative")
        .otherwise("neutral")
    )


def classifier_score(label: Column, score: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    value = F.coalesce(score, F.lit(0.0))
    return (
        F.when(low.contains("neg") | F.endswith(low, F.lit("_0")), -value)
        .when(low.contains("pos") | F.endswith(low, F.lit("_2")), value)
        .otherwise(F.lit(0.0))
    )


def direction_label(direction: Column) -> Column:
    return F.when(direction == 1, "Up").when(direction == 0, "Down").otherwise("Unknown")


def _return_band(predicted_return: Column) -> Column:
    return (
        F.when(predicted_return > 0.001, "UP")
        .when(predicted_return < -0.001, "DOWN")
        .otherwise("NEUTRAL")
    )


def watchlist_direction(direction: Column, predicted_return: Column) -> Column:
    return (
        F.when(direction == 1, "UP")
        .when(direction == 0, "DOWN")
        .otherwise(_return_band(predicted_return))
    )


def ranking_direction(direction: Column, predicted_return: Column) -> Column:
    return F.when(predicted_return.isNotNull(), _return_band(predicted_return)).otherwise(
        watchlist_direction(direction, predicted_return)
    )


def ranking_score(predicted_return, probability_up, confidence, direction) -> Column:
    signed = F.when(direction == 1, confidence).when(direction == 0, -confidence)
    return F.coalesce(predicted_return, probability_up - F.lit(0.5), signed)


def confidence_from_probability(p: Column) -> Column:
    return F.least(F.abs(p - F.lit(0.5)) * 2, F.lit(1.0))


def confidence_from_return(r: Column, volatility: Column) -> Column:
    base = F.coalesce(F.nullif(F.abs(volatility), F.lit(0.0)), F.lit(0.02))
    return F.least(F.abs(r) / base, F.lit(1.0))


def probability_from_prediction(direction: Column, confidence: Column) -> Column:
    bounded = F.when(
        confidence.isNotNull(), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    )
    return F.when(direction == 1, 0.5 + bounded * 0.5).when(direction == 0, 0.5 - bounded * 0.5)


def relative_position(left: Column, right: Column) -> Column:
    return safe_div(left, right) - F.lit(1.0)


def bounded_score(value: Column) -> Column:
    return F.coalesce(
        F.when(
            value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value / F.lit(0.08)))
        ),
        F.lit(0.0),
    )


def score_status(score: Column) -> Column:
    return F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")


def trend_label(close: Column, sma20: Column, sma50: Column) -> Column:
    return (
        F.when(close.isNull(), "No price signal")
        .when((sma20 != 0) & (sma50 != 0) & (close > sma20) & (close > sma50),
              "Above key moving averages")
        .when((sma50 != 0) & (close < sma50), "Below SMA 50")
        .when((sma20 != 0) & (close < sma20), "Below SMA 20")
        .otherwise("Mixed trend")
    )


def momentum_label(r: Column) -> Column:
    return (
        F.when(r.isNull(), "No recent momentum")
        .when(r > 0.03, "Strong bullish")
        .when(r > 0.005, "Mild bullish")
        .when(r < -0.03, "Strong bearish")
        .when(r < -0.005, "Mild bearish")
        .otherwise("Sideways")
    )


def volume_label(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), "No volume signal")
        .when(ratio >= 1.5, "High activity")
        .when(ratio >= 1.05, "Moderate activity")
        .when(ratio <= 0.65, "Quiet trading")
        .otherwise("Normal activity")
    )


def volatility_label(v: Column) -> Column:
    return (
        F.when(v.isNull(), "No volatility signal")
        .when(v >= 0.05, "High")
        .when(v >= 0.025, "Moderate")
        .otherwise("Low")
    )


def confidence_label(c: Column) -> Column:
    return (
        F.when(c.isNull(), "No model signal")
        .when(c >= 0.65, "High")
        .when(c >= 0.35, "Moderate")
        .otherwise("Low")
    )


def market_bias(bullish: Column, total: Column) -> Column:
    ratio = safe_div(bullish.cast("double"), total.cast("double"))
    return F.when(ratio >= 0.58, "bullish").when(ratio <= 0.42, "bearish").otherwise("neutral")


def news_bucket(label: Column, score: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(low.contains("positive"), "positive")
        .when(low.contains("negative"), "negative")
        .when(low.contains("neutral"), "neutral")
        .otherwise(signed_status(score))
    )


def model_health(accuracy: Column, news_mape: Column, base_mape: Column, improvement: Column) -> Column:
    improved = F.coalesce(news_mape <= base_mape, F.lit(True))
    good = (F.coalesce(accuracy >= 0.53, F.lit(False)) & improved) | F.coalesce(
        news_mape <= 0.08, F.lit(False)
    )
    return (
        F.when(good, "Operational")
        .when(improvement <= 0, "Technical Baseline Stable")
        .otherwise("Model Active")
    )


def news_context(has_ticker: Column, has_market_rows: Column) -> Column:
    return F.when(has_ticker & F.coalesce(has_market_rows, F.lit(False)), LIMITED_NEWS_TEXT).otherwise(
        LATEST_NEWS_TEXT
    )
