"""Position value over time, historical and projected, for a table of positions."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import INDEX_SYMBOL, INDEX_TICKER
from ..functions.labels import probability_from_prediction
from ..functions.numeric import clamp
from ..functions.text import strip_every_suffix

# closes used for the drift: 20 returns need 21 of them
RECENT = 21


def bar_calendar(bars: DataFrame) -> DataFrame:
    """For each ticker and calendar day, the first bar on or after it and the last on or before it.

    Turns both as-of look-ups into equi-joins. Its size is tickers times calendar days, whatever
    the number of positions.
    """
    w = W.partitionBy("ticker").orderBy("date")
    gap = bars.select("ticker", "date", "close", F.lag("date", 1).over(w).alias("before"))
    days = F.sequence(F.coalesce(F.date_add("before", 1), F.col("date")), F.col("date"))
    spread = gap.select("*", F.explode(days).alias("day"))
    return spread.select(
        "ticker", "day", F.col("date").alias("bar_date"), F.col("close").alias("entry_close"),
        F.when(F.col("day") == F.col("date"), F.col("date")).otherwise(F.col("before")).alias("held_bar"),
    )


def _spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))


def check_positions(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions with a `reason` when they cannot be valued, NULL when they can."""
    priced = bars.na.drop(subset=["date", "close"])
    spans = _spans(priced)
    joined = positions.withColumn("ticker", strip_every_suffix(F.col("ticker"))).join(spans, "ticker", "left")
    calendar = bar_calendar(priced)
    bought = calendar.select("ticker", F.col("day").alias("_entry"), "bar_date", "entry_close")
    sold = calendar.select("ticker", F.col("day").alias("_exit"), "held_bar")
    placed = (
        joined.withColumns({"_entry": F.greatest("entry_date", "first_bar"), "_exit": F.least("exit_date", "last_bar")})
        .join(bought, ["ticker", "_entry"], "left").join(sold, ["ticker", "_exit"], "left")
        .drop("_entry", "_exit")
    )
    # an exit before the first bar on or after the entry leaves no row to value
    # fixed values: reasons
    reason = (
        F.when(F.col("ticker").isin(INDEX_TICKER, INDEX_SYMBOL), "Projection requires a stock ticker, not IHSG.")
        .when(~(F.col("amount") > 0) | F.col("amount").isNull(), "amount must be greater than zero")
        .when(F.col("entry_date").isNull() | F.col("exit_date").isNull(), "entry_date and exit_date are required.")
        .when(F.col("exit_date") < F.col("entry_date"), "exit_date must be greater than or equal to entry_date")
        .when(F.col("last_bar").isNull(), "price_history must contain at least one close price")
        .when(F.col("entry_date") > F.col("last_bar"), "entry_date is after the latest available price")
        .when(F.col("bar_date") > F.col("exit_date"), "no price rows are available for the selected date range")
    )
    return placed.withColumn("reason", reason)


def recent_drift(bars: DataFrame) -> DataFrame:
    """Mean and deviation of the last 20 returns, and the last close and date, per ticker."""
    newest = W.partitionBy("ticker").orderBy(F.desc("date"))
    recent = bars.na.drop(subset=["date", "close"]).select(
        "ticker", "date", "close", F.row_number().over(newest).alias("k")
    ).where(F.col("k") <= RECENT)
    older = F.lag("close", 1).over(W.partitionBy("ticker").orderBy(F.desc("k")))
    r = recent.select("ticker", "date", "close", "k", F.when(older > 0, F.col("close") / older - 1).alias("r"))
    return r.groupBy("ticker").agg(
        F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean_return"),
        F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("volatility"),
        F.max_by("close", "date").alias("last_close"),
    )


def position_values(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per position and day held: bars first, then projected weekdays after the last held bar.

    Positions meet bars by ticker and month, so a position only travels to the months it spans;
    months hold at most 31 bars of a ticker. The projection is closed-form per weekday.
    """
    good = check_positions(positions, bars).where("reason is null").withColumn("shares", F.col("amount") / F.col("entry_close"))
    month = F.trunc("date", "month")
    months = F.sequence(F.trunc("bar_date", "month"), F.trunc("held_bar", "month"), F.expr("interval 1 month"))
    days = bars.na.drop(subset=["date", "close"]).select("ticker", "date", "close", month.alias("_month"))
    keep = ["position_id", "ticker", "amount", "entry_date", "exit_date", "bar_date", "entry_close", "shares"]
    actual = (
        good.withColumn("_month", F.explode(months)).join(days, ["ticker", "_month"])
        .where((F.col("date") >= F.col("bar_date")) & (F.col("date") <= F.col("exit_date")))
    )
    value = F.col("shares") * F.col("close")
    history = actual.select(
        *keep, "date", "close", value.alias("value"), value.alias("lower_value"), value.alias("upper_value"),
        F.lit("historical").alias("kind"),
    )
    return history.unionByName(project_positions(good, bars, keep))


def project_positions(good: DataFrame, bars: DataFrame, keep: list[str]) -> DataFrame:
    """Weekday rows after the last bar held up to the exit date, from the ticker's latest close."""
    ahead = good.where(F.col("exit_date") > F.col("held_bar")).join(recent_drift(bars), "ticker")
    p = F.coalesce(clamp(F.col("probability_up"), 0.0, 1.0), F.lit(0.5))
    daily = clamp(F.col("mean_return") + (p - 0.5) * F.col("volatility"), -0.1, 0.1)
    calendar = F.filter(
        F.sequence(F.date_add("held_bar", 1), F.col("exit_date")), lambda d: F.weekday(d) < 5
    )
    rows = ahead.withColumn("_daily", daily).select(
        *keep, "_daily", "volatility", "last_close", F.posexplode(calendar).alias("_h", "date")
    )
    h = F.col("_h") + 1
    close = F.col("last_close") * F.pow(1 + F.col("_daily"), h)
    band = F.col("volatility") * F.sqrt(h.cast("double"))
    value = F.col("shares") * close
    return rows.select(
        *keep, "date", close.alias("close"), value.alias("value"),
        (value * F.greatest(F.lit(0.01), 1 - band)).alias("lower_value"),
        (value * (1 + band)).alias("upper_value"), F.lit("projected").alias("kind"),
    )


def position_summary(values: DataFrame) -> DataFrame:
    """Exit value, profit and mode per position."""
    out = values.groupBy("position_id", "ticker", "amount", "bar_date", "exit_date", "entry_close", "shares").agg(
        F.max_by("value", "date").alias("exit_value"), F.count("*").alias("rows"),
        F.max("date").alias("last_date"), F.bool_or(F.col("kind") == "projected").alias("_p"),
    )
    return out.select(
        "position_id", "ticker", F.col("bar_date").alias("entry_date"), F.col("exit_date").alias("requested_exit_date"),
        "entry_close", "shares", F.col("amount").alias("initial_amount"), "exit_value",
        (F.col("exit_value") - F.col("amount")).alias("profit_loss"),
        (F.col("exit_value") / F.col("amount") - 1).alias("profit_loss_pct"),
        F.when(F.col("_p"), "projected").otherwise("historical").alias("mode"), "rows", "last_date",
    )


def positions_with_signal(positions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Attach the probability implied by each ticker's prediction; no model answer leaves NULL."""
    signal = predictions.select(
        "ticker",
        F.when(F.col("status") == "ok", probability_from_prediction(F.col("predicted_direction"), F.col("confidence"))).alias("probability_up"),
    )
    return positions.withColumn("ticker", strip_every_suffix(F.col("ticker"))).join(signal, "ticker", "left")
