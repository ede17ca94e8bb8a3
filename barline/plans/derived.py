"""Tables between the raw views and the registered queries: predictions, scores, positions."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import change
from ..operators import fusion, news_features, serving, technical
from ..sources import views
from .sqlkit import NEGATIVE, POSITIVE


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Doubles rounded for comparison across engines; `by_column` overrides single columns."""

    def show(c, t):
        # two steps: summation noise goes first, then exact halves round away from zero
        value = F.round(F.round(c, 9), by_column.get(c, digits))
        return value.alias(c) if t == "double" else F.col(f"`{c}`")

    return df.select(*[show(c, t) for c, t in df.dtypes])


def articles(spark, sf) -> DataFrame:
    return news_features.prepare_articles(views.news(spark, sf), POSITIVE, NEGATIVE)


@views.once
def daily(spark, sf) -> DataFrame:
    return news_features.daily_news(articles(spark, sf))


def unique_daily(spark, sf, vectors: bool = True) -> DataFrame:
    """Daily news features over de-duplicated articles."""
    return news_features.unique_daily_news(views.news(spark, sf), POSITIVE, NEGATIVE, vectors)


def dataset(spark, sf, vectors: bool = True) -> DataFrame:
    """The model-ready table: technical features of every bar fused with daily news and metadata."""
    daily_features = unique_daily(spark, sf, vectors)
    return fusion.final_dataset(technical.price_features(views.bars(spark, sf)), daily_features, views.universe(spark, sf))


def scored_news(spark, sf) -> DataFrame:
    return serving.merge_sentiment(views.news(spark, sf), daily(spark, sf))


def labelled(spark, sf) -> DataFrame:
    """Bars with label columns and the 1- and 5-row returns."""
    w = W.partitionBy("ticker").orderBy("date")
    close = F.col("close")
    return fusion.add_labels(views.bars(spark, sf)).select(
        "*", change(close, F.lag(close, 1).over(w)).alias("r1"), change(close, F.lag(close, 5).over(w)).alias("r5")
    )


def _probability() -> Column:
    lean = -0.2 * F.col("r1") + 0.1 * F.col("r5")
    return F.round(0.5 + F.greatest(F.lit(-0.45), F.least(F.lit(0.45), lean)), 4)


@views.once
def scored(spark, sf) -> DataFrame:
    """Labelled rows with two fixed-formula predictors, a probability and a class."""
    r1, r5 = F.col("r1"), F.col("r5")
    return labelled(spark, sf).where("r5 is not null and target_return is not null").select(
        "ticker", "date", "close", "next_day_price", "target_return", "direction",
        F.round(-0.5 * r1 + 0.1 * r5, 6).alias("predicted_return"),
        F.round(0.2 * r5 - 0.3 * r1, 6).alias("other_return"), _probability().alias("probability_up"),
        (-0.2 * r1 + 0.1 * r5 > 0).cast("bigint").alias("predicted_direction"),
    )


def prediction_text(spark, sf) -> DataFrame:
    """Latest predictions as text rows, with gaps that exercise every fall-back."""
    last = serving.latest_rows(labelled(spark, sf), 1).join(
        views.universe(spark, sf).select("ticker", "sector", "market_cap_rank"), "ticker"
    )
    lean = -0.5 * F.col("r1") + 0.1 * F.col("r5")
    rank = F.col("market_cap_rank")
    return last.select(
        "ticker", F.col("date").cast("string").alias("date"), "sector", F.col("close").cast("string").alias("close"),
        F.when(rank % 5 != 0, F.round(lean, 6)).cast("string").alias("predicted_return"),
        F.when(rank % 11 != 0, (lean > 0).cast("bigint")).cast("string").alias("predicted_direction"),
        F.when(rank % 7 != 0, _probability()).cast("string").alias("probability_up"),
        F.round(F.least(F.abs(lean), F.lit(1.0)), 6).cast("string").alias("confidence"),
        F.lit("formula").alias("model_name"), F.lit("").alias("model_type"),
    )


def predictions(spark, sf) -> DataFrame:
    return serving.normalize_predictions(prediction_text(spark, sf))


def positions(spark, sf) -> DataFrame:
    """Every order as a position in its customer's nation, shifted over the bar calendar."""
    orders = views.table(spark, sf, "orders")
    customer = views.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = views.table(spark, sf, "nation").select("n_nationkey", "n_name")
    entry = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 400).cast("int"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("position_id"), F.col("n_name").alias("ticker"),
            F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("amount"),
            entry.alias("entry_date"),
            F.date_add(entry, (F.col("o_custkey") % 60 - 3).cast("int")).alias("exit_date"),
            F.round((F.col("o_custkey") % 100) / F.lit(99.0), 4).alias("probability_up"),
        )
    )
