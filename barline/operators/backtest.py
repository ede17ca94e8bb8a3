"""Date splits, purged folds and per-date ranking metrics."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import NEWS_FEATURES
from ..functions.numeric import pearson_from_sums, safe_div
from ..schema import require_columns

# fixed values: columns that are never model features
NOT_FEATURES = {
    "date", "target_return", "next_day_price", "direction", "market_next_return",
    "target_excess_return", "outperform_market", "sector_next_return",
    "target_sector_excess_return", "outperform_sector", "name", "yfinance_symbol", "source", "interval",
}
NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint", "boolean")


def _numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def feature_columns(df: DataFrame, include_news: bool = True) -> list[str]:
    """Numeric columns that are neither keys nor labels; the baseline leaves news columns out."""
    news = {c for c in df.columns if c in NEWS_FEATURES or c.startswith("embedding_dim_")}
    found = [
        c for c in _numeric_columns(df) if c not in NOT_FEATURES and (include_news or c not in news)
    ]
    if not found:
        raise ValueError("dataset has no numeric feature columns")
    return found


def direction_feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Categorical and numeric features of the direction dataset."""
    categorical = [c for c in ("ticker", "sector") if c in df.columns]
    out = {"date", "target_next_return", "target_next_direction"}
    numeric = [c for c in _numeric_columns(df) if c not in out and c not in categorical]
    if not numeric:
        raise ValueError("dataset has no numeric feature columns")
    return categorical, numeric


def model_features(df: DataFrame, features: list[str], keep=("ticker", "date")) -> DataFrame:
    """Numeric features as 32-bit floats, text features with UNKNOWN for NULL."""
    types = dict(df.dtypes)

    def cast(c):
        if types[c] == "string":
            return F.coalesce(c, F.lit("UNKNOWN")).alias(c)
        return F.col(c).cast("float").alias(c)

    return df.select(*keep, *[cast(c) for c in features])


def training_rows(df: DataFrame, target: str = "target_return") -> DataFrame:
    """Labelled rows only; the return target also needs the next price."""
    require_columns(df, ["date", "ticker", "close", target], "dataset")
    needed = ["date", "ticker", "close", target] + (["next_day_price"] if target == "target_return" else [])
    return df.na.drop(subset=needed)


def date_positions(df: DataFrame) -> DataFrame:
    """Distinct dates with their zero-based position and their number; one row per calendar day."""
    dates = df.select("date").where("date is not null").distinct()
    whole = W.partitionBy(F.lit(1))
    return dates.select(
        "date", (F.row_number().over(whole.orderBy("date")) - 1).alias("pos"),
        F.count("*").over(whole).alias("total"),
    )


def split_by_date(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Add `part` (train or test) by a chronological cut over distinct dates.

    Fewer than three dates cannot be split: every row then has a NULL part. `train_test`
    checks that with one small job.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    dates = date_positions(df)
    cut = F.least(F.greatest((F.col("total") * F.lit(1 - test_size)).cast("int"), F.lit(1)), F.col("total") - 1)
    first_test = dates.where((F.col("total") >= 3) & (F.col("pos") == cut)).agg(F.max("date")).scalar()
    return df.withColumn("part", F.when(F.col("date") < first_test, "train").when(F.col("date") >= first_test, "test"))


def train_test(df: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    if df.select("date").where("date is not null").distinct().limit(3).count() < 3:
        raise ValueError("dataset must contain at least 3 unique dates")
    marked = split_by_date(df, test_size)
    return marked.where("part = 'train'").drop("part"), marked.where("part = 'test'").drop("part")


def fold_dates(df: DataFrame, n_splits: int = 5, gap_dates: int = 1) -> DataFrame:
    """(fold, role, date) of an expanding time-series split with a purge gap.

    With D dates and s folds each test block has D // (s + 1) dates, the last one ends at the
    last date, and training stops `gap_dates` before the block. Folds without training dates
    are skipped.
    """
    if gap_dates < 0:
        raise ValueError("gap_dates must be zero or greater")
    dates = date_positions(df)
    splits = F.least(F.lit(max(2, n_splits)), F.col("total") - 1).cast("int")
    # below three dates there is nothing to evaluate
    usable = dates.where("total >= 3").withColumn("s", splits)
    size = F.floor(F.col("total") / (F.col("s") + 1)).cast("int")
    spread = usable.withColumn("size", size).withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("s"))))
    start = F.col("total") - (F.col("s") - F.col("fold") + 1) * F.col("size")
    placed = spread.withColumn("start", start).where(F.col("start") - gap_dates > 0)
    role = F.when(F.col("pos") < F.col("start") - gap_dates, "train").when(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size")), "test"
    )
    return placed.select("fold", role.alias("role"), "date").where("role is not null")


def purged_folds(df: DataFrame, n_splits: int = 5, gap_dates: int = 1) -> DataFrame:
    """Rows with their fold and role; joined by date, which is an equi-join."""
    return df.join(fold_dates(df, n_splits, gap_dates), "date")


def average_ranks(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Average-tie rank inside each group of `by`."""
    ranked = F.rank().over(W.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(W.partitionBy(*by, value))
    return df.withColumn(out, ranked + (ties - 1) / F.lit(2.0))


def regression_metrics(df: DataFrame, by=("fold",), predicted: str = "predicted_return", target: str = "target_return") -> DataFrame:
    """Price and return errors and directional hit rates per group, one partial aggregate."""
    actual, guess = F.col("next_day_price"), F.col("close") * (1 + F.col(predicted))
    error, miss = actual - guess, F.col(target) - F.col(predicted)
    up, rose = F.col(predicted) > 0, F.col("target_return") > 0
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.abs(safe_div(error, actual))), F.lit(0.0)).alias("mape"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("target_rmse"), F.avg(F.abs(miss)).alias("target_mae"),
        F.avg((up == rose).cast("double")).alias("directional_accuracy"),
        F.coalesce(F.avg(F.when(up, rose.cast("double"))), F.lit(0.0)).alias("up_precision"),
        F.coalesce(F.avg(F.when(~up, (~rose).cast("double"))), F.lit(0.0)).alias("down_precision"),
        F.count("*").alias("rows"),
    )


def top_n_selection(df: DataFrame, top_n: int = 10, by=("date",), predicted: str = "predicted_return") -> DataFrame:
    """The n highest (`top`) and lowest (`bottom`) predictions per date, ties by ticker."""
    if top_n < 1:
        raise ValueError("selection_top_n must be at least 1")
    frame = df.na.drop(subset=["date", "target_return", predicted])

    def side(name, order):
        w = W.partitionBy(*by).orderBy(order, "ticker")
        return (
            frame.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_n)
            .withColumn("side", F.lit(name))
        )

    return side("top", F.desc(predicted)).unionByName(side("bottom", F.asc(predicted)))


def selection_by_date(df: DataFrame, top_n: int = 10, by=("fold",), predicted: str = "predicted_return") -> DataFrame:
    """Rank correlation and top-n figures of every date with two rows or more.

    A date's cross-section is bounded by the number of instruments; everything past the two
    rank sorts is partial aggregation.
    """
    if top_n < 1:
        raise ValueError("selection_top_n must be at least 1")
    keys = list(dict.fromkeys([*by, "date"]))
    frame = df.na.drop(subset=["date", "target_return", predicted])
    ranked = average_ranks(average_ranks(frame, predicted, keys, "_rp"), "target_return", keys, "_ra")
    w = W.partitionBy(*keys)
    placed = ranked.select(
        *keys, "target_return", "_rp", "_ra",
        F.row_number().over(w.orderBy(F.desc(predicted), "ticker")).alias("_top"),
        F.row_number().over(w.orderBy(F.asc(predicted), "ticker")).alias("_bottom"),
        F.avg("target_return").over(w).alias("_market"),
        F.count("*").over(w).alias("_n"),
    )
    mid = (F.col("_n") + 1) / F.lit(2.0)
    x, y, r = F.col("_rp") - mid, F.col("_ra") - mid, F.col("target_return")
    top, bottom = F.col("_top") <= top_n, F.col("_bottom") <= top_n
    daily = placed.where("_n >= 2").groupBy(*keys).agg(
        pearson_from_sums(F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)).alias("rank_ic"),
        F.avg(F.when(top, r)).alias("top_n_avg_return"),
        F.avg(F.when(top, (r > 0).cast("double"))).alias("top_n_hit_rate"),
        F.avg(F.when(top, (r > F.col("_market")).cast("double"))).alias("top_n_outperform_rate"),
        F.avg(F.when(bottom, r)).alias("_bottom_avg"), F.first("_market").alias("market_return"),
        F.count("*").alias("rows"),
    )
    return daily.select(
        *keys, "rank_ic", "top_n_avg_return", "top_n_hit_rate",
        (F.col("top_n_avg_return") - F.col("market_return")).alias("top_n_excess_return"),
        "top_n_outperform_rate", (F.col("top_n_avg_return") - F.col("_bottom_avg")).alias("long_short_return"),
        "rows",
    )


SELECTION = ["rank_ic", "top_n_avg_return", "top_n_hit_rate", "top_n_excess_return", "top_n_outperform_rate", "long_short_return"]


def selection_metrics(df: DataFrame, top_n: int = 10, by=("fold",), predicted: str = "predicted_return") -> DataFrame:
    """Mean over dates; a measure without any value counts as zero."""
    return selection_by_date(df, top_n, by, predicted).groupBy(*by).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in SELECTION], F.count("*").alias("selection_dates")
    )


def fold_metrics(df: DataFrame, top_n: int = 10, predicted: str = "predicted_return", target: str = "target_return") -> DataFrame:
    """All return metrics per fold."""
    return regression_metrics(df, ("fold",), predicted, target).join(selection_metrics(df, top_n, ("fold",), predicted), "fold", "left").fillna(
        0.0, SELECTION
    ).fillna(0, ["selection_dates"])


ERRORS = ["mape", "rmse", "mae", "target_rmse", "target_mae", "directional_accuracy", "up_precision", "down_precision"]


def fold_mean(folds: DataFrame) -> DataFrame:
    """Unweighted mean over folds to six places; rows and dates add up."""
    return folds.agg(
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ERRORS + SELECTION],
        F.count("*").alias("folds"), F.sum("rows").alias("evaluation_rows"),
        F.sum("selection_dates").cast("bigint").alias("selection_dates"),
    )


def confusion_metrics(df: DataFrame, by=("fold",), actual: str = "direction", predicted: str = "predicted_direction") -> DataFrame:
    """Accuracy, precision, recall and F1; an undefined ratio is zero."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    hit, claimed, real = F.count_if(a & p), F.count_if(p), F.count_if(a)
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(hit.cast("double"), claimed.cast("double")), zero).alias("precision"),
        F.coalesce(F.try_divide(hit.cast("double"), real.cast("double")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * hit, (claimed + real).cast("double")), zero).alias("f1"),
        F.count("*").alias("rows"),
    )


def exact_auc(df: DataFrame, by=("fold",), actual: str = "direction", score: str = "probability_up", slices: int = 64) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with one class only.

    Rows fold to counts per distinct score first. The running count of negatives below a score
    comes in two steps, over `slices` score ranges cut at approximate quantiles and then inside
    each range, so no group's scores meet in one task. The cut points only balance the work;
    the result does not depend on them.
    """
    keys = list(by)
    counts = df.na.drop(subset=[actual, score]).groupBy(*keys, score).agg(
        F.count_if(F.col(actual) == 1).cast("double").alias("pos"),
        F.count_if(F.col(actual) != 1).cast("double").alias("neg"),
    )
    cuts = [i / slices for i in range(1, slices)]
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(score, cuts, 10_000).alias("_cuts"))
    sliced = counts.join(bounds, keys).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col(score)))
    ).drop("_cuts")
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("neg").alias("_neg"))
    before = F.coalesce(
        F.sum("_neg").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
    )
    offsets = per_slice.select(*keys, "_slice", before.alias("_before"))
    below = F.coalesce(
        F.sum("neg").over(W.partitionBy(*keys, "_slice").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
    )
    ranked = sliced.withColumn("_below", below).join(offsets, [*keys, "_slice"])
    wins = F.sum(F.col("pos") * (F.col("_before") + F.col("_below") + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(safe_div(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def classifier_metrics(df: DataFrame, by=("fold",), actual="direction", predicted="predicted_direction", score="probability_up") -> DataFrame:
    return confusion_metrics(df, by, actual, predicted).join(exact_auc(df, by, actual, score), list(by), "left")


def classifier_fold_mean(folds: DataFrame) -> DataFrame:
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    return folds.agg(
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names],
        F.count("*").alias("folds"), F.sum("rows").alias("evaluation_rows"),
    )


def compare_models(baseline: DataFrame, with_news: DataFrame) -> DataFrame:
    """Deltas between two one-row metric tables."""
    def part(df):
        return df.select(F.struct(*df.columns)).scalar()

    both = baseline.select(F.struct(*baseline.columns).alias("b"), part(with_news).alias("n"))

    def zero(side, c):
        return F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0)) if c in have[side] else F.lit(0.0)

    have = {"b": set(baseline.columns), "n": set(with_news.columns)}

    def maybe(side, c):
        return F.col(f"{side}.{c}") if c in have[side] else F.lit(None).cast("double")

    bm, nm = zero("b", "mape"), zero("n", "mape")
    acc, cls = "directional_accuracy", "direction_classifier_accuracy"
    return both.select(
        bm.alias("baseline_mape"), nm.alias("nlp_model_mape"),
        F.round(F.coalesce(safe_div(bm - nm, bm) * 100, F.lit(0.0)), 6).alias("mape_improvement_pct"),
        maybe("b", acc).alias("baseline_directional_accuracy"), maybe("n", acc).alias("nlp_directional_accuracy"),
        F.round(maybe("n", acc) - maybe("b", acc), 6).alias("directional_accuracy_delta"),
        maybe("b", cls).alias("baseline_direction_classifier_accuracy"),
        maybe("n", cls).alias("nlp_direction_classifier_accuracy"),
        F.round(maybe("n", cls) - maybe("b", cls), 6).alias("direction_classifier_accuracy_delta"),
        zero("b", "rank_ic").alias("baseline_rank_ic"), zero("n", "rank_ic").alias("nlp_rank_ic"),
        F.round(zero("n", "rank_ic") - zero("b", "rank_ic"), 6).alias("rank_ic_delta"),
        zero("b", "top_n_excess_return").alias("baseline_top_n_excess_return"),
        zero("n", "top_n_excess_return").alias("nlp_top_n_excess_return"),
        F.round(zero("n", "top_n_excess_return") - zero("b", "top_n_excess_return"), 6).alias("top_n_excess_return_delta"),
        ((bm != 0) & (nm < bm)).alias("nlp_helped"),
    )
