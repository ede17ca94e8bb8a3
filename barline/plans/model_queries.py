"""Registered queries that fit models, and the incremental daily run.

They train on the fused dataset, all its features and every labelled row, with forests of the
fixed sizes. Trees differ between libraries, so only their inputs, counts and metric formulas are
comparable elsewhere.
"""

from pyspark.sql import functions as F

from ..constants import NEWS_FEATURES, PRICE_FEATURES
from ..operators import backtest, models, training
from ..session import cut_lineage, run_folder, spread
from ..sources import views
from . import derived, news_queries, price_queries, training_jobs
from .sqlkit import rnd, sql

QUERIES, ORACLES = {}, {}
FOREST = {"kind": "forest"}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@views.shared
def _dataset(spark, sf):
    """The fused dataset, written once as fitting reads its rows many times, and its usable features."""
    rows = spread(derived.dataset(spark, sf))
    return rows, models.usable_features(rows, backtest.feature_columns(rows))


def _rows(spark, sf):
    rows, features = _dataset(spark, sf)
    return backtest.training_rows(rows), features


LABELLED_COUNTS = "SELECT ticker, count(*) AS rows, count(*) AS {0} FROM labelled WHERE target_return IS NOT NULL AND next_day_price IS NOT NULL GROUP BY ticker"


@query("regression_model", sql(LABELLED_COUNTS.format("predicted")))
def regression_model(spark, sf):
    rows, features = _rows(spark, sf)
    model = models.fit_return_model(rows, features, **FOREST)
    scored = model.transform(models._as_double(rows, features))
    return scored.groupBy("ticker").agg(F.count("*").alias("rows"), F.count("predicted_return").alias("predicted"))


@query("direction_classifier", sql(LABELLED_COUNTS.format("scored")))
def direction_classifier(spark, sf):
    rows, features = _rows(spark, sf)
    model = models.fit_direction_classifier(rows, features, **FOREST)
    scored = models.score_direction(model, models._as_double(rows, features))
    return scored.groupBy("ticker").agg(
        F.count("*").alias("rows"), F.count_if(F.col("probability_up").between(0, 1)).alias("scored")
    )


@query("feature_importance_top20")
def feature_importance_top20(spark, sf):
    rows, features = _rows(spark, sf)
    return models.feature_importance(models.fit_return_model(rows, features, **FOREST), features)


@query("cross_validate_returns")
def cross_validate_returns(spark, sf):
    return models.cross_validate_returns(*_rows(spark, sf), **FOREST)


@query("cross_validate_direction")
def cross_validate_direction(spark, sf):
    return models.cross_validate_direction(*_rows(spark, sf), **FOREST)


@query("predict_latest")
def predict_latest(spark, sf):
    rows, features = _dataset(spark, sf)
    labelled = backtest.training_rows(rows)
    model = models.fit_return_model(labelled, features, **FOREST)
    classifier = models.fit_direction_classifier(labelled, features, **FOREST)
    return models.predict_latest(model, rows, features, classifier, model_type="forest")


@views.shared
def _graph_training(spark, sf):
    source = cut_lineage(price_queries.graph_source(spark, sf))
    return training.training_features(source), training.latest_inference_features(source)


@query("direction_baseline")
def direction_baseline(spark, sf):
    data = spread(_graph_training(spark, sf)[0])
    train, test = backtest.train_test(data)
    categorical, numeric = backtest.direction_feature_columns(data)
    model = models.direction_baseline(categorical, numeric, **FOREST).fit(train)
    return models.direction_metrics(models.score_direction(model, test))


@query("predict_directions")
def predict_directions(spark, sf):
    data, latest = _graph_training(spark, sf)
    data = spread(data)
    categorical, numeric = backtest.direction_feature_columns(data)
    model = models.direction_baseline(categorical, numeric, **FOREST).fit(data)
    return models.predict_directions(model, latest, categorical + numeric, "forest")


_PRICE, _NEWS = ", ".join(f"p.{c}" for c in PRICE_FEATURES), ", ".join(f"{rnd(f'coalesce(f.{c}, 0.0)')} AS {c}" for c in NEWS_FEATURES)


@query("dataset_deduplicated", sql(
    f"""SELECT l.ticker, l.date, u.sector, {_PRICE}, {_NEWS}, e.ticker_encoded, e.sector_encoded, {rnd('e.market_cap_encoded')} AS market_cap_encoded, {rnd('l.target_return')} AS target_return
        FROM labelled l JOIN universe u USING (ticker) JOIN features p ON p.ticker = l.ticker AND p.date = l.date
        JOIN enc e ON e.ticker = l.ticker AND e.date = l.date LEFT JOIN folded f ON f.ticker = l.ticker AND f.date = l.date""",
    True, **price_queries.FEATURE_STEPS, features=price_queries.ALL_FEATURES, **news_queries.UNIQUE_DAILY, **news_queries.LAGGED, enc=news_queries.ENCODED))
def dataset_deduplicated(spark, sf):
    """The chain that feeds the models: 56 technical and 13 news features of de-duplicated articles, codes and target."""
    out = derived.dataset(spark, sf, vectors=False).select(
        "ticker", "date", "sector", *PRICE_FEATURES, *NEWS_FEATURES, "ticker_encoded", "sector_encoded", "market_cap_encoded", "target_return")
    return derived.rounded(out, 6, **price_queries.LEVELS)


JOB_ROWS = {
    "rows": "SELECT * FROM labelled WHERE target_return IS NOT NULL AND next_day_price IS NOT NULL",
    "d": price_queries.DATES.replace("scored", "rows"), "folds": price_queries.FOLDS,
    "tested": "SELECT count(*) AS n, count(DISTINCT fold) AS folds FROM rows JOIN folds USING (date) WHERE role = 'test'",
}


@query("train_global", sql(
    """SELECT count(*) AS train_rows, CAST(min(date) AS VARCHAR) AS train_start_date, CAST(max(date) AS VARCHAR) AS train_end_date,
       (SELECT n FROM tested) AS evaluation_rows, (SELECT folds FROM tested) AS folds, (SELECT n FROM tested) AS direction_classifier_evaluation_rows,
       (SELECT folds FROM tested) AS direction_classifier_folds, CAST(135 AS BIGINT) AS feature_count, CAST(1 AS BIGINT) AS gap_dates, CAST(10 AS BIGINT) AS selection_top_n,
       (SELECT count(DISTINCT ticker) FROM bars) AS predictions, true AS errors_agree, true AS accuracy_agrees, 'forest' AS model_type FROM rows""", **JOB_ROWS))
def train_global(spark, sf):
    """The whole job with its stored artifacts, in a fresh folder below the shared one.

    Its metrics are held against plain sums over the stored test rows of the folds.
    """
    folder = run_folder(spark)
    metrics = training_jobs.train_global(_dataset(spark, sf)[0], folder, **FOREST)
    miss = F.abs(F.expr("next_day_price - close * (1 + predicted_return)"))
    by_fold = spark.read.parquet(f"{folder}/fold_returns").groupBy("fold").agg(
        F.avg(miss / F.abs("next_day_price")).alias("mape"), F.avg(miss).alias("mae"))
    errors = by_fold.agg(F.round(F.avg("mape"), 6).alias("mape"), F.round(F.avg("mae"), 6).alias("mae")).first()
    hits = spark.read.parquet(f"{folder}/fold_directions").groupBy("fold").agg(F.avg(F.expr("int(direction = predicted_direction)")).alias("hit"))
    hit = hits.agg(F.round(F.avg("hit"), 6)).first()[0]
    predictions = spark.read.parquet(f"{folder}/predictions").count()

    def near(column, value):
        return F.abs(F.col(column) - F.lit(value)) < 2e-6

    return metrics.select(
        "train_rows", F.col("train_start_date").cast("string").alias("train_start_date"), F.col("train_end_date").cast("string").alias("train_end_date"),
        "evaluation_rows", "folds", "direction_classifier_evaluation_rows", "direction_classifier_folds", "feature_count", "gap_dates", "selection_top_n",
        F.lit(predictions).cast("bigint").alias("predictions"), (near("mape", errors.mape) & near("mae", errors.mae)).alias("errors_agree"),
        near("direction_classifier_accuracy", hit).alias("accuracy_agrees"), "model_type",
    )


@query("daily_update", sql(
    """SELECT (SELECT count(*) FROM universe) AS stock_rows, (SELECT count(DISTINCT sector) FROM universe) AS stock_sectors, (SELECT count(*) FROM bars) AS price_rows,
       (SELECT count(*) FROM edges) AS correlation_rows,
       (SELECT count(*) FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM bars) WHERE i >= 20 AND nx IS NOT NULL) AS feature_rows,
       true AS trained_model, (SELECT count(*) FROM (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) > 20)) AS prediction_rows"""))
def daily_update(spark, sf):
    done = training_jobs.daily_update(
        spark, run_folder(spark), views.universe(spark, sf), views.bars(spark, sf), min_abs_correlation=0.02, train=True, **FOREST
    ).to_dict()
    done.pop("skipped_steps")
    return spark.createDataFrame([tuple(done.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'bigint'}" for k, v in done.items()))
