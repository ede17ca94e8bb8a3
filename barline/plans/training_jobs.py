"""End-to-end jobs: global return model, direction model, daily update."""

import json
from dataclasses import asdict, dataclass, field
from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..operators import backtest, correlation, models, training, upsert
from ..session import cut_lineage, spread, written
from ..sources.files import exists, write_csv, write_json, write_parquet


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    return one.select("*", other.select(F.struct("*")).scalar().alias("_other")).select("*", "_other.*").drop("_other")


def train_global(
    dataset: DataFrame, output: str, include_news: bool = True, model_name: str = "global_model",
    n_splits: int = 5, gap_dates: int = 1, top_n: int = 10, kind: str = "boosted", classify: bool = True, **size,
) -> DataFrame:
    """Evaluate, fit on all labelled rows, predict the latest rows, and store every artifact.

    Returns the one-row metrics table. `output` is a folder all executors can reach.
    """
    spark = dataset.sparkSession
    rows = written(backtest.training_rows(dataset))
    features = models.usable_features(rows, backtest.feature_columns(rows, include_news))
    table = models.training_table(rows, features, n_splits, gap_dates)
    fits = models.return_fits(table, [0, *models.fold_numbers(table)], kind, **size)
    if classify:
        # the final fit first: it is the longest
        fits |= models.direction_fits(table, [0, *models.fold_numbers(table, True)], kind, **size)
    fitted = models.fit_at_once(spark, dict(sorted(fits.items(), key=lambda f: f[0][1])))
    write_parquet(models.score_folds(table, fitted, "return"), f"{output}/fold_returns", "fold rows")
    metrics = models.return_quality(spark.read.parquet(f"{output}/fold_returns"), gap_dates, top_n)
    model = models.with_inputs(rows, features, fitted["return", 0])
    model.write().overwrite().save(f"{output}/model")
    classifier = None
    if classify:
        write_parquet(models.score_folds(table, fitted, "direction"), f"{output}/fold_directions", "fold rows")
        quality = models.direction_quality(spark.read.parquet(f"{output}/fold_directions"))
        metrics = _beside(metrics, quality.select(*[F.col(c).alias(f"direction_classifier_{c}") for c in quality.columns]))
        classifier = models.with_inputs(rows, features, fitted["direction", 0])
        classifier.write().overwrite().save(f"{output}/direction_model")
    span = rows.agg(F.count("*").alias("train_rows"), F.min("date").alias("train_start_date"), F.max("date").alias("train_end_date"))
    metrics = _beside(metrics, span).withColumns(
        {"model_name": F.lit(model_name), "model_type": F.lit(kind), "feature_count": F.lit(len(features))}
    )
    write_json(metrics, f"{output}/metrics")
    latest = models.predict_latest(model, dataset, features, classifier, model_name, kind)
    write_parquet(latest, f"{output}/predictions", "predictions")
    write_json(models.feature_importance(model, features), f"{output}/feature_importance")
    write_json(spark.createDataFrame([(json.dumps({"features": features, "model_type": kind}),)], "artifact string"), f"{output}/artifact")
    return spark.read.json(f"{output}/metrics")


def comparison_report(comparison: DataFrame, importance: DataFrame | None = None) -> str:
    """Markdown text of a one-row comparison table."""
    c = comparison.first().asDict()
    # fixed values: report lines
    lines = [
        "# Baseline vs NLP Global Model", "",
        f"- Baseline MAPE: {c['baseline_mape']:.6f}",
        f"- NLP Model MAPE: {c['nlp_model_mape']:.6f}",
        f"- Improvement: {c['mape_improvement_pct']:.2f}%",
        f"- Baseline directional accuracy: {c['baseline_directional_accuracy']}",
        f"- NLP directional accuracy: {c['nlp_directional_accuracy']}",
        f"- Directional accuracy delta: {c['directional_accuracy_delta']}",
        f"- Baseline direction classifier accuracy: {c['baseline_direction_classifier_accuracy']}",
        f"- NLP direction classifier accuracy: {c['nlp_direction_classifier_accuracy']}",
        f"- Direction classifier accuracy delta: {c['direction_classifier_accuracy_delta']}",
        f"- Baseline rank IC: {c['baseline_rank_ic']:.6f}",
        f"- NLP rank IC: {c['nlp_rank_ic']:.6f}",
        f"- Baseline top-N excess return: {c['baseline_top_n_excess_return']:.6f}",
        f"- NLP top-N excess return: {c['nlp_top_n_excess_return']:.6f}",
        f"- Did NLP improve MAPE: {'Yes' if c['nlp_helped'] else 'No'}", "",
    ]
    if not c["nlp_helped"]:
        lines += [
            "## Notes", "",
            "NLP did not improve this run. Common causes include limited news volume,",
            "news dates not aligning with market dates, sentiment model mismatch,",
            "data leakage checks removing useful rows, or feature engineering that needs refinement.", "",
        ]
    if importance is not None:
        rows = importance.orderBy(F.desc("importance"), "feature").limit(20).collect()
        lines += ["## Top 20 Feature Importance", "", *[f"- {r.feature}: {r.importance}" for r in rows], ""]
    return "\n".join(lines)


def train_direction(dataset: DataFrame, output: str, test_size: float = 0.2, kind: str = "boosted", **size) -> DataFrame:
    """Chronological split, fit, test metrics, stored model; returns the metrics row."""
    dataset = spread(dataset)
    train, test = backtest.train_test(dataset, test_size)
    categorical, numeric = backtest.direction_feature_columns(dataset)
    used = models.usable_features(train, numeric)
    model = models.direction_baseline(categorical, used, kind=kind, **size).fit(train)
    model.write().overwrite().save(f"{output}/model")
    metrics = models.direction_metrics(models.score_direction(model, test))
    spans = [
        df.agg(F.count("*").alias(f"{n}_rows"), F.min("date").alias(f"{n}_start_date"), F.max("date").alias(f"{n}_end_date"))
        for n, df in (("train", train), ("test", test))
    ]
    metrics = metrics.drop("rows").select("*", *[s.select(c).scalar().alias(c) for s in spans for c in s.columns])
    write_json(metrics, f"{output}/metrics")
    spark = dataset.sparkSession
    write_json(
        spark.createDataFrame([(categorical + used, kind)], "features array<string>, model_type string"), f"{output}/artifact"
    )
    return spark.read.json(f"{output}/metrics")


@dataclass
class DailyUpdate:
    stock_rows: int = 0
    stock_sectors: int = 0
    price_rows: int = 0
    correlation_rows: int = 0
    feature_rows: int = 0
    trained_model: bool = False
    prediction_rows: int = 0
    skipped_steps: list = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


def daily_update(
    spark, root: str, stocks: DataFrame | None = None, landed_bars: DataFrame | None = None, skip=(),
    tickers=None, min_observations: int = 20, min_abs_correlation: float = 0.3, train: bool = False, **size,
) -> DailyUpdate:
    """One incremental run over the tables below `root`.

    Steps: stocks, prices, correlations, features, optional training, prediction. `skip` names
    steps to leave out. A missing model skips the prediction and is not an error. Each table is
    written to a new numbered folder, so a failed run never damages the current one.
    """
    done = DailyUpdate()

    def newest_path(name):
        base = str(PurePosixPath(root) / name)
        if not exists(spark, base):
            return None, f"{base}/version=1"
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        numbers = [int(s.getPath().getName().split("=")[1]) for s in found if s.getPath().getName().startswith("version=")]
        top = max(numbers, default=0)
        return (f"{base}/version={top}" if top else None), f"{base}/version={top + 1}"

    def current(name, default=None):
        path, _ = newest_path(name)
        return spark.read.parquet(path) if path else default

    def store(name, df):
        _, path = newest_path(name)
        df.write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)

    def moments_of(observed):
        """Pair moments up to the last bar: those stored and the new days', or all anew.

        The stored ones stand for the days up to `through` of the same tickers.
        """
        names = ",".join(sorted(t.strip().upper().removesuffix(".JK") for t in tickers)) if tickers else ""
        held, through = current("pair_moments"), None
        if held is not None:
            through = held.where(F.col("scope") == names).agg(F.max("through")).first()[0]
        added = correlation.pair_moments(observed, through)
        parts = [added] if through is None else [held.select(*added.columns), added]
        last = observed.agg(F.max("date")).scalar()
        return store("pair_moments", correlation.merge_moments(*parts).withColumns({"through": last, "scope": F.lit(names)}))

    if "stock_ingestion" in skip or stocks is None:
        done.skipped_steps.append("stock_ingestion")
    else:
        store("stocks", upsert.merge_universe(current("stocks", stocks.limit(0)), stocks))
        counts = upsert.universe_counts(stocks).first()
        done.stock_rows, done.stock_sectors = counts.rows_processed, counts.sectors_processed
    known = current("stocks")
    bars_path = str(PurePosixPath(root) / "bars")
    if "price_ingestion" in skip or landed_bars is None or known is None:
        done.skipped_steps.append("price_ingestion")
    else:
        held = current("pair_moments")
        if held is not None:
            reached, landed = held.agg(F.max("through")).first()[0], landed_bars.agg(F.min(F.col("date").cast("date"))).first()[0]
            if reached is not None and landed is not None and landed <= reached:
                # bars of days that are summed up already: those sums are void before the bars change
                store("pair_moments", held.limit(0))
        upsert.upsert_bar_table(spark, bars_path, landed_bars, known)
        done.price_rows = upsert.bar_counts(landed_bars, known).first().rows_processed
    bars = spark.read.parquet(bars_path).drop("year") if exists(spark, bars_path) else None
    if "correlations" in skip or bars is None:
        done.skipped_steps.append("correlations")
    else:
        observed = correlation.price_observations(bars, tickers)
        fresh = correlation.edges_of_moments(moments_of(observed), min_observations, min_abs_correlation)
        edges = correlation.replace_edges(current("edges", correlation.empty_edges(spark)), fresh, observed, stocks=known)
        done.correlation_rows = store("edges", edges).count()
    source = None
    if bars is not None and known is not None:
        source = correlation.graph_feature_source(bars, known, current("edges", correlation.empty_edges(spark)), tickers)
    if "feature_dataset" in skip or source is None:
        done.skipped_steps.append("feature_dataset")
    else:
        features = store("training_features", training.training_features(source))
        write_csv(features, f"{root}/training_export", "feature rows")
        done.feature_rows = features.count()
    model_dir = f"{root}/direction_model"
    if train and current("training_features") is not None:
        train_direction(current("training_features"), model_dir, **size)
        done.trained_model = True
    else:
        done.skipped_steps.append("model_training")
    if "prediction" in skip or source is None:
        done.skipped_steps.append("prediction")
    elif not exists(spark, f"{model_dir}/model"):
        done.skipped_steps.append("prediction_missing_model")
    else:
        artifact = spark.read.json(f"{model_dir}/artifact").first()
        model = PipelineModel.load(f"{model_dir}/model")
        latest = training.latest_inference_features(source)
        guesses = models.predict_directions(model, latest, artifact.features, artifact.model_type)
        write_csv(guesses, f"{root}/predictions", "predictions")
        done.prediction_rows = guesses.count()
    return done
