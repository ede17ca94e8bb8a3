"""Return and direction models on pyspark.ml, and their latest predictions."""

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.labels import confidence_from_probability, confidence_from_return
from .backtest import (
    classifier_fold_mean, classifier_metrics, confusion_metrics, exact_auc, fold_dates, fold_mean, fold_metrics,
)
from ..session import even_partitions, run_folder, written
from .serving import latest_rows

#: How deep a forest's trees may grow, and the memory of a pass over nodes and their statistics.
GROWTH = {"maxDepth": 6, "maxMemoryInMB": 1024}
#: Fits that run at the same time.
FITS_AT_ONCE = 4
# fixed values: model sizes (rounds, leaves as depth, rate; trees, leaf size)
RETURN_BOOST = {"maxIter": 400, "maxDepth": 5, "stepSize": 0.03}
RETURN_FOREST = {"numTrees": 250, "minInstancesPerNode": 5, **GROWTH}
DIRECTION_BOOST = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.03}
DIRECTION_FOREST = {"numTrees": 250, "minInstancesPerNode": 5, **GROWTH}
BASELINE_FOREST = {"numTrees": 200, "minInstancesPerNode": 5, **GROWTH}


def usable_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features with at least one value; a mean cannot be imputed for the others."""
    counts = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if counts[c] > 0]


def _inputs(features: list[str], strategy: str = "mean") -> list:
    filled = [f"_f_{c}" for c in features]
    return [
        Imputer(inputCols=features, outputCols=filled, strategy=strategy),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
    ]


def _as_double(df: DataFrame, features: list[str]) -> DataFrame:
    # single precision first, as the feature matrix is defined; the library wants doubles
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in features})


def regression_pipeline(features: list[str], target: str = "target_return", kind: str = "boosted", seed: int = 42, **size) -> Pipeline:
    if kind == "boosted":
        model = GBTRegressor(labelCol=target, featuresCol="features", predictionCol="predicted_return", seed=seed,
                             **{**RETURN_BOOST, **size})
    else:
        model = RandomForestRegressor(labelCol=target, featuresCol="features", predictionCol="predicted_return", seed=seed,
                                      **{**RETURN_FOREST, **size})
    return Pipeline(stages=[*_inputs(features), model])


def with_class_weights(df: DataFrame, label: str = "direction") -> DataFrame:
    """Weight n / (2 * n of the class), so both classes count the same."""
    n = df.agg(F.count(label)).scalar()
    ones = df.agg(F.sum(F.col(label).cast("bigint"))).scalar()
    weight = F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    return df.withColumn("class_weight", weight.cast("double"))


def classification_pipeline(features: list[str], label: str = "direction", kind: str = "boosted", seed: int = 42, **size) -> Pipeline:
    common = dict(labelCol=label, featuresCol="features", weightCol="class_weight", seed=seed,
                  predictionCol="predicted_direction", probabilityCol="_p", rawPredictionCol="_raw")
    if kind == "boosted":
        model = GBTClassifier(**common, **{**DIRECTION_BOOST, **size})
    else:
        model = RandomForestClassifier(**common, **{**DIRECTION_FOREST, **size})
    return Pipeline(stages=[*_inputs(features), model])


def fit_return_model(df: DataFrame, features: list[str], **kw) -> PipelineModel:
    return regression_pipeline(features, **kw).fit(_as_double(df, features))


def fit_direction_classifier(df: DataFrame, features: list[str], label: str = "direction", **kw) -> PipelineModel:
    rows = df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    return classification_pipeline(features, label, **kw).fit(with_class_weights(_as_double(rows, features), label))


def direction_baseline(categorical: list[str], numeric: list[str], label="target_next_direction", kind="boosted", seed=42, **size) -> Pipeline:
    """Median-imputed, scaled numbers and one-hot ticker and sector; unseen names score as none."""
    filled = [f"_f_{c}" for c in numeric]
    codes = [f"_i_{c}" for c in categorical]
    hot = [f"_h_{c}" for c in categorical]
    stages = [
        Imputer(inputCols=numeric, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_numbers", handleInvalid="keep"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
    ]
    parts = ["_scaled"]
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True, handleInvalid="keep"),
        ]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    common = dict(labelCol=label, featuresCol="features", seed=seed, predictionCol="predicted_direction",
                  probabilityCol="_p", rawPredictionCol="_raw")
    sizes = {"boosted": {"maxIter": 250, "maxDepth": 4, "stepSize": 0.03, "subsamplingRate": 0.9}}.get(kind, BASELINE_FOREST)
    learner = GBTClassifier if kind == "boosted" else RandomForestClassifier
    return Pipeline(stages=[*stages, learner(**common, **{**sizes, **size})])


def score_direction(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Class and probability of the up class, as plain columns."""
    out = model.transform(df)
    extra = [c for c in out.columns if c.startswith("_") or c in ("features", "class_weight")]
    return out.withColumn("probability_up", vector_to_array("_p")[1]).withColumn(
        "predicted_direction", F.col("predicted_direction").cast("bigint")
    ).drop(*extra)


def feature_importance(model: PipelineModel, features: list[str], top: int = 20) -> DataFrame:
    """Importance per input feature, highest first; one row per feature, so it fits the driver."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def predict_latest(
    model: PipelineModel, dataset: DataFrame, features: list[str], direction_model: PipelineModel | None = None,
    model_name: str = "global_model", model_type: str = "boosted",
) -> DataFrame:
    """Next-day return of the latest row of every ticker; missing features count as NULL."""
    rows = latest_rows(dataset.na.drop(subset=["ticker", "date", "close"]), 1)
    absent = [c for c in features if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else rows
    sector = F.col("sector") if "sector" in rows.columns else F.lit("UNKNOWN")
    volatility = F.col("volatility_20d") if "volatility_20d" in dataset.columns else F.lit(0.02)
    base = _as_double(rows.withColumns({"_sector": sector, "_vol": volatility}), features)
    keep = ["ticker", "date", "_sector", "close", "_vol", "predicted_return"]
    if direction_model is None:
        scored = model.transform(base).select(*keep).withColumns({
            "predicted_direction": (F.col("predicted_return") > 0).cast("bigint"),
            "probability_up": F.lit(None).cast("double"),
            "confidence": confidence_from_return(F.col("predicted_return"), F.col("_vol")),
        })
    else:
        # both pipelines use the same working columns, so the second starts from clean rows
        first = model.transform(base).select(*base.columns, "predicted_return")
        scored = direction_model.transform(first).select(
            *keep, F.col("predicted_direction").cast("bigint").alias("predicted_direction"),
            vector_to_array("_p")[1].alias("probability_up"),
        ).withColumn("confidence", confidence_from_probability(F.col("probability_up")))
    return scored.select(
        "ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("_sector").alias("sector"), "close",
        "predicted_return", "predicted_direction", "probability_up", "confidence",
        F.lit(model_name).alias("model_name"), F.lit(model_type).alias("model_type"),
    ).orderBy(F.desc("predicted_return"), "ticker")


def predict_directions(model: PipelineModel, rows: DataFrame, features: list[str], model_type: str = "boosted") -> DataFrame:
    """Direction and probability for latest inference rows; an absent feature is an error."""
    absent = [c for c in features if c not in rows.columns]
    if absent:
        raise ValueError(f"Missing model feature column: {absent[0]}")
    return score_direction(model, rows).select(
        "ticker", "date", "sector", "close", F.round("probability_up", 6).alias("probability_up"),
        "predicted_direction", F.lit(model_type).alias("model_type"),
    )


def training_table(
    df: DataFrame, features: list[str], n_splits: int = 5, gap_dates: int = 1, label: str = "direction", target: str = "target_return"
) -> DataFrame:
    """Rows of every fold and role with their imputed feature vector, written once for all fits.

    Fold 0 has all rows as training rows. Values are imputed with the means of the fold's own
    training rows (0 where there are none), and `class_weight` balances the label's classes there;
    both come from one aggregate over the folds. Written by fold and role, so a fit reads its own rows.
    """
    everything = df.select("date").distinct().select(F.lit(0).alias("fold"), F.lit("train").alias("role"), "date")
    placed = df.join(fold_dates(df, n_splits, gap_dates).unionByName(everything), "date")
    single = [F.col(c).cast("float").cast("double") for c in features]
    ones, known = F.sum(F.col(label).cast("bigint")), F.count(label)
    stats = placed.where("role = 'train'").groupBy("fold").agg(
        F.array(*[F.coalesce(F.avg(v), F.lit(0.0)) for v in single]).alias("means"), known.alias("known"), ones.alias("ones"),
    )
    filled = F.array(*[F.coalesce(v, F.col("means")[k]) for k, v in enumerate(single)])
    of_class = F.when(F.col(label).cast("bigint") == 1, F.col("ones")).otherwise(F.col("known") - F.col("ones"))
    kept = dict.fromkeys(["ticker", "date", "close", "next_day_price", "target_return", target])
    table = placed.join(stats, "fold").select(
        "fold", "role", *kept, F.col(label).cast("double").alias(label), array_to_vector(filled).alias("features"),
        F.when(F.col(label).isNotNull(), F.col("known") / (2.0 * of_class)).alias("class_weight"),
        (F.least("ones", F.col("known") - F.col("ones")) > 0).alias("two_classes"),
    )
    folder = run_folder(df.sparkSession)
    # every task holds a share of every fold, so a fit reads its rows on all cores
    table.repartition(even_partitions(df), "fold", "role", "ticker", "date").write.partitionBy("fold", "role").parquet(folder)
    return df.sparkSession.read.schema(table.schema).parquet(folder)


def fit_at_once(spark, fits: dict, threads: int = FITS_AT_ONCE) -> dict:
    """Results of named fits (functions without arguments) from a bounded pool of driver threads.

    Each fit is a job group of its own and asks for a scheduler pool of its own, so that with fair
    scheduling none waits for another's whole job; the rows stay on the executors.
    """
    context = spark.sparkContext

    def run(name):
        context.setJobGroup(f"fit {name}", f"model fit {name}")
        context.setLocalProperty("spark.scheduler.pool", f"fit {name}")
        return fits[name]()

    with ThreadPool(max(1, min(threads, len(fits)))) as pool:
        return dict(zip(fits, pool.map(inheritable_thread_target(spark)(run), list(fits), chunksize=1)))


def _learner(fold_rows: DataFrame, kind: str, boosted, forest, sizes: tuple[dict, dict], size: dict, **common):
    learner, chosen = (boosted, sizes[0]) if kind == "boosted" else (forest, sizes[1])
    return learner(featuresCol="features", seed=42, **common, **{**chosen, **size}).fit(fold_rows)


def return_fits(table: DataFrame, folds: list[int], kind: str = "boosted", target: str = "target_return", **size) -> dict:
    """A return model to fit per fold, by ("return", fold)."""

    def fit(fold):
        rows = table.where((F.col("fold") == fold) & (F.col("role") == "train")).select(target, "features")
        return _learner(rows, kind, GBTRegressor, RandomForestRegressor, (RETURN_BOOST, RETURN_FOREST), size,
                        labelCol=target, predictionCol="predicted_return")

    return {("return", fold): (lambda fold=fold: fit(fold)) for fold in folds}


def direction_fits(table: DataFrame, folds: list[int], kind: str = "boosted", label: str = "direction", **size) -> dict:
    """A class-weighted direction model to fit per fold, by ("direction", fold)."""

    def fit(fold):
        rows = table.where((F.col("fold") == fold) & (F.col("role") == "train")).where(F.col(label).isNotNull())
        return _learner(rows.select(label, "class_weight", "features"), kind, GBTClassifier, RandomForestClassifier,
                        (DIRECTION_BOOST, DIRECTION_FOREST), size, labelCol=label, weightCol="class_weight",
                        predictionCol="predicted_direction", probabilityCol="_p", rawPredictionCol="_raw")

    return {("direction", fold): (lambda fold=fold: fit(fold)) for fold in folds}


def fold_numbers(table: DataFrame, two_classes: bool = False) -> list[int]:
    """Folds to evaluate; with `two_classes` those whose training rows have both."""
    rows = table.where("fold > 0 AND role = 'train'" + (" AND two_classes" if two_classes else ""))
    return sorted(r.fold for r in rows.select("fold").distinct().collect())


def score_folds(table: DataFrame, models: dict, kind: str) -> DataFrame:
    """The test rows of all folds, each scored by its fold's model of `kind`, in one pass."""
    scored = None
    for (of, fold), model in sorted(models.items()):
        if of == kind and fold > 0:
            out = model.transform(table.where((F.col("fold") == fold) & (F.col("role") == "test")))
            if kind == "direction":
                out = out.withColumn("probability_up", vector_to_array("_p")[1]).withColumn(
                    "predicted_direction", F.col("predicted_direction").cast("bigint"))
            out = out.drop("features", "_p", "_raw", "class_weight", "two_classes")
            scored = out if scored is None else scored.unionByName(out)
    if scored is None:
        raise ValueError("time-series evaluation produced no valid folds")
    return scored


def return_quality(scored: DataFrame, gap_dates: int = 1, top_n: int = 10, target: str = "target_return") -> DataFrame:
    """One row of mean metrics over the folds of scored test rows."""
    return fold_mean(fold_metrics(scored, top_n, target=target)).withColumns(
        {"gap_dates": F.lit(gap_dates), "selection_top_n": F.lit(top_n)}
    )


def direction_quality(scored: DataFrame, label: str = "direction") -> DataFrame:
    return classifier_fold_mean(classifier_metrics(scored.where(F.col(label).isNotNull()), ("fold",), label))


def cross_validated_returns(df: DataFrame, features: list[str], n_splits=5, gap_dates=1, kind="boosted", target="target_return", **size) -> DataFrame:
    """Test rows of purged folds, scored by models fitted at once."""
    table = training_table(df, features, n_splits, gap_dates, target=target)
    models = fit_at_once(df.sparkSession, return_fits(table, fold_numbers(table), kind, target, **size))
    return score_folds(table, models, "return")


def cross_validated_direction(df: DataFrame, features: list[str], n_splits=5, gap_dates=1, kind="boosted", label="direction", **size) -> DataFrame:
    """Labelled test rows of purged folds, scored; a fold with one training class is skipped."""
    table = training_table(df.where(F.col(label).isNotNull()), features, n_splits, gap_dates, label)
    models = fit_at_once(df.sparkSession, direction_fits(table, fold_numbers(table, True), kind, label, **size))
    return score_folds(table, models, "direction")


def cross_validate_returns(df: DataFrame, features: list[str], n_splits=5, gap_dates=1, top_n=10, kind="boosted", target="target_return", **size) -> DataFrame:
    """One row of mean metrics over purged folds."""
    return return_quality(written(cross_validated_returns(df, features, n_splits, gap_dates, kind, target, **size)), gap_dates, top_n, target)


def cross_validate_direction(df: DataFrame, features: list[str], n_splits=5, gap_dates=1, kind="boosted", label="direction", **size) -> DataFrame:
    """Mean classifier metrics over purged folds."""
    return direction_quality(written(cross_validated_direction(df, features, n_splits, gap_dates, kind, label, **size)), label)


def with_inputs(df: DataFrame, features: list[str], model) -> PipelineModel:
    """A fitted model behind the mean imputation and assembly of `features`, fitted on `df`."""
    imputer, assembler = _inputs(features)
    return PipelineModel([imputer.fit(_as_double(df, features)), assembler, model])


def direction_metrics(scored: DataFrame, label="target_next_direction") -> DataFrame:
    """Rounded classifier metrics of one test set, one row."""
    one = scored.withColumn("_all", F.lit(1))
    both = confusion_metrics(one, ("_all",), label).join(exact_auc(one, ("_all",), label), "_all", "left")
    return both.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")], "rows")
