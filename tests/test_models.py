import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import calendar as CAL, labels as L
from barline.operators import backtest as B, models as M, valuation as V
from barline.plans import training_jobs as J
from barline.session import spread

DAY0 = dt.date(2026, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def frame(rows, days, names=("AAA", "BBB")):
    data = []
    for i in range(days):
        for k, t in enumerate(names):
            offset = 0.01 if k == 0 else -0.01
            target = offset + i * 0.001
            data.append((day(i), t, "S", 100.0 + i, offset, target, (100.0 + i) * (1 + target), int(target > 0)))
    return rows(data, "date date, ticker string, sector string, close double, return_1d double, target_return double, next_day_price double, direction int")


def test_feature_lists(rows):
    f = frame(rows, 3).withColumns({"sentiment_mean": F.lit(0.0), "embedding_dim_0": F.lit(0.0)})
    assert B.feature_columns(f) == ["close", "return_1d", "sentiment_mean", "embedding_dim_0"]
    assert B.feature_columns(f, include_news=False) == ["close", "return_1d"]
    with pytest.raises(ValueError):
        B.feature_columns(f.select("date", "ticker"))


def test_date_split(rows):
    f = rows([(f"2026-01-0{i}", i) for i in range(1, 5)], "date string, value int")
    train, test = B.train_test(f, 0.25)
    assert (train.count(), test.count()) == (3, 1)
    with pytest.raises(ValueError):
        B.train_test(f, 1.0)
    with pytest.raises(ValueError):
        B.train_test(f.where("value < 3"), 0.25)


@pytest.mark.parametrize("days,splits,gap,folds", [(8, 2, 1, 2), (11, 2, 2, 2), (6, 5, 1, 4)])
def test_purged_folds(rows, days, splits, gap, folds):
    out = B.fold_dates(frame(rows, days), splits, gap).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("trained"),
        F.min(F.when(F.col("role") == "test", F.col("date"))).alias("first"), F.max("date").alias("last"),
    ).orderBy("fold").collect()
    assert len(out) == folds
    for r in out:
        assert (r["first"] - r.trained).days == gap + 1
    assert out[-1]["last"] == day(days - 1)
    with pytest.raises(ValueError):
        B.fold_dates(frame(rows, 4), 2, -1)


def test_auc_by_ranks(spark):
    rng = np.random.default_rng(4)
    data = [(1, int(rng.random() < 0.4), float(rng.integers(0, 40)) / 40) for _ in range(600)] + [(2, 1, 0.5), (2, 1, 0.7)]
    f = spark.createDataFrame(data, "fold int, direction int, probability_up double")
    pos = [p for g, d, p in data if g == 1 and d]
    neg = [p for g, d, p in data if g == 1 and not d]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    for slices in (2, 64):
        got = {r.fold: r.roc_auc for r in B.exact_auc(f, slices=slices).collect()}
        assert got[1] == pytest.approx(want) and got[2] is None


def test_selection_metrics_by_hand(rows):
    f = frame(rows, 3).withColumns({"fold": F.lit(1), "predicted_return": F.when(F.col("ticker") == "AAA", 0.5).otherwise(-0.5)})
    r = B.selection_metrics(f, 1).first()
    assert r.rank_ic == pytest.approx(1.0) and r.selection_dates == 3
    assert r.long_short_return == pytest.approx(0.02) and r.top_n_excess_return == pytest.approx(0.01)
    flat = B.selection_metrics(f.withColumn("predicted_return", F.lit(0.1)), 1).first()
    assert flat.rank_ic == 0.0


def test_cross_validation_and_latest(rows):
    f = frame(rows, 11)
    metrics = M.cross_validate_returns(f, ["close", "return_1d"], 2, 1, 1, kind="forest", numTrees=3, maxDepth=2).first()
    assert metrics.folds == 2 and metrics.selection_dates > 0 and metrics.gap_dates == 1
    model = M.fit_return_model(f, ["close", "return_1d"], kind="boosted", maxIter=2, maxDepth=2)
    classes = M.fit_direction_classifier(f, ["close", "return_1d"], kind="forest", numTrees=3, maxDepth=2)
    plain = M.predict_latest(model, f, ["close", "return_1d"]).collect()
    assert [r.date for r in plain] == ["2026-01-11"] * 2 and plain[0].predicted_return >= plain[1].predicted_return
    both = M.predict_latest(model, f.drop("return_1d"), ["close", "return_1d"], classes).collect()
    assert all(0 <= r.confidence <= 1 and 0 <= r.probability_up <= 1 for r in both)
    top = M.feature_importance(model, ["close", "return_1d"]).collect()
    assert len(top) == 2 and top[0].importance >= top[1].importance


def test_global_job_stores_artifacts(rows, spark, tmp_path):
    metrics = J.train_global(frame(rows, 11), str(tmp_path), n_splits=2, top_n=1, kind="forest", numTrees=3, maxDepth=2).first()
    assert metrics.train_rows == 22 and metrics.feature_count == 2
    assert spark.read.parquet(f"{tmp_path}/predictions").count() == 2
    assert (tmp_path / "model").exists() and (tmp_path / "direction_model").exists()


def test_comparison_report(rows):
    base = rows([(0.02, 0.5, 0.1, 0.01)], "mape double, directional_accuracy double, rank_ic double, top_n_excess_return double")
    better = rows([(0.01, 0.6, 0.2, 0.02)], "mape double, directional_accuracy double, rank_ic double, top_n_excess_return double")
    row = B.compare_models(base, better)
    r = row.first()
    assert r.mape_improvement_pct == 50.0 and r.nlp_helped and r.direction_classifier_accuracy_delta is None
    assert "Did NLP improve MAPE: Yes" in J.comparison_report(row)
    assert "## Notes" in J.comparison_report(B.compare_models(better, base))


def test_daily_update_and_direction_model(rows, spark, tmp_path):
    rng = np.random.default_rng(9)
    data = []
    for t in ("AAA", "BBB"):
        walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
        data += [(t, f"{t}.JK", day(i), float(c), float(c), float(c), float(c), float(c), 10 + i, "yfinance", "1d") for i, c in enumerate(walk)]
    from barline.schema import PRICE_BAR

    bars = rows(data, PRICE_BAR)
    stocks = rows([("AAA", "AAA.JK", "A", "X", 1, None), ("BBB", "BBB.JK", "B", "X", 2, None)], "ticker string, yfinance_symbol string, name string, sector string, market_cap_rank int, beta double")
    first = J.daily_update(spark, str(tmp_path), stocks, bars, min_abs_correlation=0.0)
    assert (first.stock_rows, first.stock_sectors, first.price_rows) == (2, 1, 120)
    assert first.skipped_steps == ["model_training", "prediction_missing_model"] and first.feature_rows == 2 * 39
    second = J.daily_update(spark, str(tmp_path), skip=("correlations",), train=True, kind="forest", numTrees=3, maxDepth=2)
    assert second.trained_model and second.prediction_rows == 2
    assert second.skipped_steps == ["stock_ingestion", "price_ingestion", "correlations"]
    nothing = J.daily_update(spark, str(tmp_path), skip=("correlations", "feature_dataset", "prediction"))
    assert "prediction" in nothing.skipped_steps and nothing.feature_rows == 0


def test_daily_edges_are_those_of_a_whole_recomputation(rows, spark, tmp_path):
    from barline.operators import correlation as C
    from barline.schema import PRICE_BAR

    rng = np.random.default_rng(4)
    data = []
    for t in ("AAA", "BBB", "CCC"):
        walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
        data += [(t, f"{t}.JK", day(i), float(c), float(c), float(c), float(c), float(c), 10 + i, "yfinance", "1d") for i, c in enumerate(walk)]
    stocks = rows([(t, f"{t}.JK", t, "X", 1, None) for t in ("AAA", "BBB", "CCC")], "ticker string, yfinance_symbol string, name string, sector string, market_cap_rank int, beta double")
    rest = ("feature_dataset", "prediction")
    late = [(*r[:7], r[7] * 1.5, *r[8:]) for r in data if r[0] == "AAA" and r[2] == day(20)]
    for part in ([r for r in data if r[2] < day(40)], [r for r in data if r[2] >= day(40)], late, None):
        landed = None if part is None else rows(part, PRICE_BAR)
        J.daily_update(spark, str(tmp_path), stocks, landed, skip=rest, min_observations=10, min_abs_correlation=0.0)
        newest = max(int(p.name.split("=")[1]) for p in (tmp_path / "edges").iterdir() if p.name.startswith("version="))
        got = spark.read.parquet(f"{tmp_path}/edges/version={newest}").orderBy("source_ticker", "target_ticker").collect()
        bars = spark.read.parquet(f"{tmp_path}/bars")
        want = C.return_correlations(C.price_observations(bars), 10, 0.0).orderBy("source_ticker", "target_ticker").collect()
        assert [(r.source_ticker, r.observations, r.last_date) for r in got] == [(r.source_ticker, r.observations, r.last_date) for r in want] and len(got) == 3
        assert [r.coefficient for r in got] == pytest.approx([r.coefficient for r in want], abs=2e-6)


def test_missing_feature_is_an_error(rows):
    with pytest.raises(ValueError, match="Missing model feature column: x"):
        M.predict_directions(None, frame(rows, 1), ["x"])


# --- positions ---------------------------------------------------------------------------------

POSITION = "position_id bigint, ticker string, amount double, entry_date date, exit_date date, probability_up double"


def closes(rows, values, start=DAY0):
    return rows([("BBCA", start + dt.timedelta(days=i), float(c)) for i, c in enumerate(values)], "ticker string, date date, close double")


def test_historical_position(rows):
    held = rows([(1, "bbca.jk", 1_000_000.0, day(-3), day(2), None)], POSITION)
    values = V.position_values(held, closes(rows, [100, 110, 121]))
    s = V.position_summary(values).first()
    assert s.mode == "historical" and s.exit_value == pytest.approx(1_210_000) and s.rows == 3
    assert s.profit_loss_pct == pytest.approx(0.21) and s.entry_date == DAY0


def test_projected_position(rows):
    bars = closes(rows, [100, 101, 102, 103], dt.date(2026, 1, 5))  # Monday to Thursday
    held = rows([(1, "BBCA", 1000.0, dt.date(2026, 1, 5), dt.date(2026, 1, 12), 0.6)], POSITION)
    out = V.position_values(held, bars).where("kind = 'projected'").orderBy("date").collect()
    assert [r.date for r in out] == [dt.date(2026, 1, 9), dt.date(2026, 1, 12)]
    r = np.diff([100, 101, 102, 103]) / np.array([100, 101, 102])
    daily = r.mean() + 0.1 * r.std(ddof=1)
    assert out[1].close == pytest.approx(103 * (1 + daily) ** 2)
    assert out[1].upper_value == pytest.approx(out[1].value * (1 + r.std(ddof=1) * 2**0.5))


def test_exit_on_a_weekday_without_a_bar_projects_from_the_latest_close(rows):
    monday = dt.date(2026, 1, 5)
    bars = closes(rows, [100, 110], monday).unionByName(closes(rows, [200], dt.date(2026, 1, 9)))
    held = rows([(1, "BBCA", 100.0, monday, dt.date(2026, 1, 7), 0.5)], POSITION)
    out = V.position_values(held, bars).orderBy("date").collect()
    assert [(r.date.day, r.kind) for r in out] == [(5, "historical"), (6, "historical"), (7, "projected")]
    # the mean return is beyond the allowed daily move
    assert out[2].close == pytest.approx(200 * 1.1)


@pytest.mark.parametrize("ticker,amount,entry,exit_,reason", [
    ("BBCA", 0.0, 0, 1, "amount"), ("BBCA", 1.0, 1, 0, "exit_date"), ("BBCA", 1.0, 9, 9, "after the latest"),
    ("NONE", 1.0, 0, 1, "at least one close"), ("^JKSE", 1.0, 0, 1, "stock ticker"), ("BBCA", 1.0, -5, -4, "no price rows"),
])
def test_position_errors(rows, ticker, amount, entry, exit_, reason):
    held = rows([(1, ticker, amount, day(entry), day(exit_), None)], POSITION)
    assert reason in V.check_positions(held, closes(rows, [1, 2, 3])).first().reason


# --- labels ------------------------------------------------------------------------------------

def test_threshold_labels(spark):
    def x(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert x(L.sentiment_label(F.lit(None).cast("double"))) == "Unknown" and x(L.sentiment_label(F.lit(0.05))) == "Neutral"
    assert x(L.classifier_score(F.lit("LABEL_0"), F.lit(0.7))) == -0.7 and x(L.classifier_score(F.lit("positive"), F.lit(0.7))) == 0.7
    assert x(L.watchlist_direction(F.lit(None).cast("int"), F.lit(0.002))) == "UP"
    assert x(L.ranking_direction(F.lit(1), F.lit(-0.002))) == "DOWN"
    assert x(L.confidence_from_return(F.lit(0.01), F.lit(0.0))) == 0.5
    assert x(L.market_bias(F.lit(58), F.lit(100))) == "bullish" and x(L.market_bias(F.lit(0), F.lit(0))) == "neutral"
    assert x(L.trend_label(F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double"))) == "Mixed trend"
    assert x(L.volume_label(F.lit(0.65))) == "Quiet trading" and x(L.momentum_label(F.lit(-0.04))) == "Strong bearish"
    assert x(CAL.session_open(F.lit("2026-01-05 02:00:00").cast("timestamp"))) is True
    assert x(CAL.session_open(F.lit("2026-01-05 09:01:00").cast("timestamp"))) is False


def test_argument_helpers():
    assert CAL.range_to_period("1M") == "1mo" and CAL.range_to_period("ALL") == "max" and CAL.range_to_period("?") == "1y"
    assert (CAL.clamp_limit("500", 10), CAL.clamp_limit("x", 10), CAL.clamp_limit(0, 10)) == (100, 10, 1)


def test_training_rows_use_all_cores(rows, spark):
    few = frame(rows, 40).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    out = spread(few)
    sizes = [len(part) for part in out.rdd.glom().collect()]
    assert len(sizes) == cores and min(sizes) >= 80 // cores - 2 and sorted(out.collect()) == sorted(few.collect())
    table = M.training_table(out, ["close", "return_1d"], 2, 1).where("fold = 0 AND role = 'train'")
    assert table.select(F.input_file_name()).distinct().count() == cores and table.count() == 80
