import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.constants import PRICE_FEATURES
from barline.operators import correlation as C, serving as S, technical as T, training as TR, upsert as U
from barline.schema import PRICE_BAR
from barline.sources import files, prices, universe as UL

D = dt.date


def day(n, start=D(2026, 1, 1)):
    return start + dt.timedelta(days=n)


def bars_of(rows, closes, ticker="AAA", start=D(2026, 1, 1)):
    data = [
        (ticker, f"{ticker}.JK", day(i, start), c, c + 1.0, c - 1.0, c, c, 1000 + i, "yfinance", "1d")
        for i, c in enumerate(map(float, closes))
    ]
    return rows(data, PRICE_BAR)


def test_all_features_of_rising_bars(rows):
    out = T.price_features(bars_of(rows, [100 + i for i in range(230)], start=D(2025, 1, 1)))
    last = out.orderBy(F.desc("date")).first()
    assert set(PRICE_FEATURES) <= set(out.columns) and len(PRICE_FEATURES) == 56
    assert "target_return" not in out.columns
    assert last.SMA_200 > 0 and last.return_5d == pytest.approx(329 / 324 - 1)
    assert last.RSI is None  # no loss was ever seen


def test_long_series_match_pandas(rows):
    rng = np.random.default_rng(3)
    closes = np.exp(np.cumsum(rng.normal(0, 0.02, 2600))) * 100
    got = T.price_features(bars_of(rows, closes, start=D(2001, 1, 1))).toPandas().sort_values("date").reset_index(drop=True)
    c = pd.Series(closes)
    ema = {n: c.ewm(span=n, adjust=False).mean() for n in (12, 26)}
    macd = ema[12] - ema[26]
    delta = c.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    want = {
        "EMA_12": ema[12], "EMA_26": ema[26], "MACD_signal": macd.ewm(span=9, adjust=False).mean(),
        "RSI": 100 - 100 / (1 + gain / loss.replace(0, np.nan)), "volatility_20d": c.pct_change().rolling(20).std(),
        "SMA_50": c.rolling(50).mean(),
    }
    for name, series in want.items():
        pd.testing.assert_series_equal(got[name], series, check_names=False, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("block", [256, 2048])
def test_carry_over_many_blocks_and_a_long_standstill(rows, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rng = np.random.default_rng(8)
    moves = rng.normal(0, 0.02, 5200)
    moves[900:4300] = 0  # both averages fade for 3400 rows; their ratio stays
    closes = np.round(np.exp(np.cumsum(moves)) * 100, 6)
    c = pd.Series(closes)
    delta = c.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    bars = bars_of(rows, closes, start=D(2001, 1, 1))
    got = T.rsi(bars).toPandas().sort_values("date").RSI.reset_index(drop=True)
    macd = T.ema_macd(bars).toPandas().sort_values("date").reset_index(drop=True)
    pd.testing.assert_series_equal(got[14:], (100 - 100 / (1 + gain / loss))[14:], check_names=False, rtol=1e-9)
    ema = {n: c.ewm(span=n, adjust=False).mean() for n in (12, 26)}
    pd.testing.assert_series_equal(macd.EMA_26, ema[26], check_names=False, rtol=1e-12)
    signal = (ema[12] - ema[26]).ewm(span=9, adjust=False).mean()
    pd.testing.assert_series_equal(macd.MACD_signal, signal, check_names=False, rtol=1e-9, atol=1e-12)


def test_an_average_too_quick_for_the_block_is_an_error():
    with pytest.raises(ValueError, match="shorter blocks"):
        T._look_backs(0.5)


def test_rsi_stays_at_hundred_long_after_the_last_loss(rows):
    closes = [100, 99] + [100 + i for i in range(2300)]
    last = T.rsi(bars_of(rows, closes, start=D(2001, 1, 1))).orderBy(F.desc("date")).first()
    assert last.RSI == pytest.approx(100.0)


def test_flat_range_and_zero_volume_give_null(rows):
    out = T.price_features(bars_of(rows, [50] * 70).withColumn("volume", F.lit(0).cast("bigint"))).orderBy(F.desc("date")).first()
    assert out.price_position_20d is None and out.volume_ratio_20 is None and out.obv_20d_change is None
    assert out.BB_percent_b is None and out.drawdown_60d == 0


def test_missing_price_column_fails_while_planning(rows):
    with pytest.raises(ValueError, match="volume"):
        T.price_features(rows([("A", D(2026, 1, 1), 1.0)], "ticker string, date date, close double"))


# --- correlation and training features ---------------------------------------------------------

def closes(rows, table):
    data = [(t, day(i), float(c)) for t, cs in table.items() for i, c in enumerate(cs)]
    return rows(data, "ticker string, date date, close double")


def test_correlation_of_three_series(rows):
    obs = closes(rows, {"AAA": [100, 110, 132], "BBB": [200, 220, 264], "CCC": [100, 100, 100]})
    edges = C.return_correlations(obs, min_observations=2).collect()
    assert [(e.source_ticker, e.target_ticker, e.coefficient, e.observations) for e in edges] == [("AAA", "BBB", 1.0, 2)]
    assert (edges[0].first_date, edges[0].last_date) == (day(1), day(2))


@pytest.mark.parametrize("kw", [{"min_observations": 1}, {"min_abs_correlation": 1.5}])
def test_correlation_arguments(rows, kw):
    with pytest.raises(ValueError):
        C.return_correlations(closes(rows, {"A": [1, 2]}), **kw)


@pytest.mark.parametrize("blocks", [1, 3])
def test_moments_of_spans_add_up_to_a_whole_recomputation(rows, blocks):
    rng = np.random.default_rng(6)
    data = []
    for k in range(8):
        keep = rng.random(90) < 0.6
        walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 90)))
        data += [(f"T{k}", day(i), float(walk[i])) for i in range(90) if keep[i] and not (k == 7 and i < 70)]
    data += [("FLAT", day(i), 5.0) for i in range(90)]
    schema = "ticker string, date date, close double"
    merged, after = None, None
    for end in (30, 31, 64, 90):  # what a run sees is all bars up to its day
        added = C.pair_moments(rows([d for d in data if d[1] < day(end)], schema), after, blocks)
        merged, after = (added if merged is None else C.merge_moments(merged, added)), day(end - 1)
    whole = C.return_correlations(rows(data, schema), 10, 0.0, ticker_blocks=blocks)
    order = ["source_ticker", "target_ticker"]
    got = C.edges_of_moments(merged, 10, 0.0).orderBy(*order).collect()
    want = whole.orderBy(*order).collect()
    assert [(r.source_ticker, r.target_ticker, r.observations, r.first_date, r.last_date) for r in got] == [
        (r.source_ticker, r.target_ticker, r.observations, r.first_date, r.last_date) for r in want]
    assert [r.coefficient for r in got] == pytest.approx([r.coefficient for r in want], abs=2e-6) and len(got) > 20


@pytest.mark.parametrize("blocks", [1, 3])
def test_correlation_matches_pandas_on_ragged_dates(rows, blocks):
    rng = np.random.default_rng(5)
    data = []
    for k in range(9):
        keep = rng.random(120) < 0.7
        walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 120)))
        data += [(f"T{k}", day(i), float(walk[i])) for i in range(120) if keep[i]]
    obs = rows(data, "ticker string, date date, close double")
    got = {(e.source_ticker, e.target_ticker): (e.coefficient, e.observations)
           for e in C.return_correlations(obs, 20, 0.0, ticker_blocks=blocks).collect()}
    wide = pd.DataFrame(data, columns=["t", "d", "c"]).pivot(index="d", columns="t", values="c").sort_index()
    r = {t: wide[t].dropna().pct_change().dropna() for t in wide}
    for a in wide:
        for b in wide:
            if a < b:
                both = pd.concat([r[a], r[b]], axis=1, join="inner")
                assert got[(a, b)] == (pytest.approx(both.iloc[:, 0].corr(both.iloc[:, 1]), abs=1e-6), len(both))


@pytest.mark.parametrize("blocks", [1, 12])
def test_no_series_is_shuffled_to_its_pairs(rows, blocks):
    rng = np.random.default_rng(8)
    held = {f"T{k:02}": sorted(rng.choice(70, 40, replace=False).tolist()) for k in range(14)}
    obs = rows([(t, day(i), float(rng.uniform(90, 110))) for t, at in held.items() for i in at], "ticker string, date date, close double")
    edges = C.return_correlations(obs, 2, 0.0, ticker_blocks=blocks)
    assert "hashpartitioning" not in edges._jdf.queryExecution().executedPlan().toString()
    got = {(e.source_ticker, e.target_ticker): (e.observations, e.first_date, e.last_date) for e in edges.collect()}
    common = {(a, b): sorted(set(held[a][1:]) & set(held[b][1:])) for a in held for b in held if a < b}
    assert got == {pair: (len(at), day(at[0]), day(at[-1])) for pair, at in common.items()}


@pytest.mark.parametrize("strip,cells,look", [(1152, 4_000_000, 65_536), (5, 4_000_000, 3), (1152, 200, 7)])
def test_strips_of_blocks_give_every_pair_once(monkeypatch, strip, cells, look):
    for name, value in (("STRIP", strip), ("STRIP_CELLS", cells), ("CELLS", look)):
        monkeypatch.setattr(C, name, value)
    rng = np.random.default_rng(9)
    held = {f"T{k:02}": {int(d): float(rng.normal()) for d in np.sort(rng.choice(75, 50, replace=False)) + 9000} for k in range(23)}
    # a block of every second series, and of the rest
    sides = [sorted(held)[k::2] for k in (0, 1)]
    series = pa.array([[{"ticker": t, "days": list(held[t]), "rs": list(held[t].values())} for t in side] for side in sides],
                      pa.list_(pa.struct([("ticker", pa.string()), ("days", pa.list_(pa.int32())), ("rs", pa.list_(pa.float64()))])))
    flat = list(C._flat([pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), series], names=["block", "held"])]))
    one, other = (C._Block(b.column(1)[0], True) for b in flat)
    run = C._correlated(20, 0.05)
    found = [r for pair in ((one, one), (one, other), (other, one), (other, other)) for batch in C._block_rows(*pair, run) for r in batch.to_pylist()]
    got = {(r["source_ticker"], r["target_ticker"]): r for r in found}
    across = [(r["source_ticker"] in sides[0]) != (r["target_ticker"] in sides[0]) for r in found]
    assert len(found) == len(got) + sum(across) / 2  # read from both ends, pairs across come twice
    frame = pd.DataFrame({t: pd.Series(v) for t, v in held.items()})
    want = {(a, b): frame[[a, b]].dropna() for a in frame for b in frame if a < b}
    want = {pair: both for pair, both in want.items() if len(both) >= 20 and abs(both.iloc[:, 0].corr(both.iloc[:, 1])) >= 0.05}
    assert set(got) == set(want) and len(want) > 100
    for pair, both in want.items():
        r = got[pair]
        assert r["r"] == pytest.approx(both.iloc[:, 0].corr(both.iloc[:, 1]), abs=1e-12) and r["observations"] == len(both)
        assert [r["first_date"], r["last_date"]] == [D(1970, 1, 1) + dt.timedelta(days=int(d)) for d in (both.index.min(), both.index.max())]


def test_blocks_grow_with_the_series_up_to_a_bound_of_returns():
    assert C._dealt(0, 0)[0] == C._dealt(100, 60_000)[0] == C.MIN_BLOCKS
    blocks, files = C._dealt(360_000, 190_000_000)
    # every pair of blocks reads two of them, so the reading falls with their number
    assert blocks <= 180 and files == C.MOST_FILES
    assert C._dealt(20_000, 20_000 * 9_000)[0] >= 20_000 * 9_000 / C.BLOCK_RETURNS
    assert C._dealt(500_000, 4_500_000_000)[1] >= 450


def test_bars_without_a_ticker_have_no_edges(rows):
    data = [(t, day(i), float(c)) for t in ("AAA", None, "BBB") for i, c in enumerate([100, 110, 132, 120])]
    edges = C.return_correlations(rows(data, "ticker string, date date, close double"), 2, 0.0, ticker_blocks=1)
    assert [(e.source_ticker, e.target_ticker) for e in edges.collect()] == [("AAA", "BBB")]


def test_edges_outside_the_scope_stay(rows, spark):
    fresh = C.return_correlations(closes(rows, {"AAA": [100, 110, 132], "BBB": [200, 220, 264]}), 2)
    old = fresh.select(*[F.lit("OLD").alias(c) if c == "source_ticker" else F.col(c) for c in fresh.columns]).unionByName(
        fresh.withColumn("coefficient", F.lit(-1.0)))
    scope = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")
    out = C.replace_edges(old, fresh, scope).collect()
    assert sorted((e.source_ticker, e.coefficient) for e in out) == [("AAA", 1.0), ("OLD", 1.0)]
    assert C.replace_edges(old, fresh.limit(0)).count() == 0


def graph_rows(rows, table, sector=lambda t: "S"):
    data = [(t, day(i), sector(t), float(c), 100 + i, 1, 0.5) for t, cs in table.items() for i, c in enumerate(cs)]
    return rows(data, "ticker string, date date, sector string, close double, volume bigint, correlated_peer_count int, correlation_avg_abs double")


AAA = [100, 101, 103, 102, 104]


def test_training_features_small_windows(rows):
    src = graph_rows(rows, {"AAA": AAA, "BBB": [2 * c for c in AAA]})
    out = TR.training_features(src, 2, 2, (2,)).orderBy("ticker", "date").collect()
    assert (out[0].ticker, out[0].date, out[0].target_next_direction) == ("AAA", D(2026, 1, 3), 0)
    assert out[0].sector_return_1d == out[0].return_1d == round(103 / 101 - 1, 8)
    assert len(out) == 4 and out[0].return_5d == round(103 / 100 - 1, 8)


def test_latest_inference_features(rows):
    src = graph_rows(rows, {"AAA": AAA[:4], "BBB": [2 * c for c in AAA[:4]]}, sector=lambda t: t)
    out = TR.latest_inference_features(src, 2, 2, (2,)).orderBy("ticker").collect()
    assert [(r.ticker, r.date) for r in out] == [("AAA", D(2026, 1, 4)), ("BBB", D(2026, 1, 4))]


def test_flat_window_position_is_half(rows):
    out = TR.training_features(graph_rows(rows, {"A": [5] * 6}), 2, 2, (2,)).first()
    assert out.price_position_2d == 0.5 and out.drawdown_2d == 0.0


@pytest.mark.parametrize("args", [(1, 2, (2,)), (3, 2, (2,)), (2, 2, ()), (2, 2, (1,))])
def test_window_arguments(rows, args):
    with pytest.raises(ValueError):
        TR.training_features(graph_rows(rows, {"A": AAA}), *args)


def test_default_feature_columns():
    names = list(dict.fromkeys(TR.FIXED + TR.auto_columns() + ["target_next_return", "target_next_direction"]))
    assert len(names) == 44


# --- provider rows, universe, upserts ----------------------------------------------------------

def test_provider_rows(rows):
    raw = rows(
        [("BBCA", "2026-01-02 00:00:00+07:00", "100", "106", "99", "105", "104", None), ("BBCA", "2026-01-03", "1", "1", "1", None, "1", "9"),
         ("BBCA", "2026-01-04", "1", "inf", "1", "2", "1", "7.9")],
        "ticker string, date string, Open string, High string, Low string, Close string, `Adj Close` string, Volume string",
    )
    loose = {r.date: r for r in prices.normalize_bars(raw).collect()}
    strict = {r.date: r for r in prices.normalize_bars(raw, strict=True).collect()}
    assert set(loose) == {D(2026, 1, 2), D(2026, 1, 4)} and loose[D(2026, 1, 2)].close == 105.0
    assert loose[D(2026, 1, 2)].volume == 0 and strict[D(2026, 1, 2)].volume is None
    assert loose[D(2026, 1, 4)].high == float("inf") and strict[D(2026, 1, 4)].high is None
    assert strict[D(2026, 1, 4)].volume == 7


def test_universe_rules(rows):
    raw = rows(
        [(" bbca.jk", "", "", "", "2", ""), ("tlkm", "X.jk", "Telkom", "Infra", "0", "1.5"), ("asii", None, None, None, None, None)],
        "ticker string, yfinance_symbol string, name string, sector string, market_cap_rank string, beta string",
    ).withColumn("universe_rank", F.when(F.col("ticker") == "tlkm", "1"))
    out = UL.load_universe(raw).collect()
    assert [(r.ticker, r.yfinance_symbol, r.name, r.sector, r.market_cap_rank, r.beta) for r in out] == [
        ("TLKM", "X.JK", "Telkom", "Infra", 1, 1.5), ("BBCA", "BBCA.JK", "BBCA", "UNKNOWN", 2, None), ("ASII", "ASII.JK", "ASII", "UNKNOWN", None, None)]
    assert UL.load_universe(raw, tickers=["bbca.jk"]).count() == 1 and UL.load_universe(raw, limit=2).count() == 2
    with pytest.raises(ValueError):
        UL.require_universe(UL.load_universe(raw, tickers=["ZZZZ"]))


def test_strict_records(rows):
    raw = rows([("bbca.jk", "Bank", "Financials")], "ticker string, name string, sector string")
    r = UL.load_stock_records(raw).first()
    assert (r.ticker, r.yfinance_symbol, r.exchange) == ("BBCA", "BBCA.JK", "IDX")
    with pytest.raises(ValueError, match="sector"):
        UL.load_stock_records(raw.drop("sector"))
    with pytest.raises(ValueError, match="name"):
        UL.load_stock_records(raw.withColumn("name", F.lit(" ")))
    with pytest.raises(ValueError, match="universe_rank"):
        UL.load_stock_records(raw.withColumn("universe_rank", F.lit("x")))


def test_footers_answer_counts_and_dates(rows, tmp_path):
    bars = bars_of(rows, range(1, 41), start=D(2001, 1, 1))
    files.write_parquet(bars, str(tmp_path / "bars.parquet"), "bars")
    spark = bars.sparkSession
    stats = files.footer_stats(spark, str(tmp_path / "bars.parquet"), "date", "close")
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date), MIN(close), MAX(close)]" in stats._jdf.queryExecution().executedPlan().toString()
    row = stats.first()
    assert (row.rows, row.least_close, row.greatest_close) == (40, 1.0, 40.0) and row.least_date == D(2001, 1, 1)
    status = {r.table_name: r for r in files.table_status(spark, str(tmp_path), {"bars": "date", "none": None}).collect()}
    assert status["bars"].latest_date == row.greatest_date and status["bars"].size_bytes > 0
    assert (status["none"].exists, status["none"].size_bytes, status["none"].rows) == (False, None, 0)


def test_a_failed_publication_leaves_the_old_table(spark, tmp_path):
    target = str(tmp_path / "t")
    files.write_parquet(spark.range(3), target, "rows")
    with pytest.raises(ValueError):
        files.write_parquet(spark.range(0), target, "rows")
    files.write_parquet(spark.range(5), target, "rows")
    assert spark.read.parquet(target).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_csv_universe_and_suffix_dispatch(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker , name,sector\nbbca.jk,Bank, Fin\n")
    out = UL.load_universe(UL.read_universe_csv(spark, str(tmp_path / "u.csv"))).first()
    assert (out.ticker, out.sector) == ("BBCA", "Fin")
    files.write_parquet(spark.range(3), str(tmp_path / "t"), "rows")
    assert files.read_table(spark, str(tmp_path / "t")).count() == 3
    for write in (files.write_parquet, files.write_csv):
        with pytest.raises(ValueError, match="No rows"):
            write(spark.range(0), str(tmp_path / "none"))


def test_bar_merge_counts_and_newest(rows):
    stocks = rows([("AAA",)], "ticker string")
    old = bars_of(rows, [1, 2])
    new = bars_of(rows, [5, 6, 7]).unionByName(bars_of(rows, [9], "ZZZ"))
    merged = {(r.ticker, r.date): r.close for r in U.merge_bars(old, new, stocks).collect()}
    assert merged == {("AAA", day(i)): float(c) for i, c in enumerate([5, 6, 7])}
    counts = U.bar_counts(new, stocks).first()
    assert (counts.rows_read, counts.rows_processed) == (4, 3)
    twice = bars_of(rows, [1]).withColumn("seq", F.lit(2)).unionByName(bars_of(rows, [8]).withColumn("seq", F.lit(1)))
    assert U.merge_bars(old, twice, stocks, ["seq"]).where("close = 1").count() == 1


def test_bar_table_upsert_rewrites_only_its_years(spark, rows, tmp_path):
    stocks, path = rows([("AAA",)], "ticker string"), str(tmp_path / "bars")
    U.upsert_bar_table(spark, path, bars_of(rows, [1, 2], start=D(2024, 12, 31)), stocks)
    untouched = sorted(p.name for p in (tmp_path / "bars" / "year=2024").iterdir())
    for _ in range(2):  # a repeat changes nothing
        U.upsert_bar_table(spark, path, bars_of(rows, [7, 8], start=D(2025, 1, 1)), stocks)
        got = {r.date: r.close for r in files.read_bars(spark, path).collect()}
        assert got == {D(2024, 12, 31): 1.0, D(2025, 1, 1): 7.0, D(2025, 1, 2): 8.0}
    assert sorted(p.name for p in (tmp_path / "bars" / "year=2024").iterdir()) == untouched


def test_stream_of_landed_bars(spark, rows, tmp_path):
    from barline.streaming.landing import drain_landed_bars

    stocks = rows([("AAA",)], "ticker string")
    landing, table, mark = (str(tmp_path / n) for n in ("landing", "table", "mark"))
    for closes_ in ([1, 2], [5, 6, 7]):
        bars_of(rows, closes_).write.mode("append").parquet(landing)
        drain_landed_bars(spark, landing, table, stocks, mark)
    assert sorted(r.close for r in files.read_bars(spark, table).collect()) == [5.0, 6.0, 7.0]


# --- slices and movers -------------------------------------------------------------------------

def test_slice_by_symbol_and_month(rows):
    data = bars_of(rows, [100], "BBCA").unionByName(bars_of(rows, [128], "BBCA", D(2026, 5, 23))).unionByName(bars_of(rows, [1], "BBRI", D(2026, 5, 23)))
    out = S.ohlcv_slice(data, "BBCA.JK", "1mo").collect()
    assert [(r.date, r.close) for r in out] == [("2026-05-23", 128.0)]
    assert S.ohlcv_slice(data, "BBCA.JK", "unknown").count() == 2
    with pytest.raises(ValueError):
        S.ohlcv_slice(data, "BBCA", "1y", "7d")


@pytest.mark.parametrize("period,first", [("ytd", D(2026, 1, 1)), ("1mo", D(2026, 2, 28)), ("1y", D(2025, 3, 31)), ("5d", D(2026, 3, 26)), ("max", D(2024, 1, 1))])
def test_periods(rows, period, first):
    days = [D(2024, 1, 1), D(2025, 3, 31), D(2026, 1, 1), D(2026, 2, 28), D(2026, 3, 26), D(2026, 3, 31)]
    frame = rows([(d,) for d in days], "date date")
    assert S.period_filter(frame, period).agg(F.min("date")).first()[0] == first


def test_movers_ties_and_bad_previous(rows):
    data = bars_of(rows, [10, 11], "BBB").unionByName(bars_of(rows, [20, 22], "AAA")).unionByName(bars_of(rows, [0, 5], "ZERO")).unionByName(bars_of(rows, [5], "ONE"))
    out = S.movers(data, limit=1).collect()
    assert [(r.side, r.ticker) for r in out] == [("gainers", "AAA"), ("losers", "AAA")]


def test_days_of_few_instruments_fold_by_hash(rows):
    from barline.sources import views

    day = D(2026, 1, 5)
    data = [(k, k % 3, 1, 1, 100.0 * (k % 7 + 1), 4.0, f"T{k % 2}", day if k % 5 else None, 25.0 * (k % 7 + 1)) for k in range(1, 60)]
    data += [(1, 0, p, s, 10.0, 2.0, "T1", day, 5.0 + p + s) for p in (1, 2) for s in (0, 1)]  # equal keys: the rest of the order decides
    data += [(None, 1, 1, 1, 60.0, 2.0, "T0", day, 30.0), (90, 1, 1, 1, None, 2.0, "T0", day, None), (2, 1, 1, 1, 8.0, 2.0, None, day, 4.0)]
    trades = rows(data, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, "
                        "ticker string, date date, price double")
    few, plain = views._daily_of_few(trades), views._daily(trades)
    assert few.schema == plain.schema and few.exceptAll(plain).isEmpty() and plain.exceptAll(few).isEmpty()
    first = few.where("ticker = 'T0' AND date IS NOT NULL").first()
    assert first.open == 30.0 and first.close is None  # no key comes first, and a last trade without a price counts


def test_bars_sort_and_shuffle_no_trades(spark):
    from barline.sources import views

    text = views.bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    below = text[text.rindex("HashAggregate"):]
    assert text.count("SortAggregate") == 2 and "BroadcastHashJoin" in below and "SortMergeJoin" not in text and "SortAggregate" not in below
