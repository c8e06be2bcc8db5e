import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbline.operators import backtest, diagnostics, econo, models, risk, rolling, rules, series, stress


def frame(spark, values, asset="a", column="r", start=dt.date(2020, 1, 1)):
    rows = [(asset, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"asset string, date date, {column} double")


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).normal(0, 0.01, 1200)


def test_log_returns_skip_bad_prices(spark):
    got = [r.r for r in series.log_returns(frame(spark, [1, 2, 0, 4, 8], column="price")).orderBy("date").collect()]
    assert got == pytest.approx([math.log(2), math.log(2)])


def test_historical_var_equals_numpy(spark, noise):
    r = risk.historical_var(frame(spark, noise)).first()
    q = np.quantile(noise, 0.01)
    assert r["var"] == pytest.approx(-q) and r["es"] == pytest.approx(-noise[noise <= q].mean())


def test_var_is_monotone_and_scales_with_root_of_time(spark, noise):
    f = frame(spark, noise)
    a, b, c = (risk.historical_var(f, x, h).first()["var"] for x, h in ((0.95, 1), (0.99, 1), (0.99, 4)))
    assert 0 < a < b and c == pytest.approx(2 * b)


def test_ewma_closed_form_equals_recursion_over_many_blocks(spark):
    x = np.random.default_rng(1).normal(0, 0.01, 2600)
    got = [r.next_variance for r in risk.ewma_variance(frame(spark, x)).orderBy("date").collect()]
    v, want = np.var(x[:20], ddof=1), []
    for r in x:
        v = 0.94 * v + 0.06 * r * r
        want.append(v)
    assert got == pytest.approx(want, rel=1e-9)


def test_components_add_up_and_shares_sum_to_one(spark):
    rng = np.random.default_rng(2)
    both = frame(spark, rng.normal(0, 0.01, 300), "a").union(frame(spark, rng.normal(0, 0.03, 300), "b"))
    got = risk.component_var(series.pair_moments(both), series.equal_weights(both)).collect()
    assert sum(r.pct for r in got) == pytest.approx(1)
    assert {r.asset: r.pct for r in got}["b"] > 0.8


def test_rolling_backtest_uses_the_past_only(spark):
    x = np.random.default_rng(3).normal(0, 0.01, 130)
    got = backtest.rolling_backtest(frame(spark, x), 100, 0.95).orderBy("date").collect()
    assert len(got) == 30
    assert [r.var_forecast for r in got] == pytest.approx([-np.quantile(x[i - 100 : i], 0.05) for i in range(100, 130)])


@pytest.mark.parametrize("exceptions,days,zone,multiplier", [(0, 250, "GREEN", 3.0), (4, 250, "GREEN", 3.0), (5, 250, "YELLOW", 3.4), (9, 250, "YELLOW", 3.85), (10, 250, "RED", 4.0), (20, 1000, "YELLOW", 3.4)])
def test_traffic_light(spark, exceptions, days, zone, multiplier):
    r = backtest.traffic_light(spark.createDataFrame([("a", days, exceptions)], "asset string, days long, exceptions long")).first()
    assert (r.zone, r.multiplier) == (zone, pytest.approx(multiplier))


def test_coverage_test_accepts_the_right_rate_and_rejects_clusters(spark):
    schema = "asset string, days long, exceptions long, n00 long, n01 long, n10 long, n11 long"
    rows = backtest.coverage_tests(spark.createDataFrame([("spread", 1000, 10, 979, 10, 10, 0), ("cluster", 1000, 10, 988, 1, 1, 9), ("none", 1000, 0, 999, 0, 0, 0)], schema)).collect()
    by = {r.asset: r for r in rows}
    assert not by["spread"].reject_pof and by["spread"].p_pof == pytest.approx(1, abs=1e-3)
    assert by["cluster"].reject_ind and not by["none"].reject_ind
    assert by["none"].lr_pof == pytest.approx(-2 * 1000 * math.log(0.99))


def test_overfitting_is_certain_for_a_trial_that_wins_everywhere_never(spark):
    rng = np.random.default_rng(4)
    pnl = rng.normal(0, 0.01, (240, 8))
    pnl[:, 3] += 0.01
    rows = [(t, j, float(pnl[t, j])) for t in range(240) for j in range(8)]
    got = diagnostics.overfitting_probability(spark.createDataFrame(rows, "t int, trial int, pnl double")).first()
    assert got.n_combinations == math.comb(16, 8) and got.pbo == 0


def test_purged_folds_leave_a_gap(spark):
    rows = spark.createDataFrame([("a", i, 200) for i in range(200)], "asset string, i int, n int")
    got = diagnostics.purged_folds(rows, 5, 10, 5).collect()
    for fold in range(5):
        test = {r.i for r in got if r.fold == fold and r.role == "test"}
        train = {r.i for r in got if r.fold == fold and r.role == "train"}
        assert len(test) == 40 and not test & train
        assert not {i for i in train if min(test) - 10 <= i < max(test) + 1 + 5}


def test_hurst_of_noise_is_near_a_half(spark):
    x = np.random.default_rng(5).normal(size=3000)
    assert econo.dfa(frame(spark, x)).first().alpha == pytest.approx(0.5, abs=0.1)
    assert 0.45 < econo.hurst_rs(frame(spark, x)).first().hurst < 0.68


def test_planted_cycle_is_found(spark):
    price = np.exp(0.001 * np.arange(600) + 0.1 * np.sin(2 * np.pi * np.arange(600) / 30))
    assert models.cycles(frame(spark, price, column="price")).filter("place = 1").first().period == pytest.approx(30, abs=1)


def test_factor_model_recovers_betas(spark):
    rng = np.random.default_rng(6)
    f = rng.normal(0, 0.01, (500, 2))
    y = 1.2 * f[:, 0] - 0.4 * f[:, 1] + rng.normal(0, 0.001, 500)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(500)]
    book = spark.createDataFrame([(d, float(v)) for d, v in zip(days, y, strict=True)], "date date, r double")
    panel = spark.createDataFrame([(d, k, float(v[j])) for d, v in zip(days, f, strict=True) for j, k in enumerate("ab")], "date date, factor string, r double")
    got = {r.term: r for r in stress.factor_model(book, panel, ["a", "b"]).collect()}
    assert got["a"].beta == pytest.approx(1.2, abs=0.02) and got["b"].beta == pytest.approx(-0.4, abs=0.02)
    assert sum(r.risk_share for r in got.values()) == pytest.approx(1, abs=1e-6)


def test_reverse_stress_loses_the_target(spark):
    betas = spark.createDataFrame([("equity", 1.0), ("crypto", 0.5)], "factor string, beta double")
    scaled = stress.reverse(betas, stress.shock_table(spark), 0.1).join(betas, "factor", "left")
    for r in scaled.groupBy("scenario").agg(F.sum(F.coalesce("beta", F.lit(0.0)) * F.col("scaled_move")).alias("pnl")).collect():
        assert r.pnl == pytest.approx(-0.1)


def test_directional_index_equals_the_recursion(spark):
    rng = np.random.default_rng(7)
    c = 100 + np.cumsum(rng.normal(size=120))
    pdf = pd.DataFrame({"asset": "a", "date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(120)], "high": c + 1, "low": c - 1, "close": c})
    got = rolling.directional_index(spark.createDataFrame(pdf)).orderBy("date").toPandas()
    h, low, close = pd.Series(c + 1), pd.Series(c - 1), pd.Series(c)
    up, down = h.diff(), -low.diff()
    mean = lambda x: pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean()
    span = pd.concat([h - low, (h - close.shift()).abs(), (low - close.shift()).abs()], axis=1).max(axis=1)
    plus = 100 * mean(np.where((up > down) & (up > 0), up, 0.0)) / (mean(span) + 1e-10)
    minus = 100 * mean(np.where((down > up) & (down > 0), down, 0.0)) / (mean(span) + 1e-10)
    want = mean(100 * (plus - minus).abs() / (plus + minus + 1e-10))
    assert got["adx"].to_numpy() == pytest.approx(want.to_numpy(), rel=1e-9)


def test_asof_join_takes_the_latest_quote(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "asset string, ts int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 6, 3.0)], "asset string, ts int, price double")
    got = {(r.asset, r.ts): r.price for r in series.asof_join(left, right, "price").collect()}
    assert got == {("a", 1): None, ("a", 5): 2.0, ("b", 5): None}


def test_kill_switch_latches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), p) for i, p in enumerate([10.0, -1.0, -1.0, -1.0, 50.0, 10.0])]
    got = rules.kill_switch(spark.createDataFrame(rows, "asset string, ts timestamp, pnl double"), 1000.0, losses=3).orderBy("ts").collect()
    assert [r.blocked for r in got] == [False, False, False, True, True, True]


def test_backtest_engine_stops_for_good(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    rows = [("a", d, r, 1, 0.9, 0.0) for d, r in zip(days, [-0.9, -0.9, 0.5, 0.5, 0.5, 0.5], strict=True)]
    got = models.backtest_engine(spark.createDataFrame(rows, "asset string, date date, r double, prediction int, p_buy double, p_sell double")).orderBy("date").collect()
    assert [r.position for r in got] == [1, 0, 0, 0, 0, 0]


def test_tests_on_empty_tables(spark):
    empty = frame(spark, [])
    assert risk.historical_var(empty).count() == 0
    assert backtest.rolling_backtest(empty).count() == 0
    assert econo.hurst_rs(empty).count() == 0
