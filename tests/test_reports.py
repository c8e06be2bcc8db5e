import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.operators import models, reports, rolling, rules, series


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_filtered_backtest_equals_a_loop(spark):
    x = np.random.default_rng(1).standard_t(5, 330) * 0.01
    got = reports.rolling_filtered_backtest(spark.createDataFrame([("a", d, float(v)) for d, v in zip(days(330), x, strict=True)], "asset string, date date, r double")).orderBy("date").collect()
    assert len(got) == 80
    for k, row in enumerate(got):
        past = x[k : k + 250]
        v, z = past[:20].var(ddof=1), []
        for r in past:
            z.append(r / math.sqrt(v))
            v = 0.94 * v + 0.06 * r * r
        z = np.array(z)
        q = np.quantile(z, 0.01)
        assert row.var_forecast == pytest.approx(-q * math.sqrt(v)) and row.es_forecast == pytest.approx(-z[z <= q].mean() * math.sqrt(v))
        assert row.realised_return == pytest.approx(x[k + 250]) and row.exception == (x[k + 250] < q * math.sqrt(v))


def test_path_and_performance_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    r, position = rng.normal(0, 0.02, 200), rng.integers(-1, 2, 200)
    rows = list(zip(["a"] * 200, days(200), map(float, r), map(int, position), strict=True))
    table = spark.createDataFrame(rows, "asset string, date date, r double, position int")
    path = reports.held_path(table.select("asset", "date", "r"), table.select("asset", "date", "position"))
    money, held, worth, gains, trades = 10_000.0, 0, [], [], 0
    for i, (x, p) in enumerate(zip(r, position, strict=True)):
        if p != held:
            money *= 1 - 0.0015
            trades += i > 0
            held = p
        gains.append(p * 0.25 * x)
        money *= math.exp(gains[-1])
        worth.append(money)
    assert [x.capital for x in path.orderBy("date").collect()] == pytest.approx(worth)
    out, gains, worth = reports.performance(path, 10_000.0).first(), np.array(gains), np.array(worth)
    assert out.sharpe == pytest.approx(gains.mean() / (gains.std(ddof=1) + 1e-10) * math.sqrt(252))
    assert out.sortino == pytest.approx(gains.mean() / (gains[gains < 0].std(ddof=1) + 1e-10) * math.sqrt(252))
    assert out.max_drawdown == pytest.approx((worth / np.maximum.accumulate(worth) - 1).min()) and out.trades == trades
    assert out.alpha == pytest.approx(worth[-1] / 10_000 - 1 - (math.exp(r.sum()) - 1))


def test_stretches_of_time_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seconds = np.sort(rng.choice(40_000, 300, replace=False))
    start = dt.datetime(2020, 1, 1)
    trades = spark.createDataFrame([(("a", "b")[i % 2], start + dt.timedelta(seconds=int(s)), float(v)) for i, (s, v) in enumerate(zip(seconds, rng.normal(0, 1, 300), strict=True))], "asset string, ts timestamp, pnl double")
    quotes = trades.sample(0.1, 5).select("asset", "ts", F.col("pnl").alias("price"))
    seen = []
    for size in (10**9, 7200):
        monkeypatch.setattr(series, "STRETCH", size)
        monkeypatch.setattr(rules, "STRETCH", size)
        blocked = rules.kill_switch(trades, 100.0, 0.05, 6, 20).orderBy("asset", "ts").collect()
        waiting = rules.cooled_down(trades.select("asset", "ts"), 1).orderBy("asset", "ts").collect()
        priced = series.asof_join(trades.select("asset", "ts"), quotes, "price").orderBy("asset", "ts").collect()
        seen.append([[tuple(round(v, 9) if isinstance(v, float) else v for v in r.asDict().values()) for r in rows] for rows in (blocked, waiting, priced)])
    assert seen[0] == seen[1] and len(seen[0][0]) == 300


def test_exponential_mean_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rolling, "MEMORY", 60)
    x = np.random.default_rng(4).normal(5, 1, 700)
    got = rolling.exponential_mean(spark.createDataFrame([("a", d, float(v)) for d, v in zip(days(700), x, strict=True)], "asset string, date date, x double"), ["x"], 3).orderBy("date").collect()
    y, want = x[0], [x[0]]
    for v in x[1:]:
        y += (v - y) / 3
        want.append(y)
    assert [r.ewm_x for r in got] == pytest.approx(want)


def test_worst_method_and_empty_tables(spark):
    rows = [("a", "historical", "YELLOW"), ("a", "normal", "YELLOW"), ("a", "filtered", "GREEN"), ("b", "historical", "GREEN"), ("b", "filtered", "RED")]
    got = reports.worst_method(spark.createDataFrame(rows, "asset string, method string, zone string"), ["historical", "normal", "filtered"]).collect()
    assert {(r.asset, r.method, r.zone) for r in got} == {("a", "historical", "YELLOW"), ("b", "filtered", "RED")}
    none = spark.createDataFrame([], "asset string, date date, r double")
    for out in (reports.quick_var(none), reports.ewma_forecast(none, [1]), reports.rolling_filtered_backtest(none), models.shrunk_covariance(none), models.cycles(none.withColumnRenamed("r", "price"))):
        assert out.count() == 0
