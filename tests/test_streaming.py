import datetime as dt
import statistics

import pytest

from ebbline.operators.risk import ewma_variance
from ebbline.operators.rules import kill_switch
from ebbline.operators.series import drawdowns, log_returns, resample_ohlc
from ebbline.streaming.bars import guarded, sessions, streamed_bars
from ebbline.streaming.state import RunningRisk, drained, running_risk


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def ticks(spark, path, n=200):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], t0 + dt.timedelta(hours=i), 100.0 + (i * 37 % 11), 1.0, 5.0 - (i * 13 % 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, price double, volume double, pnl double")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_streamed_bars_equal_batch(spark, tmp_path):
    batch, stream = ticks(spark, f"{tmp_path}/t")
    got = run(spark, streamed_bars(stream), "bars")
    want = resample_ohlc(batch, "day")
    keys = {(r.asset, r.bucket) for r in got.collect()}
    assert keys and len(keys) >= want.count() - 4  # the last windows stay open until the watermark passes
    shown = lambda df: {(r.asset, r.bucket): (r.open, r.high, r.low, r.close, r.volume) for r in df.collect()}
    assert all(shown(want)[k] == v for k, v in shown(got).items())


def test_sessions_split_at_gaps(spark, tmp_path):
    _, stream = ticks(spark, f"{tmp_path}/t", 40)
    got = run(spark, sessions(stream, "30 minutes"), "sess").collect()
    assert got and all(r.n == 1 for r in got)


def test_guard_equals_batch_latch(spark, tmp_path):
    batch, stream = ticks(spark, f"{tmp_path}/t", 60)
    got = {(r.asset, r.ts): r.blocked for r in run(spark, guarded(stream, 100.0, losses=2), "guard").collect()}
    want = {(r.asset, r.ts): r.blocked for r in kill_switch(batch.select("asset", "ts", "pnl"), 100.0, losses=2).collect()}
    assert got == want and any(want.values())


def test_running_risk_goes_on_after_a_restart(spark, tmp_path):
    """Two runs from one checkpoint, a file each, give what the batch operators give on all rows."""
    t0 = dt.date(2024, 1, 1)
    rows = [("ab"[i % 2], t0 + dt.timedelta(days=i), 100.0 + (i * 37 % 23) - i % 7) for i in range(140)] + [("c", t0 + dt.timedelta(days=i), 50.0 + i) for i in range(8)]
    bars = spark.createDataFrame(rows, "asset string, date date, price double")
    early, late = bars.filter("date < '2024-02-25'"), bars.filter("date >= '2024-02-25'")
    early.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = running_risk(spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/in/*"), dt.timedelta(days=30))
    drained(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    first = spark.read.parquet(f"{tmp_path}/out").count()
    late.repartition(2).write.parquet(f"{tmp_path}/in/2")
    drained(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.asset, r.date): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = ewma_variance(log_returns(bars), seed_rows=20).join(drawdowns(bars).select("asset", "date", "peak", "drawdown"), ["asset", "date"]).collect()
    assert 0 < first < len(got) == len(want) == 145  # c, which ends early, is told when its timer fires
    for r in want:
        g = got[r.asset, r.date]
        assert (g.next_variance, g.peak, g.drawdown) == pytest.approx((r.next_variance, r.peak, r.drawdown))


def test_what_waits_is_told_when_a_series_is_idle():
    risk = RunningRisk(dt.timedelta(hours=1))
    rows, variance = risk.told("a", [0.1, -0.1, 0.2], [1, 2, 3], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], None)
    v = statistics.variance([0.1, -0.1, 0.2])
    for r in (0.1, -0.1, 0.2):
        v = 0.94 * v + 0.06 * r * r
    assert len(rows) == 3 and rows[-1][3] == variance == pytest.approx(v)
