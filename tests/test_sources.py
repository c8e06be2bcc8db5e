import pytest
from pyspark.sql import functions as F

from ebbline.sources import factors, market, sinks


def test_factor_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ["This file", ",Mkt-RF,SMB", "20200102,  0.86, -0.97", "20200103,-0.67,0.30", "  2020,1,2", ""]], "value string")
    got = {(str(r.date), r.factor): r.r for r in factors.parse_factor_lines(lines, ["MKT", "SMB"]).collect()}
    assert got == {("2020-01-02", "MKT"): pytest.approx(0.0086), ("2020-01-02", "SMB"): pytest.approx(-0.0097), ("2020-01-03", "MKT"): pytest.approx(-0.0067), ("2020-01-03", "SMB"): pytest.approx(0.003)}


def test_trade_log_appends(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "COMPRAR"), ("a", 2, "VENDER"), ("b", 3, "COMPRAR")], "asset string, ts int, action string")
    for _ in range(2):
        sinks.append_trades(rows, f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    got = {r.asset: (r.trades, r.bought, r.sold, r.last) for r in sinks.trade_summary(log).collect()}
    assert got == {"a": (4, 2, 2, 2), "b": (2, 2, 0, 3)}
    assert sinks.last_trades(log, 1).count() == 2
    assert sinks.payloads(rows).filter(F.col("body").contains('"asset":"b"')).count() == 1


def test_bars_from_csv_fill_gaps(spark, tmp_path):
    (tmp_path / "p.csv").write_text("asset,date,price\na,2020-01-01,\na,2020-01-02,2\na,2020-01-03,\n")
    got = market.read_bars(spark, f"{tmp_path}/p.csv", "csv").orderBy("date").collect()
    assert [r.price for r in got] == [2.0, 2.0]
