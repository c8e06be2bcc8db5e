"""Reports that put several operators together: full backtests, stress suites, performance of paths, forecasts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.linear import let
from ebbline.functions.stats import PERIODS, normal_quantile
from ebbline.operators import backtest, risk, stress


def quick_var(returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """asset, historical, parametric: quantiles of the returns themselves, so losses are negative."""
    z = normal_quantile(1 - confidence)
    return returns.groupBy("asset").agg(F.percentile("r", F.lit(1 - confidence)).alias("historical"), (F.avg("r") + z * F.stddev_samp("r")).alias("parametric"))


def ewma_forecast(returns: DataFrame, horizons: list[int], decay: float = 0.94) -> DataFrame:
    """asset, horizon, volatility over so many days, annual: under EWMA the variance of each coming day is tomorrow's."""
    last = risk.ewma_variance(returns, decay).groupBy("asset").agg(F.max_by("next_variance", "date").alias("v"))
    each = last.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return each.select("asset", "horizon", F.sqrt(F.col("v") * F.col("horizon")).alias("volatility"), F.sqrt(F.col("v") * PERIODS).alias("annual"))


def rolling_filtered_backtest(returns: DataFrame, window: int = 250, confidence: float = 0.99, decay: float = 0.94, seed_rows: int = 20) -> DataFrame:
    """As backtest.rolling_backtest, by filtered simulation: each day's window, an array, gets an EWMA path of its own in the one sort of its series."""
    frame = Window.partitionBy("asset").orderBy("date").rowsBetween(-window, -1)
    rows = returns.withColumns({"past": F.collect_list("r").over(frame)}).filter(F.size("past") >= window)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    first = F.slice("past", 1, seed_rows)
    seed = let(total(first) / seed_rows, lambda m: total(F.transform(first, lambda v: (v - m) * (v - m))) / (seed_rows - 1))
    step = lambda a, r: F.struct((decay * a["v"] + (1 - decay) * r * r).alias("v"), F.concat(a["z"], F.array(r / F.sqrt(a["v"]))).alias("z"))
    path = F.aggregate("past", F.struct(seed.alias("v"), F.array().cast("array<double>").alias("z")), step)
    at = (window - 1) * (1 - confidence)
    low = int(at)
    quantile = lambda z: let(F.sort_array(z), lambda s: F.get(s, F.lit(low)) + (at - low) * (F.get(s, F.lit(min(low + 1, window - 1))) - F.get(s, F.lit(low))))
    tail = lambda z, q: let(F.filter(z, lambda x: x <= q), lambda worse: total(worse) / F.size(worse))
    forecast = let(path, lambda p: let(quantile(p["z"]), lambda q: F.struct((-q * F.sqrt(p["v"])).alias("var"), (-tail(p["z"], q) * F.sqrt(p["v"])).alias("es"))))
    rows = rows.select("asset", "date", "r", forecast.alias("f"))
    return rows.select("asset", "date", F.col("f.var").alias("var_forecast"), F.col("f.es").alias("es_forecast"), F.col("r").alias("realised_return"), (F.col("r") < -F.col("f.var")).alias("exception"))


def full_backtest(returns: DataFrame, window: int = 250, confidence: float = 0.99) -> DataFrame:
    """asset, method: days, exceptions, coverage tests, zone, multiplier, Z2 and its p-value of each method's walk-forward backtest."""
    runs = {m: backtest.rolling_backtest(returns, window, confidence, m) for m in ("historical", "normal", "student")} | {"filtered": rolling_filtered_backtest(returns, window, confidence)}
    out = None
    for name, run in runs.items():
        counts = backtest.exception_counts(run)
        rows = backtest.traffic_light(backtest.coverage_tests(counts, confidence)).join(backtest.shortfall_test(run, confidence).select("asset", "z2", "p_value"), "asset")
        rows = rows.select("asset", F.lit(name).alias("method"), "days", "exceptions", "p_pof", "p_ind", "p_cc", "zone", "multiplier", "z2", "p_value")
        out = rows if out is None else out.unionByName(rows)
    return out


def worst_method(report: DataFrame, methods: list[str]) -> DataFrame:
    """asset, method, zone of the worst zone; of equal ones, the method that stands first."""
    severity = F.element_at(F.create_map(F.lit("GREEN"), F.lit(0), F.lit("YELLOW"), F.lit(1), F.lit("RED"), F.lit(2)), F.col("zone"))
    place = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    return report.groupBy("asset").agg(F.max_by(F.struct("method", "zone"), F.struct(severity.alias("s"), (-place).alias("p"))).alias("x")).select("asset", "x.method", "x.zone")


def stress_suite(daily: DataFrame, betas: DataFrame, scenarios: DataFrame, shocks: DataFrame) -> DataFrame:
    """scenario, kind, pnl, max_drawdown (null for shocks) of all replays and shocks, the worst first."""
    replays = stress.replay(daily, scenarios).select("scenario", F.lit("historical").alias("kind"), "pnl", "max_drawdown")
    moves = stress.hypothetical(betas, shocks).select("scenario", F.lit("hypothetical").alias("kind"), "pnl", F.lit(None).cast("double").alias("max_drawdown"))
    return replays.unionByName(moves).orderBy("pnl", "scenario")


def performance(paths: DataFrame, start: float, periods: int = PERIODS) -> DataFrame:
    """One row per asset of a path (asset, date, capital, position, r: the path's gain, market_r): capital at the end,
    total and yearly return, volatility, Sharpe, Sortino, drawdown, Calmar, trades, buy and hold, and alpha over it."""
    w = Window.partitionBy("asset").orderBy("date")
    peak = F.max("capital").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = paths.withColumns({"drawdown": (F.col("capital") - peak) / peak, "moved": F.abs(F.col("position") - F.lag("position").over(w)) > 0})
    root = math.sqrt(periods)
    out = rows.groupBy("asset").agg(
        F.max_by("capital", "date").alias("capital"), F.count("*").alias("days"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.count_if("moved").alias("trades"), (F.exp(F.sum("market_r")) - 1).alias("buy_and_hold"),
    )
    total = F.col("capital") / start - 1
    out = out.withColumn("total", total).withColumn("cagr", F.pow(1 + F.col("total"), F.lit(float(periods)) / F.col("days")) - 1)
    return out.select(
        "asset", "capital", "total", "cagr", (F.col("sd") * root).alias("volatility"), (F.col("mean") / (F.col("sd") + 1e-10) * root).alias("sharpe"),
        (F.col("mean") / (F.coalesce("down", F.lit(0.0)) + 1e-10) * root).alias("sortino"), "max_drawdown",
        F.when(F.col("max_drawdown") != 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"), "trades", "buy_and_hold", (F.col("total") - F.col("buy_and_hold")).alias("alpha"),
    )


def held_path(returns: DataFrame, positions: DataFrame, start: float = 10_000.0, cost: float = 0.0015, kelly: float = 0.25) -> DataFrame:
    """asset, date, capital, position, r, market_r of a path without a stop: costs and gains are a running sum of logs.
    returns: asset, date, r; positions: asset, date, position (-1, 0, 1)."""
    w = Window.partitionBy("asset").orderBy("date")
    rows = returns.withColumnRenamed("r", "market_r").join(positions, ["asset", "date"])
    paid = F.when(F.col("position") != F.coalesce(F.lag("position").over(w), F.lit(0)), math.log(1 - cost)).otherwise(0.0)
    rows = rows.withColumns({"r": F.col("position") * kelly * F.col("market_r"), "paid": paid})
    return rows.select("asset", "date", (start * F.exp(F.sum(F.col("r") + F.col("paid")).over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("capital"), "position", "r", "market_r")


def event_windows(ticks: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """asset, start, n, high, low of tumbling (or sliding) windows of a finished table of ticks (asset, ts, price)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ticks.groupBy("asset", w.alias("w")).agg(F.count("*").alias("n"), F.max("price").alias("high"), F.min("price").alias("low")).select("asset", F.col("w.start").alias("start"), "n", "high", "low")


def event_sessions(events: DataFrame, gap: str) -> DataFrame:
    """asset, start, end (last event and the gap), n of runs of events without a longer gap."""
    out = events.groupBy("asset", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("asset", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
