"""Stress scenarios and factor models."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.operators.series import in_ranges, last_rows

# Days of the crises and moves of the shocks.
CRISES = {
    "GFC 2008 (Lehman)": ("2008-09-02", "2008-11-20"),
    "China / August 2015": ("2015-08-10", "2015-08-25"),
    "Volmageddon Feb 2018": ("2018-01-26", "2018-02-08"),
    "Q4 2018 selloff": ("2018-10-01", "2018-12-24"),
    "COVID crash Mar 2020": ("2020-02-19", "2020-03-23"),
    "2022 rate shock": ("2022-01-03", "2022-10-14"),
    "Terra / UST May 2022": ("2022-05-05", "2022-05-16"),
    "3AC deleveraging Jun 2022": ("2022-06-10", "2022-06-19"),
    "FTX collapse Nov 2022": ("2022-11-05", "2022-11-14"),
}
SHOCKS = {
    "equity_crash": {"equity": -0.30, "credit": -0.15, "oil": -0.20, "gold": 0.08, "crypto": -0.40},
    "rates_shock": {"rates": -0.08, "equity": -0.10, "credit": -0.06, "usd": 0.04},
    "risk_off": {"equity": -0.15, "credit": -0.08, "usd": 0.05, "gold": 0.05, "crypto": -0.20},
    "stagflation": {"equity": -0.12, "rates": -0.05, "oil": 0.25, "gold": 0.10},
    "crypto_winter": {"crypto": -0.55, "equity": -0.08},
    "stablecoin_depeg": {"crypto": -0.45, "equity": -0.05},
    "exchange_insolvency": {"crypto": -0.30, "credit": -0.05, "equity": -0.04},
}
#: Fewer common days than this give no betas.
LEAST_OVERLAP = 60


def scenario_table(spark: SparkSession, windows: dict[str, tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in windows.items()], "scenario string, start string, end string").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def shock_table(spark: SparkSession, shocks: dict[str, dict[str, float]] = SHOCKS) -> DataFrame:
    return spark.createDataFrame([(k, f, m) for k, moves in shocks.items() for f, m in moves.items()], "scenario string, factor string, move double")


def replay(daily: DataFrame, scenarios: DataFrame, compound: str = "simple", least: int = 5) -> DataFrame:
    """scenario, days, pnl, max_drawdown of a portfolio's daily returns (date, r) inside each range.

    compound "simple" compounds log returns as if they were simple ones, which is what the comparison tables expect;
    "log" compounds them as what they are."""
    growth = F.ln(1 + F.col("r")) if compound == "simple" else F.col("r")
    rows = in_ranges(daily.filter("r > -1") if compound == "simple" else daily, scenarios).withColumn("g", growth)
    w = Window.partitionBy("scenario").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.exp(F.sum("g").over(w)))
    rows = rows.withColumn("drawdown", F.col("level") / F.max("level").over(w) - 1)
    out = rows.groupBy("scenario").agg(F.count("*").alias("days"), (F.exp(F.sum("g")) - 1).alias("pnl"), F.min("drawdown").alias("max_drawdown"))
    return out.filter(F.col("days") >= least)


def single_betas(portfolio: DataFrame, factors: DataFrame, lookback: int = 500) -> DataFrame:
    """factor, n, beta, alpha, r2 of each factor alone over the last common days. portfolio: date, r; factors: date, factor, r."""
    both = portfolio.select("date", F.col("r").alias("y")).join(factors.select("date", "factor", F.col("r").alias("x")), "date")
    both = last_rows(both.withColumnRenamed("factor", "asset"), lookback)
    out = both.groupBy(F.col("asset").alias("factor")).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"))
    return out.filter(F.col("n") >= LEAST_OVERLAP)


def normal_equations(portfolio: DataFrame, factors: DataFrame, names: list[str], lookback: int | None = None) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, y'y, sum of y and rows of the common days, from one aggregate of (factors + 2)**2 sums."""
    wide = factors.groupBy("date").pivot("factor", names).agg(F.first("r")).dropna()
    rows = portfolio.join(wide, "date").withColumn("1", F.lit(1.0))
    if lookback:
        rows = last_rows(rows.withColumn("asset", F.lit("all")), lookback)
    columns = ["1", *names]
    sums = [F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{i}_{j}") for i, a in enumerate([*columns, "r"]) for j, b in enumerate([*columns, "r"]) if j >= i]
    got = rows.agg(F.count("*").alias("rows"), *sums).first()
    k = len(columns)
    full = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            full[i, j] = full[j, i] = got[f"{i}_{j}"] or 0.0
    return full[:k, :k], full[:k, k], full[k, k], full[0, k], got["rows"]


def factor_model(portfolio: DataFrame, factors: DataFrame, names: list[str], lookback: int | None = None, periods: int = 252) -> DataFrame:
    """term (intercept first), beta, t_stat, risk_share, return_share, r2, n: least squares with classical errors."""
    spark = portfolio.sparkSession
    schema = "term string, beta double, t_stat double, risk_share double, return_share double, r2 double, n long"
    xx, xy, yy, y, n = normal_equations(portfolio, factors, names, lookback)
    if n < LEAST_OVERLAP:
        return spark.createDataFrame([], schema)
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    rss = max(yy - beta @ xy, 0.0)
    tss = yy - y * y / n
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(xx)) * rss / (n - len(beta)), 1e-300))
    means = xx[0, 1:] / n
    cov = (xx[1:, 1:] - n * np.outer(means, means)) / (n - 1)
    total = tss / (n - 1)
    shares = beta[1:] * (cov @ beta[1:]) / total
    rows = [("alpha", beta[0] * periods, beta[0] / errors[0], rss / (n - 1) / total, beta[0] * periods, 1 - rss / tss, n)]
    rows += [(k, beta[i], beta[i] / errors[i], shares[i - 1], beta[i] * means[i - 1] * periods, 1 - rss / tss, n) for i, k in enumerate(names, 1)]
    return spark.createDataFrame([(k, *map(float, x[:-1]), int(x[-1])) for k, *x in rows], schema)


def hypothetical(betas: DataFrame, shocks: DataFrame) -> DataFrame:
    """scenario, pnl: sum of beta * move; a factor without a beta adds nothing. shocks: scenario, factor, move."""
    return shocks.join(F.broadcast(betas.select("factor", "beta")), "factor", "left").groupBy("scenario").agg(F.sum(F.coalesce("beta", F.lit(0.0)) * F.col("move")).alias("pnl")).orderBy("pnl")


def reverse(betas: DataFrame, shocks: DataFrame, target_loss: float = 0.10) -> DataFrame:
    """scenario, scale, scaled moves that lose the target; scenarios that gain have none."""
    if not 0 < target_loss < 1:
        raise ValueError("the target is between 0 and 1")
    scale = hypothetical(betas, shocks).filter("pnl < 0").select("scenario", (-F.lit(target_loss) / F.col("pnl")).alias("scale"))
    return shocks.join(scale, "scenario").select("scenario", "factor", "scale", (F.col("move") * F.col("scale")).alias("scaled_move"))


