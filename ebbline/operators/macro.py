"""Macro regime from a panel of rates, volatility, credit and dollar series (asset, date, price)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.frames import rolling
from ebbline.operators.rules import clip, first_case
from ebbline.operators.series import last_rows, log_returns


def last_values(panel: DataFrame, names: list[str]) -> DataFrame:
    """One row: the last value of each series (null if it has none)."""
    return panel.filter(F.col("asset").isin(names)).agg(*[F.max_by(F.when(F.col("asset") == a, F.col("price")), F.when(F.col("asset") == a, F.col("date"))).alias(a) for a in names])


def yield_curve(panel: DataFrame, short: str, five: str, ten: str, thirty: str) -> DataFrame:
    y = last_values(panel, [short, five, ten, thirty])
    a, b, c, d = (F.col(f"`{x}`") for x in (short, five, ten, thirty))
    out = y.select((c - a).alias("slope"), (c - b).alias("slope_10y_5y"), (2 * b - a - d).alias("curvature"))
    return out.withColumn("inverted", F.col("slope") < 0).withColumn("reading", first_case((F.col("slope") < 0, "inverted"), (F.col("slope") < 0.5, "flat"), otherwise="steep"))


def volatility_term(panel: DataFrame, near: str, far: str) -> DataFrame:
    v = last_values(panel, [near, far])
    out = v.select(F.col(f"`{near}`").alias("vix"), (F.col(f"`{near}`") / F.col(f"`{far}`")).alias("ratio"))
    return out.withColumn("state", F.when(F.col("ratio") > 1, "BACKWARDATION").otherwise("CONTANGO"))


def credit_proxy(panel: DataFrame, high_yield: str, treasury: str) -> DataFrame:
    """ret_20d, ret_60d of the ratio, and the share of earlier 20-day sums below the last one."""
    a = panel.filter(F.col("asset") == high_yield).select("date", F.col("price").alias("a"))
    b = panel.filter(F.col("asset") == treasury).select("date", F.col("price").alias("b"))
    rows = a.join(b, "date").select(F.lit("ratio").alias("asset"), "date", (F.col("a") / F.col("b")).alias("price"))
    w = Window.partitionBy("asset").orderBy("date")
    rows = log_returns(rows).withColumn("sum_20", rolling(w, F.sum, F.col("r"), 20)).withColumn("sum_60", F.sum("r").over(w.rowsBetween(-59, 0)))
    last = rows.agg(F.max_by("sum_20", "date").alias("ret_20d"), F.max_by("sum_60", "date").alias("ret_60d"))
    out = rows.filter("sum_20 is not null").join(F.broadcast(last)).agg(F.first("ret_20d").alias("ret_20d"), F.first("ret_60d").alias("ret_60d"), F.avg((F.col("sum_20") < F.col("ret_20d")).cast("int")).alias("percentile"))
    return out.withColumn("reading", first_case((F.col("percentile") < 0.2, "stressed"), (F.col("percentile") > 0.8, "strong"), otherwise="normal"))


def dollar_trend(panel: DataFrame, name: str) -> DataFrame:
    rows = last_rows(panel.filter(F.col("asset") == name), 50)
    out = rows.agg(F.max_by("price", "date").alias("level"), F.avg("price").alias("mean_50"))
    ratio = F.col("level") / F.col("mean_50")
    return out.select("level", (ratio - 1).alias("vs_mean"), first_case((ratio > 1.005, "SUBIENDO"), (ratio < 0.995, "BAJANDO"), otherwise="LATERAL").alias("trend"))


def cross_correlations(panel: DataFrame, anchor: str, others: list[str], window: int = 60, least: int = 20) -> DataFrame:
    """other, n, correlation of returns with the anchor's over the last common dates."""
    r = log_returns(panel)
    a = r.filter(F.col("asset") == anchor).select("date", F.col("r").alias("x"))
    both = r.filter(F.col("asset").isin(others)).join(a, "date")
    return last_rows(both, window).groupBy(F.col("asset").alias("other")).agg(F.count("*").alias("n"), F.corr("r", "x").alias("correlation")).filter(F.col("n") >= least)


def macro_regime(vol: DataFrame, credit: DataFrame, curve: DataFrame, dollar: DataFrame) -> DataFrame:
    """One row: score in -1 ... 1, regime and signals from four one-row readings."""
    x = vol.select("vix", "ratio").join(credit.select("percentile")).join(curve.select("inverted")).join(dollar.select("trend"))
    c = F.col
    parts = [
        (first_case((c("ratio") > 1, -2.0), (c("vix") > 25, -1.0), otherwise=1.0), "volatility"),
        (first_case((c("percentile") < 0.20, -2.0), (c("percentile") > 0.70, 1.0)), "credit"),
        (first_case((c("inverted"), -1.0), otherwise=0.5), "curve"),
        (first_case((c("trend") == "SUBIENDO", -1.0), (c("trend") == "BAJANDO", 0.5)), "dollar"),
    ]
    total = sum((p for p, _ in parts), F.lit(0.0))
    signals = F.array_compact(F.array(*[first_case((p < 0, f"-{k}"), (p > 0, f"+{k}"), otherwise=None) for p, k in parts]))
    out = x.select(clip(total / 5, -1, 1).alias("score"), F.concat_ws(",", signals).alias("signals"))
    return out.withColumn("regime", first_case((c("score") < -0.3, "RISK-OFF"), (c("score") > 0.3, "RISK-ON"), otherwise="NEUTRAL"))
