"""Value at risk and expected shortfall (positive numbers are losses), volatility, portfolio decomposition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.stats import kurt_from, normal_density, normal_quantile, skew_from

#: Fewer returns than this give no row.
LEAST_ROWS = 30
#: Rows of one block in closed-form recursions; powers stay finite and what a block before the last adds is under 1e-20.
BLOCK = 1000


def with_quantile(returns: DataFrame, p: float, key: str = "asset") -> DataFrame:
    q = returns.groupBy(key).agg(F.percentile("r", F.lit(p)).alias("q"))
    return returns.join(q, key)


def tail(returns: DataFrame, confidence: float, key: str = "asset", scale: str | None = None) -> DataFrame:
    """key, n, tail_n, var, es: quantile with linear interpolation and mean of the returns at or below it."""
    out = with_quantile(returns, 1 - confidence, key).groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("r") <= F.col("q")).alias("tail_n"), (-F.first("q")).alias("var"), (-F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))).alias("es")
    )
    return out.filter(F.col("n") >= LEAST_ROWS).withColumn("es", F.coalesce("es", "var"))


def historical_var(returns: DataFrame, confidence: float = 0.99, horizon: int = 1, value: float = 1.0) -> DataFrame:
    root = math.sqrt(horizon)
    out = tail(returns, confidence).withColumns({"var": F.col("var") * root, "es": F.col("es") * root})
    note = F.when(F.col("tail_n") < 5, F.format_string("only %d returns in the tail", "tail_n"))
    return out.withColumns({"var_amount": F.col("var") * value, "es_amount": F.col("es") * value, "note": note})


def normal_var(returns: DataFrame, confidence: float = 0.99, horizon: int = 1) -> DataFrame:
    z = normal_quantile(1 - confidence)
    root, shape = math.sqrt(horizon), normal_density(z) / (1 - confidence)
    out = returns.groupBy("asset").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")).filter(F.col("n") >= LEAST_ROWS)
    return out.withColumns({"var": -(F.col("mean") + z * F.col("sd")) * root, "es": -(F.col("mean") - shape * F.col("sd")) * root})


def ewma_variance(returns: DataFrame, decay: float = 0.94, seed_rows: int = 20, key: str = "asset") -> DataFrame:
    """Adds variance (known before the row) and next_variance (after it): v' = decay * v + (1 - decay) * r**2, from the
    sample variance of the first rows. Closed form by blocks, so that no power overflows."""
    w = Window.partitionBy(key).orderBy("date")
    rows = returns.withColumn("i", F.row_number().over(w) - 1)
    rows = rows.withColumns({"seed": F.var_samp(F.when(F.col("i") < seed_rows, F.col("r"))).over(Window.partitionBy(key)), "block": F.floor(F.col("i") / BLOCK), "j": F.col("i") % BLOCK})
    inside = Window.partitionBy(key, "block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    part = (1 - decay) * F.pow(F.lit(decay), "j") * F.sum(F.col("r") * F.col("r") * F.pow(F.lit(decay), -F.col("j"))).over(inside)
    rows = rows.withColumn("inner", part)
    ends = rows.groupBy(key, "block").agg(F.max_by("inner", "j").alias("end"))
    ends = ends.select(F.col(key).alias("__key"), (F.col("block") + 1).alias("__block"), "end")
    rows = rows.join(ends, (F.col(key) == F.col("__key")) & (F.col("block") == F.col("__block")), "left")
    carried = F.when(F.col("block") == 0, F.col("seed")).otherwise(F.col("end"))
    rows = rows.withColumn("next_variance", F.col("inner") + carried * F.pow(F.lit(decay), F.col("j") + 1))
    rows = rows.withColumn("variance", F.coalesce(F.lag("next_variance").over(w), F.col("seed")))
    return rows.select(*returns.columns, "variance", "next_variance")


def filtered_var(returns: DataFrame, confidence: float = 0.99, decay: float = 0.94) -> DataFrame:
    """Historical simulation on returns over their EWMA volatility, times tomorrow's volatility; returns are not demeaned."""
    rows = ewma_variance(returns, decay).withColumn("z", F.col("r") / F.sqrt("variance"))
    latest = rows.groupBy("asset").agg(F.sqrt(F.max_by("next_variance", "date")).alias("sigma"))
    out = tail(rows.select("asset", "date", F.col("z").alias("r")), confidence).join(latest, "asset")
    return out.select("asset", "n", (F.col("var") * F.col("sigma")).alias("var"), (F.col("es") * F.col("sigma")).alias("es"), "sigma")


def summary(returns: DataFrame, periods: int = 252) -> DataFrame:
    n = F.count("*").cast("double")
    return returns.groupBy("asset").agg(
        F.count("*").alias("n"), (F.avg("r") * periods).alias("mean"), (F.stddev_samp("r") * math.sqrt(periods)).alias("volatility"),
        skew_from(F.skewness("r"), n).alias("skew"), kurt_from(F.kurtosis("r"), n).alias("kurtosis"), F.min("r").alias("least"), F.max("r").alias("most"),
    )


def weighted_pairs(moments: DataFrame, weights: DataFrame) -> DataFrame:
    w = F.broadcast(weights)
    return moments.join(w.select(F.col("asset").alias("asset_i"), F.col("weight").alias("wi")), "asset_i").join(w.select(F.col("asset").alias("asset_j"), F.col("weight").alias("wj")), "asset_j")


def risk_shares(moments: DataFrame, weights: DataFrame) -> DataFrame:
    """asset, weight, share of the portfolio's variance, and the portfolio's volatility."""
    rows = weighted_pairs(moments, weights).groupBy(F.col("asset_i").alias("asset")).agg(F.first("wi").alias("weight"), F.sum(F.col("wj") * F.col("covariance")).alias("beta"))
    total = F.sum(F.col("weight") * F.col("beta")).over(Window.partitionBy())
    return rows.withColumn("variance", total).select("asset", "weight", "beta", (F.col("weight") * F.col("beta") / F.col("variance")).alias("share"), F.sqrt("variance").alias("volatility"))


def component_var(moments: DataFrame, weights: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Marginal and component VaR (normal, without the mean); components add up to the portfolio's VaR."""
    z = -normal_quantile(1 - confidence)
    rows = risk_shares(moments, weights).withColumn("marginal", z * F.col("beta") / F.col("volatility"))
    return rows.select("asset", "weight", "marginal", (F.col("weight") * F.col("marginal")).alias("component"), F.col("share").alias("pct"))


def incremental_var(returns: DataFrame, weights: DataFrame, confidence: float = 0.99) -> DataFrame:
    """VaR of the portfolio less VaR without an asset (weights normalised anew); normal, with the mean."""
    from ebbline.operators.series import aligned

    z = normal_quantile(1 - confidence)
    full = aligned(returns).join(F.broadcast(weights), "asset")
    dropped = F.broadcast(weights.select(F.col("asset").alias("dropped")).union(weights.limit(1).select(F.lit(None).cast("string"))))
    daily = full.join(dropped, F.col("dropped").isNull() | (F.col("asset") != F.col("dropped"))).groupBy("dropped", "date").agg((F.sum(F.col("r") * F.col("weight")) / F.sum("weight")).alias("r"))
    var = daily.groupBy("dropped").agg((-(F.avg("r") + z * F.stddev_samp("r"))).alias("var"))
    whole = var.filter("dropped is null").select(F.col("var").alias("whole_var"))
    return var.filter("dropped is not null").join(F.broadcast(whole)).select(F.col("dropped").alias("asset"), "whole_var", (F.col("whole_var") - F.col("var")).alias("incremental"))


def asset_statistics(bars: DataFrame, periods: int = 252) -> DataFrame:
    """Years, annual return and volatility, Sharpe, skew, kurtosis, worst drawdown, Calmar."""
    from ebbline.operators.series import drawdowns, log_returns

    s = summary(log_returns(bars), 1)
    worst = drawdowns(bars).groupBy("asset").agg(F.min("drawdown").alias("max_drawdown"))
    out = s.join(worst, "asset").withColumns({"years": F.col("n") / periods, "annual": F.pow(1 + F.col("mean"), F.lit(float(periods))) - 1, "vol": F.col("volatility") * math.sqrt(periods)})
    return out.select("asset", "years", "annual", "vol", (F.col("annual") / F.col("vol")).alias("sharpe"), "skew", "kurtosis", "max_drawdown", (F.col("annual") / F.abs("max_drawdown")).alias("calmar"))
