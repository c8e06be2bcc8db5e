"""Is a backtest's Sharpe ratio real: probabilistic and deflated Sharpe, overfitting probability, purged folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.stats import EULER_GAMMA, normal_cdf, normal_quantile


def expected_max_sharpe(trials: int, trials_sd: float = 1.0) -> float:
    """Of the best of so many trials without skill, per period."""
    if trials <= 1:
        return 0.0
    return trials_sd * ((1 - EULER_GAMMA) * normal_quantile(1 - 1 / trials) + EULER_GAMMA * normal_quantile(1 - 1 / (trials * math.e)))


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0, periods: int = 252) -> DataFrame:
    """asset, n, sharpe (annual), psr: chance that the true Sharpe is over the (annual) benchmark; 0.5 without variation."""
    m = returns.groupBy("asset").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("g1"), (F.kurtosis("r") + 3).alias("g2")).filter("n >= 20")
    sr = F.col("mean") / F.nullif("sd", F.lit(0.0))
    m = m.withColumn("sr", sr)
    spread = F.sqrt(F.greatest(1 - F.col("g1") * F.col("sr") + (F.col("g2") - 1) / 4 * F.col("sr") * F.col("sr"), F.lit(1e-12)))
    z = (F.col("sr") - benchmark / math.sqrt(periods)) * F.sqrt(F.col("n") - 1) / spread
    return m.select("asset", "n", F.coalesce(F.col("sr") * math.sqrt(periods), F.lit(0.0)).alias("sharpe"), F.coalesce(normal_cdf(z), F.lit(0.5)).alias("psr"))


def deflated_sharpe(returns: DataFrame, trials: int = 20, trials_sd: float | None = None, periods: int = 252) -> DataFrame:
    """asset, n, sharpe, threshold (annual best of the trials by luck), dsr, verdict."""
    sd = 0.5 / math.sqrt(periods) if trials_sd is None else trials_sd
    threshold = expected_max_sharpe(trials, sd) * math.sqrt(periods)
    out = probabilistic_sharpe(returns, threshold, periods).withColumnRenamed("psr", "dsr").withColumn("threshold", F.lit(threshold))
    return out.withColumn("verdict", F.when(F.col("dsr") >= 0.95, "credible").when(F.col("dsr") >= 0.5, "inconclusive").otherwise("likely overfit"))


def overfitting_splits(pnl: DataFrame, blocks: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """Combinatorially symmetric cross-validation. pnl: by..., t (from 0, gapless), trial, pnl. One row per group of `by` and choice of half of the
    blocks (bit b of choice: block b is inside): best trial inside, its rank outside, logit. Sums per block and trial are all that is combined, so the cost
    beyond one pass doesn't depend on the rows; the choices are 2 ** blocks numbers, so more than 20 blocks are refused."""
    if blocks > 20:
        raise ValueError("20 blocks at most")
    spark = pnl.sparkSession
    length = F.max("t").over(Window.partitionBy(*by)) + 1 if by else None
    rows = pnl.withColumn("length", length) if by else pnl.join(F.broadcast(pnl.agg((F.max("t") + 1).alias("length"))))
    # Bounds are floor(i * length / blocks), so a row's block is the last whose bound isn't above t.
    bound = lambda i: F.floor(F.lit(i) * F.col("length") / blocks)
    block = F.lit(0)
    for i in range(1, blocks):
        block = F.when(F.col("t") >= bound(i), i).otherwise(block)
    moments = rows.groupBy(*by, block.alias("block"), "trial").agg(F.count("*").alias("n"), F.sum("pnl").alias("s"), F.sum(F.col("pnl") * F.col("pnl")).alias("ss"))
    choices = spark.range(2**blocks).filter(F.bit_count("id") == blocks // 2)
    choices = choices.select(F.col("id").alias("choice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("inside", F.expr("shiftright(choice, block) & 1") == 1)
    both = moments.join(choices, "block").groupBy(*by, "choice", "trial", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    variance = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    both = both.withColumn("sharpe", F.coalesce(F.when(variance > 1e-300, F.col("s") / F.col("n") / F.sqrt(variance)), F.lit(0.0)))
    pair = both.groupBy(*by, "choice", "trial").agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("inside"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("outside"))
    by_choice = Window.partitionBy(*by, "choice")
    ranked = pair.withColumns({
        "place": F.row_number().over(by_choice.orderBy(F.desc("inside"), "trial")), "trials": F.count("*").over(by_choice),
        "rank": F.rank().over(by_choice.orderBy("outside")) + (F.count("*").over(Window.partitionBy(*by, "choice", "outside")) - 1) / 2.0,
    })
    best = ranked.filter("place = 1").withColumn("w", F.col("rank") / (F.col("trials") + 1))
    return best.select(*by, "choice", F.col("trial").alias("best_trial"), "rank", F.ln(F.col("w") / (1 - F.col("w"))).alias("logit"))


def overfitting_probability(pnl: DataFrame, blocks: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    s = overfitting_splits(pnl, blocks, by).groupBy(*by)
    return s.agg(F.avg((F.col("logit") < 0).cast("int")).alias("pbo"), F.count("*").alias("n_combinations"), F.percentile("logit", F.lit(0.5)).alias("median_logit"))


def purged_folds(rows: DataFrame, splits: int = 5, horizon: int = 5, embargo: int = 0) -> DataFrame:
    """Rows (with i from 0, gapless per asset, and n) once per fold as test or train; those near the test part go."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    rows = rows.withColumn("fold", folds).withColumns({"start": F.floor(F.col("fold") * F.col("n") / splits), "stop": F.floor((F.col("fold") + 1) * F.col("n") / splits)})
    test = (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop"))
    blocked = (F.col("i") >= F.col("start") - horizon) & (F.col("i") < F.col("stop") + embargo)
    return rows.withColumn("role", F.when(test, "test").when(~blocked, "train")).filter("role is not null").drop("start", "stop")
