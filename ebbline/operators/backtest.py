"""Walk-forward VaR backtests and their tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions import fits
from ebbline.functions.linear import let
from ebbline.functions.stats import CHI2_1_CRITICAL, CHI2_2_CRITICAL, chi2_1_tail, chi2_2_tail, normal_density, normal_quantile, xlogy

#: Yellow zone: what exceptions in 250 days add to the multiplier of 3.
YELLOW = {5: 0.40, 6: 0.50, 7: 0.65, 8: 0.75, 9: 0.85}


#: Degrees of freedom that a window's likelihood chooses from.
FREEDOM = [round(2.1 * (60 / 2.1) ** (k / 23), 4) for k in range(24)]


def student_tables(alpha: float) -> tuple[list[float], list[float], list[float]]:
    """Of each choice: the constant of the log-likelihood, quantile and shortfall of a Student density with a deviation of one."""
    scales = [math.sqrt((nu - 2) / nu) for nu in FREEDOM]
    quantiles = [fits.student_quantile(alpha, nu) for nu in FREEDOM]
    constants = [math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2)) for nu in FREEDOM]
    tails = [fits.student_pdf(q, nu) / alpha * (nu + q * q) / (nu - 1) for nu, q in zip(FREEDOM, quantiles, strict=True)]
    return constants, [s * q for s, q in zip(scales, quantiles, strict=True)], [s * t for s, t in zip(scales, tails, strict=True)]


def best_freedom(past: Column, mean: Column, sd: Column, n: int) -> Column:
    """Place (from 1) in FREEDOM of the greatest likelihood of a window's values; location and deviation are the window's own."""
    constants, _, _ = student_tables(0.01)
    choices = F.array(*[F.struct(F.lit(n * c).alias("c"), F.lit((nu + 1) / 2).alias("h"), F.lit(nu - 2).alias("d")) for c, nu in zip(constants, FREEDOM, strict=True)])
    squares = F.transform(past, lambda r: F.pow((r - mean) / sd, F.lit(2.0)))
    likelihoods = let(squares, lambda z: F.transform(choices, lambda c: c["c"] - c["h"] * F.aggregate(z, F.lit(0.0), lambda a, x: a + F.ln(1 + x / c["d"]))))
    return let(likelihoods, lambda x: F.array_position(x, F.array_max(x)).cast("int"))


def rolling_backtest(returns: DataFrame, window: int = 250, confidence: float = 0.99, method: str = "historical", key: str = "asset") -> DataFrame:
    """key, date, var_forecast, es_forecast, realised_return, exception: each day forecast from the `window` days before."""
    order = Window.partitionBy(key).orderBy("date")
    frame = order.rowsBetween(-window, -1)
    rows = returns.withColumn("seen", F.count("r").over(frame))
    if method == "student":
        rows = rows.withColumns({"past": F.collect_list("r").over(frame), "mean": F.avg("r").over(frame), "sd": F.stddev_samp("r").over(frame)}).filter(F.col("seen") >= window)
        rows = rows.withColumn("k", best_freedom(F.col("past"), F.col("mean"), F.col("sd"), window))
        _, quantiles, shortfalls = student_tables(1 - confidence)
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k"))
        rows = rows.withColumns({"var_forecast": -(F.col("mean") + of(quantiles) * F.col("sd")), "es_forecast": -(F.col("mean") - of(shortfalls) * F.col("sd"))})
    elif method == "historical":
        rows = rows.withColumns({"q": F.percentile("r", F.lit(1 - confidence)).over(frame), "past": F.collect_list("r").over(frame)})
        worse = F.filter("past", lambda x: x <= F.col("q"))
        rows = rows.withColumns({"var_forecast": -F.col("q"), "es_forecast": -F.aggregate(worse, F.lit(0.0), lambda a, x: a + x) / F.size(worse)})
    else:
        z = normal_quantile(1 - confidence)
        mean, sd = F.avg("r").over(frame), F.stddev_samp("r").over(frame)
        rows = rows.withColumns({"var_forecast": -(mean + z * sd), "es_forecast": -(mean - normal_density(z) / (1 - confidence) * sd)})
    rows = rows.filter(F.col("seen") >= window)
    return rows.select(key, "date", "var_forecast", "es_forecast", F.col("r").alias("realised_return"), (F.col("r") < -F.col("var_forecast")).alias("exception"))


def exception_counts(backtest: DataFrame, key: str = "asset") -> DataFrame:
    """key, days, exceptions and the four transition counts."""
    before = F.lag("exception").over(Window.partitionBy(key).orderBy("date"))
    rows = backtest.withColumn("before", before)
    count = lambda a, b: F.count_if((F.col("before") == a) & (F.col("exception") == b))
    return rows.groupBy(key).agg(
        F.count("*").alias("days"), F.count_if("exception").alias("exceptions"), count(False, False).alias("n00"), count(False, True).alias("n01"), count(True, False).alias("n10"), count(True, True).alias("n11")
    )


def coverage_tests(counts: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Unconditional coverage, independence of exceptions and both: likelihood ratio, p-value, whether rejected at 5 %."""
    n, x, p = F.col("days"), F.col("exceptions"), F.lit(1 - confidence)
    rate = x / n
    pof = -2 * (xlogy(n - x, 1 - p) + xlogy(x, p) - xlogy(n - x, 1 - rate) - xlogy(x, rate))
    a, b, c, d = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    p01, p11, p1 = b / F.nullif(a + b, F.lit(0)), d / F.nullif(c + d, F.lit(0)), (b + d) / F.nullif(a + b + c + d, F.lit(0))
    ind = -2 * (xlogy(a + c, 1 - p1) + xlogy(b + d, p1) - xlogy(a, 1 - p01) - xlogy(b, p01) - xlogy(c, 1 - p11) - xlogy(d, p11))
    degenerate = (b + d == 0) | (a + b == 0) | (c + d == 0)
    out = counts.withColumns({"lr_pof": F.greatest(pof, F.lit(0.0)), "lr_ind": F.when(degenerate, 0.0).otherwise(F.greatest(ind, F.lit(0.0)))})
    out = out.withColumn("lr_cc", F.col("lr_pof") + F.col("lr_ind"))
    out = out.withColumns({"p_pof": chi2_1_tail(F.col("lr_pof")), "p_ind": chi2_1_tail(F.col("lr_ind")), "p_cc": chi2_2_tail(F.col("lr_cc"))})
    return out.withColumns({"reject_pof": F.col("lr_pof") > CHI2_1_CRITICAL, "reject_ind": F.col("lr_ind") > CHI2_1_CRITICAL, "reject_cc": F.col("lr_cc") > CHI2_2_CRITICAL})


def traffic_light(counts: DataFrame) -> DataFrame:
    """Zone and capital multiplier; limits for 250 days scale with the days, exceptions are scaled back with half to even."""
    scale = F.col("days") / 250
    scaled = F.least(F.greatest(F.bround(F.col("exceptions") / scale), F.lit(5)), F.lit(9)).cast("int")
    green, red = F.col("exceptions") <= 4 * scale, F.col("exceptions") >= 10 * scale
    extra = F.element_at(F.create_map(*[F.lit(v) for kv in YELLOW.items() for v in kv]), scaled)
    zone = F.when(green, "GREEN").when(red, "RED").otherwise("YELLOW")
    return counts.withColumns({"zone": zone, "multiplier": F.when(green, 3.0).when(red, 4.0).otherwise(3.0 + extra)})


def shortfall_z2(backtest: DataFrame, confidence: float = 0.975, key: str = "asset") -> DataFrame:
    """Acerbi and Szekely's second statistic: 1 + sum of r / ES over exceptions / (days * (1 - confidence)); 0 without exceptions."""
    hit = F.col("exception")
    out = backtest.groupBy(key).agg(F.count("*").alias("days"), F.count_if(hit).alias("exceptions"), F.sum(F.when(hit, F.col("realised_return") / F.col("es_forecast"))).alias("s"))
    return out.select(key, "days", "exceptions", F.when(F.col("exceptions") == 0, 0.0).otherwise(1 + F.col("s") / (F.col("days") * (1 - confidence))).alias("z2"))


#: A prime and the draws of a bootstrap. P(Poisson(1) <= k) for k = 0, 1, ...
PRIME, DRAWS = 2**31 - 1, 2000
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def times_drawn(day: Column, draw: Column, seed: int = 0) -> Column:
    """How often a bootstrap's draw takes a day: Poisson(1) of a number that day and draw alone decide, so parts of a sum can be made anywhere."""
    a = F.pmod(day * 48271 + draw * 69621 + (7919 * seed + 1), F.lit(PRIME))
    b = let(a, lambda a: (a * a + draw * 40692 + 11) % PRIME)
    c = let(b, lambda b: let((b * 16807 + day) % PRIME, lambda c: (c * c + b) % PRIME))
    return let(c / PRIME, lambda u: sum(((u > p).cast("int") for p in POISSON), F.lit(0)))


def shortfall_test(backtest: DataFrame, confidence: float = 0.975, key: str = "asset", draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """key, z2, p_value, critical, reject: Z2 and the share of bootstrap draws that aren't below 0 (1 if Z2 isn't), the draws' 5 % quantile,
    whether p < 5 %. Only exception days enter a sum, each as often as its hash says, so a draw's terms add up across tasks."""
    z2 = shortfall_z2(backtest, confidence, key)
    terms = backtest.filter("exception").select(key, F.unix_date("date").cast("long").alias("day"), (F.col("realised_return") / F.col("es_forecast")).alias("term"))
    drawn = terms.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
    sums = drawn.groupBy(key, "draw").agg(F.sum(F.col("term") * times_drawn(F.col("day"), F.col("draw"), seed)).alias("s"))
    each = sums.join(z2.select(key, "days"), key).withColumn("z", 1 + F.col("s") / (F.col("days") * (1 - confidence)))
    found = each.groupBy(key).agg(F.avg((F.col("z") >= 0).cast("int")).alias("share"), F.percentile("z", F.lit(0.05)).alias("quantile"))
    p = F.when((F.col("z2") < 0) & F.col("share").isNotNull(), F.col("share")).otherwise(1.0)
    return z2.join(found, key, "left").select(key, "z2", p.alias("p_value"), F.coalesce("quantile", F.lit(0.0)).alias("critical"), (p < 0.05).alias("reject"))
