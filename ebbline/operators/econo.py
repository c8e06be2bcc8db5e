"""Long memory, volatility regimes, pairs: statistics of a series as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.frames import rolling, series
from ebbline.functions.linear import cross_products, let, remainders, without
from ebbline.functions.stats import normal_cdf


def numbered(returns: DataFrame) -> DataFrame:
    w = series()
    return returns.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("asset"))})


def scales(rows: DataFrame, count: int, least_share: float, least: int, most_divisor: int) -> DataFrame:
    """Each row with every block size: whole numbers, evenly spaced in logarithm from max(least, share * n) to n / divisor."""
    low, high = F.greatest(F.lit(least), F.floor(F.col("n") * least_share)), F.floor(F.col("n") / most_divisor)
    step = lambda k: F.floor(F.pow(F.lit(10.0), F.log10(low) + (F.log10(high) - F.log10(low)) * k / (count - 1)) + 1e-9).cast("int")
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), step))
    return rows.withColumn("size", F.explode(F.when(high >= low, sizes).otherwise(F.array().cast("array<int>"))))


def rescaled_range(rows: DataFrame) -> DataFrame:
    """asset, size, rs: mean over whole blocks of (range of cumulated deviations) / sample deviation. rows: asset, i, n, r, size."""
    rows = rows.withColumn("block", F.floor(F.col("i") / F.col("size"))).filter(F.col("block") < F.floor(F.col("n") / F.col("size")))
    inside = Window.partitionBy("asset", "size", "block")
    rows = rows.withColumn("deviation", F.col("r") - F.avg("r").over(inside))
    rows = rows.withColumn("walk", F.sum("deviation").over(inside.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("asset", "size", "block").agg((F.max("walk") - F.min("walk")).alias("range"), F.stddev_samp("r").alias("sd")).filter("sd > 1e-10")
    return blocks.groupBy("asset", "size").agg(F.avg(F.col("range") / F.col("sd")).alias("rs"))


def hurst_rs(returns: DataFrame, count: int = 20, least_share: float = 0.02, least: int = 10) -> DataFrame:
    """asset, hurst: slope of ln(R/S) on ln(block size)."""
    points = rescaled_range(scales(numbered(returns), count, least_share, least, 4))
    return points.groupBy("asset").agg(F.regr_slope(F.ln("rs"), F.ln("size")).alias("hurst"))


def hurst_quick(returns: DataFrame) -> DataFrame:
    """asset, hurst from three block sizes, clipped to 0 ... 1; 0.5 where it can't be had."""
    n = F.col("n")
    sizes = F.array_distinct(F.array(F.greatest(F.lit(10), F.floor(n / 8)), F.greatest(F.lit(20), F.floor(n / 4)), F.greatest(F.lit(30), F.floor(n / 2))))
    rows = numbered(returns)
    points = rescaled_range(rows.withColumn("size", F.explode(sizes)).filter("size < n"))
    slope = points.groupBy("asset").agg(F.regr_slope(F.ln("rs"), F.ln("size")).alias("slope"), F.count("*").alias("points"))
    known = F.when((F.col("points") >= 2) & (F.col("n") >= 20), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("slope"))))
    return rows.select("asset", "n").distinct().join(slope, "asset", "left").select("asset", F.coalesce(known, F.lit(0.5)).alias("hurst"))


def dfa(returns: DataFrame, count: int = 25) -> DataFrame:
    """asset, alpha: slope of ln F on ln size, F the mean over blocks of the root mean square about a line in the profile."""
    rows = numbered(returns)
    mean = F.avg("r").over(Window.partitionBy("asset"))
    rows = rows.withColumn("d", F.col("r") - mean)
    rows = rows.withColumn("profile", F.sum("d").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    rows = scales(rows, count, 0.01, 10, 5).withColumn("block", F.floor(F.col("i") / F.col("size"))).filter(F.col("block") < F.floor(F.col("n") / F.col("size")))
    rest = F.regr_syy("profile", "i") - F.pow(F.regr_sxy("profile", "i"), F.lit(2)) / F.regr_sxx("profile", "i")
    blocks = rows.groupBy("asset", "size", "block").agg(F.sqrt(F.greatest(rest, F.lit(0.0)) / F.count("*")).alias("rms"))
    points = blocks.groupBy("asset", "size").agg(F.avg("rms").alias("f")).filter("f > 0")
    return points.groupBy("asset").agg(F.regr_slope(F.ln("f"), F.ln("size")).alias("alpha"))


def hurst_consensus(returns: DataFrame) -> DataFrame:
    """Mean of R/S (25 sizes from 1 % or 20) and DFA, with its reading."""
    both = hurst_rs(returns, 25, 0.01, 20).join(dfa(returns), "asset").withColumn("consensus", (F.col("hurst") + F.col("alpha")) / 2)
    h = F.col("consensus")
    return both.withColumn("reading", F.when(h < 0.40, "strong reversion").when(h < 0.48, "mild reversion").when(h < 0.52, "random walk").when(h < 0.62, "mild persistence").otherwise("strong persistence"))


def volatility_regime(returns: DataFrame, n: int = 21) -> DataFrame:
    """asset, vol, vol_median, regime: ESTRÉS if the last rolling volatility is above its median, else CALMA."""
    rows = returns.withColumn("vol", rolling(series(), F.stddev_samp, F.col("r"), n) * F.sqrt(F.lit(252.0)))
    out = rows.groupBy("asset").agg(F.max_by("vol", "date").alias("vol"), F.percentile("vol", F.lit(0.5)).alias("vol_median"))
    return out.withColumn("regime", F.when(F.col("vol") > F.col("vol_median"), "ESTRÉS").otherwise("CALMA"))


def pair_spreads(bars: DataFrame) -> DataFrame:
    """For each pair of assets (a < b): hedge ratio of ln a on ln b, half-life of the spread, its last z-score and signal."""
    p = bars.select("asset", "date", F.ln("price").alias("y"))
    a, b = p.select(F.col("asset").alias("a"), "date", "y"), p.select(F.col("asset").alias("b"), "date", F.col("y").alias("x"))
    both = a.join(b, "date").filter("a < b")
    fit = both.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("hedge"), F.regr_intercept("y", "x").alias("level"))
    spread = both.join(fit, ["a", "b"]).withColumn("s", F.col("y") - F.col("hedge") * F.col("x") - F.col("level"))
    w = Window.partitionBy("a", "b").orderBy("date")
    spread = spread.withColumn("s0", F.lag("s").over(w))
    out = spread.groupBy("a", "b").agg(
        F.first("hedge").alias("hedge"), F.regr_slope(F.col("s") - F.col("s0"), F.col("s0")).alias("pull"),
        ((F.max_by("s", "date") - F.avg("s")) / F.stddev_pop("s")).alias("z"), F.count("*").alias("n"),
    )
    half = F.when(F.col("pull") < 0, -F.ln(F.lit(2.0)) / F.col("pull"))
    signal = F.when(F.col("z") > 2, F.concat(F.lit("sell "), "a", F.lit(", buy "), "b")).when(F.col("z") < -2, F.concat(F.lit("buy "), "a", F.lit(", sell "), "b")).otherwise("none")
    return out.select("a", "b", "n", "hedge", half.alias("half_life"), "z", signal.alias("signal"))


#: MacKinnon's (1994) response surface for a constant and two series. From the least to the greatest statistic that has a
#: p-value between 0 and 1, a quadratic up to SURFACE_STAR and a cubic beyond, both through the normal distribution.
SURFACE_MIN, SURFACE_STAR, SURFACE_MAX = -18.86, -2.62, 0.92
SURFACE_SMALL, SURFACE_LARGE = (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)


def surface_p_value(t: Column) -> Column:
    """P-value of an Engle-Granger statistic of two series. What is used more than once is bound, so that a filter on the
    result that is pushed below the statistic doesn't compute it anew for each use."""
    polynomial = lambda t, cs: sum((c * F.pow(t, F.lit(float(k))) for k, c in enumerate(cs)), F.lit(0.0))
    inside = lambda t: let(F.when(t <= SURFACE_STAR, polynomial(t, SURFACE_SMALL)).otherwise(polynomial(t, SURFACE_LARGE)), normal_cdf)
    return let(t, lambda t: F.when(t > SURFACE_MAX, 1.0).when(t < SURFACE_MIN, 0.0).otherwise(inside(t)))


def augmented_dickey_fuller(series: DataFrame, by: list[str]) -> DataFrame:
    """by..., lag, statistic: does e return to zero (no constant), with as many lagged changes as AIC asks for.

    series: by..., i (from 0, gapless), n, e. Lags up to 12 (n / 100) ** (1/4) are tried on the rows that have all of them: one
    aggregate of cross products serves every lag, as eliminating the regressors in turn leaves the squared residuals of each.
    The statistic is then of the chosen lag, on all rows that have it."""
    most = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 1).cast("int")
    w = Window.partitionBy(*by).orderBy("i")
    rows = series.withColumns({"before": F.lag("e").over(w), "most": most}).withColumn("d", F.col("e") - F.col("before"))
    longest = rows.agg(F.max("most")).first()[0] or 0
    rows = rows.withColumn("past", F.reverse(F.collect_list("d").over(w.rowsBetween(-longest, -1)))).filter("d is not null")
    first = rows.filter("i > most").select(*by, F.concat(F.array("before"), F.slice("past", F.lit(1), F.col("most")), F.array("d")).alias("v"))
    tried = cross_products(first, by, "v").withColumn("left", remainders(F.col("m"), F.sequence(F.lit(0), F.size("m") - 2)))
    criteria = F.transform(F.slice("left", 2, F.size("left")), lambda s, p: F.col("k") * F.ln(s / F.col("k")) + 2 * (p + 1))
    chosen = tried.select(*by, (F.array_position(criteria, F.array_min(criteria)) - 1).cast("int").alias("lag"))
    again = rows.join(chosen, by).filter("i > lag").select(*by, F.concat(F.slice("past", F.lit(1), F.col("lag")), F.array("before", "d")).alias("v"))
    last = cross_products(again, by, "v").withColumn("lag", F.size("m") - 2)
    ends = F.slice(without(F.col("m"), F.filter(F.sequence(F.lit(0), F.col("lag")), lambda k: k < F.col("lag"))), F.col("lag") + 1, 2)

    def statistic(m: Column) -> Column:
        q, r, s = (F.element_at(F.get(m, F.lit(i)), j) for i, j in ((0, -2), (0, -1), (1, -1)))
        return r / q / F.sqrt((s - r * r / q) / (F.col("k") - F.col("lag") - 1) / q)

    return last.select(*by, "lag", let(ends, statistic).alias("statistic"))


def cointegrated_pairs(bars: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Engle-Granger for each pair of assets (a < b): a regression of ln a on ln b and the test of its residuals, with half-life, last
    z-score and signal of the spread. Pairs need ten days in common."""
    p = bars.select("asset", "date", F.ln("price").alias("y"))
    a, b = p.select(F.col("asset").alias("a"), "date", "y"), p.select(F.col("asset").alias("b"), "date", F.col("y").alias("x"))
    both = a.join(b, "date").filter("a < b")
    fit = both.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("hedge"), F.regr_intercept("y", "x").alias("level"), F.count("*").alias("n")).filter("n >= 10")
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("date")) - 1
    spread = both.join(fit, ["a", "b"]).select("a", "b", "n", place.alias("i"), (F.col("y") - F.col("hedge") * F.col("x") - F.col("level")).alias("e"))
    tests = augmented_dickey_fuller(spread, ["a", "b"]).withColumn("p_value", surface_p_value(F.col("statistic")))
    out = pair_spreads(bars).drop("signal").join(tests, ["a", "b"]).withColumn("cointegrated", F.col("p_value") < alpha)
    signal = F.when(~F.col("cointegrated"), "none: not cointegrated").when(F.coalesce(F.col("half_life"), F.lit(1e9)) > 252, "none: slow")
    signal = signal.when(F.col("z") > 2, F.concat(F.lit("sell "), "a", F.lit(", buy "), "b")).when(F.col("z") < -2, F.concat(F.lit("buy "), "a", F.lit(", sell "), "b")).otherwise("none: neutral")
    return out.withColumn("signal", signal)


def best_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k cointegrated pairs of least p-value (ties: least statistic, then names)."""
    return pairs.filter("cointegrated").orderBy("p_value", "statistic", "a", "b").limit(k)


def histogram(returns: DataFrame, bins: int = 100) -> DataFrame:
    """asset, bin, centre, density; the last bin holds its right end."""
    edges = returns.groupBy("asset").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    rows = returns.join(edges, "asset").withColumn("bin", F.least(F.floor((F.col("r") - F.col("low")) / width), F.lit(bins - 1)))
    out = rows.groupBy("asset", "bin").agg(F.count("*").alias("k"), F.first("low").alias("low"), F.first(width).alias("width"), F.first("n").alias("n"))
    return out.select("asset", "bin", (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("centre"), (F.col("k") / F.col("n") / F.col("width")).alias("density"))


def short_signal(hurst: DataFrame, regimes: DataFrame, sharpes: DataFrame) -> DataFrame:
    """asset, points, signal: a point for persistence (less one for reversion), calm (less one for stress) and Sharpe over 0.5."""
    both = hurst.join(regimes, "asset").join(sharpes, "asset")
    points = F.when(F.col("hurst") > 0.55, 1).when(F.col("hurst") < 0.45, -1).otherwise(0) + F.when(F.col("regime") == "CALMA", 1).otherwise(-1) + F.when(F.col("sharpe") > 0.5, 1).otherwise(0)
    both = both.withColumn("points", points)
    return both.withColumn("signal", F.when(F.col("points") >= 2, "ALCISTA").when(F.col("points") <= -1, "BAJISTA/CAUTELA").otherwise("NEUTRAL"))


def long_signal(consensus: DataFrame, bubbles: DataFrame, statistics: DataFrame) -> DataFrame:
    """asset, points, bias from the long-memory consensus, bubble flag and confidence, and Calmar ratio."""
    rows = consensus.join(bubbles, "asset").join(statistics, "asset")
    h, calmar = F.col("consensus"), F.col("calmar")
    points = F.when(h > 0.55, 2).when(h < 0.45, -1).otherwise(0) + F.when(F.col("bubble") & (F.col("confidence") > 0.65), -2).otherwise(1) + F.when(calmar > 0.5, 1).when(calmar < 0, -1).otherwise(0)
    rows = rows.withColumn("points", points)
    bias = F.when(F.col("points") >= 3, "ALCISTA FUERTE").when(F.col("points") >= 1, "LEVEMENTE ALCISTA").when(F.col("points") == 0, "NEUTRAL").otherwise("CAUTELOSO")
    return rows.select("asset", "points", bias.alias("bias"))
