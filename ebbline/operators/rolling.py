"""Technical features and labels; one window specification per series, so that all columns share one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.frames import rolling, rolling_autocorrelation, rolling_hurst, rolling_kurtosis, series

#: Keeps ratios finite.
TINY = 1e-10
#: Terms after which a decay of 1 - 1/n adds nothing, in multiples of n.
MEMORY = 60
FEATURES = (
    "hurst fractal_dim vol_ratio regimen_vol tsallis_q rsi_14 rsi_28 bb_pos mom_5 mom_10 mom_21 mom_63 vol_5 vol_21 autocorr_5 ret_lag1 ret_lag2 ret_lag3".split()
)


def relative_strength(n: int = 14) -> Column:
    """RSI with simple means; needs the column `change` (price less the price before)."""
    w = series()
    # greatest() skips nulls, and the first row has no change.
    part = lambda x: rolling(w, F.avg, F.when(F.col("change").isNotNull(), F.greatest(x, F.lit(0.0))), n)
    up, down = part(F.col("change")), part(-F.col("change"))
    return 100 - 100 / (1 + up / (down + TINY))


def bollinger_position(price: str = "price", n: int = 20) -> Column:
    w = series()
    mean, sd = rolling(w, F.avg, F.col(price), n), rolling(w, F.stddev_samp, F.col(price), n)
    return (F.col(price) - (mean - 2 * sd)) / (4 * sd + TINY) - 0.5


def features(bars: DataFrame) -> DataFrame:
    """asset, date, price, r and 18 features; null until a full frame is there (regimen_vol is 0 then)."""
    w = series()
    base = bars.withColumns({"change": F.col("price") - F.lag("price").over(w), "r": F.ln(F.col("price") / F.lag("price").over(w))})
    base = base.withColumn("r_lag5", F.lag("r", 5).over(w))
    r = F.col("r")
    year = F.sqrt(F.lit(252.0))
    base = base.withColumns({
        "hurst": rolling_hurst(w, r, 63), "v21": rolling(w, F.stddev_samp, r, 21) * year, "v63": rolling(w, F.stddev_samp, r, 63) * year,
        "kurt": rolling_kurtosis(w, r, 63), "rsi_14": relative_strength(14), "rsi_28": relative_strength(28), "bb_pos": bollinger_position(),
        **{f"mom_{n}": rolling(w, F.sum, r, n) for n in (5, 10, 21, 63)}, **{f"vol_{n}": rolling(w, F.stddev_samp, r, n) for n in (5, 21)},
        "autocorr_5": rolling_autocorrelation(w, r, F.col("r_lag5"), 21, 5), **{f"ret_lag{n}": F.lag("r", n).over(w) for n in (1, 2, 3)},
    })
    base = base.withColumn("v63_median", rolling(w, lambda x: F.percentile(x, F.lit(0.5)), F.col("v63"), 63))
    base = base.withColumns({
        "fractal_dim": 2 - F.col("hurst"), "vol_ratio": F.col("v21") / (F.col("v63") + TINY),
        "regimen_vol": F.coalesce((F.col("v21") > F.col("v63_median")).cast("int"), F.lit(0)),
        "tsallis_q": F.when(F.col("kurt").isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(2.5), 1 + 2 / (F.abs("kurt") + 3)))),
    })
    return base.select("asset", "date", "price", "r", *FEATURES)


def exponential_mean(rows: DataFrame, columns: list[str], n: int, key: str = "asset", order: str = "date") -> DataFrame:
    """Adds ewm_<column>: y = y before + (x - y before) / n, from the first value; nulls count as 0.

    Closed form by blocks of MEMORY * n rows, so that no power overflows; what is older than a whole block weighs under
    1e-26 and is left out."""
    q, size = 1 - 1 / n, MEMORY * n
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    rows = rows.withColumns({"__b": F.floor(F.col("__i") / size), "__j": (F.col("__i") % size).cast("double")})
    inside = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("__i") > 0, 1 / n).otherwise(1.0) * F.pow(F.lit(q), -F.col("__j"))
    rows = rows.withColumns({f"ewm_{c}": F.pow(F.lit(q), F.col("__j")) * F.sum(F.coalesce(F.col(c), F.lit(0.0)) * weight).over(inside) for c in columns})
    ends = rows.groupBy(key, "__b").agg(*[F.max_by(f"ewm_{c}", "__j").alias(f"__end_{c}") for c in columns])
    ends = ends.select(F.col(key).alias("__key"), (F.col("__b") + 1).alias("__next"), *[f"__end_{c}" for c in columns])
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__b") == F.col("__next")), "left")
    rows = rows.withColumns({f"ewm_{c}": F.col(f"ewm_{c}") + F.coalesce(f"__end_{c}", F.lit(0.0)) * F.pow(F.lit(q), F.col("__j") + 1) for c in columns})
    return rows.drop("__i", "__b", "__j", "__key", "__next", *[f"__end_{c}" for c in columns])


def directional_index(ohlc: DataFrame, n: int = 14) -> DataFrame:
    """asset, date, adx, di_diff (Wilder means)."""
    w = series()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    before = F.lag("close").over(w)
    rows = ohlc.withColumns({
        "plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
    })
    rows = exponential_mean(rows, ["plus", "minus", "range"], n)
    plus, minus = 100 * F.col("ewm_plus") / (F.col("ewm_range") + TINY), 100 * F.col("ewm_minus") / (F.col("ewm_range") + TINY)
    rows = rows.withColumns({"di_diff": plus - minus, "dx": 100 * F.abs(plus - minus) / (plus + minus + TINY)})
    return exponential_mean(rows, ["dx"], n).select("asset", "date", F.col("ewm_dx").alias("adx"), "di_diff")


def triple_barrier(bars: DataFrame, horizon: int = 5, limit: float = 0.025, drop_unresolved: bool = False) -> DataFrame:
    """label: 1 or -1 for the barrier that the next `horizon` prices touch first (upper first), else 0; the last rows of a
    series have 0 too, or go with drop_unresolved."""
    w = series()
    label = F.lit(0)
    for h in range(horizon, 0, -1):
        change = F.lead("price", h).over(w) / F.col("price") - 1
        label = F.when(change >= limit, 1).when(change <= -limit, -1).otherwise(label)
    rows = bars.withColumns({"resolved": F.lead("price", horizon).over(w).isNotNull(), "label": label})
    rows = rows.withColumn("label", F.when(F.col("resolved"), F.col("label")).otherwise(0))
    return rows.filter("resolved") if drop_unresolved else rows


def fixed_horizon(returns: DataFrame, horizon: int = 5, limit: float = 0.02) -> DataFrame:
    ahead = series().rowsBetween(1, horizon)
    total = F.when(F.count("r").over(ahead) >= horizon, F.sum("r").over(ahead))
    return returns.withColumn("label", F.when(total > limit, 1).when(total < -limit, -1).otherwise(0))
