"""Returns, alignment, resampling, gaps, joins in time. Long tables of (asset, date, price) throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.frames import last_known, next_known, series
from ebbline.functions.stats import finite


def log_returns(bars: DataFrame, price: str = "price", order: str = "date") -> DataFrame:
    """asset, date, r = ln(p / p before). Prices that are not positive are an error of the data: they give null returns, which go."""
    p = F.when(F.col(price) > 0, F.col(price))
    r = F.ln(p / F.lag(p).over(series(order=order)))
    return bars.select("asset", order, r.alias("r")).filter("r is not null")


def simple_returns(bars: DataFrame, price: str = "price") -> DataFrame:
    return bars.select("asset", "date", (F.col(price) / F.lag(price).over(series()) - 1).alias("r")).filter("r is not null")


def monthly_returns(bars: DataFrame) -> DataFrame:
    """asset, month, r: change of the last price of each calendar month."""
    last = bars.groupBy("asset", F.trunc("date", "month").alias("month")).agg(F.max_by("price", "date").alias("price"))
    return last.select("asset", "month", (F.col("price") / F.lag("price").over(series(order="month")) - 1).alias("r")).filter("r is not null")


def winsorised(returns: DataFrame, low: float = -0.9, high: float = 9.0) -> DataFrame:
    """Infinite values become null, others are clipped; nulls go."""
    return returns.withColumn("r", F.greatest(F.lit(low), F.least(F.lit(high), finite(F.col("r"))))).filter("r is not null")


def forward_fill(bars: DataFrame, columns: list[str], order: str = "date", back: bool = False) -> DataFrame:
    """The last known value; with back, what comes before the first known value takes that one."""
    w = series(order=order)
    fill = lambda c: F.coalesce(last_known(w, F.col(c)), next_known(w, F.col(c))) if back else last_known(w, F.col(c))
    return bars.withColumns({c: fill(c) for c in columns})


def last_rows(bars: DataFrame, n: int, order: str = "date") -> DataFrame:
    place = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc(order)))
    return bars.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def date_slice(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends included; the filter reaches the scan."""
    return bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def aligned(rows: DataFrame, order: str = "date") -> DataFrame:
    """Rows of the dates on which every asset is there. The number of assets is one aggregate, joined as a single row."""
    assets = rows.agg(F.count_distinct("asset").alias("assets"))
    full = rows.groupBy(order).agg(F.count_distinct("asset").alias("present")).join(F.broadcast(assets), F.col("present") == F.col("assets"))
    return rows.join(full.select(order), order, "left_semi")


def positive_dates(bars: DataFrame) -> DataFrame:
    """Rows of dates on which all prices are positive."""
    good = bars.groupBy("date").agg(F.min("price").alias("low")).filter("low > 0")
    return bars.join(good.select("date"), "date", "left_semi")


def equal_weights(rows: DataFrame) -> DataFrame:
    assets = rows.select("asset").distinct()
    return normalised(assets.withColumn("weight", F.lit(1.0)))


def normalised(weights: DataFrame) -> DataFrame:
    """Weights that sum to one. One row per asset, so the unpartitioned window is over as many rows."""
    return weights.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def missing_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Assets that have no weight."""
    return rows.select("asset").distinct().join(weights, "asset", "left_anti")


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """date, r: weighted sum on dates where every asset has a return (fixed weights: daily rebalancing)."""
    return aligned(returns).join(F.broadcast(normalised(weights)), "asset").groupBy("date").agg(F.sum(F.col("r") * F.col("weight")).alias("r"))


def resample_ohlc(ticks: DataFrame, unit: str, price: str = "price") -> DataFrame:
    """Bars per asset and calendar unit from finer rows with ts, price and volume."""
    return ticks.groupBy("asset", F.date_trunc(unit, "ts").alias("bucket")).agg(
        F.min_by(price, F.struct("ts", price)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct("ts", price)).alias("close"), F.sum("volume").alias("volume")
    )


def drawdowns(bars: DataFrame, price: str = "price") -> DataFrame:
    peak = F.max(price).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("peak", peak).withColumn("drawdown", (F.col(price) - F.col("peak")) / F.col("peak"))


#: Seconds of one stretch of time (an hour at least): what is long in time is dealt into groups of so much.
STRETCH = 30 * 86_400


def stretch(ts: str) -> Column:
    """Number of a time's stretch; rows without a time are one before all others."""
    return F.coalesce(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / STRETCH), F.lit(-(2**40)).cast("long"))


def running(rows: DataFrame, key: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums over a key's rows, which have a column stretch: sums inside a stretch, and those of all earlier ones."""
    before = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.groupBy(key, "stretch").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = whole.select(key, "stretch", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    out = rows.join(earlier, [key, "stretch"]).withColumns({n: F.col(f"__{n}") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.drop(*[f"__{n}" for n in sums])


def asof_join(left: DataFrame, right: DataFrame, value: str, key: str = "asset", order: str = "ts") -> DataFrame:
    """Each left row with the right table's latest value at or before its time: union and last known value, no range join.

    Groups are stretches of a key's time; a small table of each stretch's last value goes on into the later ones."""
    both = left.withColumns({value: F.lit(None).cast(dict(right.dtypes)[value]), "__right": F.lit(0)}).unionByName(right.select(key, order, value, F.lit(1).alias("__right")), allowMissingColumns=True)
    both = both.withColumn("__stretch", stretch(order))
    ends = both.groupBy(key, "__stretch").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    before = Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("__key"), F.col("__stretch").alias("__at"), F.last("__end", ignorenulls=True).over(before).alias("__earlier"))
    w = Window.partitionBy(key, "__stretch").orderBy(order, F.desc("__right")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__right = 0")
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & F.col("__stretch").eqNullSafe(F.col("__at")))
    return rows.withColumn(value, F.coalesce(value, "__earlier")).drop("__right", "__stretch", "__key", "__at", "__earlier")


def in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with every (name, start, end) range that holds their date; ranges are a short list, which is broadcast."""
    return rows.join(F.broadcast(ranges), F.col("date").between(F.col("start"), F.col("end")))


def pair_moments(returns: DataFrame) -> DataFrame:
    """asset_i, asset_j, n, covariance, correlation on aligned dates: pairs inside a date, so rows grow with assets squared, not with dates squared."""
    a = aligned(returns)
    x, y = a.select("date", F.col("asset").alias("asset_i"), F.col("r").alias("x")), a.select("date", F.col("asset").alias("asset_j"), F.col("r").alias("y"))
    return x.join(y, "date").groupBy("asset_i", "asset_j").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("covariance"), F.corr("x", "y").alias("correlation"))
