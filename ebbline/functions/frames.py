"""Rolling frames with the rule that a value needs a full frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ebbline.functions.stats import kurt_from


def series(key: str = "asset", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def rolling(w: WindowSpec, aggregate: Callable[[Column], Column], x: Column, n: int, need: int | None = None) -> Column:
    """The aggregate over the last n rows; null until `need` (n) values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (need or n), aggregate(x).over(frame))


def rolling_kurtosis(w: WindowSpec, x: Column, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= n, kurt_from(F.kurtosis(x).over(frame), F.lit(float(n))))


def rolling_autocorrelation(w: WindowSpec, x: Column, lagged: Column, n: int, lag: int) -> Column:
    """Pearson correlation of x with itself `lag` rows before, inside the last n rows."""
    return F.when(F.count(x).over(w.rowsBetween(-(n - 1), 0)) >= n, F.corr(x, lagged).over(w.rowsBetween(-(n - lag - 1), 0)))


def rolling_hurst(w: WindowSpec, x: Column, n: int) -> Column:
    """ln(range of cumulated deviations / population deviation) / ln n over the last n rows, in 0 ... 1; 0.5 if flat."""
    frame = w.rowsBetween(-(n - 1), 0)
    values = F.collect_list(x).over(frame)
    mean = F.avg(x).over(frame)
    walk = F.aggregate(
        F.transform(values, lambda v: v - mean),
        F.struct(F.lit(0.0).alias("s"), F.lit(-1e300).alias("hi"), F.lit(1e300).alias("lo")),
        lambda a, v: F.struct((a.s + v).alias("s"), F.greatest(a.hi, a.s + v).alias("hi"), F.least(a.lo, a.s + v).alias("lo")),
        lambda a: a.hi - a.lo,
    )
    sd = F.stddev_pop(x).over(frame)
    value = F.when(sd < 1e-10, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(walk / sd) / F.ln(F.lit(float(n))))))
    return F.when(F.count(x).over(frame) >= n, value)


def last_known(w: WindowSpec, x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def next_known(w: WindowSpec, x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
