"""Small linear algebra on arrays of arrays, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def swept(m: Column, k: Column) -> Column:
    """A matrix with its k-th row (from 0) eliminated from all others."""
    return let(F.get(m, k), lambda pivot: F.transform(m, lambda row: F.zip_with(row, pivot, lambda v, p: v - F.get(row, k) * p / F.get(pivot, k))))


def corner(m: Column) -> Column:
    return F.element_at(F.element_at(m, -1), -1)


def remainders(m: Column, steps: Column) -> Column:
    """m: cross products of regressors and, last, what they explain. Sums of squared residuals with none, the first, the first two, ... of the regressors `steps` (an array of 0, 1, ...)."""
    zero = F.struct(m.alias("m"), F.array(corner(m)).alias("left"))
    return F.aggregate(steps, zero, lambda a, k: let(swept(a["m"], k), lambda s: F.struct(s.alias("m"), F.concat(a["left"], F.array(corner(s))).alias("left"))), lambda a: a["left"])


def without(m: Column, steps: Column) -> Column:
    """m with the regressors `steps` eliminated."""
    return F.aggregate(steps, m, swept)


def cross_products(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by..., m, k: the matrix of sums over rows of products of a vector's entries, and the number of rows. Each pair of
    entries is one key, so sums are combined inside tasks and a key is as long as a number of tasks, not of rows."""
    one = rows.select(*by, F.col(vector).alias("v"), F.posexplode(vector).alias("i", "x"))
    two = one.select(*by, "i", "x", F.posexplode(F.slice("v", F.col("i") + 1, F.size("v"))).alias("d", "y"))
    sums = two.groupBy(*by, "i", (F.col("i") + F.col("d")).alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.count("*").alias("k"))
    entry = F.struct(F.struct("i", "j").alias("at"), F.col("s"))
    whole = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("s"), F.max("j").alias("last"), F.max("k").alias("k"))
    places = F.sequence(F.lit(0), F.col("last"))
    cell = lambda i, j: F.element_at("s", F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")))
    return whole.select(*by, F.transform(places, lambda i: F.transform(places, lambda j: cell(i, j))).alias("m"), "k")
