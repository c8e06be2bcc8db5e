"""A return's potential well propagated in time: bands of where the last move will be, by implicit steps on a grid in the JVM.

The density of returns, R squared, is the ground state of H = -1/2 d2/dx2 + R''/(2R). On a grid H is a tridiagonal matrix, an
array of its diagonal and one number beside it. Its two least levels come from counts of negative pivots (Sturm), its ground
state from inverse iteration, and exp(-t (H - E0)) from L-stable implicit steps of second order, each two sweeps over an array.
A row holds a grid, so each asset is a row and no matrix is formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions import fits
from ebbline.functions.linear import let
from ebbline.operators.models import per_series

GRID, REACH = 221, 6.0
WIDTH = 2 * REACH / (GRID - 1)
BESIDE = -0.5 / WIDTH**2
BISECTIONS, INVERSIONS, STEPS, GROWTH = 60, 4, 60, 1.1
#: Of the two-stage step that is L-stable.
GAMMA = 1 - 1 / math.sqrt(2)
LEAST_ROWS = 120


def places() -> Column:
    return F.sequence(F.lit(0), F.lit(GRID - 1))


def at(i: Column) -> Column:
    return i * WIDTH - REACH


def potential(nu: Column, scale: Column) -> Column:
    """R''/(2R) of a Student density on the grid, less its least value."""
    a = (nu + 1) / 4

    def value(i: Column) -> Column:
        u = at(i) / scale
        g = 1 + u * u / nu
        return 0.5 * (-2 * a / (nu * g) + 4 * a * (1 + a) * u * u / (nu * nu * g * g)) / (scale * scale)

    return let(F.transform(places(), value), lambda v: F.transform(v, lambda x: x - F.array_min(v)))


def levels_below(diagonal: Column, energy: Column) -> Column:
    """How many eigenvalues are below an energy: negative pivots of the matrix less the energy."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(1e300).alias("p"))

    def pivot(a: Column, d: Column) -> Column:
        p = d - energy - BESIDE * BESIDE / a["p"]
        p = F.when(F.abs(p) < 1e-300, 1e-300).otherwise(p)
        return let(p, lambda p: F.struct((a["n"] + (p < 0).cast("int")).alias("n"), p.alias("p")))

    return F.aggregate(diagonal, zero, pivot, lambda a: a["n"])


def level(diagonal: Column, number: int) -> Column:
    """The eigenvalue with so many below it, by bisection."""
    zero = F.struct(F.lit(0.0).alias("low"), (F.array_max(diagonal) - 2 * BESIDE).alias("high"))

    def halved(a: Column, _: Column) -> Column:
        middle = (a["low"] + a["high"]) / 2
        below = levels_below(diagonal, middle) > number
        return F.struct(F.when(below, a["low"]).otherwise(middle).alias("low"), F.when(below, middle).otherwise(a["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), zero, halved, lambda a: (a["low"] + a["high"]) / 2)


def factors(diagonal: Column, beside: Column) -> Column:
    """Multipliers of the forward sweep for a symmetric tridiagonal matrix: beside / pivot of each row."""
    zero = F.array().cast("array<double>")
    return F.aggregate(diagonal, zero, lambda c, d: F.concat(c, F.array(beside / (d - beside * F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0.0))))))


def solved(multipliers: Column, beside: Column, right: Column) -> Column:
    """x with M x = right, by the sweeps of a factored tridiagonal matrix (multiplier / beside is one over the pivot)."""
    zero = F.array().cast("array<double>")
    both = F.arrays_zip(multipliers.alias("c"), right.alias("r"))
    forward = F.aggregate(both, zero, lambda y, e: F.concat(y, F.array((e["r"] - beside * F.coalesce(F.try_element_at(y, F.lit(-1)), F.lit(0.0))) * e["c"] / beside)))
    back = lambda y: F.aggregate(
        F.reverse(F.arrays_zip(multipliers.alias("c"), y.alias("y"))), zero, lambda x, e: F.concat(x, F.array(e["y"] - e["c"] * F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0.0))))
    )
    return F.reverse(let(forward, back))


def ground_state(diagonal: Column, energy: Column) -> Column:
    """The eigenvector of the least level, by inverse iteration; its greatest entry is 1."""
    shifted = F.transform(diagonal, lambda d: d - energy + 1e-7)
    unit = lambda v: let(F.array_max(F.transform(v, F.abs)), lambda m: F.transform(v, lambda x: F.abs(x) / m))
    start = F.transform(places(), lambda i: F.exp(-at(i) * at(i) / 4))
    return let(factors(shifted, F.lit(BESIDE)), lambda c: F.aggregate(F.sequence(F.lit(1), F.lit(INVERSIONS)), start, lambda v, _: let(solved(c, F.lit(BESIDE), v), unit)))


def applied(diagonal: Column, v: Column) -> Column:
    """The tridiagonal matrix times a vector."""
    return F.transform(v, lambda x, i: F.get(diagonal, i) * x + BESIDE * (F.coalesce(F.get(v, i - 1), F.lit(0.0)) + F.coalesce(F.get(v, i + 1), F.lit(0.0))))


def evolved(diagonal: Column, start: Column, time: Column, steps: int = STEPS) -> Column:
    """exp(-time M) start for a tridiagonal M, in steps that grow with what is past, as the sharp start is lost fast."""
    total = sum(GROWTH**k for k in range(steps))

    def step(u: Column, k: Column) -> Column:
        h = time * (F.pow(F.lit(GROWTH), k) / total)
        return let(h, lambda h: let(h * GAMMA * BESIDE, lambda beside: let(factors(F.transform(diagonal, lambda d: 1 + GAMMA * h * d), beside), lambda c: both(u, h, beside, c))))

    def both(u: Column, h: Column, beside: Column, c: Column) -> Column:
        slope = lambda v: solved(c, beside, F.transform(applied(diagonal, v), lambda x: -x))
        moved = lambda v, k, w: F.zip_with(v, k, lambda a, b: a + w * h * b)
        second = lambda k1: let(slope(moved(u, k1, 1 - GAMMA)), lambda k2: moved(moved(u, k1, 1 - GAMMA), k2, GAMMA))
        return let(slope(u), second)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step)


def well_states(returns: DataFrame) -> DataFrame:
    """asset, x_now (the last five days' move in deviations), ar1 (of five-day moves), half_life in days; series of 120 returns at least."""
    w = Window.partitionBy("asset").orderBy("date")
    m = returns.groupBy("asset").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.count("*").alias("n")).filter(f"n >= {LEAST_ROWS}")
    rows = returns.join(m, "asset").withColumns({"move": F.sum((F.col("r") - F.col("mean")) / F.col("sd")).over(w.rowsBetween(-4, 0)) / math.sqrt(5), "i": F.row_number().over(w)})
    rows = rows.filter("i >= 5").withColumn("before", F.lag("move").over(w))
    ar1 = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.sum(F.col("move") * F.col("before")) / (F.sum(F.col("before") * F.col("before")) + 1e-12)))
    states = rows.groupBy("asset").agg(F.max_by("move", "date").alias("move"), ar1.alias("ar1"))
    half = F.greatest(F.lit(1.5), F.least(F.lit(60.0), -math.log(2) / F.ln("ar1")))
    return states.select("asset", F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("move"))).alias("x_now"), "ar1", half.alias("half_life"))


def well_shapes(returns: DataFrame) -> DataFrame:
    """asset, nu, scale of a centred Student density fitted to the standardised returns."""

    def fit(r):
        z = (r - r.mean()) / r.std(ddof=1)
        _, scale, nu = fits.student_fit(z, centre=0.0)
        return {"nu": float(min(max(nu, 2.2), 250.0)), "scale": scale}

    return per_series(returns, fit, "asset string, nu double, scale double", least=LEAST_ROWS)


def propagated(wells: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """asset, horizon, gap (between the two least levels), mean and band (mean and deviation of the move that many days on, in deviations),
    mass (of the forecast density, 1). wells: asset, nu, scale, x_now, half_life; natural time becomes days by the half-life."""
    rows = wells.withColumn("diagonal", F.transform(potential(F.col("nu"), F.col("scale")), lambda v: v + 1 / WIDTH**2))
    rows = rows.withColumns({"e0": level(F.col("diagonal"), 0), "e1": level(F.col("diagonal"), 1)}).withColumn("gap", F.col("e1") - F.col("e0")).filter("gap > 1e-6")
    rows = rows.withColumns({"state": ground_state(F.col("diagonal"), F.col("e0")), "moved": F.transform("diagonal", lambda d: d - F.col("e0")), "start": F.transform(places(), lambda i: F.when(i == F.ceil((F.col("x_now") + REACH) / WIDTH - 0.5), 1.0).otherwise(0.0))})
    rows = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    time = F.col("horizon") / (F.col("half_life") * F.col("gap") / math.log(2))
    rows = rows.withColumn("u", evolved(F.col("moved"), F.col("start"), time))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    density = F.zip_with("u", "state", lambda u, s: F.greatest(u, F.lit(0.0)) * F.greatest(s, F.lit(1e-9)))
    rows = rows.withColumn("p", let(density, lambda p: let(total(p) * WIDTH, lambda area: F.transform(p, lambda x: x / area))))
    mean = total(F.transform("p", lambda p, i: p * at(i))) * WIDTH
    rows = rows.withColumns({"mean": mean, "square": total(F.transform("p", lambda p, i: p * at(i) * at(i))) * WIDTH, "mass": total(F.col("p")) * WIDTH})
    return rows.select("asset", "horizon", "gap", "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("band"), "mass")


def propagator(returns: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Bands of each asset's move over the next days, with the state that they start from."""
    wells = well_shapes(returns).join(well_states(returns), "asset")
    return propagated(wells, horizons).join(wells.select("asset", "x_now", "ar1", "half_life"), "asset")
