import math
from statistics import NormalDist

import numpy as np
import pytest

from pyspark.sql import functions as F

from ebbline.functions.linear import cross_products, remainders, without
from ebbline.operators import econo


def regression(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, float(((y - x @ beta) ** 2).sum())


def dickey_fuller(e):
    """Lag by AIC on the rows that have all lags, then the statistic on all rows that have the chosen ones."""
    n, d = len(e), np.diff(e)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1)

    def design(lag, first):
        rows = range(first + 1, n)
        return np.array([[e[t - 1], *(d[t - 1 - j] for j in range(1, lag + 1))] for t in rows]), np.array([d[t - 1] for t in rows])

    criteria = []
    for lag in range(most + 1):
        x, y = design(lag, most)
        criteria.append(len(y) * math.log(regression(x, y)[1] / len(y)) + 2 * (lag + 1))
    lag = int(np.argmin(criteria))
    x, y = design(lag, lag)
    beta, left = regression(x, y)
    spread = np.linalg.inv(x.T @ x)[0, 0] * left / (len(y) - lag - 1)
    return lag, beta[0] / math.sqrt(spread)


def test_unit_root_test_equals_regressions(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for name, n, phi in (("a", 60, 0.5), ("b", 150, 0.95), ("c", 150, 1.0)):
        noise, e = rng.normal(size=n), np.zeros(n)
        for t in range(1, n):
            e[t] = phi * e[t - 1] + noise[t] + 0.4 * noise[t - 1]
        want[name] = dickey_fuller(e)
        rows += [(name, t, n, float(e[t])) for t in range(n)]
    got = econo.augmented_dickey_fuller(spark.createDataFrame(rows, "name string, i int, n int, e double").repartition(3), ["name"]).collect()
    assert {r.name: r.lag for r in got} == {k: lag for k, (lag, _) in want.items()}
    assert {r.name: r.statistic for r in got} == pytest.approx({k: t for k, (_, t) in want.items()}, rel=1e-8)


def test_elimination(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([("x", list(map(float, r))) for r in x], "name string, v array<double>")
    row = cross_products(df, ["name"], "v").select("m", "k", remainders(F.col("m"), F.array(*map(F.lit, range(3)))).alias("left"), without(F.col("m"), F.array(F.lit(0))).alias("rest"))
    m, n, left, rest = row.first()
    assert n == 40 and np.allclose(m, x.T @ x)
    assert left == pytest.approx([float((x[:, 3] ** 2).sum())] + [regression(x[:, :k], x[:, 3])[1] for k in (1, 2, 3)])
    residual = x[:, 1:] - np.outer(x[:, 0], x[:, 0] @ x[:, 1:] / (x[:, 0] @ x[:, 0]))
    assert np.allclose(np.array(rest)[1:, 1:], residual.T @ residual)


def test_p_values(spark):
    at = [-30.0, -4.0, -3.34, -2.0, 0.0, 2.0]
    got = [r.p for r in spark.createDataFrame([(t,) for t in at], "t double").select(econo.surface_p_value(F.col("t")).alias("p")).collect()]
    assert got[0] == 0 and got[-1] == 1 and got[2] == pytest.approx(0.05, abs=0.002)
    small = 2.92 + 1.5012 * -4 + 0.039796 * 16
    assert got[1] == pytest.approx(NormalDist().cdf(small), rel=1e-5) and got == sorted(got)


def test_pairs(spark):
    """b follows a's level, c goes its own way."""
    rng, start = np.random.default_rng(3), np.datetime64("2020-01-01")
    a, c, rows = np.cumsum(rng.normal(0, 0.01, 400)), np.cumsum(rng.normal(0, 0.01, 400)), []
    for t in range(400):
        day = (start + t).astype(object)
        rows += [("A", day, float(np.exp(a[t]))), ("B", day, float(np.exp(0.5 * a[t] + 0.002 * rng.normal()))), ("C", day, float(np.exp(c[t])))]
    pairs = econo.cointegrated_pairs(spark.createDataFrame(rows, "asset string, date date, price double"))
    got = {(r.a, r.b): r for r in pairs.collect()}
    assert got["A", "B"].cointegrated and got["A", "B"].p_value < 1e-6 and got["A", "B"].hedge == pytest.approx(2, rel=0.1)
    assert not got["A", "C"].cointegrated and got["A", "C"].signal == "none: not cointegrated"
    best = econo.best_pairs(pairs, 1).collect()
    assert len(best) == 1 and (best[0].a, best[0].b) == ("A", "B")
