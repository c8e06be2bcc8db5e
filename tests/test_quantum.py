import math

import numpy as np
import pytest

from ebbline.operators import quantum


def dense(nu, s, x_now, half_life, days):
    """Gap, mean and band from all eigenvectors of the same grid's matrix."""
    x = np.linspace(-quantum.REACH, quantum.REACH, quantum.GRID)
    dx, u, a = x[1] - x[0], x / s, (nu + 1) / 4
    g = 1 + u * u / nu
    log_slope = -2 * a * u / (nu * g)
    curve = -2 * a / nu * (1 / g - 2 * u * u / (nu * g * g))
    v = 0.5 * (curve + log_slope**2) / s**2
    h = np.diag(v - v.min() + 1 / dx**2) - 0.5 / dx**2 * (np.eye(len(x), k=1) + np.eye(len(x), k=-1))
    e, phi = np.linalg.eigh(h)
    i, ground = int(np.argmin(np.abs(x - x_now))), np.clip(np.abs(phi[:, 0]), 1e-9, None)
    gap = e[1] - e[0]
    t = days / (half_life * gap / math.log(2))
    p = np.clip(ground * (phi @ (phi[i] * np.exp(-(e - e[0]) * t))), 0, None)
    p /= p.sum() * dx
    mean = float((x * p).sum() * dx)
    return gap, mean, math.sqrt(float((x * x * p).sum() * dx) - mean**2)


def test_bands_equal_the_dense_solution(spark):
    wells = [("a", 4.0, 0.7, 1.5, 6.0), ("b", 30.0, 0.95, -2.2, 1.5), ("c", 2.5, 0.5, 0.03, 20.0)]
    df = spark.createDataFrame(wells, "asset string, nu double, scale double, x_now double, half_life double").repartition(3)
    got = {(r.asset, r.horizon): r for r in quantum.propagated(df).collect()}
    assert len(got) == 9
    for asset, nu, s, x_now, half in wells:
        for days in (1, 5, 20):
            gap, mean, band = dense(nu, s, x_now, half, days)
            r = got[asset, days]
            assert r.mass == pytest.approx(1) and r.gap == pytest.approx(gap, rel=1e-6)
            assert r.mean == pytest.approx(mean, abs=2e-3) and r.band == pytest.approx(band, abs=2e-3)


def test_states_and_bands_of_a_series(spark):
    rng = np.random.default_rng(2)
    start = np.datetime64("2020-01-01")
    rows = [("A", (start + k).astype(object), float(r)) for k, r in enumerate(0.01 * rng.standard_t(5, 400))] + [("short", (start + k).astype(object), 0.01 * k) for k in range(50)]
    returns = spark.createDataFrame(rows, "asset string, date date, r double")
    got = {r.horizon: r for r in quantum.propagator(returns).collect()}
    shape = quantum.well_shapes(returns).collect()
    assert sorted(got) == [1, 5, 20] and [s.asset for s in shape] == ["A"] and 2.2 <= shape[0].nu < 60
    z = np.array([r[2] for r in rows[:400]])
    z = (z - z.mean()) / z.std(ddof=1)
    m = np.convolve(z, np.ones(5), "valid") / math.sqrt(5)
    ar1 = float(np.clip(m[:-1] @ m[1:] / (m[:-1] @ m[:-1]), 0.02, 0.98))
    half = min(max(-math.log(2) / math.log(ar1), 1.5), 60)
    for days, r in got.items():
        assert (r.x_now, r.ar1, r.half_life) == pytest.approx((m[-1], ar1, half))
        _, mean, band = dense(shape[0].nu, shape[0].scale, m[-1], half, days)
        assert (r.mean, r.band) == pytest.approx((mean, band), abs=2e-3)
