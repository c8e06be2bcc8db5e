import math

import numpy as np
import pytest

from ebbline.functions import fits
from ebbline.operators import models
from ebbline.operators.diagnostics import expected_max_sharpe


def test_student_distribution_matches_known_values():
    assert fits.student_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert fits.student_cdf(0.0, 5) == pytest.approx(0.5)
    assert fits.student_cdf(2.015048373, 5) == pytest.approx(0.95, abs=1e-7)
    assert fits.student_pdf(0.0, 1) == pytest.approx(1 / math.pi)


def test_student_fit_finds_degrees_of_freedom():
    x = np.random.default_rng(1).standard_t(4, 20_000) * 0.01
    loc, scale, nu = fits.student_fit(x)
    assert nu == pytest.approx(4, rel=0.1)
    assert scale == pytest.approx(0.01, rel=0.05)
    assert abs(loc) < 5e-4


def test_pareto_fit_recovers_shape():
    rng = np.random.default_rng(2)
    xi, beta = 0.3, 0.02
    x = beta / xi * (rng.random(20_000) ** -xi - 1)
    got = fits.pareto_fit(x)
    assert got[0] == pytest.approx(xi, abs=0.05)
    assert got[1] == pytest.approx(beta, rel=0.06)


def test_garch_fit_recovers_persistence():
    rng = np.random.default_rng(3)
    omega, alpha, beta, h, r = 1e-6, 0.08, 0.90, 5e-5, []
    for z in rng.standard_normal(6000):
        r.append(math.sqrt(h) * z)
        h = omega + alpha * r[-1] ** 2 + beta * h
    got = fits.garch_fit(np.array(r))
    assert got[1] + got[2] == pytest.approx(0.98, abs=0.03)
    assert got[1] == pytest.approx(alpha, abs=0.04)


def test_entropy_weights_are_feasible_and_equal_without_risk():
    w = fits.entropy_weights(np.zeros((4, 4)), 1.0, 0.02, 0.6)
    assert w == pytest.approx(np.full(4, 0.25), abs=1e-6)
    risky = fits.entropy_weights(np.diag([10.0, 0.1, 0.1, 0.1]), 2.0, 0.02, 0.6)
    assert risky.sum() == pytest.approx(1) and risky[0] < 0.1 and (risky >= 0.02 - 1e-9).all()


def test_best_of_one_trial_has_no_luck():
    assert expected_max_sharpe(1) == 0
    assert expected_max_sharpe(100) > expected_max_sharpe(10) > 0


def test_log_periodic_search_finds_a_planted_bubble(spark):
    n, start = 300, np.datetime64("2020-01-01")
    t = np.arange(n) / n
    d = 1.1 - t
    y = 5 - 0.8 * d**0.5 + 0.03 * d**0.5 * np.cos(8 * np.log(d) + 1) + 0.002 * np.random.default_rng(1).normal(size=n)
    df = spark.createDataFrame([("A", (start + k).astype(object), float(np.exp(v))) for k, v in enumerate(y)], "asset string, date date, price double")
    one, many, again = (models.bubble(df, attempts=k).first() for k in (1, 6, 6))
    assert many == again and many.r2 >= one.r2 > 0.98 and many.bubble and many.b < 0
    assert many.tc_days == pytest.approx(30, abs=12)
    rss, coef = models.log_periodic((1.1, 0.5, 8.0, 1.0), t, y)
    assert rss < 0.002 and coef == pytest.approx([5, -0.8, 0.03], abs=0.01)
