import math

import numpy as np
import pytest

from ebbline.operators import matrices, models

SHAPE = "asset string, date date, r double"


def returns_of(x):
    start = np.datetime64("2020-01-01")
    return [(f"a{j:04}", (start + t).astype(object), float(x[t, j])) for t in range(len(x)) for j in range(x.shape[1])]


def factors(days, assets, seed=3, k=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(days, k)) @ rng.normal(size=(k, assets)) + 2 * rng.normal(size=(days, assets))


def test_cleaning_equals_a_dense_matrix(spark):
    x = factors(120, 200)
    rows = returns_of(x) + [("a0003", np.datetime64("2030-01-01").astype(object), 5.0)]
    got = matrices.cleaned_correlation(spark.createDataFrame(rows, SHAPE).repartition(5)).collect()
    c = np.corrcoef(x.T)
    values, vectors = np.linalg.eigh(c)
    limit = (1 + math.sqrt(200 / 120)) ** 2
    clean = vectors @ np.diag(np.where(values > limit, values, 0)) @ vectors.T
    d = np.sqrt(np.maximum(np.diag(clean), 1e-12))
    clean = clean / np.outer(d, d)
    np.fill_diagonal(clean, 1)
    assert len(got) == 200 * 200 and got[0].limit == pytest.approx(limit)
    assert got[0].noise_share == pytest.approx((values <= limit).mean())
    assert all(r.correlation == pytest.approx(clean[int(r.asset_i[1:]), int(r.asset_j[1:])], abs=1e-7) for r in got)


@pytest.mark.parametrize("size,limit", [(3, 0.5), (40, 2.0), (300, 1.5), (300, 1e9)])
def test_leading_values(size, limit):
    m = np.corrcoef(factors(90, size, size).T)
    values, vectors = matrices.leading(lambda q: m @ q, size, limit)
    want = np.linalg.eigvalsh(m)[::-1]
    assert values == pytest.approx(want[want > limit])
    assert np.allclose(m @ vectors, vectors * values, atol=1e-6)


def test_equal_returns_and_no_returns(spark):
    flat = matrices.cleaned_correlation(spark.createDataFrame(returns_of(np.zeros((10, 3))), SHAPE)).collect()
    assert sorted((r.asset_i, r.asset_j, r.correlation) for r in flat) == [(f"a{i:04}", f"a{j:04}", float(i == j)) for i in range(3) for j in range(3)]
    assert matrices.cleaned_correlation(spark.createDataFrame([], SHAPE)).count() == 0
    assert models.entropy_portfolio(spark.createDataFrame([], SHAPE)).count() == 0


def test_many_assets_have_equal_weights(spark):
    x = factors(40, 60) / 100
    got = models.entropy_portfolio(spark.createDataFrame(returns_of(x), SHAPE)).collect()
    assert {r.weight for r in got} == {1 / 60} and len(got) == 60
    assert got[0].volatility == pytest.approx(x.mean(1).std(ddof=1) * math.sqrt(252))
    few = models.entropy_portfolio(spark.createDataFrame(returns_of(x[:, :4]), SHAPE)).collect()
    assert sum(r.weight for r in few) == pytest.approx(1) and all(0.02 <= r.weight <= 0.6 for r in few)
    with pytest.raises(ValueError):
        models.few_enough(models.MOST_ASSETS + 1)
