import math

import numpy as np
import pytest

from ebbline.functions import forests
from ebbline.operators import boosting
from ebbline.operators.rolling import FEATURES


def noisy(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES)))
    return x, np.digitize(x[:, 0] + 1.5 * rng.normal(size=n), [-1.0, 1.0])


@pytest.fixture(scope="module")
def told(spark):
    x, y = noisy(700)
    columns = "asset string, i int, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = [("A", k, int(y[k]) - 1, *map(float, x[k])) for k in range(700)] + [("short", k, 0, *map(float, x[k])) for k in range(30)]
    return boosting.calibrated_probabilities(spark.createDataFrame(rows, columns).repartition(4), rounds=60), x, y


def test_probabilities_of_held_out_rows(told):
    df, x, y = told
    got = {r.i: r for r in df.collect()}
    assert sorted(got) == list(range(560, 700))
    for i, r in got.items():
        assert r.y == y[i] and sum(r.raw) == pytest.approx(1) and sum(r.calibrated) == pytest.approx(1)
    scores = forests.boosted_scores(x[:555], y[:555], x[560:], 60, boosting.DEPTH, boosting.STEP, boosting.SHARE, boosting.LEAF, boosting.SEED)
    p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    assert np.allclose([got[i].raw for i in range(560, 700)], p)


def test_calibration_mends_too_sure_trees(told):
    report = boosting.calibration_report(told[0]).first()
    assert report.rows == 140 and report.loss < report.raw_loss and report.brier < report.raw_brier


def test_sigmoids_are_of_greatest_likelihood(spark):
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(400, 3)), 3)
    y = np.array([int(rng.random() < 1 / (1 + math.exp(-2 * s[1] + 0.5))) for s in scores])
    df = spark.createDataFrame([("A", int(c), list(map(float, s))) for s, c in zip(scores, y, strict=True)], "asset string, y int, scores array<double>").repartition(3)
    got = {r["class"]: (r.slope, r.level) for r in boosting.sigmoid_parameters(df, ["asset"]).collect()}
    for c, (a, b) in got.items():
        hit = y == c
        target = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
        p = 1 / (1 + np.exp(-(a * scores[:, c] + b)))
        assert abs((target - p).sum()) < 1e-6 and abs(((target - p) * scores[:, c]).sum()) < 1e-6
    assert got[1][0] == pytest.approx(2, abs=0.5)


def test_trees_learn_a_rule():
    x, _ = noisy(600, 3)
    y = np.digitize(x[:, 2], [-0.5, 0.5])
    scores = forests.boosted_scores(x[:400], y[:400], x[400:], 40, 3, 0.2, 0.8, 10, 1)
    assert (scores.argmax(1) == y[400:]).mean() > 0.9
