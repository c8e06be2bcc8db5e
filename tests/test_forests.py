import numpy as np
import pytest

from ebbline.functions import forests
from ebbline.operators import learning
from ebbline.operators.rolling import FEATURES


def one_turn(x, y, weights, tree, depth, leaf, seed, told):
    """A tree grown on these rows alone, node by node; class shares of other rows."""
    drawn, classes = forests.bootstrap(seed, tree, np.arange(len(y))), len(weights)
    tried = int(np.sqrt(x.shape[1]))

    def counts(rows):
        return np.array([drawn[rows][y[rows] == c].sum() * weights[c] for c in range(classes)])

    def purity(v):
        return (v**2).sum() / max(v.sum(), 1e-300)

    def grow(rows, others, level, node):
        if level < depth:
            best = (1e-9, None)
            for f in forests.node_features(seed, tree, level, x.shape[1], tried)[node]:
                for b in range(forests.BINS):
                    left, right = rows[x[rows, f] <= b], rows[x[rows, f] > b]
                    if drawn[left].sum() >= leaf and drawn[right].sum() >= leaf:
                        gain = purity(counts(left)) + purity(counts(right)) - purity(counts(rows))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b))
            if best[1]:
                f, b = best[1]
                return {**grow(rows[x[rows, f] <= b], others[x[others, f] <= b], level + 1, 2 * node), **grow(rows[x[rows, f] > b], others[x[others, f] > b], level + 1, 2 * node + 1)}
        v = counts(rows)
        return {int(i): v / max(v.sum(), 1e-300) for i in others}

    return grow(np.arange(len(y)), told, 0, 0)


def series(n, seed=0, features=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features))
    return x, (x[:, 0] + 0.7 * rng.normal(size=n) > 0.5).astype(int) + (x[:, 1] > 0.8).astype(int)


def test_all_turns_at_once_equal_each_turn_alone():
    x, y = series(230)
    first, step, purge, depth, leaf = 90, 25, 5, 3, 6
    got = forests.expanding_votes(x, y, [0, 3], first, step, purge, depth, leaf, 11)
    bins = forests.binned(x, x[: first - purge])
    for t in range(first, len(y), step):
        cut, end = t - purge, min(t + step, len(y))
        weights = forests.balanced_weights(y, np.array([cut]), 3)[0]
        total = np.zeros((end - t, 3))
        for k in (0, 3):
            told = one_turn_on(bins, y, cut, t, end, weights, k, depth, leaf)
            total += np.array([told[i] for i in range(t, end)])
        assert np.allclose(got[t:end], total)
    assert not got[:first].any()


def one_turn_on(bins, y, cut, t, end, weights, tree, depth, leaf):
    """Rows before cut are learned from; rows t to end are told."""
    shown = np.vstack([bins[:cut], bins[t:end]])
    told = one_turn(shown, y[:cut], weights, tree, depth, leaf, 11, np.arange(cut, cut + end - t))
    return {i - cut + t: v for i, v in told.items()}


def test_no_row_tells_of_the_future():
    x, y = series(300, 4)
    other_x, other_y = x.copy(), y.copy()
    other_x[200:], other_y[195:] = -other_x[200:], 2 - other_y[195:]
    a, b = (forests.expanding_votes(p, q, [1], 100, 20, 5, 3, 5, 3) for p, q in ((x, y), (other_x, other_y)))
    assert np.array_equal(a[:200], b[:200]) and not np.array_equal(a[200:], b[200:])


def test_walk_forward_adds_up_its_blocks(spark):
    x, y = series(180, 7, len(FEATURES))
    columns = "asset string, date date, i int, r double, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    start = np.datetime64("2020-01-01")
    rows = [(a, (start + k).astype(object), k, 0.01, int(y[k]) - 1, *map(float, x[k])) for a in "AB" for k in range(180)]
    rows += [("short", (start + k).astype(object), k, 0.01, 0, *map(float, x[k])) for k in range(70)]
    df = spark.createDataFrame(rows, columns).repartition(5)
    got = {(r.asset, r.date): r for r in learning.walk_forward(df, first=60, trees=6, blocks=4, leaf=5).collect()}
    want = forests.expanding_votes(x, y, list(range(6)), 60, 21, 5, 4, 5, learning.SEED) / 6
    assert len(got) == len(rows)
    for k in range(180):
        for a in "AB":
            r = got[a, (start + k).astype(object)]
            assert (r.p_sell, r.p_buy) == pytest.approx((want[k, 0], want[k, 2]))
            assert r.prediction == (int(want[k].argmax()) - 1 if k >= 60 else 0)
    assert all(r.prediction == 0 and r.p_buy == 0 for (a, _), r in got.items() if a == "short")


def test_a_learnable_rule_is_learned():
    x, y = series(700, 9)
    votes = forests.expanding_votes(x, y, list(range(20)), 252, 21, 5, 4, 20, 42)
    assert (votes[252:].argmax(1) == y[252:]).mean() > 0.7
    assert np.allclose(votes[252:].sum(1), 20)
