"""Forests for every turn of an expanding window at once, from histograms of binned features.

A turn's training rows are the turn's before and some more, so counts by (node, feature, bin, class) of all turns that share a
tree so far are prefix sums of counts by the turn that a row is new in. Turns part where their best splits differ. Bootstrap
weights are a hash of (tree, row) and a node's features one of (tree, depth, node), so they are alike in all turns and any two
runs agree. Balanced class weights differ by turn and multiply the counts.
"""

from __future__ import annotations

import numpy as np

BINS = 32
#: P(Poisson(1) <= k) for k = 0, 1, ...
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def hashed(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers from [0, 1), a function of the seed and the parts alone."""
    h = np.uint64(seed)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def bootstrap(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree."""
    return np.searchsorted(POISSON, hashed(seed, 1, tree, rows)).astype(float)


def node_features(seed: int, tree: int, depth: int, features: int, tried: int) -> np.ndarray:
    """The features that each node of a depth tries."""
    u = hashed(seed, 2, tree, depth, np.arange(2**depth)[:, None], np.arange(features)[None, :])
    return np.argsort(u, axis=1, kind="stable")[:, :tried]


def binned(x: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Bin of each value by the quantiles of reference rows (the first training window, so that no later row shapes a bin)."""
    edges = np.quantile(reference, np.arange(1, BINS) / BINS, axis=0)
    return np.stack([np.searchsorted(edges[:, f], x[:, f], side="right") for f in range(x.shape[1])], 1)


def balanced_weights(y: np.ndarray, cuts: np.ndarray, classes: int) -> np.ndarray:
    """Weights of the classes for each turn that make those present count alike."""
    seen = np.stack([np.bincount(y[:c], minlength=classes) for c in cuts]).astype(float)
    present = (seen > 0).sum(1, keepdims=True)
    return np.where(seen > 0, seen.sum(1, keepdims=True) / (present * np.maximum(seen, 1)), 0.0)


def counts_by_turn(cuts: np.ndarray, index: np.ndarray, size: int, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(turn, size) sums of weights by index over the rows before each turn's cut, as prefix sums of what is new in a turn."""
    turn = np.searchsorted(cuts, rows, side="right")
    return np.bincount(turn * size + index, weight, minlength=len(cuts) * size).reshape(len(cuts), size).cumsum(0)


def best_splits(h: np.ndarray, weights: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Of counts (turn, node, tried, bin, class): which tried feature and after which bin to split, -1 if nothing gains."""
    n = h.sum(-1).cumsum(-1)
    left = (h * weights[:, None, None, None, :]).cumsum(3)
    total = left[:, :, :, -1:, :]
    right = total - left
    purity = lambda x: (x * x).sum(-1) / np.maximum(x.sum(-1), 1e-300)
    gain = purity(left) + purity(right) - purity(total)
    gain = np.where((n >= leaf) & (n[..., -1:] - n >= leaf), gain, -1.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(-1)
    found = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-9
    return np.where(found, best // BINS, -1), np.where(found, best % BINS, 0)


def grown(x: np.ndarray, y: np.ndarray, cuts: np.ndarray, told: list[tuple[int, int]], weights: np.ndarray, tree: int, depth: int, leaf: int, seed: int) -> np.ndarray:
    """Class shares (row, class) that one tree tells; turn k learns from the rows before cuts[k] and tells those of the range told[k]."""
    n, classes = len(y), weights.shape[1]
    tried = max(1, int(np.sqrt(x.shape[1])))
    drawn = bootstrap(seed, tree, np.arange(n))
    out = np.zeros((n, classes))
    # Stretches of turns that share the tree so far, with each row's node and which nodes are leaves already.
    stretches = [(0, len(cuts), np.zeros(n, np.int64), np.zeros(1, bool))]
    for level in range(depth):
        chosen, nodes, further = node_features(seed, tree, level, x.shape[1], tried), 2**level, []
        for a, b, node, done in stretches:
            m = cuts[b - 1]
            here = node[:m]
            bins = np.take_along_axis(x[:m], chosen[here], 1)
            index = ((here[:, None] * tried + np.arange(tried)) * BINS + bins) * classes + y[:m, None]
            h = counts_by_turn(cuts[a:b], index.ravel(), nodes * tried * BINS * classes, np.repeat(drawn[:m], tried), np.repeat(np.arange(m), tried))
            which, after = best_splits(h.reshape(b - a, nodes, tried, BINS, classes), weights[a:b], leaf)
            which[:, done] = -1
            new = np.flatnonzero((which[1:] != which[:-1]).any(1) | (after[1:] != after[:-1]).any(1)) + 1
            for p, q in zip([0, *new], [*new, b - a], strict=True):
                split = which[p]
                feature = np.where(split >= 0, chosen[np.arange(nodes), np.maximum(split, 0)], 0)
                right = (split[node] >= 0) & (x[np.arange(n), feature[node]] > after[p][node])
                further.append((a + p, a + q, 2 * node + right, np.repeat(split < 0, 2)))
        stretches = further
    leaves = 2**depth
    for a, b, node, _ in stretches:
        m = cuts[b - 1]
        h = counts_by_turn(cuts[a:b], node[:m] * classes + y[:m], leaves * classes, drawn[:m], np.arange(m)).reshape(b - a, leaves, classes) * weights[a:b, None, :]
        share = h / np.maximum(h.sum(-1, keepdims=True), 1e-300)
        for k in range(a, b):
            rows = slice(*told[k])
            out[rows] = share[k - a, node[rows]]
    return out


def expanding_votes(x: np.ndarray, y: np.ndarray, trees: list[int], first: int, step: int, purge: int, depth: int, leaf: int, seed: int, classes: int = 3, least: int = 50) -> np.ndarray:
    """Sums over the trees of class shares (row, class). x: features by row in order of time; rows [t, t + step) are told by what was
    learned before t - purge; rows before `first`, and turns with fewer than `least` rows or one class, have zeros."""
    out = np.zeros((len(y), classes))
    starts = np.arange(first, len(y), step)
    cuts = np.maximum(1, starts - purge)
    usable = [k for k, c in enumerate(cuts) if c >= least and len(set(y[:c])) > 1]
    if not usable:
        return out
    cuts = cuts[usable]
    told = [(starts[k], min(starts[k] + step, len(y))) for k in usable]
    bins, weights = binned(x, x[: max(1, first - purge)]), balanced_weights(y, cuts, classes)
    for tree in trees:
        out += grown(bins, y, cuts, told, weights, tree, depth, leaf, seed)
    return out


def grown_on_gradients(bins: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, depth: int, leaf: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A tree of Newton steps: (feature, last bin to the left) by node of each depth, feature -1 for a leaf; values of the last depth's nodes."""
    n, features = bins.shape
    node, done, splits = np.zeros(n, np.int64), np.zeros(1, bool), []
    x = bins[used]
    for level in range(depth):
        nodes = 2**level
        index = (node[used][:, None] * features + np.arange(features)) * BINS + x
        count = lambda w: np.bincount(index.ravel(), None if w is None else np.repeat(w[used], features), minlength=nodes * features * BINS).reshape(nodes, features, BINS).cumsum(-1)  # noqa: E731, B023
        k, a, b = count(None), count(g), count(h)
        score = lambda a, b: a * a / (b + 1e-12)
        gain = score(a, b) + score(a[..., -1:] - a, b[..., -1:] - b) - score(a[..., -1:], b[..., -1:])
        gain = np.where((k >= leaf) & (k[..., -1:] - k >= leaf), gain, -1.0).reshape(nodes, -1)
        best = gain.argmax(1)
        feature = np.where((gain[np.arange(nodes), best] > 1e-9) & ~done, best // BINS, -1)
        splits.append((feature, best % BINS))
        node, done = routed(bins, node, feature, best % BINS), np.repeat(feature < 0, 2)
    total = lambda w: np.bincount(node[used], w[used], minlength=2**depth)
    return splits, total(g) / (total(h) + 1e-12)


def routed(bins: np.ndarray, node: np.ndarray, feature: np.ndarray, last: np.ndarray) -> np.ndarray:
    f = feature[node]
    return 2 * node + ((f >= 0) & (bins[np.arange(len(node)), np.maximum(f, 0)] > last[node]))


def boosted_scores(x: np.ndarray, y: np.ndarray, told: np.ndarray, rounds: int, depth: int, step: float, share: float, leaf: int, seed: int, classes: int = 3) -> np.ndarray:
    """Scores (row of told, class) of boosted trees, one a round and class, for the softmax of scores; x, y: rows to learn from. Each round
    uses a share of the rows that a hash draws."""
    bins, other = binned(x, x), binned(told, x)
    prior = np.log((np.bincount(y, minlength=classes) + 1e-9) / len(y))
    scores, out = np.tile(prior, (len(y), 1)), np.tile(prior, (len(told), 1))
    for r in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        used = np.flatnonzero(hashed(seed, 3, r, np.arange(len(y))) < share)
        for c in range(classes):
            g, h = (y == c) - p[:, c], p[:, c] * (1 - p[:, c])
            splits, values = grown_on_gradients(bins, g, h, used, depth, leaf)
            for rows, to in ((bins, scores), (other, out)):
                node = np.zeros(len(rows), np.int64)
                for feature, last in splits:
                    node = routed(rows, node, feature, last)
                to[:, c] += step * values[node]
    return out
