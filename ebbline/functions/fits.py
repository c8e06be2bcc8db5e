"""Small numerical fits in numpy: distributions, bounded simplex search, seeded differential evolution."""

from __future__ import annotations

import math

import numpy as np


def nelder_mead(f, start, step=0.1, rounds=400, tol=1e-10):
    """Minimum of f near start."""
    n = len(start)
    points = np.array([start] + [np.array(start, float) + step * (abs(start[i]) + 0.1) * np.eye(n)[i] for i in range(n)], float)
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if values[-1] - values[0] < tol * (1 + abs(values[0])):
            break
        centre = points[:-1].mean(axis=0)
        tries = [centre + a * (centre - points[-1]) for a in (1.0, 2.0, 0.5, -0.5)]
        mirrored = f(tries[0])
        if mirrored < values[0]:
            far = f(tries[1])
            points[-1], values[-1] = (tries[1], far) if far < mirrored else (tries[0], mirrored)
        elif mirrored < values[-2]:
            points[-1], values[-1] = tries[0], mirrored
        else:
            inner = tries[2] if mirrored < values[-1] else tries[3]
            v = f(inner)
            if v < min(mirrored, values[-1]):
                points[-1], values[-1] = inner, v
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best])


def student_fit(x: np.ndarray, centre: float | None = None) -> tuple[float, float, float]:
    """Location (centre, if given), scale and degrees of freedom of greatest likelihood: weighted means for given nu, search over ln nu."""

    def inner(nu):
        loc, s2 = float(np.median(x)) if centre is None else centre, float(np.var(x)) * 0.6 + 1e-300
        for _ in range(60):
            w = (nu + 1) / (nu + (x - loc) ** 2 / s2)
            new = float((w * x).sum() / w.sum()) if centre is None else centre
            s2_new = float((w * (x - new) ** 2).mean()) + 1e-300
            done = abs(s2_new - s2) < 1e-10 * s2
            loc, s2 = new, s2_new
            if done:
                break
        z = (x - loc) ** 2 / s2
        like = len(x) * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2)) - (nu + 1) / 2 * np.log1p(z / nu).sum()
        return float(like), loc, math.sqrt(s2)

    a, b = math.log(1.01), math.log(200.0)
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = inner(math.exp(c))[0], inner(math.exp(d))[0]
    for _ in range(40):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = inner(math.exp(c))[0]
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = inner(math.exp(d))[0]
    nu = math.exp((a + b) / 2)
    _, loc, scale = inner(nu)
    return loc, scale, nu


def student_pdf(t: float, nu: float) -> float:
    return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + t * t / nu) ** (-(nu + 1) / 2)


def student_cdf(t: float, nu: float) -> float:
    """By the regularised incomplete beta function's continued fraction (Lentz)."""
    x, a, b = nu / (nu + t * t), nu / 2, 0.5

    def fraction(x, a, b):
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + top / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(max(1 - x, 1e-300))) if 0 < x < 1 else 0.0
    if x >= 1:
        half = 0.5
    elif x < (a + 1) / (a + b + 2):
        half = 0.5 * front * fraction(x, a, b) / a
    else:
        half = 0.5 * (1 - front * fraction(1 - x, b, a) / b)
    return half if t < 0 else 1 - half


def student_quantile(p: float, nu: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, nu) < p else (low, mid)
        if high - low < 1e-12 * (1 + abs(mid)):
            break
    return (low + high) / 2


def pareto_fit(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution by the one-parameter profile of its likelihood."""
    n, top, mean = len(excess), float(excess.max()), float(excess.mean())

    def profile(theta):
        if abs(theta) < 1e-9:
            return -n * math.log(mean) - n
        xi = float(np.log1p(-theta * excess).mean())
        if xi == 0 or -xi / theta <= 0:
            return -1e300
        return -n * math.log(-xi / theta) - n * xi - n

    grid = np.concatenate([1 / top * (1 - np.geomspace(1e-6, 1, 60)), -np.geomspace(1e-4, 20, 120) / mean])
    best = max(grid, key=profile)
    width = abs(best) * 0.2 + 1e-4 / mean
    for _ in range(60):
        around = best + width * np.linspace(-1, 1, 9)
        around = around[around < (1 - 1e-9) / top]
        best = max(around, key=profile)
        width *= 0.6
    if abs(best) < 1e-9:
        return 0.0, mean
    xi = float(np.log1p(-best * excess).mean())
    return xi, -xi / best


def garch_variances(r2: np.ndarray, omega: float, alpha: float, beta: float, seed: float) -> np.ndarray:
    out = np.empty(len(r2) + 1)
    out[0] = seed
    for i, x in enumerate(r2):
        out[i + 1] = omega + alpha * x + beta * out[i]
    return out


def garch_fit(r: np.ndarray) -> tuple[float, float, float]:
    """omega, alpha, beta of greatest normal likelihood; the seed is the sample variance, alpha + beta < 1 by construction."""
    x2 = (r - r.mean()) ** 2
    v = float(x2.mean())

    def unpack(p):
        persistence = 0.9999 / (1 + math.exp(-np.clip(p[1], -30, 30)))
        share = 1 / (1 + math.exp(-np.clip(p[2], -30, 30)))
        return v * math.exp(np.clip(p[0], -15, 3)), persistence * share, persistence * (1 - share)

    def cost(p):
        h = garch_variances(x2, *unpack(p), v)[:-1]
        return float(0.5 * (np.log(h) + x2 / h).sum())

    best, _ = nelder_mead(cost, [math.log(0.05), 3.0, -2.0], 0.3, 250)
    return unpack(best)


def simplex_box(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """Nearest weights in [low, high] that sum to one."""
    a, b = (w - high).min(), (w - low).max()
    for _ in range(100):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(w - m, low, high).sum() > 1 else (a, m)
    return np.clip(w - (a + b) / 2, low, high)


def entropy_weights(cov: np.ndarray, penalty: float, low: float, high: float) -> np.ndarray:
    """Weights of least -entropy + penalty * w' cov w, by projected gradient with halving steps."""
    n = len(cov)
    low, high = min(low, 1 / n), max(high, 1 / n)
    w = np.full(n, 1 / n)
    cost = lambda w: float((w * np.log(np.maximum(w, 1e-12))).sum() + penalty * w @ cov @ w)
    step, now = 0.1, cost(w)
    for _ in range(2000):
        new = simplex_box(w - step * (np.log(np.maximum(w, 1e-12)) + 1 + 2 * penalty * cov @ w), low, high)
        value = cost(new)
        if value > now + 1e-15:
            step /= 2
            if step < 1e-10:
                break
            continue
        if np.abs(new - w).max() < 1e-10:
            break
        w, now = new, value
    return w


def differential_evolution(f, bounds, seed: int, population: int = 40, rounds: int = 120):
    """Best of a seeded best/1/bin search."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds).T
    x = low + rng.random((population, len(low))) * (high - low)
    y = np.array([f(p) for p in x])
    for _ in range(rounds):
        best = x[int(np.argmin(y))]
        for i in range(population):
            a, b = rng.choice(population, 2, replace=False)
            trial = np.clip(best + rng.uniform(0.5, 1.0) * (x[a] - x[b]), low, high)
            trial = np.where(rng.random(len(low)) < 0.7, trial, x[i])
            v = f(trial)
            if v < y[i]:
                x[i], y[i] = trial, v
    i = int(np.argmin(y))
    return x[i], float(y[i])
