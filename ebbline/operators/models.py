"""Fits per series: one task per asset gets that asset's returns, already aggregated to a row a day."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions import fits


def per_series(rows: DataFrame, fit, schema: str, column: str = "r", least: int = 50) -> DataFrame:
    """fit(array of the column by date) -> dict, for each asset with enough rows; shorter ones give no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[column].to_numpy(float)
        x = x[np.isfinite(x)]
        names = [c.split()[0] for c in schema.split(", ")]
        out = [{"asset": pdf["asset"].iloc[0], **fit(x)}] if len(x) >= least else []
        return pd.DataFrame(out, columns=names)

    return rows.select("asset", "date", column).groupBy("asset").applyInPandas(run, schema)


def student_var(returns: DataFrame, confidence: float = 0.99, min_nu: float = 2.05) -> DataFrame:
    """Student-t VaR: only nu is taken from the fit (at least min_nu), the quantile is scaled to the sample deviation."""
    alpha = 1 - confidence

    def fit(r):
        nu = fits.student_fit(r)[2]
        used, mean, sd = max(nu, min_nu), r.mean(), r.std(ddof=1)
        scale, q = sd * math.sqrt((used - 2) / used), fits.student_quantile(alpha, used)
        es = fits.student_pdf(q, used) / alpha * (used + q * q) / (used - 1)
        return {"nu": nu, "var": -(mean + scale * q), "es": -(mean - scale * es), "note": "nu clipped" if nu < min_nu else ""}

    return per_series(returns, fit, "asset string, nu double, var double, es double, note string", least=30)


def evt_var(returns: DataFrame, confidence: float = 0.99, threshold: float = 0.95) -> DataFrame:
    """Peaks over threshold: threshold and exceedances are cut in SQL, so only the tail (1 - threshold) reaches the fit."""
    losses = returns.select("asset", "date", (-F.col("r")).alias("loss"))
    cut = losses.groupBy("asset").agg(F.percentile("loss", F.lit(threshold)).alias("u"), F.count("*").alias("n")).filter("n >= 250")
    tail = losses.join(cut, "asset").filter("loss > u")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, n = float(pdf["u"].iloc[0]), int(pdf["n"].iloc[0])
        excess = pdf["loss"].to_numpy(float) - u
        names = ["asset", "exceedances", "u", "xi", "beta", "var", "es"]
        if len(excess) < 10:
            return pd.DataFrame([], columns=names)
        xi, beta = fits.pareto_fit(excess)
        ratio = (1 - confidence) * n / len(excess)
        var = u - beta * math.log(ratio) if abs(xi) < 1e-8 else u + beta / xi * (ratio**-xi - 1)
        es = var / (1 - xi) + (beta - xi * u) / (1 - xi) if xi < 1 else float("nan")
        return pd.DataFrame([[pdf["asset"].iloc[0], len(excess), u, xi, beta, var, es]], columns=names)

    return tail.groupBy("asset").applyInPandas(run, "asset string, exceedances long, u double, xi double, beta double, var double, es double")


def garch(returns: DataFrame, horizon: int = 10) -> DataFrame:
    """omega, alpha, beta, next volatility, the horizon's volatility, annual long-run volatility."""

    def fit(r):
        omega, alpha, beta = fits.garch_fit(r)
        x2 = (r - r.mean()) ** 2
        v, long_run, p = fits.garch_variances(x2, omega, alpha, beta, x2.mean())[-1], omega / (1 - alpha - beta), alpha + beta
        path = sum(long_run + p**k * (v - long_run) for k in range(horizon))
        return {"omega": omega, "alpha": alpha, "beta": beta, "next_sigma": math.sqrt(v), "horizon_sigma": math.sqrt(path), "annual_long_run": math.sqrt(long_run * 252)}

    return per_series(returns, fit, "asset string, omega double, alpha double, beta double, next_sigma double, horizon_sigma double, annual_long_run double")


def garch_filtered_var(returns: DataFrame, confidence: float = 0.99) -> DataFrame:
    def fit(r):
        x2 = (r - r.mean()) ** 2
        h = fits.garch_variances(x2, *fits.garch_fit(r), x2.mean())
        z = r / np.sqrt(h[:-1])
        q = np.quantile(z, 1 - confidence)
        return {"var": -q * math.sqrt(h[-1]), "es": -z[z <= q].mean() * math.sqrt(h[-1]), "sigma": math.sqrt(h[-1])}

    return per_series(returns, fit, "asset string, var double, es double, sigma double")


def monte_carlo_var(moments: DataFrame, means: DataFrame, weights: DataFrame, confidence: float = 0.99, horizon: int = 1, simulations: int = 100_000, nu: float | None = None, seed: int = 42, blocks: int = 16) -> DataFrame:
    """n, var, es of simulated portfolio returns; moments: asset_i, asset_j, covariance; means: asset, mean.

    Covariances are assets squared rows, which the driver factors (MOST_ASSETS at most, else an error); paths are drawn in `blocks` seeded tasks, so reruns agree."""
    spark = moments.sparkSession
    names = sorted(r["asset"] for r in weights.select("asset").limit(MOST_ASSETS + 1).collect())
    few_enough(len(names))
    at = {a: i for i, a in enumerate(names)}
    cov, mean, w = np.zeros((len(names),) * 2), np.zeros(len(names)), np.zeros(len(names))
    for r in moments.collect():
        cov[at[r["asset_i"]], at[r["asset_j"]]] = r["covariance"]
    for r in means.collect():
        mean[at[r["asset"]]] = r["mean"]
    for r in weights.collect():
        w[at[r["asset"]]] = r["weight"]
    values, vectors = np.linalg.eigh(cov)
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 1e-14)))
    each = -(-simulations // blocks)

    def draw(batches):
        for pdf in batches:
            for block in pdf["id"]:
                rng = np.random.default_rng([seed, int(block)])
                n = min(each, simulations - int(block) * each)
                z = rng.standard_normal((n, horizon, len(names))) if nu is None else rng.standard_t(nu, (n, horizon, len(names))) * math.sqrt((nu - 2) / nu)
                yield pd.DataFrame({"asset": "book", "r": ((mean + z @ root.T) @ w).sum(axis=1)})

    from ebbline.operators.risk import tail

    paths = spark.range(0, blocks, 1, blocks).mapInPandas(draw, "asset string, r double")
    return tail(paths, confidence).select("n", "var", "es")


def shrunk_covariance(returns: DataFrame) -> DataFrame:
    """asset_i, asset_j, covariance shrunk to a scaled identity (Ledoit and Wolf, 2004); sums of squares of pairs come from one aggregate."""
    from ebbline.operators.series import aligned

    a = aligned(returns)
    mean = a.groupBy("asset").agg(F.avg("r").alias("m"))
    c = a.join(F.broadcast(mean), "asset").select("date", "asset", (F.col("r") - F.col("m")).alias("x"))
    x, y = c.select("date", F.col("asset").alias("asset_i"), "x"), c.select("date", F.col("asset").alias("asset_j"), F.col("x").alias("y"))
    sums = x.join(y, "date").groupBy("asset_i", "asset_j").agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("y")).alias("s"), F.avg(F.col("x") * F.col("x") * F.col("y") * F.col("y")).alias("s4"))
    same = F.col("asset_i") == F.col("asset_j")
    size = sums.agg(F.sum(F.when(same, F.col("s"))).alias("trace"), F.count_if(same).alias("k"))
    sums = sums.join(F.broadcast(size)).withColumn("target", F.when(same, F.col("trace") / F.col("k")).otherwise(0.0))
    gap = F.col("s") - F.col("target")
    noise = sums.agg((F.sum(gap * gap) / F.max("k")).alias("spread"), (F.sum((F.col("s4") - F.col("s") * F.col("s")) / F.col("n")) / F.max("k")).alias("noise"))
    noise = noise.select(F.when(F.col("spread") > 0, F.least("noise", "spread") / F.col("spread")).otherwise(0.0).alias("shrinkage"))
    out = sums.join(F.broadcast(noise))
    return out.select("asset_i", "asset_j", ((1 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * F.col("target")).alias("covariance"), "shrinkage")


#: Assets whose matrix (18 MB) the driver holds at most.
MOST_ASSETS = 1500


def few_enough(assets: int) -> None:
    if assets > MOST_ASSETS:
        raise ValueError(f"{assets} assets: the driver factors a matrix of {MOST_ASSETS} at most")


def matrix_of(moments: DataFrame, column: str) -> tuple[list[str], np.ndarray, int]:
    few_enough(math.isqrt(moments.count()))
    rows = moments.select("asset_i", "asset_j", column, "n").collect()
    names = sorted({r["asset_i"] for r in rows})
    at = {k: i for i, k in enumerate(names)}
    m = np.zeros((len(names),) * 2)
    for r in rows:
        m[at[r["asset_i"]], at[r["asset_j"]]] = r[column]
    return names, m, rows[0]["n"]


def entropy_portfolio(returns: DataFrame, penalty: float = 2.0, periods: int = 252, low: float = 0.02, high: float = 0.60) -> DataFrame:
    """asset, weight, entropy, max_entropy, volatility.

    No more than 1 / low assets can each have the least weight, so beyond that all weights are equal; only for fewer, and never for
    more than MOST_ASSETS, does the driver see a matrix of assets squared."""
    from ebbline.operators.series import aligned, pair_moments

    rows = aligned(returns)
    count = rows.agg(F.count_distinct("asset")).first()[0]
    if count and count * low >= 1:
        daily = rows.groupBy("date").agg(F.avg("r").alias("r")).agg((F.stddev_samp("r") * math.sqrt(periods)).alias("volatility"))
        assets = rows.select("asset").distinct().withColumns({"weight": F.lit(1 / count), "entropy": F.lit(math.log(count)), "max_entropy": F.lit(math.log(count))})
        return assets.join(F.broadcast(daily))
    shape = "asset string, weight double, entropy double, max_entropy double, volatility double"
    if not count:
        return returns.sparkSession.createDataFrame([], shape)
    names, cov, _ = matrix_of(pair_moments(returns), "covariance")
    w = fits.entropy_weights(cov * periods, penalty, low, high)
    entropy, vol = float(-(w * np.log(w)).sum()), float(math.sqrt(w @ cov @ w * periods))
    return returns.sparkSession.createDataFrame([(a, float(x), entropy, math.log(len(names)), vol) for a, x in zip(names, w, strict=True)], shape)


def cycles(bars: DataFrame, top: int = 5) -> DataFrame:
    """asset, place, period (days), power_share: strongest frequencies of the detrended, Hann-weighted log price.

    The transform is a sum for each frequency, added up before it is shuffled; days times half the days of an asset."""
    w = Window.partitionBy("asset")
    rows = bars.select("asset", F.ln("price").alias("y"), (F.row_number().over(w.orderBy("date")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    rows = rows.withColumn("y", F.col("y") - F.regr_intercept("y", "i").over(w) - F.regr_slope("y", "i").over(w) * F.col("i"))
    rows = rows.withColumn("y", F.col("y") * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("i") / (F.col("n") - 1))))
    waves = rows.filter("n > 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2))))
    angle = 2 * math.pi * (F.col("k") * F.col("i") % F.col("n")) / F.col("n")
    power = waves.groupBy("asset", "k", "n").agg(F.sum(F.col("y") * F.cos(angle)).alias("c"), F.sum(F.col("y") * F.sin(angle)).alias("s"))
    power = power.withColumn("power", F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    power = power.withColumns({"power_share": F.col("power") / F.sum("power").over(w), "place": F.row_number().over(w.orderBy(F.desc("power"))).cast("long")})
    return power.filter(F.col("place") <= top).select("asset", "place", (F.col("n") / F.col("k")).alias("period"), "power_share")


def tsallis(density: DataFrame) -> DataFrame:
    """asset, q, beta of a q-Gaussian fitted to a histogram's density (asset, centre, density): at most a row a bin reaches the fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["centre"].to_numpy(float), pdf["density"].to_numpy(float)
        s = math.sqrt(max(float((y * x * x).sum() / y.sum()), 1e-12))

        def curve(p):
            q, b = 1 + 2 / (1 + math.exp(-p[0])), math.exp(p[1]) / s**2
            base = 1 + (q - 1) * b * x * x
            g = base ** (-1 / (q - 1)) if q > 1 + 1e-9 else np.exp(-b * x * x)
            return q, b, g * (y.sum() / g.sum())

        best, _ = fits.nelder_mead(lambda p: float(((curve(p)[2] - y) ** 2).sum()), [-1.0, 0.0], 0.5, 300)
        q, b, _ = curve(best)
        kind = "gaussian" if q < 1.1 else "heavy tails" if q < 5 / 3 else "very heavy tails"
        return pd.DataFrame([[pdf["asset"].iloc[0], q, b, kind]], columns=["asset", "q", "beta", "kind"])

    return density.groupBy("asset").applyInPandas(run, "asset string, q double, beta double, kind string")


#: Searches of the log-periodic fit, members and rounds of each, and bounds of end (in lengths of the series), power, frequency and phase.
ATTEMPTS, MEMBERS, SEARCH_ROUNDS = 50, 20, 30
LOG_PERIODIC = [(1.01, 1.5), (0.1, 0.9), (4, 25), (0, 2 * math.pi)]


def log_periodic(p, t: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Squared residuals and the three linear parameters at end, power, frequency and phase, by moment sums."""
    end, m, omega, phase = p
    d = np.maximum(end - t, 1e-6)
    f = d**m
    x = np.stack([np.ones(len(t)), f, f * np.cos(omega * np.log(d) + phase)])
    coef = np.linalg.lstsq(x @ x.T, x @ y, rcond=None)[0]
    return float(((y - coef @ x) ** 2).sum()), coef


def bubble(bars: DataFrame, seed: int = 7, attempts: int = ATTEMPTS) -> DataFrame:
    """Log-periodic power law: asset, tc_days, m, omega, b, r2, confidence, bubble.

    Four parameters by differential evolution, three linear ones inside. Each attempt is a search from a seed of its own and a group of its
    own, so one long series uses as many tasks as there are attempts; the least residual wins (ties: the first attempt)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.log(pdf.sort_values("date")["price"].to_numpy(float))
        n, attempt = len(y), int(pdf["attempt"].iloc[0])
        t = np.arange(n) / n
        best, rss = fits.differential_evolution(lambda p: log_periodic(p, t, y)[0], LOG_PERIODIC, seed + attempt, MEMBERS, SEARCH_ROUNDS)
        total = float(((y - y.mean()) ** 2).sum())
        return pd.DataFrame([[pdf["asset"].iloc[0], attempt, rss, n, *best, log_periodic(best, t, y)[1][1], 1 - rss / total if total > 0 else 0.0]], columns=["asset", "attempt", "rss", "n", "tc", "m", "omega", "phase", "b", "r2"])

    shape = "asset string, attempt int, rss double, n long, tc double, m double, omega double, phase double, b double, r2 double"
    dealt = bars.select("asset", "date", "price", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    wide = max(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * bars.sparkSession.sparkContext.defaultParallelism)
    tried = dealt.repartition(wide, "asset", "attempt").groupBy("asset", "attempt").applyInPandas(run, shape)
    best = tried.groupBy("asset").agg(F.min_by(F.struct("n", "tc", "m", "omega", "b", "r2"), F.struct("rss", "attempt")).alias("x")).select("asset", "x.*")
    near = F.greatest(F.lit(0.0), 1 - (F.col("tc") - 1) / 0.5)
    score = 0.35 * F.greatest("r2", F.lit(0.0)) + 0.30 * (F.col("b") < 0).cast("double") + 0.25 * near + 0.10 * F.col("omega").between(6, 13).cast("double")
    best = best.withColumn("confidence", score)
    return best.select("asset", ((F.col("tc") - 1) * F.col("n")).alias("tc_days"), "m", "omega", "b", "r2", "confidence", ((F.col("b") < 0) & (F.col("confidence") > 0.5)).alias("bubble"))


def quantum_well(returns: DataFrame, grid: int = 221) -> DataFrame:
    """Potential -ln density of a Student-t fit: asset, nu, scale, omega (well's frequency), confinement, z (last move in deviations), and the levels' gap from a finite-difference Hamiltonian."""

    def fit(r):
        _, scale, nu = fits.student_fit(r)
        nu = float(np.clip(nu, 2.2, 250))
        x = np.linspace(-8 * scale, 8 * scale, grid)
        v = (nu + 1) / 2 * np.log1p((x / scale) ** 2 / nu)
        dx = x[1] - x[0]
        h = np.diag(v + 1 / (dx / scale) ** 2) - 0.5 / (dx / scale) ** 2 * (np.eye(grid, k=1) + np.eye(grid, k=-1))
        levels = np.linalg.eigvalsh(h)[:3]
        return {"nu": nu, "scale": scale, "omega": math.sqrt((nu + 1) / nu) / scale, "confinement": float(v[-1]), "z": float(r[-1] / scale), "gap": float(levels[1] - levels[0])}

    return per_series(returns, fit, "asset string, nu double, scale double, omega double, confinement double, z double, gap double", least=120)


def backtest_engine(signals: DataFrame, capital: float = 10_000.0, cost: float = 0.0015, kelly: float = 0.25, stop: float = 0.20, threshold: float = 0.55, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """by..., date, capital, position, r: a path with a latched stop and a cost at each change. signals: by..., date, r, prediction, p_buy, p_sell;
    where they have columns `kelly` and `threshold`, those of a group's rows hold instead of the parameters."""
    own = [c for c in ("kelly", "threshold") if c in signals.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        share, limit = (float(pdf[c].iloc[0]) if c in own else given for c, given in (("kelly", kelly), ("threshold", threshold)))
        money, position, stopped, rows = capital, 0, False, []
        for r, pred, buy, sell in zip(pdf["r"], pdf["prediction"], pdf["p_buy"], pdf["p_sell"], strict=True):
            stopped = stopped or money <= capital * (1 - stop)
            position = 0 if stopped else position
            wanted = 0 if stopped else 1 if pred == 1 and buy >= limit else -1 if pred == -1 and sell >= limit else 0
            if wanted != position:
                money *= 1 - cost
                position = wanted
            gain = position * share * r
            money *= math.exp(gain)
            rows.append((money, position, gain))
        return pdf[[*by, "date"]].assign(**dict(zip(("capital", "position", "r"), zip(*rows), strict=True)))

    names = ", ".join(f"{c} {t}" for c, t in signals.dtypes if c in by)
    return signals.groupBy(*by).applyInPandas(run, f"{names}, date date, capital double, position int, r double").select(*by, "date", "capital", "position", "r")
