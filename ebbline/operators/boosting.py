"""Boosted trees with calibrated probabilities: out-of-fold scores over purged folds, two sigmoid parameters by Newton steps on counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.forests import boosted_scores
from ebbline.functions.linear import let
from ebbline.operators.rolling import FEATURES

ROUNDS, DEPTH, STEP, SHARE, LEAF, SEED = 150, 3, 0.05, 0.8, 10, 42
CLASSES, NEWTON_STEPS, DIGITS = 3, 25, 3
LEAST_ROWS = 50


def boosted_parts(rows: DataFrame, by: list[str], rounds: int = ROUNDS) -> DataFrame:
    """by..., i, y, scores of the rows with role "test", told by boosted trees of the group's rows with role "train". rows: by..., i, y (0, 1,
    2), role, features. A group is one part of one series; groups with fewer than 50 rows to learn from, or one class, give no rows."""
    names = list(FEATURES)
    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in by) + ", i long, y int, scores array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        y = train["y"].to_numpy()
        if len(train) < LEAST_ROWS or len(np.unique(y)) < 2:
            return test[[*by, "i", "y"]].assign(scores=None)[:0]
        scores = boosted_scores(train[names].to_numpy(float), y, test[names].to_numpy(float), rounds, DEPTH, STEP, SHARE, LEAF, SEED)
        return test[[*by, "i", "y"]].assign(scores=list(scores))

    # A given number of partitions isn't coalesced, so that each group has a task of its own.
    wide = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select(*by, F.col("i").cast("long").alias("i"), F.col("y").cast("int").alias("y"), "role", *names).repartition(wide, *by).groupBy(*by).applyInPandas(run, shape)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_parameters(scores: DataFrame, by: list[str]) -> DataFrame:
    """by..., class, slope, level of the sigmoid of greatest likelihood for each class against the rest, with Platt's smoothed targets.

    Scores to three decimals are counted first (counts add up across tasks and are as many as distinct scores, not rows); Newton's
    steps run over those counts as an array, each a sum of gradient and curvature."""
    each = scores.select(*by, "y", F.posexplode("scores").alias("class", "score")).select(*by, "class", (F.col("y") == F.col("class")).alias("hit"), F.round("score", DIGITS).alias("x"))
    counts = each.groupBy(*by, "class", "x").agg(F.count_if("hit").cast("double").alias("n1"), F.count_if(~F.col("hit")).cast("double").alias("n0"))
    whole = counts.groupBy(*by, "class").agg(F.collect_list(F.struct("x", "n1", "n0")).alias("bins"), F.sum("n1").alias("hits"), F.sum("n0").alias("others"))
    high, low = (F.col("hits") + 1) / (F.col("hits") + 2), 1 / (F.col("others") + 2)

    def sums(a: Column, b: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("ga", "gb", "haa", "hab", "hbb")])

        def more(s: Column, e: Column) -> Column:
            def at(p: Column) -> Column:
                g, h = e["n1"] * (high - p) + e["n0"] * (low - p), (e["n1"] + e["n0"]) * p * (1 - p)
                return F.struct((s["ga"] + g * e["x"]).alias("ga"), (s["gb"] + g).alias("gb"), (s["haa"] + h * e["x"] * e["x"]).alias("haa"), (s["hab"] + h * e["x"]).alias("hab"), (s["hbb"] + h).alias("hbb"))

            return let(sigmoid(a * e["x"] + b), at)

        return F.aggregate("bins", zero, more)

    def step(p: Column, _: Column) -> Column:
        def moved(s: Column) -> Column:
            haa, hbb = s["haa"] + 1e-9, s["hbb"] + 1e-9
            det = haa * hbb - s["hab"] * s["hab"]
            limited = lambda x: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), x))
            da, db = (hbb * s["ga"] - s["hab"] * s["gb"]) / det, (haa * s["gb"] - s["hab"] * s["ga"]) / det
            return F.struct((p["slope"] + limited(da)).alias("slope"), (p["level"] + limited(db)).alias("level"))

        return let(sums(p["slope"], p["level"]), moved)

    start = F.struct(F.lit(0.0).alias("slope"), F.ln((F.col("hits") + 1) / (F.col("others") + 1)).alias("level"))
    found = whole.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step))
    return found.select(*by, "class", "p.slope", "p.level")


def calibrated_probabilities(rows: DataFrame, horizon: int = 5, folds: int = 3, held_out: float = 0.2, rounds: int = ROUNDS) -> DataFrame:
    """asset, i, y, raw, calibrated (probabilities of the classes sell, wait, buy, each adding up to one) of the last held_out share of each series.

    rows: asset, i (from 0, gapless), label (-1, 0, 1), features. What is learned comes from the rows before, less the last `horizon`, whose
    labels look into the share. Those are told fold by fold by trees of the other folds, purged by the horizon; the sigmoids are fitted on
    these out-of-fold scores and applied to the scores of trees of all of them."""
    n = F.count("*").over(Window.partitionBy("asset"))
    rows = rows.withColumns({"y": F.col("label") + 1, "n": n}).withColumn("cut", F.floor(F.col("n") * (1 - held_out)))
    known, new = rows.filter(F.col("i") < F.col("cut") - horizon), rows.filter(F.col("i") >= F.col("cut"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds)))
    last, size = F.col("part") == folds, F.col("cut") - horizon
    start, stop = F.floor(F.col("part") * size / folds), F.floor((F.col("part") + 1) * size / folds)
    inside = (F.col("i") >= start) & (F.col("i") < stop)
    near = (F.col("i") >= start - horizon) & (F.col("i") < stop + horizon)
    role = F.when(last, "train").when(inside, "test").when(~near, "train")
    parts = known.withColumn("part", fold).withColumn("role", role).filter("role is not null")
    parts = parts.unionByName(new.withColumns({"part": F.lit(folds), "role": F.lit("test")}))
    told = boosted_parts(parts, ["asset", "part"], rounds)
    fitted = sigmoid_parameters(told.filter(~last), ["asset"]).groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("class", "slope", "level"))).alias("fits"))
    share = lambda values: let(values, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(v, lambda x: x / t)))
    raw = let(F.array_max("scores"), lambda m: share(F.transform("scores", lambda s: F.exp(s - m))))
    sigmoids = share(F.zip_with("scores", "fits", lambda s, f: sigmoid(f["slope"] * s + f["level"])))
    return told.filter(last).join(fitted, "asset").select("asset", "i", "y", raw.alias("raw"), sigmoids.alias("calibrated"))


def calibration_report(told: DataFrame) -> DataFrame:
    """asset, rows, log_loss and Brier score of raw and calibrated probabilities."""
    of = lambda c: F.get(F.col(c), F.col("y"))
    loss = lambda c: F.avg(-F.ln(F.greatest(of(c), F.lit(1e-15))))
    brier = lambda c: F.avg(F.aggregate(F.transform(c, lambda p, k: F.pow(p - (k == F.col("y")).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x))
    return told.groupBy("asset").agg(F.count("*").alias("rows"), loss("raw").alias("raw_loss"), loss("calibrated").alias("loss"), brier("raw").alias("raw_brier"), brier("calibrated").alias("brier"))
