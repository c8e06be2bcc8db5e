"""Walk-forward classification: forests for all turns at once, and models of pyspark.ml."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.forests import expanding_votes
from ebbline.operators.models import backtest_engine
from ebbline.operators.rolling import FEATURES, features, triple_barrier

SEED = 42


def labelled(bars: DataFrame, horizon: int = 5, limit: float = 0.01) -> DataFrame:
    """asset, date, i (from 0), r, features and label -1, 0, 1; rows with a missing feature go."""
    f = features(bars)
    rows = f.join(triple_barrier(bars, horizon, limit).select("asset", "date", "label"), ["asset", "date"]).dropna(subset=list(FEATURES))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1)


def forest(trees: int = 200, depth: int = 4, leaf: int = 20) -> Pipeline:
    steps = [VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    return Pipeline(stages=[*steps, RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="balance", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=SEED)])


def balanced(rows: DataFrame) -> DataFrame:
    """y = label + 1 and a weight that makes the classes count alike."""
    n = rows.groupBy("label").agg(F.count("*").alias("k"))
    total = rows.agg(F.count("*").alias("total"), F.count_distinct("label").alias("classes"))
    return rows.join(F.broadcast(n), "label").join(F.broadcast(total)).withColumns({"balance": F.col("total") / (F.col("classes") * F.col("k")), "y": (F.col("label") + 1).cast("double")})


def walk_forward(
    rows: DataFrame, by: tuple[str, ...] = ("asset",), first: int = 252, step: int = 21, purge: Column | int = 5, trees: int = 200, depth: int = 4, leaf: int = 20, blocks: int = 20
) -> DataFrame:
    """by..., date, r, prediction, p_buy, p_sell of all rows: those of [t, t + step) are told by a forest that learned from the rows
    of their series before t - purge; rows before `first`, and turns that have too little to learn from, have zeros.

    rows: by..., date, i (from 0, gapless), r, features, label. A series is given to `blocks` groups, each of which grows its share of the
    trees for all turns in one pass per depth; the shares that trees tell are added up by row. A group holds one series."""
    names = list(FEATURES)
    shape = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by) + ", i long, told array<double>"
    purge = F.lit(purge) if isinstance(purge, int) else purge
    dealt = rows.select(*by, F.col("i").cast("long").alias("i"), (F.col("label") + 1).cast("int").alias("y"), purge.cast("int").alias("purge"), *names, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        mine = list(range(int(pdf["block"].iloc[0]), trees, blocks))
        votes = expanding_votes(pdf[names].to_numpy(float), pdf["y"].to_numpy(), mine, first, step, int(pdf["purge"].iloc[0]), depth, leaf, SEED)
        return pdf[[*by, "i"]].assign(told=list(votes / trees))

    # A given number of partitions isn't coalesced: the rows are few, but each group is work for a task of its own.
    wide = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    votes = dealt.repartition(wide, *by, "block").groupBy(*by, "block").applyInPandas(grow, shape)
    each = [F.sum(F.col("told")[k]).alias(f"p{k}") for k in range(3)]
    told = votes.groupBy(*by, "i").agg(*each)
    best = F.when(F.col("p0") + F.col("p1") + F.col("p2") <= 0, 0).when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), -1).when(F.col("p1") >= F.col("p2"), 0).otherwise(1)
    return rows.select(*by, "i", "date", "r").join(told, [*by, "i"]).select(*by, "date", "r", best.alias("prediction"), F.col("p2").alias("p_buy"), F.col("p0").alias("p_sell"))


def latest_prediction(rows: DataFrame, latest: DataFrame, model: Pipeline | None = None) -> DataFrame:
    """asset, action, probability, confidence of each asset's latest features, told by a model of all labelled rows.
    latest: the features of one row per asset; missing ones count as 0."""
    told = (model or forest()).fit(balanced(rows)).transform(latest.fillna(0.0, list(FEATURES)))
    p = F.element_at(vector_to_array("probability"), (F.col("prediction") + 1).cast("int"))
    action = F.element_at(F.array(F.lit("VENDER"), F.lit("ESPERAR"), F.lit("COMPRAR")), (F.col("prediction") + 1).cast("int"))
    return told.select("asset", action.alias("action"), F.round(p, 3).alias("probability"), F.when(p > 0.65, "ALTA").when(p > 0.55, "MEDIA").otherwise("BAJA").alias("confidence"))


def importance(rows: DataFrame) -> DataFrame:
    model = forest().fit(balanced(rows))
    values = model.stages[-1].featureImportances.toArray()
    return rows.sparkSession.createDataFrame(sorted(((k, float(v)) for k, v in zip(FEATURES, values, strict=True)), key=lambda x: -x[1]), "feature string, importance double")


#: The reference grid of a walk-forward's parameters: least confidence, label horizon, share of the Kelly stake.
THRESHOLDS, HORIZONS, KELLY = (0.52, 0.55, 0.60), (3, 5, 10), (0.15, 0.25)


def model_grid(bars: DataFrame, limit: float = 0.01, thresholds: tuple[float, ...] = THRESHOLDS, horizons: tuple[int, ...] = HORIZONS, kelly: tuple[float, ...] = KELLY, **growth) -> DataFrame:
    """asset, t (from 0), trial, pnl: what each configuration of a walk-forward earns a day. A label horizon is one walk (purged by
    that horizon); confidence and stake only change what is traded on it. Days that a configuration hasn't count as 0."""
    rows = reduce(DataFrame.unionByName, [labelled(bars, h, limit).withColumn("horizon", F.lit(h)) for h in horizons])
    told = walk_forward(rows, ("asset", "horizon"), purge=F.col("horizon"), **growth)
    trials = [(k, u, h, s) for k, (u, h, s) in enumerate((u, h, s) for u in thresholds for h in horizons for s in kelly)]
    each = F.array(*[F.struct(F.lit(k).alias("trial"), F.lit(u).alias("threshold"), F.lit(h).alias("of"), F.lit(s).alias("kelly")) for k, u, h, s in trials])
    signals = told.select("*", F.inline(F.filter(each, lambda x: x["of"] == F.col("horizon"))))
    traded = backtest_engine(signals, by=("asset", "trial")).select("asset", "trial", "date", F.col("r").alias("pnl"))
    days = traded.filter("trial = 0").select("asset", "date", (F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1).alias("t"))
    full = days.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(trials) - 1))))
    return full.join(traded, ["asset", "trial", "date"], "left").select("asset", "t", "trial", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))
