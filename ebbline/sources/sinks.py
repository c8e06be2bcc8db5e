"""What leaves: trade logs, JSON payloads, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_trades(trades: DataFrame, path: str, kind: str = "parquet") -> None:
    """Appends to a log by asset; nothing written before is read or rewritten."""
    trades.write.mode("append").partitionBy("asset").format(kind).save(path)


def append_epoch(rows: DataFrame, path: str, epoch: int) -> bool:
    """Adds a batch to a log once: its rows are written below its number, replacing what a failed try left, and then its number to the
    manifest. A batch that the manifest has is left as it is, so that one repeated after a failure adds nothing. Works with foreachBatch.
    Whether rows were added."""
    spark = rows.sparkSession
    if epoch in committed(spark, path):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
    spark.range(1).selectExpr(f"CAST({epoch} AS BIGINT) AS epoch").write.mode("overwrite").parquet(f"{path}/manifest/{epoch}")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def committed(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches in a log: one small row each. A number counts when its file is whole."""
    if not exists(spark, f"{path}/manifest"):
        return set()
    return {r.epoch for r in spark.read.schema("epoch long").option("recursiveFileLookup", "true").parquet(f"{path}/manifest").collect()}


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a log with their epoch; what a failed batch left isn't read. The manifest prunes folders. No batch yet: an error of Spark's reader."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/epoch={e}" for e in sorted(committed(spark, path))])
    return rows.withColumn("epoch", F.col("epoch").cast("long"))


def append_debates(decisions: DataFrame, path: str, epoch: int) -> bool:
    """Adds the texts of decisions (asset, ts, bull, bear, vetoes, action) to a log, once for each batch number."""
    return append_epoch(decisions.select("asset", "ts").join(debate_text(decisions), "asset"), path, epoch)


def trade_summary(trades: DataFrame) -> DataFrame:
    """asset, trades, bought, sold, last. trades: asset, ts, action."""
    return trades.groupBy("asset").agg(F.count("*").alias("trades"), F.count_if(F.col("action") == "COMPRAR").alias("bought"), F.count_if(F.col("action") == "VENDER").alias("sold"), F.max("ts").alias("last"))


def last_trades(trades: DataFrame, n: int = 50) -> DataFrame:
    """The latest n of each asset."""
    place = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))
    return trades.withColumn("place", place).filter(F.col("place") <= n)


def payloads(rows: DataFrame, key: str = "asset") -> DataFrame:
    """key and body: the row as JSON."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("body"))


def debate_text(decisions: DataFrame) -> DataFrame:
    """asset, text: the reasons behind a decision, line by line."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    return decisions.select("asset", F.concat_ws("\n", line("bull", "bull"), line("bear", "bear"), F.concat(F.lit("vetoes: "), F.concat_ws(", ", "vetoes")), line("action", "action")).alias("text"))
