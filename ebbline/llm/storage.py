"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where no checkpoint folder is set and all runs on one machine, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder given to SparkContext.setCheckpointDir; a cluster without either is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage, survives lost executors, and is computed one time."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later result is computed from."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, getattr(df, "_stored_at")
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_up_to(df: DataFrame, most_bytes: int) -> DataFrame:
    """Broadcast a table that is written already, if all its values have at most so many bytes; else leave the join to shuffle."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df
