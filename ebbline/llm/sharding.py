"""Sharding by vector bin packing: bytes, tokens and rows are balanced together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.llm.storage import materialize
from ebbline.llm.text import WORD

#: Groups with more than total / LARGE bytes are placed one by one: fewer than LARGE of them.
LARGE = 16_384
#: Other groups go to so many bundles by hash. So the driver places LARGE + BUNDLES rows at most, at any size of input.
BUNDLES = 8192
#: Ranges of ids that slots are counted in.
SLOT_RANGES = 1024
#: Of bytes, tokens and rows in the dot product.
IMPORTANCE = (1.0, 0.05, 0.05)


def pack(loads: np.ndarray, shards: int, importance=IMPORTANCE) -> np.ndarray:
    """Shard of each row of (bytes, tokens, rows), largest bytes first: where the dot product with the residual capacity is highest."""
    share = loads / np.maximum(loads.sum(axis=0), 1) * shards
    residual = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int64)
    for i in np.lexsort((np.arange(len(loads)), -loads[:, 0])).tolist():
        need = share[i] * importance
        shard = int(np.argmax(residual @ need))
        residual[shard] -= share[i]
        out[i] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = 16, importance=IMPORTANCE) -> DataFrame:
    """All columns of docs, and size (UTF-8 bytes and 1), tokens (words), shard, slot (gapless from 0 in each shard).

    Documents of one text are a group and share a shard. Law: bytes, near equal as far as groups allow: the last unit
    placed is the least one, so shards differ by about one small group, or by one bundle where there are more groups
    than LARGE (1 / BUNDLES of all bytes on average, 0.2 % of one of 16 shards); a group above a shard's share is a
    shard's excess. Null texts have size 1 and count as empty. Slots follow doc_id (nulls first) within ranges of its
    hash; repeated rows get slots of their own. Columns of docs with the names of the new ones are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.lit(1), text).alias("g"),
    )
    groups = rows.groupBy("h", "g").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = materialize(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = F.col("bytes") * LARGE > total
    bundle = F.pmod("h", F.lit(BUNDLES))
    units = groups.filter(alone).select("h", "g", "bytes", "tokens", "rows").withColumn("bundle", F.lit(-1).cast("long"))
    units = units.unionByName(groups.filter(~alone).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).withColumns({"h": F.lit(0).cast("long"), "g": F.lit(0).cast("long")}))
    placed = units.orderBy("bundle", "h", "g").toPandas()
    placed["shard"] = pack(placed[["bytes", "tokens", "rows"]].to_numpy(float), shards, np.array(importance)) if len(placed) else []
    spark: SparkSession = docs.sparkSession
    plan = materialize(spark.createDataFrame(placed[["h", "g", "bundle", "shard"]].astype("int64"), "h long, g long, bundle long, shard long"), "plan")
    large = plan.filter("bundle < 0").select("h", "g", F.col("shard").alias("large_shard"))
    small = plan.filter("bundle >= 0").select("bundle", F.col("shard").alias("bundle_shard"))
    rows = rows.join(F.broadcast(large), ["h", "g"], "left").withColumn("bundle", bundle)
    rows = rows.join(F.broadcast(small), "bundle", "left").withColumn("shard", F.coalesce("large_shard", "bundle_shard").cast("int"))
    rows = rows.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(SLOT_RANGES)))
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")
    offsets = materialize(counts.select("shard", "range", offset.alias("offset")), "offsets")
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("id", "h", "size"))
    rows = rows.withColumn("n", within).join(F.broadcast(offsets), ["shard", "range"])
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "tokens", "shard", "slot")]
    return rows.select(*kept, "size", "tokens", "shard", (F.col("offset") + F.col("n") - 1).alias("slot"))
