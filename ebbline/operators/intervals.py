"""Joins of intervals with intervals where neither side is small: time bins by classes of length, hot bins split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the least class in microseconds (class c holds lengths up to BASE * 2**c), and intervals of one side that a bin holds before it is split.
BASE, FULL_BIN = 60_000_000.0, 20_000


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def leveled(rows: DataFrame, side: str, key: str, start: str, end: str) -> DataFrame:
    """The side's columns under one name, key, from and to in microseconds, and the class of its length. Intervals without an end or that end before they start go."""
    out = rows.select(F.struct("*").alias(side), F.col(key).alias("k"), micros(start).alias(f"{side}_from"), micros(end).alias(f"{side}_to"))
    out = out.filter(F.col("k").isNotNull() & (F.col(f"{side}_from") <= F.col(f"{side}_to")))
    return out.withColumn("own", F.greatest(F.ceil(F.log2((F.col(f"{side}_to") - F.col(f"{side}_from")) / BASE)), F.lit(0)).cast("int")).withColumn("own", F.coalesce("own", F.lit(0)))


def binned(rows: DataFrame, side: str, levels: DataFrame) -> DataFrame:
    """A row for each level from the interval's own class up and each bin of that level that it touches: two at most."""
    both = rows.join(F.broadcast(levels), F.col("level") >= F.col("own"))
    width = F.lit(BASE) * F.pow(F.lit(2.0), F.col("level"))
    return both.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{side}_from") / width), F.floor(F.col(f"{side}_to") / width))))


def overlapping(left: DataFrame, right: DataFrame, key: str = "asset", start: str = "start", end: str = "end", full_bin: int = FULL_BIN) -> DataFrame:
    """left, right (structs of each side's columns), from, to (of what they share, in microseconds of the epoch) of every pair of one key whose closed
    intervals meet.

    Two intervals meet in the bins of the longer one's class, where each touches two bins at most; a pair is given in the bin
    where the later of the two starts, so once. A bin with more than full_bin left intervals is split by hash and its right ones are
    copied to each part: a part's pairs are the result's. Intervals without a key, start or end meet nothing, repeated rows pair
    each, and an instant is an interval."""
    a, b = leveled(left, "left", key, start, end), leveled(right, "right", key, start, end)
    # Classes are logarithms of lengths, so there are few.
    levels = a.select("own").union(b.select("own")).distinct().withColumnRenamed("own", "level")
    a, b = binned(a, "left", levels), binned(b, "right", levels)
    parts = a.groupBy("k", "level", "bin").agg(F.ceil(F.count("*") / full_bin).cast("int").alias("parts")).filter("parts > 1")
    at = ["k", "level", "bin"]
    a = a.join(parts, at, "left").withColumn("part", F.pmod(F.xxhash64("left", "left_from"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    b = b.join(parts, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = a.withColumnRenamed("own", "left_own").join(b.withColumnRenamed("own", "right_own"), [*at, "part"])
    later, first = F.greatest("left_from", "right_from"), F.least("left_to", "right_to")
    width = F.lit(BASE) * F.pow(F.lit(2.0), F.col("level"))
    meets = (later <= first) & (F.greatest("left_own", "right_own") == F.col("level")) & (F.floor(later / width) == F.col("bin"))
    return both.filter(meets).select("left", "right", later.alias("from"), first.alias("to"))
