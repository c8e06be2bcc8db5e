"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.storage import materialize
from ebbline.llm.text import WORD

SEED = "mix-1"
#: Hash ranges that a source's documents are counted in; only the range where the fraction ends is sorted.
RANGES = 4096


def cyclic_weights(weights: list[int]) -> Column:
    """Weights for sources by code point (null last), repeating; over columns of the source table."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    return F.get(F.array(*map(F.lit, weights)), (rank - 1) % len(weights)).cast("long")


def water_fill(sources: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """Adds target to a table of source, source_size, weight.

    A source is full if its cap (max_epochs * size) is at most its share by weight of what the others leave. In the
    order of cap per weight the full ones come first, so running sums tell each source's level; no rounds are needed.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("cap", (F.col("source_size") * max_epochs).cast("long"))
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "budget": budget,
        "left_caps": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    rows = rows.withColumn("level", (F.col("budget") - F.col("left_caps")) / F.col("left_weight"))
    rows = rows.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    rows = rows.withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight"))
    return rows.withColumn("target", target).drop("cap", "budget", "left_caps", "left_weight", "level", "full", "open_level")


def mix(docs: DataFrame, weights: list[int], budget_percent: int = 150, max_epochs: int = 2, seed: str = SEED, ranges: int = RANGES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target (words of its source), copies, taken; and the columns to keep.

    Every document is taken floor(target / source_size) times; then whole documents in the order of a seeded hash, as
    long as that brings the source nearer to its target (half a document is the most that it misses by). The hash is of the id alone, so reruns agree. Null texts have size 0;
    a null source is a source of its own; a null id counts as one id; repeated rows are each a document. Size 0: all
    copies are of nothing, and go along with the hash order. Needs doc_id, text, source; other columns are ignored.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *keep)
    docs = docs.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    digits = len(f"{ranges - 1:x}")
    docs = docs.withColumn("range", F.conv(F.substring("draw", 1, digits), 16, 10).cast("long"))
    docs = materialize(docs, "sizes")

    per_range = materialize(docs.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    sources = per_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    sources = sources.withColumn("weight", cyclic_weights(weights))
    budget = F.sum("source_size").over(Window.partitionBy()) * budget_percent / 100
    sources = water_fill(sources, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", F.least(whole, F.lit(max_epochs).cast("long")))
    sources = materialize(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = per_range.withColumn("earlier", F.coalesce(F.sum("range_size").over(in_order), F.lit(0)))
    cut = cut.withColumnRenamed("source", "cut_source").join(sources.withColumnRenamed("source", "cut_source2"), F.col("cut_source").eqNullSafe(F.col("cut_source2"))).drop("cut_source2")
    cut = materialize(cut.withColumnRenamed("range", "cut_range"), "cuts")
    docs = docs.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("range") == F.col("cut_range")))
    inside = F.col("earlier") + F.col("range_size") <= F.col("rest")
    edge = ~inside & (F.col("earlier") < F.col("rest"))
    # Only the range in which a source's fraction ends is put in order: 1 in `ranges` of its documents.
    sure = docs.filter(~edge).withColumn("extra", inside.cast("long"))
    running = Window.partitionBy("source").orderBy("draw", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("earlier") + F.sum("size").over(running) - F.col("size") / 2
    drawn = docs.filter(edge).withColumn("extra", (middle < F.col("rest")).cast("long"))
    out = sure.unionByName(drawn).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
