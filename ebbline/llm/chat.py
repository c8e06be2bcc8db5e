"""Chat formatting by cumulative-snapshot collapse, with DataFrame functions only.

A log often holds each state of a growing conversation as a conversation of its own. Rolling hashes of turn prefixes
tell which conversations are a prefix of a longer one; an anti-join leaves the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.storage import materialize

#: Turn numbers of one chunk; positions and hashes are added up by chunk first, so that a long conversation is many groups.
CHUNK = 1024


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in ChatML; a mark inside a text is broken up, so that it can't end its turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.replace(text, F.lit("<|im_"), F.lit("<| im_")), F.lit("<|im_end|>\n"))


def prefixed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text, and a, b: rolling hashes of all turns up to this one."""
    turns = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**40))))
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("oc"), F.col("chunk").alias("ok"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    same = lambda c, k: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("chunk") == F.col(k))
    placed = turns.withColumn("n", F.row_number().over(in_chunk)).join(offsets, same("oc", "ok")).withColumn("pos", F.col("n") + F.col("offset"))
    placed = placed.select("conv_id", "chunk", "pos", "role", "text", F.xxhash64("pos", "role", "text").alias("a1"), F.xxhash64(F.lit(1), "pos", "role", "text").alias("b1"))
    # A position is part of each hash, so exclusive or tells orders apart.
    sums = placed.groupBy("conv_id", "chunk").agg(F.bit_xor("a1").alias("a"), F.bit_xor("b1").alias("b"))
    before = sums.select(F.col("conv_id").alias("bc"), F.col("chunk").alias("bk"), *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ab"])
    running = Window.partitionBy("conv_id", "chunk").orderBy("pos")
    rolled = placed.withColumns({"ra": F.bit_xor("a1").over(running), "rb": F.bit_xor("b1").over(running)}).join(before, same("bc", "bk"))
    return rolled.select("conv_id", "pos", "role", "text", F.col("ra").bitwiseXOR(F.col("a0")).alias("a"), F.col("rb").bitwiseXOR(F.col("b0")).alias("b"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered.

    Turns stand in the order of turn (nulls first), then role and text. A conversation goes if another has all its
    turns and more after them; of equal ones the least conv_id stays and n_copies counts them. Null roles and texts
    are empty; turns with a null conv_id are one conversation. Repeated rows are turns of their own. Needs conv_id,
    turn, role, text; other columns are ignored.
    """
    rolled = materialize(prefixed_turns(turns), "turns")
    convs = rolled.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max_by(F.struct("a", "b"), "pos").alias("h")).select("conv_id", "n", "h.a", "h.b")
    convs = materialize(convs, "conversations")
    ends = convs.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = rolled.join(convs.select(F.col("conv_id").alias("lc"), F.col("n").alias("length")), F.col("conv_id").eqNullSafe(F.col("lc"))).filter("pos < length")
    inner = inner.select(F.col("pos").alias("n"), "a", "b").distinct()
    kept = ends.join(inner, ["n", "a", "b"], "left_anti").select(F.col("conv_id").alias("kc"), "n", "n_copies")
    shown = rolled.join(kept, F.col("conv_id").eqNullSafe(F.col("kc")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("line")))), lambda x: x["line"])
    return shown.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.array_join(lines, "").alias("rendered"))
