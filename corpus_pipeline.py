"""A corpus pipeline of five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.decontaminate import contamination
from ebbline.llm.minhash import near_duplicates
from ebbline.llm.mixing import mix
from ebbline.llm.quality import quality_filter
from ebbline.llm.sharding import shard_documents
from ebbline.llm.storage import broadcast_up_to, materialize

#: Weights of sources in order of their names, repeating; words of the mix in percent of all words; epochs at most.
WEIGHTS, BUDGET_PERCENT, MAX_EPOCHS = [3, 1, 2], 150, 2
SHARDS = 16


#: Bytes (as JSON) of row ids that are broadcast to their rows; more are shuffled with them.
BROADCAST_IDS = 32 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with a row id in __row (a column of that name is replaced), so that a decision goes back to its row and not to
    all rows of one doc_id (or of none). Rows of a plain read of files have the same ids each time; others are written first."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    read = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return rows if read else materialize(rows, "rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule lets pass; null and empty texts don't, repeated rows are judged each."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (similarity 0.8 or more) one with the least doc_id, of equal rows one; rows without a doc_id stay."""
    rows = numbered(docs)
    named = rows.filter("doc_id is not null")
    found = near_duplicates(named.select(F.col("__row").alias("doc_id"), "text"), shingle=5, percent=80).withColumnRenamed("doc_id", "__row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = found.join(named.select("__row", "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2")), "__row")
    # Texts without a word link with nothing: there only rows of one doc_id and text are copies of each other.
    alone = lambda c: F.when(F.col("n_shingles") == 0, F.col(c)).alias(f"own_{c}")
    groups = found.groupBy(F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"), alone("doc_id"), alone("h1"), alone("h2"))
    kept = materialize(groups.agg(F.min(F.struct("doc_id", "h1", "h2", "__row")).alias("least")).select("least.__row"), "kept")
    return named.join(broadcast_up_to(kept, BROADCAST_IDS), "__row", "left_semi").unionByName(rows.filter("doc_id is null")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words (or all, if fewer) of a benchmark item. Rows are judged one by one, also
    those that repeat or have no doc_id; null texts have no words and stay; without benchmark items all stay."""
    rows = numbered(docs)
    found = contamination(rows.select(F.col("__row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = materialize(found.filter("contaminated").select(F.col("doc_id").alias("__row")), "contaminated")
    return rows.join(broadcast_up_to(bad, BROADCAST_IDS), "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; null and empty texts have no words, so that
    copies of them add nothing; rows that repeat or have no doc_id are taken each by itself, in a fixed order."""
    rows = numbered(docs)
    copies = mix(rows, WEIGHTS, BUDGET_PERCENT, MAX_EPOCHS, keep=["__row"]).filter("copies > 0")
    copies = materialize(copies.select("__row", F.col("copies").cast("int").alias("__copies")), "copies")
    taken = rows.join(broadcast_up_to(copies, BROADCAST_IDS), "__row")
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, tokens, shard and slot; rows of one text, null ones among them, share a shard; every row has a slot."""
    return shard_documents(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]

#: Components of near-duplicates and greedy packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
