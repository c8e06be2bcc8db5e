import random
import time

from pyspark.sql import functions as F

from ebbline.llm import quality
from ebbline.llm.text import WORD
from tests.llm import brute


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_into_words_once(spark):
    """A pushed-down filter or a collapsed projection must not repeat the cut, least of all inside a lambda over windows."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for out in (quality.quality_filter(docs), quality.quality_report(docs), quality.quality_report(docs).filter("kept").select("doc_id")):
        assert plan_of(out).count(WORD) <= 1


def test_time_grows_with_the_bytes(spark):
    rng = random.Random(4)
    took = {}
    for n in (2_000, 2_000, 20_000):
        text = " ".join(brute.sentence(rng, 1) + str(i) for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").repartition(1).withColumn("text", F.concat("text", F.lit(" end")))
        began = time.monotonic()
        assert docs.filter(~quality.judged(F.col("text"), lambda m: quality.rejected_by(quality.RULES, m))).count() == 4
        took[n] = time.monotonic() - began
    assert took[20_000] < 5 + 30 * took[2_000]
