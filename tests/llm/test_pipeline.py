import re

from pyspark.sql import functions as F

import corpus_pipeline
from ebbline.llm import mixing
from ebbline.llm.text import NOT_ALNUM
from tests.llm import brute


def test_stages_follow_each_other(spark, tmp_path):
    rows = brute.documents()
    items = [(1, rows[20][1])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("copies", "bundle", "n", "mix_id")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, [(r[0], r[1]) for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        ids = sorted({g for g in got})
        if name == "quality":
            left = [(d, t) for d, t in left if len((t or "").split()) >= 20 and "aa aa" not in (t or "")]
        elif name == "near_dedup":
            want = brute.components(left, 5)
            left = [(d, t) for d, t in dict.fromkeys(left) if d is None or want[d][1] == d]
        elif name == "decontaminate":
            bad = {(d, n) for d, n, hit, _ in brute.hits(left, items) if hit}
            left = [(d, t) for d, t in left if (d, len(brute.item_words(t))) not in bad]
        if name in ("quality", "near_dedup", "decontaminate"):
            assert got == sorted((d is None, d or 0) for d, _ in left), name
            assert docs.columns == columns
        elif name == "mix":
            assert docs.columns == columns and set(ids) <= {(d is None, d or 0) for d, _ in left}
            assert max(got.count(i) for i in ids) <= 2
        else:
            assert {"shard", "slot"} <= set(docs.columns) and docs.count() == spark.read.parquet(f"{tmp_path}/mix").count()
    assert re.split(NOT_ALNUM, "a b")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_decisions_go_back_to_rows_and_not_to_ids(spark, tmp_path):
    """Rows that share a doc_id, or have none, are judged one by one, in every stage."""
    words = lambda *w: " ".join(f"{a}{i}" for a in w for i in range(30))
    item, clean, other = words("item"), words("clean"), words("other")
    shape = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [(None, item, "en", "a"), (None, clean, "en", "a"), (None, other, "en", "b"), (5, "x " + item, "en", "a"), (5, clean, "en", "a")]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, shape), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, clean), (0, other), (5, clean)]

    # Of id 5, one text is a copy of document 1's and one is its own; of id 7, both rows are equal; no id, no decision.
    rows = [(1, clean, "en", "a"), (5, clean, "en", "a"), (5, other, "en", "a"), (7, item, "en", "a"), (7, item, "de", "a"), (9, "", "en", "a"), (9, None, "en", "a"), (8, "", "en", "a"), (None, clean, "en", "a"), (None, clean, "en", "a")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, shape), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, clean), (5, other), (7, item), (9, ""), (8, ""), (0, clean), (0, clean)])

    # Source b can be taken twice at most; without ids, a's documents must not be taken as often as b's.
    rows = [(None, words("a", f"t{i}"), "en", "a") for i in range(40)] + [(None, words("b", f"t{i}"), "en", "b") for i in range(4)] + [(3, words("c"), "en", "a")] * 2
    docs = spark.createDataFrame(rows, shape)
    want = {r.source: r.n for r in mixing.mix(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.BUDGET_PERCENT, corpus_pipeline.MAX_EPOCHS).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == want and mixed.columns == docs.columns


def test_empty_tables(spark, tmp_path):
    """Each stage, and all of them, give no rows and the columns that they give of others."""
    shape = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "shard" or out.columns == docs.columns), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
