import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ebbline.llm import queries, toxicity

SHAPE = "doc_id long, text string"
BAD = {"en": ["idiot", "schnoodle", "grobnik"], "xx": ["lowvara", "lowvaro", "lowvarix", "lowvarum"]}


def texts(rng, n):
    """Invented words; one in five documents has bad ones of its language."""
    plain = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for d in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            bad = BAD[rng.choice(["en", "xx"])]
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", ","]))
        docs.append((d, " ".join(words)))
        labels.append((d, toxic))
    return docs, labels


def test_held_out_documents_and_hidden_labels(spark, tmp_path):
    rng = random.Random(1)
    docs, labels = texts(rng, 900)
    odd = [(None, "a b"), (5000, None), (5001, ""), (5002, "x " * 50_000), (3, docs[3][1]), (3, docs[3][1])]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    results = []
    for flipped in (False, True):
        # Labels of held-out rows and columns that aren't inputs must not matter.
        known = [(d, 1 - t if flipped and held(d) else t) for d, t in labels] + [(None, 1), (7000, None), (5000, None)]
        folder = f"{tmp_path}/{flipped}"
        wide = spark.createDataFrame(docs + odd, SHAPE).withColumns({c: F.lit("x" if not flipped else "y") for c in ("lang", "source", "toxic", "fold", "features", "raw", "step", "label")})
        wide.repartition(3, F.col("doc_id") * 7).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(known, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        results.append(sorted(map(tuple, queries.op11_toxicity(spark, folder).collect()), key=str))
    assert results[0] == results[1] and len(results[0]) == len(docs) + len(odd)
    truth = dict(labels)
    wrong, total = 0, 0
    for doc, held_out, score, predicted in results[0]:
        assert 0 <= score <= 1 and predicted == int(score >= 0.5) and held_out == (doc is not None and held(doc))
        if held_out and doc in truth:
            wrong, total = wrong + (predicted != truth[doc]), total + 1
    assert total > 100 and wrong / total < 0.03
    by_id = {r[0]: r[2] for r in results[0]}
    assert by_id[5000] == by_id[5001] < 0.5 and by_id[None] < 0.5


def test_features():
    make = toxicity.Featurizer({"grobnik": 3.0}, {"lowva": 2.0})
    at = lambda text: dict(zip(toxicity.NAMES, make.features(text), strict=True))
    assert len(make.features("")) == len(toxicity.NAMES) and all(math.isfinite(x) for x in make.features(""))
    x = at("You are a GROBNIK, grobnik! lowvarant")
    assert x["word_density"] == pytest.approx(6 / 6) and x["word_hits"] == pytest.approx(math.log(3)) and x["stem_density"] == pytest.approx(2 / 6)
    assert x["nearest_you"] == pytest.approx(1 / 4) and x["hits_near_you"] == pytest.approx(2 / 6) and x["shouted"] == pytest.approx(1 / 6)
    assert at("gr0bnik x")["hidden_hits"] == 0.5 and at("g.r.o.b.n.i.k x")["hidden_hits"] == 0.5 and at("grooobnik x")["hidden_hits"] == 0.5
    assert at("robnik x")["word_hits"] == 0 and at("a1 2b x9y")["hidden_hits"] == 0 and at("a1 2b x9y")["obfuscated"] == pytest.approx(1 / 3)


def test_tables_without_enough_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "you")], SHAPE)
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(False)).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.5, 1)] * 3
    clean = toxicity.toxicity(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"), F.lit(False)).collect()
    assert len(clean) == 3 and all(r.score < 0.5 and r.predicted == 0 for r in clean)
    assert toxicity.toxicity(spark.createDataFrame([], SHAPE), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), F.lit(False)).count() == 0
