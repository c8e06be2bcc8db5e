import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ebbline.operators import intervals
from ebbline.sources import sinks

SHAPE = "asset string, id int, start timestamp, end timestamp"


def spans(rng, n, first):
    t0, out = dt.datetime(2024, 1, 1), []
    for k in range(n):
        a = t0 + dt.timedelta(seconds=rng.randint(0, 500_000))
        out.append((rng.choice(["a", "a", "a", "b"]), first + k, a, a + dt.timedelta(seconds=rng.choice([0, 0, 30, 60, 61, 4000, 300_000]) * rng.random())))
    return out + [("a", first + n, None, t0), (None, first + n + 1, t0, t0), ("a", first + n + 2, t0, t0 - dt.timedelta(1)), ("a", first + n + 3, t0, t0), ("a", first + n + 3, t0, t0)]


@pytest.mark.parametrize("full", [20_000, 5])
def test_every_pair_that_meets_once(spark, full):
    rng = random.Random(full)
    left, right = spans(rng, 250, 0), spans(rng, 300, 1000)
    got = intervals.overlapping(spark.createDataFrame(left, SHAPE).repartition(3), spark.createDataFrame(right, SHAPE), full_bin=full)
    got = sorted((r.left.id, r.right.id, r.to - r["from"]) for r in got.collect())
    ok = lambda x: x[0] and x[2] and x[3] and x[2] <= x[3]
    want = [(x[1], y[1], (min(x[3], y[3]) - max(x[2], y[2])) // dt.timedelta(microseconds=1)) for x in left if ok(x) for y in right if ok(y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]]
    assert got == sorted(want) and len(want) > 500
    assert intervals.overlapping(spark.createDataFrame([], SHAPE), spark.createDataFrame(right, SHAPE)).count() == 0


def test_a_batch_is_logged_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    batch = lambda *ids: spark.createDataFrame([("a", i) for i in ids], "asset string, id int")
    assert sinks.append_epoch(batch(1, 2), path, 0) and not sinks.append_epoch(batch(1, 2), path, 0)
    # A job that ends between rows and manifest leaves rows that aren't read, and its next try replaces them.
    with monkeypatch.context() as m:
        m.setattr(type(spark), "range", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sinks.append_epoch(batch(3, 4, 5), path, 1)
    assert sorted(r.id for r in sinks.read_epochs(spark, path).collect()) == [1, 2]
    assert sinks.append_epoch(batch(3, 4), path, 1)
    assert sorted((r.id, r.epoch) for r in sinks.read_epochs(spark, path).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_debates_are_logged_as_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01", 0.7, 0.2, ["x", "y"], "COMPRAR")], "asset string, ts string, bull double, bear double, vetoes array<string>, action string")
    assert sinks.append_debates(rows, f"{tmp_path}/d", 3) and not sinks.append_debates(rows, f"{tmp_path}/d", 3)
    got = sinks.read_epochs(spark, f"{tmp_path}/d").select("asset", "ts", "text", F.col("epoch")).collect()
    assert [tuple(r) for r in got] == [("a", "2024-01-01", "bull: 0.7\nbear: 0.2\nvetoes: x, y\naction: COMPRAR", 3)]
