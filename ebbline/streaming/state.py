"""Running risk of streams of (asset, date, price): EWMA variance and drawdown as state that expires, in the RocksDB store."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHAPE = "asset string, date date, price double, next_variance double, peak double, drawdown double"
#: Last price, peak, variance (null until there are seed rows), and the returns and days that wait for the seed.
STATE = "price double, peak double, variance double, waiting array<double>, days array<date>, prices array<double>, peaks array<double>"
SEED_ROWS, DECAY = 20, 0.94


class RunningRisk(StatefulProcessor):
    """State of an asset. Its rows must come in order of date across micro-batches; within one they are sorted. The first
    SEED_ROWS returns wait until the variance can start from theirs. A timer of event time is set `idle` after the last row: when
    the watermark passes it, what still waits is told from what there is, and the state is dropped; a series that goes on later
    starts anew."""

    def __init__(self, idle: dt.timedelta, decay: float = DECAY, seed_rows: int = SEED_ROWS) -> None:
        self.idle, self.decay, self.seed_rows = int(idle.total_seconds() * 1000), decay, seed_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("risk", STATE)

    def told(self, asset: str, waiting: list, days: list, prices: list, peaks: list, variance: float | None) -> tuple[list, float | None]:
        """Rows of what waits, and the variance after them."""
        if variance is None:
            n = len(waiting[: self.seed_rows])
            mean = sum(waiting[:n]) / n
            variance = sum((r - mean) ** 2 for r in waiting[:n]) / (n - 1) if n > 1 else float("nan")
        rows = []
        for r, day, price, peak in zip(waiting, days, prices, peaks, strict=True):
            variance = self.decay * variance + (1 - self.decay) * r * r
            rows.append((asset, day, price, variance, peak, (price - peak) / peak))
        return rows, variance

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, peak, variance, *held = self.state.get() if self.state.exists() else (None, None, None, [], [], [], [])
        waiting, days, prices, peaks = map(list, held)
        new = pd.concat(list(rows)).sort_values("date")
        for day, price in zip(new["date"], new["price"], strict=True):
            peak = price if peak is None else max(peak, price)
            if last is not None:
                waiting.append(math.log(price / last))
                days.append(day)
                prices.append(price)
                peaks.append(peak)
            last = price
        out = []
        if waiting and (variance is not None or len(waiting) >= self.seed_rows):
            out, variance = self.told(key[0], waiting, days, prices, peaks, variance)
            waiting, days, prices, peaks = [], [], [], []
        self.state.update((last, peak, variance, waiting, days, prices, peaks))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(new["ts"].max().timestamp() * 1000) + self.idle)
        yield pd.DataFrame(out, columns=SHAPE_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            last, peak, variance, *held = self.state.get()
            waiting = list(held[0])
            if waiting:
                out, variance = self.told(key[0], *map(list, held), variance)
            self.state.clear()
        yield pd.DataFrame(out, columns=SHAPE_NAMES)

    def close(self) -> None:
        pass


SHAPE_NAMES = [c.split()[0] for c in SHAPE.split(", ")]


def running_risk(bars: DataFrame, idle: dt.timedelta = dt.timedelta(days=90), late: str = "7 days") -> DataFrame:
    """asset, date, price, next_variance, peak, drawdown of a stream of bars (asset, date, price); rows later than `late` are dropped by Spark."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = bars.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("asset").transformWithStateInPandas(RunningRisk(idle), SHAPE, "Append", "EventTime")


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that the stream's source has now, appended to parquet; run again with the same checkpoint it adds what is new."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all of the cluster can write: below spark.checkpoint.dir, or below /tmp where all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
