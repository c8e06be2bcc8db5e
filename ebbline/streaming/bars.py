"""Bars, sessions, cooldowns and kill switches on streams of (asset, ts, price, volume) or trades (asset, ts, pnl)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def streamed_bars(ticks: DataFrame, width: str = "1 day", late: str = LATE, slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bars; of ticks at one time the least price is first; a window is final when the watermark passes its end, later ticks are dropped by Spark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    bars = ticks.withWatermark("ts", late).groupBy("asset", w.alias("w")).agg(
        F.min_by("price", F.struct("ts", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "price")).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select("asset", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """asset, start, end, n of runs of events without a longer gap."""
    out = events.withWatermark("ts", late).groupBy("asset", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("asset", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(ticks: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def guarded(trades: DataFrame, capital: float, max_drawdown: float = 0.20, losses: int = 8, cooldown_hours: float = 4.0) -> DataFrame:
    """asset, ts, pnl, worth, blocked, waiting: the state of an asset is its worth, run of losses, latch and last trade."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        worth, run, latched, last = state.get if state.exists else (capital, 0, False, None)
        for pdf in batches:
            rows = []
            for ts, pnl in pdf.sort_values("ts")[["ts", "pnl"]].itertuples(index=False):
                worth += pnl
                run = run + 1 if pnl < 0 else 0
                latched = latched or (capital - worth) / capital >= max_drawdown or run >= losses
                now = ts.timestamp()
                rows.append((key[0], ts, pnl, worth, latched, last is not None and now - last < cooldown_hours * 3600))
                last = now
            yield pd.DataFrame(rows, columns=["asset", "ts", "pnl", "worth", "blocked", "waiting"])
        state.update((worth, run, latched, last))

    return trades.groupBy("asset").applyInPandasWithState(
        step, "asset string, ts timestamp, pnl double, worth double, blocked boolean, waiting boolean", "worth double, run int, latched boolean, last double", "append", GroupStateTimeout.NoTimeout
    )


def score_each_batch(stream: DataFrame, score, path: str, checkpoint: str, every: str = "60 minutes"):
    """Starts a query that calls a batch operator on each micro-batch and appends its rows to parquet."""

    def write(batch: DataFrame, epoch: int) -> None:
        score(batch).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
