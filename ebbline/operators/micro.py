"""Order flow and perpetual-market readings, one row per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TINY = 1e-10
KLINE = "array<string>"


def parse_klines(lines: DataFrame) -> DataFrame:
    """symbol, ts, open ... volume from rows of symbol and body, a JSON array of bars (ms, open, high, low, close, volume, ...)."""
    bars = lines.select("symbol", F.explode(F.from_json("body", f"array<{KLINE}>")).alias("k"))
    number = lambda i: F.get("k", F.lit(i)).cast("double")
    return bars.select("symbol", F.timestamp_millis(F.get("k", F.lit(0)).cast("long")).alias("ts"), *[number(i).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)])


def order_book_ratio(levels: DataFrame) -> DataFrame:
    """symbol, ratio of bid to ask notional; 1 without levels. levels: symbol, side ('bid' or 'ask'), price, qty."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("price") * F.col("qty")).otherwise(0.0))
    return levels.groupBy("symbol").agg(F.round(side("bid") / (side("ask") + TINY), 3).alias("ratio"))


def large_trades(trades: DataFrame, threshold: float) -> DataFrame:
    """symbol, n, bought, sold, ratio, signal of trades whose notional is large. trades: symbol, price, qty, buyer_is_maker."""
    value = F.col("price") * F.col("qty")
    big = trades.filter(value >= threshold).groupBy("symbol").agg(
        F.count("*").alias("n"), F.sum(F.when(~F.col("buyer_is_maker"), value).otherwise(0.0)).alias("bought"), F.sum(F.when(F.col("buyer_is_maker"), value).otherwise(0.0)).alias("sold")
    )
    ratio = F.col("bought") / (F.col("sold") + TINY)
    return big.withColumn("ratio", ratio).withColumn("signal", F.when(F.col("ratio") > 1.5, "ALCISTA").when(F.col("ratio") < 0.67, "BAJISTA").otherwise("NEUTRAL"))


def funding(rates: DataFrame, last: int = 21) -> DataFrame:
    """symbol, current, mean, annual_pct, signal over the last payments. rates: asset, ts, rate."""
    from ebbline.operators.series import last_rows

    out = last_rows(rates, last, "ts").groupBy("asset").agg(F.max_by("rate", "ts").alias("current"), F.avg("rate").alias("mean"))
    signal = F.when(F.col("mean") > 0.0005, "LONGS SATURADOS").when(F.col("mean") < -0.0003, "SHORTS SATURADOS").otherwise("NEUTRAL")
    return out.withColumns({"annual_pct": F.col("mean") * 3 * 365 * 100, "signal": signal})


def basis(quotes: DataFrame) -> DataFrame:
    """(mark - index) / index of the last quote, and its state. quotes: asset, ts, mark, index_price."""
    out = quotes.groupBy("asset").agg(F.max_by("mark", "ts").alias("mark"), F.max_by("index_price", "ts").alias("index_price"))
    out = out.withColumn("basis", (F.col("mark") - F.col("index_price")) / F.col("index_price"))
    return out.withColumn("state", F.when(F.col("basis") > 0, "CONTANGO").otherwise("BACKWARDATION"))


def open_interest_change(interest: DataFrame, days: int = 8) -> DataFrame:
    """asset, now, change over the last values. interest: asset, ts, value."""
    from ebbline.operators.series import last_rows

    out = last_rows(interest, days, "ts").groupBy("asset").agg(F.max_by("value", "ts").alias("now"), F.min_by("value", "ts").alias("then"))
    return out.select("asset", "now", (F.col("now") / F.col("then") - 1).alias("change"))


def crowd_bias(ratios: DataFrame) -> DataFrame:
    """asset, ratio, bias of the last long/short ratio. ratios: asset, ts, ratio."""
    out = ratios.groupBy("asset").agg(F.max_by("ratio", "ts").alias("ratio"))
    return out.withColumn("bias", F.when(F.col("ratio") > 1.5, "LARGOS").when(F.col("ratio") < 0.8, "CORTOS").otherwise("EQUILIBRADO"))


def microstructure(fund: DataFrame, bas: DataFrame, interest: DataFrame, crowd: DataFrame) -> DataFrame:
    """All four readings of an asset and what they say together; a missing one is neutral."""
    rows = fund.select("asset", F.col("mean").alias("funding"), F.col("signal").alias("funding_signal"))
    rows = rows.join(bas.select("asset", "basis"), "asset", "left").join(interest.select("asset", F.col("change").alias("oi_change")), "asset", "left").join(crowd.select("asset", "bias"), "asset", "left")
    reading = (
        F.when((F.col("funding") > 0.0005) & (F.col("oi_change") > 0.05), "long squeeze risk")
        .when(F.col("funding") < -0.0003, "short squeeze possible")
        .when(F.col("oi_change") < -0.10, "deleveraging")
        .otherwise("no extremes")
    )
    return rows.withColumn("reading", reading)


def fear_band(values: DataFrame) -> DataFrame:
    """Contrarian signal of a 0 ... 100 fear and greed value. values: asset, value."""
    v = F.col("value")
    return values.withColumn("signal", F.when(v < 25, "COMPRAR").when(v < 45, "ALCISTA").when(v < 55, "NEUTRAL").when(v < 75, "BAJISTA").otherwise("VENDER"))


def breadth(changes: DataFrame, key: str = "day") -> DataFrame:
    """Per key: how many assets rose, and the mood (of ten: over seven is up, under three is down). changes: key, asset, change."""
    out = changes.groupBy(key).agg(F.count_if(F.col("change") > 0).alias("risers"), F.count("*").alias("n"))
    return out.withColumn("mood", F.when(F.col("risers") * 10 > F.col("n") * 7, "ALCISTA").when(F.col("risers") * 10 < F.col("n") * 3, "BAJISTA").otherwise("NEUTRAL"))


def normalised_tickers(rows: DataFrame, column: str = "ticker") -> DataFrame:
    """Adds symbol (upper case, trimmed, 'BTC-USD' as 'BTCUSDT'), yahoo ('BTC-USD') and is_crypto."""
    up = F.upper(F.trim(column))
    crypto = F.rlike(up, F.lit("(-USD|USDT)$"))
    base = F.regexp_replace(up, "(-USD|USDT)$", "")
    return rows.withColumns({"is_crypto": crypto, "symbol": F.when(crypto, F.concat(base, F.lit("USDT"))).otherwise(up), "yahoo": F.when(crypto, F.concat(base, F.lit("-USD"))).otherwise(up)})


def interleaved(stocks: DataFrame, coins: DataFrame) -> DataFrame:
    """One list of both (columns place, ticker), a stock and a coin in turn."""
    s, c = stocks.select((2 * F.col("place")).alias("place"), "ticker"), coins.select((2 * F.col("place") + 1).alias("place"), "ticker")
    return s.unionByName(c).orderBy("place")


