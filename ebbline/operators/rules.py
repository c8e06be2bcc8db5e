"""Market regimes, rule agents and orders: case expressions over one row per asset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.functions.frames import rolling, series
from ebbline.operators.econo import hurst_quick, volatility_regime
from ebbline.operators.rolling import bollinger_position, directional_index, relative_strength
from ebbline.operators.series import STRETCH, last_rows, log_returns, running, stretch


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def first_case(*cases: tuple[Column, object], otherwise: object = 0.0) -> Column:
    value = None
    for condition, result in cases:
        value = F.when(condition, result) if value is None else value.when(condition, result)
    return value.otherwise(otherwise)


def trend(bars: DataFrame, days: int = 126) -> DataFrame:
    """asset, trend_pct (annualised slope of ln price, percent), r2 over the last days; 0 with fewer than 30."""
    rows = last_rows(bars, days)
    rows = rows.withColumn("i", F.row_number().over(series()))
    fit = rows.groupBy("asset").agg(F.count("*").alias("n"), F.regr_slope(F.ln("price"), F.col("i")).alias("slope"), F.regr_r2(F.ln("price"), F.col("i")).alias("r2"))
    enough = F.col("n") >= 30
    return fit.select("asset", F.when(enough, (F.exp(F.col("slope") * 252) - 1) * 100).otherwise(0.0).alias("trend_pct"), F.when(enough, F.col("r2")).otherwise(0.0).alias("r2"))


def average_structure(bars: DataFrame) -> DataFrame:
    """asset, structure, structure_score: last price against the means of the last 50 and min(200, n - 1) prices."""
    w = Window.partitionBy("asset").orderBy(F.desc("date"))
    rows = bars.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("asset"))})
    long = F.least(F.lit(200), F.col("n") - 1)
    m = rows.groupBy("asset").agg(
        F.max("n").alias("n"), F.max_by("price", "date").alias("p"), F.avg(F.when(F.col("k") <= 50, F.col("price"))).alias("s50"), F.avg(F.when(F.col("k") <= long, F.col("price"))).alias("s200")
    )
    p, a, b = F.col("p"), F.col("s50"), F.col("s200")
    score = first_case((F.col("n") < 60, 0.0), ((p > a) & (a > b), 1.0), ((p < a) & (a < b), -1.0), ((p > a) & (p > b), 0.5), ((p < a) & (p < b), -0.5))
    m = m.withColumn("structure_score", score)
    return m.select("asset", first_case((score > 0, "ALCISTA"), (score < 0, "BAJISTA"), otherwise="MIXTA").alias("structure"), "structure_score")


def distance_from_high(bars: DataFrame, days: int = 252) -> DataFrame:
    return last_rows(bars, days).groupBy("asset").agg(((F.max_by("price", "date") / F.max("price") - 1) * 100).alias("drawdown"))


def directional_regime(ohlc: DataFrame) -> DataFrame:
    """One row per asset: regime (BULL, BEAR, SIDEWAYS), score, strength, confidence and what they come from. ohlc needs 60 rows an asset."""
    bars = ohlc.withColumn("price", F.col("close"))
    returns = log_returns(bars)
    adx = directional_index(ohlc).groupBy("asset").agg(F.max_by("adx", "date").alias("adx"), F.max_by("di_diff", "date").alias("di_diff"), F.count("*").alias("rows"))
    vol = returns.groupBy("asset").agg((F.stddev_samp("r") * math.sqrt(252) * 100).alias("vol"))
    x = trend(bars).join(average_structure(bars), "asset").join(adx, "asset").join(distance_from_high(bars), "asset").join(hurst_quick(returns), "asset").join(vol, "asset").filter("rows >= 60")
    x = x.withColumn("strength", 0.5 * clip(F.col("adx") / 40 * 100, 0, 100) + 0.5 * clip(F.col("r2") / 0.7 * 100, 0, 100))
    by_trend = clip(F.col("trend_pct") / 40, -1, 1) * 35
    direction = F.when(by_trend == 0, 1.0).otherwise(F.signum(by_trend))
    score = by_trend + F.col("structure_score") * 25 + clip(F.col("di_diff") / 25, -1, 1) * 20 + clip((F.col("drawdown") + 15) / 15, -1, 1) * 15 + (F.col("hurst") - 0.5) * 10 * direction
    x = x.withColumn("score", clip(score, -100, 100))
    flat = ((F.col("adx") < 20) & (F.col("r2") < 0.30)) | (F.col("strength") < 25)
    x = x.withColumn("regime", first_case((flat, "SIDEWAYS"), (F.col("score") > 20, "BULL"), (F.col("score") < -20, "BEAR"), otherwise="SIDEWAYS"))
    size = F.abs("score")
    sure = F.when(F.col("regime") == "SIDEWAYS", clip(1 - size / 60, 0.3, 1)).otherwise(clip(0.4 + (size - 20) / 80 * 0.4 + F.col("strength") / 100 * 0.2, 0.3, 1))
    return x.withColumn("confidence", sure).drop("rows")


# What each regime's strategy does.
STRATEGIES = [
    # regime, kelly_mult, min_confidence, max_positions, w_momentum, w_reversion, w_risk, rsi_buy, rsi_sell
    ("BULL", 1.0, 0.55, 6, 1.5, 0.6, 0.8, 55.0, 82.0),
    ("BEAR", 0.4, 0.72, 2, 0.4, 1.2, 1.6, 25.0, 55.0),
    ("SIDEWAYS", 0.6, 0.62, 4, 0.3, 1.8, 1.0, 35.0, 65.0),
]


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, "regime string, kelly_mult double, min_confidence double, max_positions int, w_momentum double, w_reversion double, w_risk double, rsi_buy double, rsi_sell double")


def with_strategy(regimes: DataFrame, market: Column | str) -> DataFrame:
    """Adds the strategy of a row's regime (SIDEWAYS if unknown), adjusted to the market's regime."""
    table = F.broadcast(strategies(regimes.sparkSession).withColumnRenamed("regime", "strategy"))
    key = F.when(F.col("regime").isin("BULL", "BEAR"), F.col("regime")).otherwise("SIDEWAYS")
    rows = regimes.withColumn("market", market if isinstance(market, Column) else F.col(market)).join(table, key == F.col("strategy"))
    bear, bull = F.col("market") == "BEAR", F.col("market") == "BULL"
    change = lambda c, down, up: F.when(bear, down).when(bull, up).otherwise(F.col(c))
    c = F.col
    return rows.withColumns({
        "kelly_mult": change("kelly_mult", c("kelly_mult") * 0.5, F.least(c("kelly_mult") * 1.15, F.lit(1.2))),
        "min_confidence": change("min_confidence", F.least(c("min_confidence") + 0.08, F.lit(0.85)), F.greatest(c("min_confidence") - 0.03, F.lit(0.50))),
        "max_positions": change("max_positions", F.greatest(F.lit(1), F.floor(c("max_positions") / 2)).cast("int"), c("max_positions")),
        "w_momentum": change("w_momentum", c("w_momentum") * 0.7, c("w_momentum")),
        "w_risk": change("w_risk", c("w_risk") * 1.3, c("w_risk") * 0.9),
        "rsi_buy": change("rsi_buy", c("rsi_buy") - 5, c("rsi_buy")), "rsi_sell": change("rsi_sell", c("rsi_sell") - 5, c("rsi_sell")),
    })


def agent_context(bars: DataFrame) -> DataFrame:
    """One row per asset at its last date: price, returns (percent), volatility, hurst, stress, rsi, bb, volume_ratio. bars: asset, date, price, volume."""
    w = series()
    rows = bars.withColumns({"r": F.ln(F.col("price") / F.lag("price").over(w)), "change": F.col("price") - F.lag("price").over(w)})
    rows = rows.withColumns({
        "rsi": relative_strength(14), "bb": bollinger_position(), "volume_ratio": F.col("volume") / F.nullif(rolling(w, F.avg, F.col("volume"), 20), F.lit(0)),
        "ret_7d": F.sum("r").over(w.rowsBetween(-4, 0)) * 100, "ret_1m": F.sum("r").over(w.rowsBetween(-20, 0)) * 100,
    })
    last = lambda c: F.max_by(c, "date").alias(c)
    now = rows.groupBy("asset").agg(last("price"), (F.max_by("r", "date") * 100).alias("ret_24h"), last("ret_7d"), last("ret_1m"), last("rsi"), last("bb"), F.coalesce(F.max_by("volume_ratio", "date"), F.lit(1.0)).alias("volume_ratio"), (F.stddev_samp("r") * math.sqrt(252) * 100).alias("volatility"))
    returns = rows.filter("r is not null").select("asset", "date", "r")
    stress = volatility_regime(returns).select("asset", F.col("regime").alias("stress"))
    return now.join(hurst_quick(returns), "asset").join(stress, "asset").withColumns({"ml_signal": F.lit(0), "ml_prob": F.lit(0.5), "whales": F.lit("NEUTRAL")})


def rounded(points: Column, most: float | Column) -> Column:
    return F.bround(points / most, 3)


def base_agents(context: DataFrame, max_vol: float = 100.0, min_consensus: float = 0.15, kelly: float = 0.25, min_edge: float = 0.15) -> DataFrame:
    """Bull and bear scores, vetoes, decision and Kelly share of the base rule set."""
    c = F.col
    calm, ml = c("stress") == "CALMA", c("ml_prob") * 2
    bull = (
        first_case((c("hurst") > 0.60, 2.0), (c("hurst") > 0.53, 1.0)) + first_case((calm, 1.5)) + first_case((c("rsi") < 30, 2.0), (c("rsi") < 45, 1.0)) + first_case((c("bb") < -0.6, 1.5), (c("bb") < 0, 0.5))
        + first_case((c("ml_signal") == 1, ml)) + first_case((c("whales") == "ALCISTA", 1.5)) + first_case((c("volume_ratio") > 1.5, 0.5)) + first_case((c("ret_7d") > 3, 1.0))
    )
    bear = (
        first_case((~calm, 2.0)) + first_case((c("rsi") > 70, 2.0), (c("rsi") > 60, 0.8)) + first_case((c("volatility") > 80, 1.5), (c("volatility") > 50, 0.7)) + first_case((c("hurst") < 0.42, 1.5), (c("hurst") < 0.48, 0.5))
        + first_case((c("ml_signal") == -1, ml)) + first_case((c("whales") == "BAJISTA", 1.5)) + first_case((c("ret_24h") < -3, 1.0), (c("ret_24h") > 5, 0.3)) + first_case((c("bb") > 0.6, 1.0))
    )
    x = context.withColumns({"bull": rounded(bull, 12.0), "bear": rounded(bear, 12.5)})
    vetoes = F.array_compact(F.array(
        F.when(c("volatility") > max_vol, "volatility"), F.when(~calm & (c("volatility") > 60), "stress"), F.when(F.abs(c("bull") - c("bear")) < min_consensus, "balanced"),
        F.when((c("bull") > 0.5) & (c("rsi") > 78), "overbought"), F.when((c("bear") > 0.5) & (c("rsi") < 22), "oversold"),
    ))
    return decided(x.withColumn("vetoes", vetoes).withColumns({"threshold": F.lit(min_edge), "size_mult": F.lit(1.0)}), kelly)


def decided(x: DataFrame, kelly: float) -> DataFrame:
    """edge, action, kelly_share from bull, bear, vetoes, threshold, volatility, stress, size_mult."""
    c = F.col
    edge = c("bull") - c("bear")
    veto, weak = F.size("vetoes") > 0, F.abs(edge) < c("threshold")
    share = F.abs(edge) * kelly * first_case((c("volatility") > 80, 0.4), (c("volatility") > 60, 0.6), (c("volatility") > 40, 0.8), otherwise=1.0) * F.when(c("stress") == "ESTRÉS", 0.5).otherwise(1.0) * c("size_mult")
    return x.withColumns({
        "edge": edge, "vetoed": veto, "action": first_case((veto | weak, "ESPERAR"), (edge > 0, "COMPRAR"), otherwise="VENDER"),
        "kelly_share": F.when(veto | weak, 0.0).otherwise(clip(share, 0.0, 0.20)),
    })


def adaptive_agents(context: DataFrame, regimes: DataFrame, market: Column | str, positions: int = 0, max_vol: float = 100.0, min_consensus: float = 0.15, kelly: float = 0.25, min_edge: float = 0.15) -> DataFrame:
    """The rule set whose weights and limits follow the asset's regime and the market's. context and regimes join on asset."""
    c = F.col
    reg = with_strategy(regimes.select("asset", "regime", "confidence", "drawdown", *([market] if isinstance(market, str) else [])), market)
    x = context.join(reg, "asset")
    calm, side, wm, wv, wr = c("stress") == "CALMA", c("regime") == "SIDEWAYS", c("w_momentum"), c("w_reversion"), c("w_risk")
    ml = c("ml_prob") * 2
    bull = (
        first_case((c("hurst") > 0.60, 2 * wm), (c("hurst") > 0.53, wm)) + first_case((side & (c("ret_7d") < -5), 1.5 * wm), (~side & (c("ret_7d") > 3), 1.5 * wm))
        + first_case((c("rsi") < c("rsi_buy") - 10, 2 * wv), (c("rsi") < c("rsi_buy"), 1.2 * wv)) + first_case((c("bb") < -0.6, 1.5 * wv), (c("bb") < 0, 0.5 * wv))
        + first_case((c("ml_signal") == 1, ml)) + first_case((c("whales").isin("ALCISTA", "COMPRADORA"), 1.5)) + first_case((calm, 1.0))
        + first_case((c("regime") == "BULL", 2 * c("confidence")), (c("regime") == "BEAR", 0.0), otherwise=0.6)
    )
    bear = (
        first_case((~calm, 2 * wr)) + first_case((c("rsi") > c("rsi_sell"), 2 * wr), (c("rsi") > c("rsi_sell") - 10, 0.8 * wr)) + first_case((c("volatility") > 80, 1.5 * wr), (c("volatility") > 50, 0.7 * wr))
        + first_case((c("ml_signal") == -1, ml)) + first_case((c("whales").isin("BAJISTA", "VENDEDORA"), 1.5)) + first_case((c("bb") > 0.6, 1.0))
        + first_case((c("regime") == "BEAR", 3 * c("confidence")), (side, 1.0)) + first_case((c("drawdown") < -25, 1.0))
    )
    x = x.withColumns({"bull": rounded(bull, 3.5 * wm + 3.5 * wv + 6.5), "bear": rounded(bear, 5.5 * wr + 8.5)})
    limit = max_vol * first_case((c("regime") == "BEAR", 0.7), (side, 0.85), otherwise=1.0)
    buys = c("bull") > 0.5
    vetoes = F.array_compact(F.array(
        F.when(c("volatility") > limit, "volatility"), F.when(~calm & (c("volatility") > 60), "stress"), F.when(F.abs(c("bull") - c("bear")) < min_consensus, "balanced"),
        F.when((F.lit(positions) >= c("max_positions")) & buys, "positions"), F.when(buys & (c("regime") == "BEAR") & (c("confidence") > 0.7) & (c("rsi") > 40), "against bear"),
        F.when((c("market") == "BEAR") & buys & (c("volatility") > 60), "bear market"), F.when(buys & (c("rsi") > 82), "overbought"), F.when((c("bear") > 0.5) & (c("rsi") < 18), "oversold"),
    ))
    x = x.withColumns({"vetoes": vetoes, "threshold": F.greatest(F.lit(min_edge), c("min_confidence") - 0.40), "size_mult": c("kelly_mult")})
    return decided(x, kelly)


def decision_report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count("*").alias("n"), F.count_if("vetoed").alias("vetoed"), F.avg(F.when(~F.col("vetoed"), F.abs("edge"))).alias("mean_edge"))


def quick_signals(context: DataFrame) -> DataFrame:
    arrow = first_case(((F.col("hurst") > 0.55) & (F.col("stress") == "CALMA"), "up"), (F.col("stress") == "ESTRÉS", "down"), otherwise="flat")
    return context.select("asset", "price", "hurst", "volatility", "ret_7d", "ret_1m", "stress", arrow.alias("signal"))


def kill_switch(trades: DataFrame, capital: float, max_drawdown: float = 0.20, losses: int = 8, per_hour: int = 200) -> DataFrame:
    """Adds blocked (latched) to executed trades: asset, ts, pnl. Trades in the last hour are counted over true time.

    An asset's trades are many groups, one per stretch of time: sums inside a stretch go on from those of earlier ones,
    and a stretch sees the last hour of the one before.
    """
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    x = trades.withColumn("stretch", stretch("ts"))
    x = running(x, "asset", "ts", {"total": F.col("pnl"), "wins": (F.col("pnl") >= 0).cast("int")}).withColumn("worth", capital + F.col("total"))
    x = x.withColumn("streak", F.sum(F.when(F.col("pnl") < 0, 1).otherwise(0)).over(Window.partitionBy("asset", "wins").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    late = x.filter(second >= (F.col("stretch") + 1) * STRETCH - 3599).withColumns({"stretch": F.col("stretch") + 1, "own": F.lit(False)})
    x = x.withColumn("own", F.lit(True)).unionByName(late)
    x = x.withColumn("last_hour", F.count("*").over(Window.partitionBy("asset", "stretch").orderBy(second).rangeBetween(-3599, 0))).filter("own")
    now = ((capital - F.col("worth")) / capital >= max_drawdown) | (F.col("streak") >= losses) | (F.col("last_hour") >= per_hour)
    x = running(x.withColumn("now", now.cast("int")), "asset", "ts", {"alarms": F.col("now")})
    return x.withColumn("blocked", F.col("alarms") > 0).drop("wins", "total", "stretch", "own", "now", "alarms")


def cooled_down(signals: DataFrame, hours: int = 4) -> DataFrame:
    """Adds waiting: the asset's signal before is under `hours` old. signals: asset, ts. Groups are stretches of time (see kill_switch)."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    x = signals.withColumn("stretch", stretch("ts"))
    before = Window.partitionBy("asset").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy("asset", "stretch").agg(F.max(second).alias("end")).select("asset", "stretch", F.max("end").over(before).alias("earlier"))
    last = F.coalesce(F.lag(second).over(Window.partitionBy("asset", "stretch").orderBy("ts")), F.col("earlier"))
    return x.join(ends, ["asset", "stretch"]).withColumn("waiting", F.coalesce(second - last < hours * 3600, F.lit(False))).drop("stretch", "earlier")


def sized_orders(decisions: DataFrame, capital: float, max_share: float = 0.10, stop: float = 0.05, take: float = 0.10, least_confidence: float = 0.15) -> DataFrame:
    """asset, action, qty, stop_price, take_price, reason: the filter chain and order rounding (whole units over 100, else two decimals)."""
    c = F.col
    reason = first_case((c("vetoed"), "veto"), (c("action") == "ESPERAR", "wait"), (F.abs("edge") < least_confidence, "confidence"), (F.lit(capital < 100), "capital"), otherwise="execute")
    qty = capital * max_share / c("price")
    whole = F.when(c("price") > 100, F.floor(qty).cast("double")).otherwise(F.bround(qty, 2))
    sign = F.when(c("action") == "COMPRAR", 1.0).otherwise(-1.0)
    return decisions.select(
        "asset", "action", reason.alias("reason"), F.when(whole <= 0, 1.0).otherwise(whole).alias("qty"), F.bround(c("price") * (1 - sign * stop), 2).alias("stop_price"), F.bround(c("price") * (1 + sign * take), 2).alias("take_price")
    )
