"""Queries of operators.reports and of source operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.operators import boosting, diagnostics, econo, intervals, learning, micro, quantum, reports, rolling, stress
from ebbline.operators import series as ts
from ebbline.plans import oracles as o
from ebbline.plans.queries import SCENARIOS, book, damped_returns, event_trades, factor_panel, query, returns, rounded
from ebbline.sources import factors, market, sinks
from ebbline.streaming import state

SQL: dict[str, str] = {}


@query
def quick_var(spark, d):
    return rounded(reports.quick_var(returns(spark, d)))


SQL["quick_var"] = f"WITH {o.RETS} SELECT asset, round(quantile_cont(r, 0.05), 6) AS historical, round(avg(r) + {o.Z95} * stddev_samp(r), 6) AS parametric FROM rets GROUP BY asset"


@query
def ewma_forecast(spark, d):
    return rounded(reports.ewma_forecast(returns(spark, d), [1, 5, 10, 21]))


SQL["ewma_forecast"] = f"WITH {o.RETS}{o.EWMA}, l AS (SELECT asset, arg_max(nv, date) AS v FROM e2 GROUP BY asset) SELECT asset, CAST(horizon AS INTEGER) AS horizon, round(sqrt(v * horizon), 6) AS volatility, round(sqrt(v * 252), 6) AS annual FROM l, unnest([1, 5, 10, 21]) x(horizon)"

#: bt(asset, date, ...) by filtered simulation.
FILTERED = """, nb AS (SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i FROM rets),
ex AS (SELECT a.asset, a.i AS t, b.i - a.i + 250 AS k, b.r FROM nb a JOIN nb b ON a.asset = b.asset AND b.i >= a.i - 250 AND b.i < a.i WHERE a.i >= 250),
ey AS (SELECT *, var_samp(r) FILTER (k < 20) OVER (PARTITION BY asset, t) AS seed, r * r * pow(0.94, -(k + 1.0)) AS part, coalesce(sum(r * r * pow(0.94, -(k + 1.0))) OVER (PARTITION BY asset, t ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ex),
ez AS (SELECT *, r / sqrt(pow(0.94, k) * (seed + 0.06 * before)) AS z FROM ey),
eq AS (SELECT asset, t, quantile_cont(z, 0.01) AS q, sqrt(pow(0.94, 250) * (first(seed) + 0.06 * sum(part))) AS sigma FROM ez GROUP BY 1, 2),
es AS (SELECT ez.asset, ez.t, avg(z) AS es FROM ez JOIN eq ON ez.asset = eq.asset AND ez.t = eq.t WHERE z <= q GROUP BY 1, 2),
bt AS (SELECT nb.asset, nb.date, -q * sigma AS var_forecast, -es * sigma AS es_forecast, r AS realised_return, r < q * sigma AS exception FROM nb JOIN eq ON nb.asset = eq.asset AND nb.i = eq.t JOIN es ON nb.asset = es.asset AND nb.i = es.t)"""


@query
def rolling_filtered_backtest(spark, d):
    return rounded(reports.rolling_filtered_backtest(returns(spark, d)))


SQL["rolling_filtered_backtest"] = f"WITH {o.RETS}{FILTERED} {o.SHOW_BT}"


@query
def full_backtest(spark, d):
    return rounded(reports.full_backtest(returns(spark, d)), 4)


def report_sql(name: str, runs: str) -> str:
    pof = o.POF.replace("1 - 0.95", "1 - 0.99").replace("0.95", "0.99")
    return f"""SELECT asset, '{name}' AS method, days, exceptions, round({o.erfc('sqrt(lr_pof / 2)')}, 4) AS p_pof, round({o.erfc('sqrt(lr_ind / 2)')}, 4) AS p_ind, round(exp(-(lr_pof + lr_ind) / 2), 4) AS p_cc,
  CASE WHEN exceptions <= 4 * s THEN 'GREEN' WHEN exceptions >= 10 * s THEN 'RED' ELSE 'YELLOW' END AS zone,
  CASE WHEN exceptions <= 4 * s THEN 3.0 WHEN exceptions >= 10 * s THEN 4.0 ELSE 3.0 + [0.40, 0.50, 0.65, 0.75, 0.85][CAST(least(greatest(round_even(exceptions / s, 0), 5), 9) AS INTEGER) - 4] END AS multiplier, z2, p_value
FROM (WITH {o.RETS}{runs}{o.COUNTS}{o.shortfall_test(0.99)}, l AS (SELECT *, {pof} AS lr_pof, {o.IND} AS lr_ind, days / 250 AS s FROM bc)
SELECT l.*, round(z2, 4) AS z2, round(p_value, 4) AS p_value FROM l JOIN st ON l.asset = st.asset)"""


METHODS = ["historical", "normal", "student", "filtered"]
REPORT = " UNION ALL ".join(report_sql(name, runs) for name, runs in zip(METHODS, (o.backtest(0.01, "historical"), o.backtest(0.01, "normal"), o.backtest(1 - 0.99, "student"), FILTERED), strict=True))
SQL["full_backtest"] = REPORT


@query
def worst_method(spark, d):
    return reports.worst_method(reports.full_backtest(returns(spark, d)), METHODS)


SQL["worst_method"] = f"WITH f AS ({REPORT}) SELECT asset, arg_max(method, s) AS method, arg_max(zone, s) AS zone FROM (SELECT *, CASE zone WHEN 'RED' THEN 20 WHEN 'YELLOW' THEN 10 ELSE 0 END - list_position({METHODS}, method) AS s FROM f) GROUP BY asset"


@query
def stress_suite(spark, d):
    r = damped_returns(spark, d)
    daily = ts.portfolio_returns(r, ts.equal_weights(r))
    return rounded(reports.stress_suite(daily, stress.single_betas(daily, factor_panel(spark, d)), stress.scenario_table(spark, SCENARIOS), stress.shock_table(spark)))


SQL["stress_suite"] = f"""WITH {o.DAMPED_RETS}{o.BOOK}{o.FACTORS}{o.HYPO}, s(scenario, a, b) AS (VALUES {', '.join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in SCENARIOS.items())}),
x AS (SELECT scenario, date, exp(sum(ln(1 + r)) OVER (PARTITION BY scenario ORDER BY date)) AS level FROM book JOIN s ON date BETWEEN a AND b),
y AS (SELECT *, level / max(level) OVER (PARTITION BY scenario ORDER BY date) - 1 AS dd FROM x)
SELECT scenario, 'historical' AS kind, round(arg_max(level, date) - 1, 6) AS pnl, round(min(dd), 6) AS max_drawdown FROM y GROUP BY scenario HAVING count(*) >= 5
UNION ALL SELECT scenario, 'hypothetical', round(pnl, 6), NULL FROM hypo"""


def momentum_path(spark, d, threshold: float = 0.0, days: int = 21, kelly: float = 0.25):
    """Long after a rise over the last days, short after a fall, by the day before."""
    r = damped_returns(spark, d)
    moved = F.sum("r").over(rolling.series().rowsBetween(-days, -1))
    positions = r.withColumn("seen", F.count("r").over(rolling.series().rowsBetween(-days, -1))).withColumn("m", moved).filter(F.col("seen") == days)
    positions = positions.select("asset", "date", F.when(F.col("m") > threshold, 1).when(F.col("m") < -threshold, -1).otherwise(0).alias("position"))
    return reports.held_path(r, positions, kelly=kelly)


@query
def strategy_performance(spark, d):
    return rounded(reports.performance(momentum_path(spark, d), 10_000.0), 4)


PATH = """, mp AS (SELECT asset, date, r, sum(r) OVER f AS m, count(r) OVER f AS seen FROM rets WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
po AS (SELECT asset, date, r AS market_r, CASE WHEN m > 0 THEN 1 WHEN m < 0 THEN -1 ELSE 0 END AS position FROM mp WHERE seen = 21),
pa AS (SELECT *, position * 0.25 * market_r AS r, CASE WHEN position <> coalesce(lag(position) OVER w, 0) THEN ln(1 - 0.0015) ELSE 0 END AS paid, abs(position - lag(position) OVER w) > 0 AS moved FROM po WINDOW w AS (PARTITION BY asset ORDER BY date)),
cp AS (SELECT *, 10000 * exp(sum(r + paid) OVER (PARTITION BY asset ORDER BY date)) AS capital FROM pa),
cd AS (SELECT *, capital / max(capital) OVER (PARTITION BY asset ORDER BY date) - 1 AS dd FROM cp),
pf AS (SELECT asset, arg_max(capital, date) AS capital, arg_max(capital, date) / 10000 - 1 AS total, count(*) AS days, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down, min(dd) AS dd, count(*) FILTER (moved) AS trades, exp(sum(market_r)) - 1 AS hold FROM cd GROUP BY asset)"""
SQL["strategy_performance"] = f"""WITH {o.DAMPED_RETS}{PATH} SELECT asset, round(capital, 4) AS capital, round(total, 4) AS total, round(pow(1 + total, 252.0 / days) - 1, 4) AS cagr, round(sd * sqrt(252.0), 4) AS volatility, round(mean / (sd + 1e-10) * sqrt(252.0), 4) AS sharpe,
  round(mean / (coalesce(down, 0) + 1e-10) * sqrt(252.0), 4) AS sortino, round(dd, 4) AS max_drawdown, round(CASE WHEN dd <> 0 THEN (pow(1 + total, 252.0 / days) - 1) / abs(dd) ELSE 0 END, 4) AS calmar, trades, round(hold, 4) AS buy_and_hold, round(total - hold, 4) AS alpha FROM pf"""


@query
def market_proxy_regime(spark, d):
    """Each asset beside the regime of its market: the structure of averages of the asset that stands for all others."""
    from ebbline.operators import rules

    own = rules.average_structure(market.damped_bars(spark, d))
    proxy = own.select(F.col("asset").alias("proxy"), F.when(F.col("structure_score") > 0, "BULL").when(F.col("structure_score") < 0, "BEAR").otherwise("SIDEWAYS").alias("market"))
    named = own.withColumn("proxy", F.when(F.col("asset") == "R", "A").otherwise("R"))
    return named.join(proxy, "proxy").select("asset", "proxy", "structure", "market")


SQL["market_proxy_regime"] = f"WITH own AS ({o.SQL['average_structure']}) SELECT own.asset, CASE own.asset WHEN 'R' THEN 'A' ELSE 'R' END AS proxy, own.structure, CASE WHEN m.structure_score > 0 THEN 'BULL' WHEN m.structure_score < 0 THEN 'BEAR' ELSE 'SIDEWAYS' END AS market FROM own JOIN own m ON m.asset = CASE own.asset WHEN 'R' THEN 'A' ELSE 'R' END"


@query
def positive_dates(spark, d):
    lines = market.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date")).agg((F.avg("l_extendedprice") - 20_000).alias("price"))
    return rounded(ts.positive_dates(lines).select("date", "asset", "price"))


SQL["positive_dates"] = "WITH p AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) - 20000 AS price FROM lineitem GROUP BY 1, 2) SELECT date, asset, round(price, 6) AS price FROM p WHERE date NOT IN (SELECT date FROM p WHERE price <= 0)"


@query
def factor_lines(spark, d):
    """Factor files' text lines, written from the order panel, and read again."""
    p = market.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    lines = p.select(F.format_string("%s, %d, %d", F.date_format("date", "yyyyMMdd"), "n", "f").alias("value")).union(p.select(F.lit("Annual Factors").alias("value")).limit(1))
    return rounded(factors.parse_factor_lines(lines, ["Orders", "Filled"]))


SQL["factor_lines"] = "WITH p AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) SELECT date, 'Orders' AS factor, round(n / 100, 6) AS r FROM p UNION ALL SELECT date, 'Filled', round(f / 100, 6) FROM p"


@query
def factors_with_momentum(spark, d):
    base = factor_panel(spark, d).filter("factor in ('equity', 'rates')")
    return rounded(factors.joined_factors(base, returns(spark, d).filter("asset = 'A'").select("date", F.lit("Mom").alias("factor"), "r")))


SQL["factors_with_momentum"] = f"WITH {o.RETS}{o.BOOK}{o.FACTORS}, b AS (SELECT date, factor, r FROM fr WHERE factor IN ('equity', 'rates')), m AS (SELECT date, 'Mom' AS factor, r FROM rets WHERE asset = 'A') SELECT date, factor, round(r, 6) AS r FROM (SELECT * FROM b UNION ALL SELECT * FROM m) WHERE date IN (SELECT date FROM b) AND date IN (SELECT date FROM m)"


@query
def interleaved_watchlist(spark, d):
    """The brands with the dearest parts and the customers with most money, in turn."""
    w = lambda key: F.row_number().over(ts.Window.orderBy(*key)) - 1
    brands = market.table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.max("p_retailprice").alias("v"))
    nations = market.table(spark, d, "nation").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("v"))
    return micro.interleaved(brands.select(w([F.desc("v"), "ticker"]).alias("place"), "ticker").filter("place < 20"), nations.select(w(["v", "ticker"]).alias("place"), "ticker").filter("place < 20"))


SQL["interleaved_watchlist"] = "WITH b AS (SELECT p_brand AS ticker, row_number() OVER (ORDER BY max(p_retailprice) DESC, p_brand) - 1 AS place FROM part GROUP BY 1), n AS (SELECT n_name AS ticker, row_number() OVER (ORDER BY n_nationkey, n_name) - 1 AS place FROM nation) SELECT CAST(2 * place AS INTEGER) AS place, ticker FROM b WHERE place < 20 UNION ALL SELECT CAST(2 * place + 1 AS INTEGER), ticker FROM n WHERE place < 20"


def event_ticks(spark, d):
    return market.table(spark, d, "events").select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"))


@query
def sliding_windows(spark, d):
    return rounded(reports.event_windows(event_ticks(spark, d), "6 hours", "3 hours"))


SQL["sliding_windows"] = "WITH e AS (SELECT event_type AS asset, value AS price, CAST(floor(epoch(ts) / 10800) AS BIGINT) * 10800 AS s FROM events), w AS (SELECT asset, price, s - k AS s FROM e, unnest([0, 10800]) x(k)) SELECT asset, make_timestamp(s * 1000000) AS start, count(*) AS n, round(max(price), 6) AS high, round(min(price), 6) AS low FROM w GROUP BY 1, 2"


@query
def event_sessions(spark, d):
    users = market.table(spark, d, "events").select(F.col("user_id").cast("string").alias("asset"), "ts")
    return reports.event_sessions(users, "30 minutes")


SQL["event_sessions"] = "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS asset, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE AS same FROM events), s AS (SELECT asset, ts, count(*) FILTER (NOT coalesce(same, false)) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e) SELECT asset, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY asset, k"


LEFT_OUT = ("rsi_28", "mom_63", "vol_21", "autocorr_5", "ret_lag3")


@query
def inline_features(spark, d):
    """The thirteen features of the quick model."""
    return rounded(rolling.features(market.damped_bars(spark, d)).select("asset", "date", *[c for c in rolling.FEATURES if c not in LEFT_OUT]), 5)


SQL["inline_features"] = f"SELECT asset, date, {', '.join(c for c in rolling.FEATURES if c not in LEFT_OUT)} FROM ({o.SQL['technical_features']})"

#: Least squares on an intercept and three factors, by the inverse of their covariance matrix.
SQL["factor_model"] = f"""WITH {o.RETS}{o.BOOK}{o.FACTORS},
w AS (SELECT book.date, book.r AS y, max(fr.r) FILTER (factor = 'credit') AS a, max(fr.r) FILTER (factor = 'equity') AS b, max(fr.r) FILTER (factor = 'gold') AS c FROM book JOIN fr ON book.date = fr.date GROUP BY 1, 2 HAVING count(DISTINCT factor) FILTER (factor IN ('credit', 'equity', 'gold')) = 3),
m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_samp(y) AS vy, var_samp(a) AS aa, var_samp(b) AS bb, var_samp(c) AS cc, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc, covar_samp(a, y) AS ay, covar_samp(b, y) AS byy, covar_samp(c, y) AS cy FROM w),
i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
v AS (SELECT *, (bb * cc - bc * bc) / det AS iaa, (aa * cc - ac * ac) / det AS ibb, (aa * bb - ab * ab) / det AS icc, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac, (ab * ac - aa * bc) / det AS ibc FROM i),
s AS (SELECT *, iaa * ay + iab * byy + iac * cy AS ba, iab * ay + ibb * byy + ibc * cy AS bb2, iac * ay + ibc * byy + icc * cy AS bc2 FROM v),
t AS (SELECT *, my - ba * ma - bb2 * mb - bc2 * mc AS b0, (n - 1) * (vy - ba * ay - bb2 * byy - bc2 * cy) AS rss FROM s),
e AS (SELECT *, rss / (n - 4) AS s2, 1.0 / n + (ma * (iaa * ma + iab * mb + iac * mc) + mb * (iab * ma + ibb * mb + ibc * mc) + mc * (iac * ma + ibc * mb + icc * mc)) / (n - 1) AS i0 FROM t),
r AS (
  SELECT 'alpha' AS term, b0 * 252 AS beta, b0 * 252 / sqrt(s2 * i0) AS t_stat, rss / (n - 1) / vy AS risk_share, b0 * 252 AS return_share, n, rss, vy FROM e
  UNION ALL SELECT 'credit', ba, ba / sqrt(s2 * iaa / (n - 1)), ba * ay / vy, ba * ma * 252, n, rss, vy FROM e
  UNION ALL SELECT 'equity', bb2, bb2 / sqrt(s2 * ibb / (n - 1)), bb2 * byy / vy, bb2 * mb * 252, n, rss, vy FROM e
  UNION ALL SELECT 'gold', bc2, bc2 / sqrt(s2 * icc / (n - 1)), bc2 * cy / vy, bc2 * mc * 252, n, rss, vy FROM e
)
SELECT term, round(beta, 6) AS beta, round(CASE term WHEN 'alpha' THEN t_stat / 252 ELSE t_stat END, 6) AS t_stat, round(risk_share, 6) AS risk_share, round(return_share, 6) AS return_share, round(1 - rss / (n - 1) / vy, 6) AS r2, n FROM r"""

STRUCTURE = o.SQL["average_structure"].split(o.DAMPED, 1)[1].rsplit(" SELECT ", 1)[0]
#: The directional regime, not rounded.
DIRECTION = f"""WITH {o.DAMPED_OHLC}, damped AS (SELECT asset, date, volume, close AS price FROM dohlc){o.RET.format('damped')}{o.rs(o.QUICK)}{o.QUICK_HURST}{o.ADX}{o.TREND}{STRUCTURE},
dx AS (SELECT asset, arg_max(adx, date) AS adx, arg_max(di_diff, date) AS di_diff, count(*) AS rows FROM adx GROUP BY asset),
dh AS (SELECT asset, (arg_max(price, date) / max(price) - 1) * 100 AS drawdown FROM (SELECT * FROM damped QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 252) GROUP BY asset),
vo AS (SELECT asset, stddev_samp(r) * sqrt(252.0) * 100 AS vol FROM rets GROUP BY asset),
j AS (SELECT *, 0.5 * greatest(0, least(100, adx / 40 * 100)) + 0.5 * greatest(0, least(100, r2 / 0.7 * 100)) AS strength, greatest(-1, least(1, trend_pct / 40)) * 35 AS bt,
  CASE WHEN structure_score > 0 THEN 'ALCISTA' WHEN structure_score < 0 THEN 'BAJISTA' ELSE 'MIXTA' END AS structure
  FROM tr JOIN s USING (asset) JOIN dx USING (asset) JOIN dh USING (asset) JOIN hq USING (asset) JOIN vo USING (asset) WHERE rows >= 60),
g AS (SELECT *, greatest(-100, least(100, bt + structure_score * 25 + greatest(-1, least(1, di_diff / 25)) * 20 + greatest(-1, least(1, (drawdown + 15) / 15)) * 15 + (hurst - 0.5) * 10 * CASE WHEN bt = 0 THEN 1.0 ELSE sign(bt) END)) AS score FROM j),
q AS (SELECT *, CASE WHEN (adx < 20 AND r2 < 0.30) OR strength < 25 THEN 'SIDEWAYS' WHEN score > 20 THEN 'BULL' WHEN score < -20 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM g)
SELECT asset, trend_pct, r2, structure, structure_score, adx, di_diff, drawdown, hurst, vol, strength, score, regime, CASE WHEN regime = 'SIDEWAYS' THEN greatest(0.3, least(1, 1 - abs(score) / 60)) ELSE greatest(0.3, least(1, 0.4 + (abs(score) - 20) / 80 * 0.4 + strength / 100 * 0.2)) END AS confidence FROM q"""
NUMBERS = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in "trend_pct r2 structure_score adx di_diff drawdown hurst vol strength score confidence".split())
SQL["directional_regime"] = f"SELECT asset, structure, regime, {NUMBERS} FROM ({DIRECTION})"

#: Rules with weights by regime; the market is asset N.
SQL["adaptive_agents"] = f"""WITH {o.CONTEXT}, reg AS ({DIRECTION}), st(strategy, kelly_mult, min_confidence, max_positions, wm, wv, wr, rsi_buy, rsi_sell) AS (VALUES {o.ROWS}),
mk AS (SELECT regime AS market FROM reg WHERE asset = 'N'),
a1 AS (SELECT ctx.*, reg.regime, reg.confidence, reg.drawdown, market, strategy,
  CASE market WHEN 'BEAR' THEN kelly_mult * 0.5 WHEN 'BULL' THEN least(kelly_mult * 1.15, 1.2) ELSE kelly_mult END AS kelly_mult,
  CASE market WHEN 'BEAR' THEN least(min_confidence + 0.08, 0.85) WHEN 'BULL' THEN greatest(min_confidence - 0.03, 0.50) ELSE min_confidence END AS min_confidence,
  CASE market WHEN 'BEAR' THEN wm * 0.7 ELSE wm END AS wm, wv, CASE market WHEN 'BEAR' THEN wr * 1.3 WHEN 'BULL' THEN wr * 0.9 ELSE wr END AS wr,
  CASE market WHEN 'BEAR' THEN rsi_buy - 5 ELSE rsi_buy END AS rsi_buy, CASE market WHEN 'BEAR' THEN rsi_sell - 5 ELSE rsi_sell END AS rsi_sell
  FROM ctx JOIN reg ON ctx.asset = reg.asset CROSS JOIN mk JOIN st ON st.strategy = reg.regime),
a2 AS (SELECT *, stress = 'CALMA' AS calm, regime = 'SIDEWAYS' AS side FROM a1),
a3 AS (SELECT *, round_even(CAST(
    CASE WHEN hurst > 0.60 THEN 2 * wm WHEN hurst > 0.53 THEN wm ELSE 0 END + CASE WHEN side AND ret_7d < -5 THEN 1.5 * wm WHEN NOT side AND ret_7d > 3 THEN 1.5 * wm ELSE 0 END
    + CASE WHEN rsi < rsi_buy - 10 THEN 2 * wv WHEN rsi < rsi_buy THEN 1.2 * wv ELSE 0 END + CASE WHEN bb < -0.6 THEN 1.5 * wv WHEN bb < 0 THEN 0.5 * wv ELSE 0 END
    + CASE WHEN calm THEN 1.0 ELSE 0 END + CASE regime WHEN 'BULL' THEN 2 * confidence WHEN 'BEAR' THEN 0.0 ELSE 0.6 END AS DOUBLE) / CAST(3.5 * wm + 3.5 * wv + 6.5 AS DOUBLE), 3) AS bull,
  round_even(CAST(
    CASE WHEN NOT calm THEN 2 * wr ELSE 0 END + CASE WHEN rsi > rsi_sell THEN 2 * wr WHEN rsi > rsi_sell - 10 THEN 0.8 * wr ELSE 0 END + CASE WHEN volatility > 80 THEN 1.5 * wr WHEN volatility > 50 THEN 0.7 * wr ELSE 0 END
    + CASE WHEN bb > 0.6 THEN 1.0 ELSE 0 END + CASE WHEN regime = 'BEAR' THEN 3 * confidence WHEN side THEN 1.0 ELSE 0 END + CASE WHEN drawdown < -25 THEN 1.0 ELSE 0 END AS DOUBLE) / CAST(5.5 * wr + 8.5 AS DOUBLE), 3) AS bear FROM a2),
a4 AS (SELECT *, list_filter([CASE WHEN volatility > 100 * CASE WHEN regime = 'BEAR' THEN 0.7 WHEN side THEN 0.85 ELSE 1.0 END THEN 'volatility' END, CASE WHEN NOT calm AND volatility > 60 THEN 'stress' END, CASE WHEN abs(bull - bear) < 0.15 THEN 'balanced' END,
  CASE WHEN bull > 0.5 AND regime = 'BEAR' AND confidence > 0.7 AND rsi > 40 THEN 'against bear' END, CASE WHEN market = 'BEAR' AND bull > 0.5 AND volatility > 60 THEN 'bear market' END, CASE WHEN bull > 0.5 AND rsi > 82 THEN 'overbought' END,
  CASE WHEN bear > 0.5 AND rsi < 18 THEN 'oversold' END], lambda x : x IS NOT NULL) AS v, greatest(0.15, min_confidence - 0.40) AS threshold FROM a3),
a5 AS (SELECT *, len(v) > 0 AS vetoed, len(v) > 0 OR abs(bull - bear) < threshold AS waits FROM a4)
SELECT asset, regime, round(bull, 6) AS bull, round(bear, 6) AS bear, array_to_string(v, ',') AS vetoes, vetoed, CASE WHEN waits THEN 'ESPERAR' WHEN bull > bear THEN 'COMPRAR' ELSE 'VENDER' END AS action,
  round(CAST(CASE WHEN waits THEN 0.0 ELSE greatest(0.0, least(0.20, abs(bull - bear) * 0.25 * CASE WHEN volatility > 80 THEN 0.4 WHEN volatility > 60 THEN 0.6 WHEN volatility > 40 THEN 0.8 ELSE 1.0 END * CASE WHEN stress = 'ESTRÉS' THEN 0.5 ELSE 1.0 END * kelly_mult)) END AS DOUBLE), 6) AS kelly_share FROM a5"""

LONG_RS = f"WITH {o.RETS}{o.rs(o.log_sizes(25, 0.01, 20, 4))} SELECT asset, regr_slope(ln(rs), ln(size)) AS hurst FROM pts GROUP BY asset"
SQL["hurst_consensus"] = f"""WITH h AS ({LONG_RS}), d AS ({o.SQL['detrended_fluctuation'].replace('round(regr_slope', '(regr_slope').replace(', 5) AS alpha', ') AS alpha')}), c AS (SELECT h.asset, hurst, alpha, (hurst + alpha) / 2 AS consensus FROM h JOIN d ON h.asset = d.asset)
SELECT asset, round(hurst, 5) AS hurst, round(alpha, 5) AS alpha, round(consensus, 5) AS consensus, CASE WHEN consensus < 0.40 THEN 'strong reversion' WHEN consensus < 0.48 THEN 'mild reversion' WHEN consensus < 0.52 THEN 'random walk' WHEN consensus < 0.62 THEN 'mild persistence' ELSE 'strong persistence' END AS reading FROM c"""


#: Rows looked back and least move of each configuration of the grid of momentum rules.
GRID = [(days, limit) for days in (5, 10, 15, 21, 42, 63) for limit in (0.0, 0.005, 0.01)]


@query
def momentum_grid(spark, d):
    """Probability that the best of a grid of momentum rules is overfitted; days without a position earn nothing."""
    r = damped_returns(spark, d).filter("asset = 'N'")
    frame = lambda days: rolling.series().rowsBetween(-days, -1)
    moves = {days: F.when(F.count("r").over(frame(days)) == days, F.sum("r").over(frame(days))) for days, _ in GRID}
    rows = r.withColumn("t", F.row_number().over(rolling.series()) - 1).withColumns({f"m{days}": m for days, m in moves.items()})
    held = lambda m, limit: F.when(m > limit, 1).when(m < -limit, -1).otherwise(0)
    each = F.array(*[F.struct(F.lit(k).alias("trial"), (held(F.col(f"m{days}"), limit) * 0.25 * F.col("r")).alias("pnl")) for k, (days, limit) in enumerate(GRID)])
    return rounded(diagnostics.overfitting_probability(rows.select("t", F.inline(each)), blocks=10))


def grid_sql() -> str:
    block = "CASE " + " ".join(f"WHEN t >= floor({i} * len / 10) THEN {i}" for i in range(9, 0, -1)) + " ELSE 0 END"
    moves = ", ".join(f"CASE WHEN count(r) OVER f{days} = {days} THEN sum(r) OVER f{days} END AS m{days}" for days in sorted({k for k, _ in GRID}))
    frames = ", ".join(f"f{days} AS (ORDER BY date ROWS BETWEEN {days} PRECEDING AND 1 PRECEDING)" for days in sorted({k for k, _ in GRID}))
    trials = " UNION ALL ".join(f"SELECT {k} AS trial, block, CASE WHEN m{days} > {limit} THEN 1 WHEN m{days} < -{limit} THEN -1 ELSE 0 END * 0.25 * r AS pnl FROM rb" for k, (days, limit) in enumerate(GRID))
    start = f"WITH {o.DAMPED_RETS}, ra AS (SELECT date, r, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS len, {moves} FROM rets WHERE asset = 'N' WINDOW {frames}), rb AS (SELECT *, {block} AS block FROM ra), pn AS ({trials}), ch AS (SELECT range AS choice FROM range(1024) WHERE bit_count(range) = 5)"
    return start + ", mb AS" + o.PBO.split(", mb AS", 1)[1] + " SELECT round(avg(CAST(logit < 0 AS INTEGER)), 6) AS pbo, count(*) AS n_combinations, round(quantile_cont(logit, 0.5), 6) AS median_logit FROM sp"


SQL["momentum_grid"] = grid_sql()


@query
def robustness_grid(spark, d):
    """By asset, the probability that the best of 18 walk-forward configurations (confidence, label horizon, stake) is overfitted."""
    pnl = learning.model_grid(market.damped_bars(spark, d))
    return rounded(diagnostics.overfitting_probability(pnl, blocks=10, by=("asset",)))


SQL["shrunk_covariance"] = f"""WITH {o.RETS}{o.BOOK}, c AS (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS x FROM aligned),
s AS (SELECT a.asset AS i, b.asset AS j, count(*) AS n, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS s4 FROM c a JOIN c b ON a.date = b.date GROUP BY 1, 2),
k AS (SELECT sum(s) / count(*) AS mu, count(*) AS k FROM s WHERE i = j), t AS (SELECT s.*, k, CASE WHEN i = j THEN mu ELSE 0 END AS target FROM s, k),
g AS (SELECT sum((s - target) * (s - target)) / max(k) AS spread, sum((s4 - s * s) / n) / max(k) AS noise FROM t), h AS (SELECT CASE WHEN spread > 0 THEN least(noise, spread) / spread ELSE 0 END AS share FROM g)
SELECT i AS asset_i, j AS asset_j, round((1 - share) * s + share * target, 6) AS covariance, round(share, 6) AS shrinkage FROM t, h"""

SQL["spectral_cycles"] = f"""WITH {o.BARS}, a AS (SELECT asset, ln(price) AS y, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM bars),
f AS (SELECT asset, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM a GROUP BY asset),
d AS (SELECT a.asset, i, n, (y - f.a - f.b * i) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM a JOIN f ON a.asset = f.asset),
p AS (SELECT asset, k, n, pow(sum(y * cos(2 * pi() * (k * i % n) / n)), 2) + pow(sum(y * sin(2 * pi() * (k * i % n) / n)), 2) AS power FROM d, unnest(range(1, n // 2 + 1)) x(k) GROUP BY 1, 2, 3)
SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY power DESC) AS place, round(n / k, 6) AS period, round(power / sum(power) OVER (PARTITION BY asset), 6) AS power_share FROM p QUALIFY place <= 5"""


@query
def factor_simple_returns(spark, d):
    """Simple returns of the factor panel, kept between -90 % and 900 %."""
    return rounded(ts.winsorised(ts.simple_returns(market.daily_orders(spark, d)), -0.9, 9.0))


SQL["factor_simple_returns"] = f"WITH {o.ORDERS} SELECT asset, date, round(greatest(-0.9, least(9.0, r)), 6) AS r FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM panel) WHERE r IS NOT NULL"


@query
def labelled_rows(spark, d):
    """Rows that have all features and a label, by label: what a model learns from."""
    return learning.labelled(market.damped_bars(spark, d)).groupBy("asset", "label").agg(F.count("*").alias("n"))


SQL["labelled_rows"] = f"""WITH f AS ({o.SQL['technical_features']}), {o.DAMPED}, l AS (SELECT asset, date, CAST({o.BARRIER.replace('0.025', '0.01')} AS INTEGER) AS label FROM damped WINDOW w AS (PARTITION BY asset ORDER BY date))
SELECT f.asset, label, count(*) AS n FROM f JOIN l ON f.asset = l.asset AND f.date = l.date WHERE {' AND '.join(f'{c} IS NOT NULL' for c in rolling.FEATURES)} GROUP BY 1, 2"""


@query
def cointegrated_pairs(spark, d):
    """Engle-Granger tests of all pairs of the order panel's assets."""
    return rounded(econo.cointegrated_pairs(market.daily_orders(spark, d)), 5)


@query
def best_pairs(spark, d):
    return rounded(econo.best_pairs(econo.cointegrated_pairs(market.daily_orders(spark, d))), 5)


#: A matrix as a list of lists; the recursion eliminates a regressor a step and keeps what each leaves unexplained.
def eliminations(name: str, source: str, steps: str, left: str) -> str:
    sweep = "list_transform(m, lambda row: list_transform(list_zip(row, m[s + 1]), lambda x: x[1] - row[s + 1] * x[2] / m[s + 1][s + 1]))"
    return f"""{name} AS (SELECT a, b, k, lag, 0 AS s, m, [m[-1][-1]] AS l FROM {source}
  UNION ALL SELECT a, b, k, lag, s + 1, {sweep}, list_append(l, ({sweep})[-1][-1]) FROM {name} WHERE s < {steps}),
{left} AS (SELECT a, b, k, lag, m, l FROM {name} WHERE s = {steps})"""


def crossed(name: str, source: str) -> str:
    return f"""{name} AS (SELECT a, b, max(k) AS k, max(lag) AS lag, list(r ORDER BY i) AS m FROM (
  SELECT a, b, i, max(lag) AS lag, max(k) AS k, list(s ORDER BY j) AS r FROM (
    SELECT a, b, i, j, max(lag) AS lag, count(*) AS k, sum(v[i] * v[j]) AS s FROM (SELECT a, b, lag, v, unnest(range(1, len(v) + 1)) AS i FROM {source}) x, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY 1, 2, 3, 4)
  GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


PAIRS = o.SQL["pair_spreads"].replace(o.BARS, o.ORDERS).replace("FROM bars", "FROM panel").replace("WITH ", "", 1)
PAIR_TESTS = f"""WITH RECURSIVE {PAIRS.rsplit(' SELECT a, b, n, round(hedge', 1)[0]}, e AS (SELECT a, b, date, s AS e, s - s0 AS d, s0 AS before, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n,
  list(s - s0) OVER (PARTITION BY a, b ORDER BY date ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS past FROM l WINDOW w AS (PARTITION BY a, b ORDER BY date)),
g AS (SELECT *, CAST(least(ceil(12 * pow(n / 100, 0.25)), n // 2 - 1) AS INTEGER) AS most FROM e WHERE n >= 10),
v1 AS (SELECT a, b, most AS lag, list_concat([before], list_reverse(past)[1:most], [d]) AS v FROM g WHERE i > most),
{crossed('c1', 'v1')}, {eliminations('e1', 'c1', 'lag + 1', 'f1')},
ch AS (SELECT a, b, list_position(c, list_min(c)) - 1 AS lag FROM (SELECT a, b, list_transform(list_zip(l[2:], range(1, lag + 2)), lambda x: k * ln(x[1] / k) + 2 * x[2]) AS c FROM f1)),
v2 AS (SELECT g.a, g.b, ch.lag, list_concat(CASE WHEN ch.lag > 0 THEN list_reverse(past)[1:ch.lag] ELSE [] END, [before, d]) AS v FROM g JOIN ch ON g.a = ch.a AND g.b = ch.b WHERE i > ch.lag),
{crossed('c2', 'v2')}, {eliminations('e2', 'c2', 'lag', 'f2')},
st AS (SELECT a, b, lag, m[-2][-1] / m[-2][-2] / sqrt((m[-1][-1] - m[-2][-1] * m[-2][-1] / m[-2][-2]) / (k - lag - 1) / m[-2][-2]) AS t FROM f2),
pv AS (SELECT *, CASE WHEN t > 0.92 THEN 1.0 WHEN t < -18.86 THEN 0.0 ELSE {{cdf}} END AS p FROM (SELECT *, CASE WHEN t <= -2.62 THEN 2.92 + 1.5012 * t + 0.039796 * t * t ELSE 2.1945 + 0.64695 * t - 0.29198 * t * t - 0.042377 * t * t * t END AS y FROM st)),
al AS (SELECT o.a, o.b, n, hedge, CASE WHEN pull < 0 THEN -ln(2.0) / pull END AS half_life, z, lag, t, p FROM o JOIN pv ON o.a = pv.a AND o.b = pv.b)
SELECT a, b, n, round(hedge, 5) AS hedge, round(half_life, 5) AS half_life, round(z, 5) AS z, CAST(lag AS INTEGER) AS lag, round(t, 5) AS statistic, round(p, 5) AS p_value, p < 0.05 AS cointegrated,
  CASE WHEN p >= 0.05 THEN 'none: not cointegrated' WHEN coalesce(half_life, 1e9) > 252 THEN 'none: slow' WHEN z > 2 THEN 'sell ' || a || ', buy ' || b WHEN z < -2 THEN 'buy ' || a || ', sell ' || b ELSE 'none: neutral' END AS signal FROM al"""
SQL["cointegrated_pairs"] = PAIR_TESTS.replace("{cdf}", o.cdf("y"))
SQL["best_pairs"] = SQL["cointegrated_pairs"] + " WHERE p < 0.05 ORDER BY p, t, a, b LIMIT 5"


@query
def propagator(spark, d):
    """Where the last five days' move of each asset will be in 1, 5 and 20 days, by its potential well."""
    return rounded(quantum.propagator(returns(spark, d)), 4)


@query
def calibrated_probabilities(spark, d):
    """Held-out class probabilities of boosted trees, raw and calibrated, as columns."""
    told = boosting.calibrated_probabilities(learning.labelled(market.damped_bars(spark, d)))
    columns = [F.col(kind)[k].alias(f"{kind}_{name}") for kind in ("raw", "calibrated") for k, name in enumerate(("sell", "wait", "buy"))]
    return rounded(told.select("asset", "i", (F.col("y") - 1).alias("label"), *columns))


@query
def calibration_report(spark, d):
    return rounded(boosting.calibration_report(boosting.calibrated_probabilities(learning.labelled(market.damped_bars(spark, d)))))


@query
def online_risk(spark, d):
    """EWMA variance and drawdown of each asset's daily bars, read as a stream and kept as state; the bars are written before they are streamed."""
    folder = state.work_folder(spark, "stream")
    bars = market.damped_bars(spark, d).select("asset", "date", "price")
    bars.write.parquet(f"{folder}/bars")
    state.drained(state.running_risk(spark.readStream.schema(bars.schema).parquet(f"{folder}/bars")), f"{folder}/out", f"{folder}/state")
    return rounded(spark.read.parquet(f"{folder}/out"))


SQL["online_risk"] = f"""WITH {o.DAMPED_RETS}{o.EWMA}, dd AS (SELECT asset, date, price, max(price) OVER (PARTITION BY asset ORDER BY date) AS peak FROM damped)
SELECT e2.asset, e2.date, round(price, 6) AS price, round(nv, 6) AS next_variance, round(peak, 6) AS peak, round((price - peak) / peak, 6) AS drawdown FROM e2 JOIN dd ON e2.asset = dd.asset AND e2.date = dd.date"""


@query
def overlapping_intervals(spark, d):
    """Each user's day with an event type, from its first to its last event, with the sessions of that type which it meets."""
    e = market.table(spark, d, "events").select(F.col("event_type").alias("asset"), "user_id", "ts")
    days = e.groupBy("asset", "user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    met = intervals.overlapping(days, reports.event_sessions(e, "30 minutes"))
    return met.select("left.asset", "left.user_id", "left.day", F.col("right.start").alias("session"), F.col("right.n").alias("n"), (F.col("to") - F.col("from")).alias("micros"))


SQL["overlapping_intervals"] = """WITH e AS (SELECT event_type AS asset, user_id, ts FROM events), days AS (SELECT asset, user_id, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1, 2, 3),
g AS (SELECT asset, ts, ts - lag(ts) OVER (PARTITION BY asset ORDER BY ts) < INTERVAL 30 MINUTE AS same FROM e),
k AS (SELECT asset, ts, count(*) FILTER (NOT coalesce(same, false)) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g),
s AS (SELECT asset, k, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM k GROUP BY 1, 2)
SELECT d.asset, user_id, day, s.a AS session, n, epoch_us(least(d.b, s.b)) - epoch_us(greatest(d.a, s.a)) AS micros FROM days d JOIN s ON d.asset = s.asset AND d.a <= s.b AND s.a <= d.b"""


@query
def trade_log(spark, d):
    """Orders as trades, logged in one batch a year and the first batch twice, as after a failure: what the log then holds."""
    orders = market.table(spark, d, "orders")
    action = F.when(F.col("o_orderstatus") == "O", "COMPRAR").when(F.col("o_orderstatus") == "F", "VENDER").otherwise("ESPERAR")
    trades = orders.select(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").alias("ts"), action.alias("action"), F.round("o_totalprice", 2).alias("amount"), F.year("o_orderdate").alias("year"))
    path = state.work_folder(spark, "trades")
    for epoch in (1995, *range(1995, 2002)):
        sinks.append_epoch(trades.filter(F.col("year") == epoch).drop("year"), path, epoch)
    return sinks.read_epochs(spark, path).groupBy("asset", "epoch", "action").agg(F.count("*").alias("trades"), F.round(F.sum("amount"), 2).alias("amount"))


SQL["trade_log"] = """SELECT o_orderpriority AS asset, CAST(year(o_orderdate) AS BIGINT) AS epoch, CASE o_orderstatus WHEN 'O' THEN 'COMPRAR' WHEN 'F' THEN 'VENDER' ELSE 'ESPERAR' END AS action, count(*) AS trades, round(sum(round(o_totalprice, 2)), 2) AS amount
FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2, 3"""
