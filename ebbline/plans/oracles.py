"""SQL that gives the rows of plans.queries, for DuckDB."""

from __future__ import annotations

from ebbline.operators.backtest import FREEDOM, POISSON, student_tables
from ebbline.operators.diagnostics import expected_max_sharpe
from ebbline.operators.rules import STRATEGIES
from ebbline.operators.stress import SHOCKS

BARS = "bars AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"
DAMPED = BARS + ", damped AS (SELECT asset, date, volume, 100 * pow(price / first_value(price) OVER (PARTITION BY asset ORDER BY date), 0.02) AS price FROM bars)"
RET = ", rets AS (SELECT * FROM (SELECT asset, date, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS r FROM {0}) WHERE r IS NOT NULL)"
RETS = BARS + RET.format("bars")
DAMPED_RETS = DAMPED + RET.format("damped")
BOOK = ", full_days AS (SELECT date FROM rets GROUP BY date HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM rets)), aligned AS (SELECT * FROM rets WHERE date IN (SELECT date FROM full_days)), book AS (SELECT date, sum(r / (SELECT count(DISTINCT asset) FROM rets)) AS r FROM aligned GROUP BY date)"
ORDERS = "panel AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2)"
HOURLY = "hourly AS (SELECT event_type AS asset, date_trunc('hour', ts) AS ts, avg(value) + 1 AS price, count(*) AS volume FROM events GROUP BY 1, 2)"
TICK = "l_extendedprice / l_quantity"
OHLC = f"ohlc AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, arg_min({TICK}, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open, max({TICK}) AS high, min({TICK}) AS low, arg_max({TICK}, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"
DAMPED_OHLC = OHLC + ", dohlc AS (SELECT asset, date, volume, 100 * pow(open / f, 0.02) AS open, 100 * pow(high / f, 0.02) AS high, 100 * pow(low / f, 0.02) AS low, 100 * pow(close / f, 0.02) AS close FROM (SELECT *, first_value(close) OVER (PARTITION BY asset ORDER BY date) AS f FROM ohlc))"
Z99, PHI99, Z95 = -2.3263478740408408, 0.02665214220345808, -1.6448536269514722

#: Tail, one row per asset, of a table t(asset, r).
TAIL = "SELECT asset, count(*) AS n, count(*) FILTER (r <= q) AS tail_n, -first(q) AS var, -avg(r) FILTER (r <= q) AS es FROM (SELECT *, quantile_cont(r, {p}) OVER (PARTITION BY asset) AS q FROM {t}) GROUP BY asset"


def erfc(x: str) -> str:
    t = f"(1 / (1 + 0.5 * {x}))"
    fit = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = f"({fit} * {t} + {c})"
    return f"({t} * exp({fit} - {x} * {x}))"


def cdf(z: str) -> str:
    return f"(CASE WHEN {z} > 0 THEN 1 - {erfc(f'(abs({z}) / sqrt(2.0))')} / 2 ELSE {erfc(f'(abs({z}) / sqrt(2.0))')} / 2 END)"


def backtest(p: float, method: str, z: float = Z99, shape: float = PHI99 / 0.01) -> str:
    if method == "student":
        constants, quantiles, shortfalls = student_tables(p)
        forecast = "avg(r) OVER f AS mean, stddev_samp(r) OVER f AS sd, list(r) OVER f AS past"
        each = f"list_transform(range(1, {len(FREEDOM) + 1}), lambda k: {[250 * c for c in constants]}[k] - {[(nu + 1) / 2 for nu in FREEDOM]}[k] * list_sum(list_transform(past, lambda r: ln(1 + pow((r - mean) / sd, 2) / {[nu - 2 for nu in FREEDOM]}[k]))))"
        windows = f"SELECT asset, date, r, count(*) OVER f AS seen, {forecast} FROM rets WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)"
        chosen = f"SELECT asset, date, r, mean, sd, list_position(l, list_max(l)) AS k FROM (SELECT *, {each} AS l FROM ({windows}) WHERE seen >= 250)"
        return f", bt AS (SELECT asset, date, var_forecast, es_forecast, r AS realised_return, r < -var_forecast AS exception FROM (SELECT *, -(mean + {quantiles}[k] * sd) AS var_forecast, -(mean - {shortfalls}[k] * sd) AS es_forecast FROM ({chosen})))"
    if method == "historical":
        forecast = f"-quantile_cont(r, {p}) OVER f AS var_forecast, list(r) OVER f AS past"
        es = "-list_avg(list_filter(past, lambda x : x <= -var_forecast))"
    else:
        forecast = f"-(avg(r) OVER f + {z} * stddev_samp(r) OVER f) AS var_forecast, -(avg(r) OVER f - {shape} * stddev_samp(r) OVER f) AS es0"
        es = "es0"
    return f", bt AS (SELECT asset, date, var_forecast, {es} AS es_forecast, r AS realised_return, r < -var_forecast AS exception FROM (SELECT asset, date, r, count(*) OVER f AS seen, {forecast} FROM rets WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) WHERE seen >= 250)"


def shortfall_test(confidence: float) -> str:
    """st(asset, z2, p_value, critical, reject) of bt."""
    poisson = " + ".join(f"CAST(u > {p!r} AS INTEGER)" for p in POISSON)
    return f""", sz AS (SELECT asset, count(*) AS days, CASE WHEN count(*) FILTER (exception) = 0 THEN 0.0 ELSE 1 + sum(realised_return / es_forecast) FILTER (exception) / (count(*) * (1 - {confidence})) END AS z2 FROM bt GROUP BY asset),
sa AS (SELECT asset, CAST(date - DATE '1970-01-01' AS BIGINT) AS day, draw, realised_return / es_forecast AS term FROM bt, range(1, 2001) x(draw) WHERE exception),
sb AS (SELECT *, (((day * 48271 + draw * 69621 + 1) % 2147483647) + 2147483647) % 2147483647 AS a FROM sa), sc AS (SELECT *, (a * a + draw * 40692 + 11) % 2147483647 AS b FROM sb),
sd AS (SELECT *, (b * 16807 + day) % 2147483647 AS c FROM sc), se AS (SELECT *, ((c * c + b) % 2147483647) / 2147483647 AS u FROM sd),
sf AS (SELECT asset, draw, sum(term * ({poisson})) AS s FROM se GROUP BY 1, 2),
sg AS (SELECT sf.asset, avg(CAST(1 + s / (days * (1 - {confidence})) >= 0 AS INTEGER)) AS share, quantile_cont(1 + s / (days * (1 - {confidence})), 0.05) AS q FROM sf JOIN sz ON sf.asset = sz.asset GROUP BY 1),
st AS (SELECT sz.asset, z2, CASE WHEN z2 < 0 AND share IS NOT NULL THEN share ELSE 1.0 END AS p_value, coalesce(q, 0.0) AS critical FROM sz LEFT JOIN sg ON sz.asset = sg.asset)"""


COUNTS = ", bc AS (SELECT asset, count(*) AS days, count(*) FILTER (exception) AS exceptions, count(*) FILTER (NOT b AND NOT exception) AS n00, count(*) FILTER (NOT b AND exception) AS n01, count(*) FILTER (b AND NOT exception) AS n10, count(*) FILTER (b AND exception) AS n11 FROM (SELECT *, lag(exception) OVER (PARTITION BY asset ORDER BY date) AS b FROM bt) GROUP BY asset)"
XLOG = "(CASE WHEN {0} = 0 THEN 0.0 ELSE {0} * ln(CASE WHEN {1} > 0 THEN {1} END) END)"


def xlog(n: str, p: str) -> str:
    return XLOG.format(f"({n})", f"({p})")


def rs(sizes: str, source: str = "rets") -> str:
    """pts(asset, size, rs) of rows numbered i of n, for SQL that lists sizes."""
    return f""", nb AS (SELECT asset, r, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM {source}),
sc AS (SELECT DISTINCT asset, n, unnest({sizes}) AS size FROM (SELECT DISTINCT asset, n FROM nb)),
bl AS (SELECT nb.asset, size, nb.n, i, i // size AS block, r FROM nb JOIN sc ON nb.asset = sc.asset WHERE size < nb.n AND i // size < nb.n // size),
dv AS (SELECT *, r - avg(r) OVER (PARTITION BY asset, size, block) AS d FROM bl),
wk AS (SELECT *, sum(d) OVER (PARTITION BY asset, size, block ORDER BY i) AS w FROM dv),
pts AS (SELECT asset, size, avg(g / sd) AS rs FROM (SELECT asset, size, block, max(w) - min(w) AS g, stddev_samp(r) AS sd FROM wk GROUP BY 1, 2, 3) WHERE sd > 1e-10 GROUP BY 1, 2)"""


QUICK = "list_distinct([greatest(10, n // 8), greatest(20, n // 4), greatest(30, n // 2)])"
QUICK_HURST = ", hq AS (SELECT a.asset, CASE WHEN k >= 2 AND a.n >= 20 THEN greatest(0.0, least(1.0, s)) ELSE 0.5 END AS hurst FROM (SELECT DISTINCT asset, n FROM nb) a LEFT JOIN (SELECT asset, regr_slope(ln(rs), ln(size)) AS s, count(*) AS k FROM pts GROUP BY asset) p ON a.asset = p.asset)"


def log_sizes(count: int, share: float, least: int, divisor: int) -> str:
    low, high = f"greatest({least}, floor(n * {share}))", f"(n // {divisor})"
    return f"CASE WHEN {high} >= {low} THEN list_distinct([CAST(floor(pow(10.0, log10({low}) + (log10({high}) - log10({low})) * k / {count - 1}) + 1e-9) AS BIGINT) FOR k IN range({count})]) ELSE [] END"


VOL = ", vr AS (SELECT asset, date, CASE WHEN count(r) OVER f >= 21 THEN stddev_samp(r) OVER f * sqrt(252.0) END AS vol FROM rets WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), vg AS (SELECT asset, arg_max_null(vol, date) AS vol, quantile_cont(vol, 0.5) AS vol_median FROM vr GROUP BY asset), vreg AS (SELECT *, CASE WHEN vol > vol_median THEN 'ESTRÉS' ELSE 'CALMA' END AS regime FROM vg)"

KURT = "(CASE WHEN count(r) OVER f63 >= 63 THEN kurtosis(r) OVER f63 END)"

FEATURES = DAMPED + """, a AS (SELECT asset, date, price, price - lag(price) OVER w AS ch, ln(price / lag(price) OVER w) AS r FROM damped WINDOW w AS (PARTITION BY asset ORDER BY date)),
a2 AS (SELECT *, lag(r, 5) OVER (PARTITION BY asset ORDER BY date) AS r5, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0) END AS up, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0) END AS dn FROM a),
b AS (SELECT *, list(r) OVER f63 AS l63, count(r) OVER f63 AS c63, avg(r) OVER f63 AS m63, stddev_pop(r) OVER f63 AS p63,
 CASE WHEN count(r) OVER f21 >= 21 THEN stddev_samp(r) OVER f21 * sqrt(252.0) END AS v21, CASE WHEN count(r) OVER f63 >= 63 THEN stddev_samp(r) OVER f63 * sqrt(252.0) END AS v63,
 CASE WHEN count(r) OVER f63 >= 63 THEN kurtosis(r) OVER f63 END AS kurt,
 CASE WHEN count(up) OVER f14 >= 14 THEN 100 - 100 / (1 + avg(up) OVER f14 / (avg(dn) OVER f14 + 1e-10)) END AS rsi_14, CASE WHEN count(up) OVER f28 >= 28 THEN 100 - 100 / (1 + avg(up) OVER f28 / (avg(dn) OVER f28 + 1e-10)) END AS rsi_28,
 CASE WHEN count(price) OVER f20 >= 20 THEN (price - (avg(price) OVER f20 - 2 * stddev_samp(price) OVER f20)) / (4 * stddev_samp(price) OVER f20 + 1e-10) - 0.5 END AS bb_pos,
 CASE WHEN count(r) OVER f5 >= 5 THEN sum(r) OVER f5 END AS mom_5, CASE WHEN count(r) OVER f10 >= 10 THEN sum(r) OVER f10 END AS mom_10, CASE WHEN count(r) OVER f21 >= 21 THEN sum(r) OVER f21 END AS mom_21, CASE WHEN count(r) OVER f63 >= 63 THEN sum(r) OVER f63 END AS mom_63,
 CASE WHEN count(r) OVER f5 >= 5 THEN stddev_samp(r) OVER f5 END AS vol_5, CASE WHEN count(r) OVER f21 >= 21 THEN stddev_samp(r) OVER f21 END AS vol_21,
 CASE WHEN count(r) OVER f21 >= 21 THEN corr(r, r5) OVER f16 END AS autocorr_5, lag(r, 1) OVER w AS ret_lag1, lag(r, 2) OVER w AS ret_lag2, lag(r, 3) OVER w AS ret_lag3
 FROM a2 WINDOW w AS (PARTITION BY asset ORDER BY date), f5 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f10 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), f14 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), f16 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), f20 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f21 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), f28 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), f63 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN count(v63) OVER f >= 63 THEN quantile_cont(v63, 0.5) OVER f END AS med, [sum_to FOR sum_to IN [list_sum(list_transform(l63[1:k], lambda x : x - m63)) FOR k IN range(1, 64)]] AS walk FROM b WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, CASE WHEN c63 >= 63 THEN CASE WHEN p63 < 1e-10 THEN 0.5 ELSE greatest(0.0, least(1.0, ln((list_max(walk) - list_min(walk)) / p63) / ln(63.0))) END END AS hurst FROM c)
SELECT asset, date, round(price, 5) AS price, round(r, 5) AS r, round(hurst, 5) AS hurst, round(2 - hurst, 5) AS fractal_dim, round(v21 / (v63 + 1e-10), 5) AS vol_ratio, coalesce(CAST(v21 > med AS INTEGER), 0) AS regimen_vol,
 round(CASE WHEN kurt IS NOT NULL THEN greatest(1.0, least(2.5, 1 + 2 / (abs(kurt) + 3))) END, 5) AS tsallis_q, round(rsi_14, 5) AS rsi_14, round(rsi_28, 5) AS rsi_28, round(bb_pos, 5) AS bb_pos, round(mom_5, 5) AS mom_5, round(mom_10, 5) AS mom_10, round(mom_21, 5) AS mom_21, round(mom_63, 5) AS mom_63, round(vol_5, 5) AS vol_5, round(vol_21, 5) AS vol_21, round(autocorr_5, 5) AS autocorr_5, round(ret_lag1, 5) AS ret_lag1, round(ret_lag2, 5) AS ret_lag2, round(ret_lag3, 5) AS ret_lag3 FROM d"""

SQL: dict[str, str] = {}

SQL["historical_var"] = f"WITH {RETS}{BOOK}, t AS (SELECT asset, r FROM rets UNION ALL SELECT 'book', r FROM book) SELECT asset, n, tail_n, round(var, 6) AS var, round(es, 6) AS es, CASE WHEN tail_n < 5 THEN 'only ' || tail_n || ' returns in the tail' ELSE '' END AS note FROM ({TAIL.format(p=0.01, t='t')}) WHERE n >= 30"
SQL["log_returns"] = f"WITH {RETS} SELECT asset, date, round(r, 6) AS r FROM rets"
SQL["simple_returns"] = f"WITH {BARS} SELECT asset, date, round(r, 6) AS r FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM bars) WHERE r IS NOT NULL"
SQL["monthly_returns"] = f"WITH {BARS}, m AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(price, date) AS price FROM bars GROUP BY 1, 2) SELECT asset, month, round(r, 6) AS r FROM (SELECT asset, month, price / lag(price) OVER (PARTITION BY asset ORDER BY month) - 1 AS r FROM m) WHERE r IS NOT NULL"
SQL["portfolio_returns"] = f"WITH {RETS}{BOOK} SELECT date, round(r, 6) AS r FROM book"
SQL["winsorised_returns"] = f"WITH {BARS} SELECT asset, date, round(greatest(-0.5, least(0.5, r)), 6) AS r FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM bars) WHERE r IS NOT NULL"
SQL["normal_var"] = f"WITH {RETS} SELECT asset, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(-(avg(r) + {Z99} * stddev_samp(r)), 6) AS var, round(-(avg(r) - {PHI99} / 0.01 * stddev_samp(r)), 6) AS es FROM rets GROUP BY asset"
SQL["expected_shortfall_975"] = f"WITH {RETS} SELECT asset, n, round(es, 6) AS es FROM ({TAIL.format(p='1 - 0.975', t='rets')})"
SQL["scaled_horizon_var"] = f"WITH {RETS} SELECT asset, round(var * sqrt(10.0), 6) AS var, round(es * sqrt(10.0), 6) AS es FROM ({TAIL.format(p=0.01, t='rets')})"
EWMA = ", e0 AS (SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i FROM rets), e1 AS (SELECT *, var_samp(r) FILTER (i < 20) OVER (PARTITION BY asset) AS seed FROM e0), e2 AS (SELECT *, pow(0.94, i) * seed + 0.06 * coalesce(sum(r * r * pow(0.94, -(i + 1.0))) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(0.94, i) AS v, pow(0.94, i + 1) * seed + 0.06 * sum(r * r * pow(0.94, -(i + 1.0))) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * pow(0.94, i + 1) AS nv FROM e1)"
SQL["ewma_volatility"] = f"WITH {RETS}{EWMA} SELECT asset, date, round(sqrt(v), 6) AS sigma, round(sqrt(nv), 6) AS next_sigma FROM e2"
SQL["filtered_var"] = f"WITH {RETS}{EWMA}, z AS (SELECT asset, r / sqrt(v) AS r FROM e2), s AS (SELECT asset, sqrt(arg_max(nv, date)) AS sigma FROM e2 GROUP BY asset) SELECT t.asset, n, round(var * sigma, 6) AS var, round(es * sigma, 6) AS es, round(sigma, 6) AS sigma FROM ({TAIL.format(p=0.01, t='z')}) t JOIN s ON t.asset = s.asset"
SQL["return_summary"] = f"WITH {RETS} SELECT asset, count(*) AS n, round(avg(r) * 252, 6) AS mean, round(stddev_samp(r) * sqrt(252.0), 6) AS volatility, round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurtosis, round(min(r), 6) AS least, round(max(r), 6) AS most FROM rets GROUP BY asset"
DRAW = "dd AS (SELECT asset, date, (price - max(price) OVER (PARTITION BY asset ORDER BY date)) / max(price) OVER (PARTITION BY asset ORDER BY date) AS drawdown FROM {0})"
SQL["asset_statistics"] = f"WITH {DAMPED_RETS}, {DRAW.format('damped')}, s AS (SELECT asset, count(*) / 252 AS years, pow(1 + avg(r), 252) - 1 AS annual, stddev_samp(r) * sqrt(252.0) AS vol, skewness(r) AS skew, kurtosis(r) AS kurtosis FROM rets GROUP BY asset), m AS (SELECT asset, min(drawdown) AS max_drawdown FROM dd GROUP BY asset) SELECT s.asset, round(years, 6) AS years, round(annual, 6) AS annual, round(vol, 6) AS vol, round(annual / vol, 6) AS sharpe, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(max_drawdown, 6) AS max_drawdown, round(annual / abs(max_drawdown), 6) AS calmar FROM s JOIN m ON s.asset = m.asset"
PAIRS = ", pm AS (SELECT x.asset AS asset_i, y.asset AS asset_j, count(*) AS n, covar_samp(x.r, y.r) AS covariance, corr(x.r, y.r) AS correlation FROM aligned x JOIN aligned y ON x.date = y.date GROUP BY 1, 2)"
SQL["pair_moments"] = f"WITH {RETS}{BOOK}{PAIRS} SELECT asset_i, asset_j, n, round(covariance, 6) AS covariance, round(correlation, 6) AS correlation FROM pm"
SQL["component_var"] = f"WITH {RETS}{BOOK}{PAIRS}, w AS (SELECT 1.0 / count(DISTINCT asset) AS w FROM rets), b AS (SELECT asset_i AS asset, sum(w * covariance) AS beta, first(w) AS weight FROM pm, w GROUP BY asset_i), v AS (SELECT *, sum(weight * beta) OVER () AS variance FROM b) SELECT asset, round(weight, 6) AS weight, round({-Z99} * beta / sqrt(variance), 6) AS marginal, round(weight * {-Z99} * beta / sqrt(variance), 6) AS component, round(weight * beta / variance, 6) AS pct FROM v"
SQL["incremental_var"] = f"WITH {RETS}{BOOK}, whole AS (SELECT -(avg(r) + {Z99} * stddev_samp(r)) AS v FROM (SELECT date, avg(r) AS r FROM aligned GROUP BY date)), dr AS (SELECT d.asset, date, avg(a.r) AS r FROM aligned a, (SELECT DISTINCT asset FROM rets) d WHERE a.asset <> d.asset GROUP BY 1, 2) SELECT asset, round((SELECT v FROM whole), 6) AS whole_var, round((SELECT v FROM whole) + (avg(r) + {Z99} * stddev_samp(r)), 6) AS incremental FROM dr GROUP BY asset"
SHOW_BT = "SELECT asset, date, round(var_forecast, 6) AS var_forecast, round(es_forecast, 6) AS es_forecast, round(realised_return, 6) AS realised_return, exception FROM bt"
SQL["rolling_historical_backtest"] = f"WITH {RETS}{backtest(0.01, 'historical')} {SHOW_BT}"
SQL["rolling_normal_backtest"] = f"WITH {RETS}{backtest(0.01, 'normal')} {SHOW_BT}"
POF = f"greatest(-2 * ({xlog('days - exceptions', '0.95')} + {xlog('exceptions', '1 - 0.95')} - {xlog('days - exceptions', '1 - exceptions / days')} - {xlog('exceptions', 'exceptions / days')}), 0)"
P01, P11, P1 = "n01 / nullif(n00 + n01, 0)", "n11 / nullif(n10 + n11, 0)", "(n01 + n11) / nullif(n00 + n01 + n10 + n11, 0)"
IND = f"CASE WHEN n01 + n11 = 0 OR n00 + n01 = 0 OR n10 + n11 = 0 THEN 0.0 ELSE greatest(-2 * ({xlog('n00 + n10', f'1 - {P1}')} + {xlog('n01 + n11', P1)} - {xlog('n00', f'1 - {P01}')} - {xlog('n01', P01)} - {xlog('n10', f'1 - {P11}')} - {xlog('n11', P11)}), 0) END"
SQL["coverage_tests"] = f"WITH {RETS}{backtest(0.05, 'normal', Z95, 0.0)}{COUNTS}, l AS (SELECT *, {POF} AS lr_pof, {IND} AS lr_ind FROM bc) SELECT asset, days, exceptions, n00, n01, n10, n11, round(lr_pof, 4) AS lr_pof, round(lr_ind, 4) AS lr_ind, round(lr_pof + lr_ind, 4) AS lr_cc, round({erfc('sqrt(lr_pof / 2)')}, 4) AS p_pof, round({erfc('sqrt(lr_ind / 2)')}, 4) AS p_ind, round(exp(-(lr_pof + lr_ind) / 2), 4) AS p_cc, lr_pof > 3.841458820694124 AS reject_pof, lr_ind > 3.841458820694124 AS reject_ind, lr_pof + lr_ind > 5.991464547107979 AS reject_cc FROM l"
SQL["traffic_light"] = f"WITH {RETS}{backtest(0.01, 'historical')}{COUNTS}, z AS (SELECT *, days / 250 AS s FROM bc) SELECT asset, days, exceptions, CASE WHEN exceptions <= 4 * s THEN 'GREEN' WHEN exceptions >= 10 * s THEN 'RED' ELSE 'YELLOW' END AS zone, CASE WHEN exceptions <= 4 * s THEN 3.0 WHEN exceptions >= 10 * s THEN 4.0 ELSE 3.0 + [0.40, 0.50, 0.65, 0.75, 0.85][CAST(least(greatest(round_even(exceptions / s, 0), 5), 9) AS INTEGER) - 4] END AS multiplier FROM z"
SQL["es_bootstrap"] = f"WITH {RETS}{backtest('1 - 0.975', 'historical')}{shortfall_test(0.975)} SELECT asset, round(z2, 6) AS z2, round(p_value, 6) AS p_value, round(critical, 6) AS critical, p_value < 0.05 AS reject FROM st"
SQL["shortfall_z2"] = f"WITH {RETS}{backtest('1 - 0.975', 'historical')} SELECT asset, count(*) AS days, count(*) FILTER (exception) AS exceptions, round(CASE WHEN count(*) FILTER (exception) = 0 THEN 0.0 ELSE 1 + sum(realised_return / es_forecast) FILTER (exception) / (count(*) * (1 - 0.975)) END, 6) AS z2 FROM bt GROUP BY asset"
SQL["resample_daily"] = f"WITH {HOURLY} SELECT asset, CAST(date_trunc('day', ts) AS DATE) AS bucket, round(arg_min(price, ts), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, ts), 6) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM hourly GROUP BY 1, 2"
SQL["forward_filled"] = f"WITH {BARS}, g AS (SELECT a.asset, d.date, b.price FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON a.asset = b.asset AND d.date = b.date) SELECT asset, date, round(coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS price FROM g"
SQL["drawdown_series"] = f"WITH {BARS}, {DRAW.format('bars')} SELECT asset, date, round(drawdown, 6) AS drawdown FROM dd"
SQL["asof_prices"] = f"WITH {BARS}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, ['A', 'N', 'R'][o_orderkey % 3 + 1] AS asset FROM orders) SELECT o_orderkey, o.asset, round(b.price, 6) AS price FROM o ASOF LEFT JOIN bars b ON o.asset = b.asset AND o.date >= b.date"
SQL["last_rows"] = f"WITH {BARS} SELECT asset, date, round(price, 6) AS price FROM bars QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 20"
SQL["date_slice"] = f"WITH {BARS} SELECT asset, date, round(price, 6) AS price FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'"
SQL["assets_without_weight"] = "SELECT DISTINCT o_orderpriority AS asset FROM orders WHERE o_orderpriority LIKE '1-%'"
SQL["top_moves"] = f"WITH {RETS} SELECT asset, date, round(r, 6) AS r FROM rets ORDER BY abs(rets.r) DESC, asset, date LIMIT 10"
SQL["stress_replay"] = f"WITH {DAMPED_RETS}{BOOK}, s(scenario, a, b) AS (VALUES ('first half 1996', DATE '1996-01-01', DATE '1996-06-30'), ('autumn 1997', DATE '1997-09-01', DATE '1997-11-30'), ('1998', DATE '1998-01-01', DATE '1998-12-31')), x AS (SELECT scenario, date, exp(sum(ln(1 + r)) OVER (PARTITION BY scenario ORDER BY date)) AS level FROM book JOIN s ON date BETWEEN a AND b), y AS (SELECT *, level / max(level) OVER (PARTITION BY scenario ORDER BY date) - 1 AS dd FROM x) SELECT scenario, count(*) AS days, round(arg_max(level, date) - 1, 6) AS pnl, round(min(dd), 6) AS max_drawdown FROM y GROUP BY scenario HAVING count(*) >= 5"
FACTORS = f", {ORDERS}, fr AS (SELECT * FROM (SELECT map {{'1-URGENT': 'equity', '2-HIGH': 'rates', '3-MEDIUM': 'credit', '4-NOT SPECIFIED': 'usd', '5-LOW': 'gold'}}[asset] AS factor, date, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS r FROM panel) WHERE r IS NOT NULL), jb AS (SELECT factor, book.date, book.r AS y, fr.r AS x FROM book JOIN fr ON book.date = fr.date QUALIFY row_number() OVER (PARTITION BY factor ORDER BY book.date DESC) <= 500), betas AS (SELECT factor, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_r2(y, x) AS r2 FROM jb GROUP BY factor HAVING count(*) >= 60)"
SQL["factor_betas"] = f"WITH {RETS}{BOOK}{FACTORS} SELECT factor, n, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM betas"
VALUES = ", ".join(f"('{k}', '{f}', {m})" for k, moves in SHOCKS.items() for f, m in moves.items())
HYPO = f", shocks(scenario, factor, move) AS (VALUES {VALUES}), hypo AS (SELECT scenario, sum(coalesce(beta, 0) * move) AS pnl FROM shocks LEFT JOIN betas ON shocks.factor = betas.factor GROUP BY scenario)"
SQL["stress_hypothetical"] = f"WITH {RETS}{BOOK}{FACTORS}{HYPO} SELECT scenario, round(pnl, 6) AS pnl FROM hypo"
SQL["stress_reverse"] = f"WITH {RETS}{BOOK}{FACTORS}{HYPO} SELECT shocks.scenario, factor, round(-0.10 / pnl, 4) AS scale, round(move * (-0.10 / pnl), 4) AS scaled_move FROM shocks JOIN hypo ON shocks.scenario = hypo.scenario WHERE pnl < 0"
MOMENTS = ", mo AS (SELECT asset, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS g1, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS g2 FROM (SELECT *, avg(r) OVER (PARTITION BY asset) AS m FROM rets) GROUP BY asset HAVING count(*) >= 20), sr AS (SELECT *, mean / sd AS sr, sqrt(1 - g1 * (mean / sd) + (g2 - 1) / 4 * (mean / sd) * (mean / sd)) AS se FROM mo)"
SQL["probabilistic_sharpe"] = f"WITH {RETS}{MOMENTS}, z AS (SELECT *, sr * sqrt(n - 1) / se AS z FROM sr) SELECT asset, n, round(sr * sqrt(252.0), 6) AS sharpe, round({cdf('z')}, 6) AS psr FROM z"
THRESHOLD = expected_max_sharpe(20, 0.5 / 252**0.5)
SQL["deflated_sharpe"] = f"WITH {RETS}{MOMENTS}, z AS (SELECT *, (sr - {THRESHOLD!r}) * sqrt(n - 1) / se AS z FROM sr), p AS (SELECT *, {cdf('z')} AS dsr FROM z) SELECT asset, n, round(sr * sqrt(252.0), 6) AS sharpe, round({THRESHOLD!r} * sqrt(252.0), 6) AS threshold, round(dsr, 6) AS dsr, CASE WHEN dsr >= 0.95 THEN 'credible' WHEN dsr >= 0.5 THEN 'inconclusive' ELSE 'likely overfit' END AS verdict FROM p"
EWM = "list_reduce(list({0}) OVER f, lambda a, x : a * 13 / 14.0 + x / 14.0)"
ADX = f", dm AS (SELECT asset, date, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM dohlc WINDOW w AS (PARTITION BY asset ORDER BY date)), d1 AS (SELECT asset, date, CAST(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS DOUBLE) AS p, CAST(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS DOUBLE) AS m, tr FROM dm), d2 AS (SELECT asset, date, 100 * {EWM.format('p')} / ({EWM.format('tr')} + 1e-10) AS pd, 100 * {EWM.format('m')} / ({EWM.format('tr')} + 1e-10) AS md FROM d1 WINDOW f AS (PARTITION BY asset ORDER BY date)), d3 AS (SELECT *, 100 * abs(pd - md) / (pd + md + 1e-10) AS dx FROM d2), adx AS (SELECT asset, date, {EWM.format('dx')} AS adx, pd - md AS di_diff FROM d3 WINDOW f AS (PARTITION BY asset ORDER BY date))"
SQL["directional_index"] = f"WITH {DAMPED_OHLC}{ADX} SELECT asset, date, round(adx, 6) AS adx, round(di_diff, 6) AS di_diff FROM adx"
BLOCK = "CASE " + " ".join(f"WHEN t >= floor({i} * len / 16) THEN {i}" for i in range(15, 0, -1)) + " ELSE 0 END"
PNL = "tp AS (SELECT l_linenumber AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1, 2), rets AS (SELECT * FROM (SELECT asset, date, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS r FROM tp) WHERE r IS NOT NULL)"
PBO = f"{PNL}{BOOK}, td AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS len FROM full_days), pn AS (SELECT asset AS trial, r AS pnl, {BLOCK} AS block FROM aligned JOIN td USING (date)), ch AS (SELECT range AS choice FROM range(65536) WHERE bit_count(range) = 8), mb AS (SELECT trial, block, count(*) AS n, sum(pnl) AS s, sum(pnl * pnl) AS ss FROM pn GROUP BY 1, 2), sh AS (SELECT choice, trial, (choice >> block) & 1 = 1 AS inside, coalesce(sum(s) / sum(n) / nullif(sqrt((sum(ss) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1)), 0), 0) AS s FROM mb, ch GROUP BY 1, 2, 3), pr AS (SELECT choice, trial, max(s) FILTER (inside) AS i, max(s) FILTER (NOT inside) AS o FROM sh GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY choice ORDER BY i DESC, trial) AS place, count(*) OVER (PARTITION BY choice) AS trials, rank() OVER (PARTITION BY choice ORDER BY o) + (count(*) OVER (PARTITION BY choice, o) - 1) / 2.0 AS rank FROM pr), sp AS (SELECT choice, trial AS best_trial, rank, ln(rank / (trials + 1) / (1 - rank / (trials + 1))) AS logit FROM rk WHERE place = 1)"
SQL["overfitting_splits"] = f"WITH {PBO} SELECT choice, best_trial, rank, round(logit, 6) AS logit FROM sp"
SQL["overfitting_probability"] = f"WITH {PBO} SELECT round(avg(CAST(logit < 0 AS INTEGER)), 6) AS pbo, count(*) AS n_combinations, round(quantile_cont(logit, 0.5), 6) AS median_logit FROM sp"
SQL["purged_folds"] = f"WITH {RETS}, nb AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM rets), f AS (SELECT asset, i, CAST(fold AS INTEGER) AS fold, fold * n // 5 AS a, (fold + 1) * n // 5 AS b FROM nb, range(5) x(fold)), g AS (SELECT asset, i, fold, CASE WHEN i >= a AND i < b THEN 'test' WHEN i < a - 10 OR i >= b + 5 THEN 'train' END AS role FROM f) SELECT asset, fold, role, count(*) AS rows, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM g WHERE role IS NOT NULL GROUP BY 1, 2, 3"
SQL["technical_features"] = "WITH " + FEATURES
BARRIER = "CASE WHEN lead(price, 5) OVER w IS NULL THEN 0 " + " ".join(f"WHEN lead(price, {h}) OVER w / price - 1 >= 0.025 THEN 1 WHEN lead(price, {h}) OVER w / price - 1 <= -0.025 THEN -1" for h in range(1, 6)) + " ELSE 0 END"
SQL["triple_barrier"] = f"WITH {BARS} SELECT asset, date, CAST({BARRIER} AS INTEGER) AS label FROM bars WINDOW w AS (PARTITION BY asset ORDER BY date)"
SQL["fixed_horizon"] = f"WITH {RETS} SELECT asset, date, CAST(CASE WHEN count(r) OVER w >= 5 AND sum(r) OVER w > 0.02 THEN 1 WHEN count(r) OVER w >= 5 AND sum(r) OVER w < -0.02 THEN -1 ELSE 0 END AS INTEGER) AS label FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


SQL["hurst_rs"] = f"WITH {RETS}{rs(log_sizes(20, 0.02, 10, 4))} SELECT asset, round(regr_slope(ln(rs), ln(size)), 5) AS hurst FROM pts GROUP BY asset"
SQL["hurst_quick"] = f"WITH {RETS}{rs(QUICK)}{QUICK_HURST} SELECT asset, round(hurst, 6) AS hurst FROM hq"
SQL["detrended_fluctuation"] = f"WITH {RETS}, nb AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n, sum(r - m) OVER (PARTITION BY asset ORDER BY date) AS p FROM (SELECT *, avg(r) OVER (PARTITION BY asset) AS m FROM rets)), sc AS (SELECT DISTINCT asset, n, unnest({log_sizes(25, 0.01, 10, 5)}) AS size FROM (SELECT DISTINCT asset, n FROM nb)), bl AS (SELECT nb.asset, size, i // size AS block, i, p FROM nb JOIN sc ON nb.asset = sc.asset WHERE i // size < nb.n // size), f AS (SELECT asset, size, avg(rms) AS f FROM (SELECT asset, size, block, sqrt(greatest(regr_syy(p, i) - pow(regr_sxy(p, i), 2) / regr_sxx(p, i), 0) / count(*)) AS rms FROM bl GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT asset, round(regr_slope(ln(f), ln(size)), 5) AS alpha FROM f WHERE f > 0 GROUP BY asset"
SQL["volatility_regime"] = f"WITH {RETS}{VOL} SELECT asset, round(vol, 6) AS vol, round(vol_median, 6) AS vol_median, regime FROM vreg"
SQL["pair_spreads"] = f"WITH {BARS}, p AS (SELECT asset, date, ln(price) AS y FROM bars), j AS (SELECT x.asset AS a, z.asset AS b, x.date, x.y AS y, z.y AS x FROM p x JOIN p z ON x.date = z.date AND x.asset < z.asset), f AS (SELECT a, b, regr_slope(y, x) AS hedge, regr_intercept(y, x) AS lev FROM j GROUP BY 1, 2), s AS (SELECT j.a, j.b, date, hedge, y - hedge * x - lev AS s FROM j JOIN f ON j.a = f.a AND j.b = f.b), l AS (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY date) AS s0 FROM s), o AS (SELECT a, b, count(*) AS n, first(hedge) AS hedge, regr_slope(s - s0, s0) AS pull, (arg_max(s, date) - avg(s)) / stddev_pop(s) AS z FROM l GROUP BY 1, 2) SELECT a, b, n, round(hedge, 5) AS hedge, round(CASE WHEN pull < 0 THEN -ln(2.0) / pull END, 5) AS half_life, round(z, 5) AS z, CASE WHEN z > 2 THEN 'sell ' || a || ', buy ' || b WHEN z < -2 THEN 'buy ' || a || ', sell ' || b ELSE 'none' END AS signal FROM o"
SQL["return_histogram"] = f"WITH {RETS}, e AS (SELECT asset, min(r) AS low, max(r) AS high, count(*) AS n FROM rets GROUP BY asset), b AS (SELECT rets.asset, CAST(least(floor((r - low) / ((high - low) / 100)), 99) AS BIGINT) AS bin, low, (high - low) / 100 AS width, n FROM rets JOIN e ON rets.asset = e.asset) SELECT asset, bin, round(first(low) + (bin + 0.5) * first(width), 5) AS centre, round(count(*) / first(n) / first(width), 5) AS density FROM b GROUP BY asset, bin"
SQL["short_signal"] = f"WITH {RETS}{rs(log_sizes(20, 0.02, 10, 4))}{VOL}, h AS (SELECT asset, regr_slope(ln(rs), ln(size)) AS h FROM pts GROUP BY asset), s AS (SELECT asset, avg(r) / stddev_samp(r) * sqrt(252.0) AS s FROM rets GROUP BY asset), p AS (SELECT h.asset, CASE WHEN h > 0.55 THEN 1 WHEN h < 0.45 THEN -1 ELSE 0 END + CASE WHEN regime = 'CALMA' THEN 1 ELSE -1 END + CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS points FROM h JOIN vreg USING (asset) JOIN s USING (asset)) SELECT asset, points, CASE WHEN points >= 2 THEN 'ALCISTA' WHEN points <= -1 THEN 'BAJISTA/CAUTELA' ELSE 'NEUTRAL' END AS signal FROM p"
TREND = ", l126 AS (SELECT asset, ln(price) AS y, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM (SELECT * FROM damped QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 126)), tr AS (SELECT asset, CASE WHEN count(*) >= 30 THEN (exp(regr_slope(y, i) * 252) - 1) * 100 ELSE 0 END AS trend_pct, CASE WHEN count(*) >= 30 THEN regr_r2(y, i) ELSE 0 END AS r2 FROM l126 GROUP BY asset)"
SQL["trend_regression"] = f"WITH {DAMPED}{TREND} SELECT asset, round(trend_pct, 6) AS trend_pct, round(r2, 6) AS r2 FROM tr"
SQL["average_structure"] = f"WITH {DAMPED}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY asset) AS n FROM damped), m AS (SELECT asset, max(n) AS n, arg_max(price, date) AS p, avg(price) FILTER (k <= 50) AS a, avg(price) FILTER (k <= least(200, n - 1)) AS b FROM k GROUP BY asset), s AS (SELECT asset, CASE WHEN n < 60 THEN 0.0 WHEN p > a AND a > b THEN 1.0 WHEN p < a AND a < b THEN -1.0 WHEN p > a AND p > b THEN 0.5 WHEN p < a AND p < b THEN -0.5 ELSE 0.0 END AS structure_score FROM m) SELECT asset, CASE WHEN structure_score > 0 THEN 'ALCISTA' WHEN structure_score < 0 THEN 'BAJISTA' ELSE 'MIXTA' END AS structure, CAST(structure_score AS DOUBLE) AS structure_score FROM s"
ROWS = ", ".join(f"({', '.join(repr(x) for x in row)})" for row in STRATEGIES)
SQL["strategy_table"] = f"WITH s(regime, kelly_mult, min_confidence, max_positions, w_momentum, w_reversion, w_risk, rsi_buy, rsi_sell) AS (VALUES {ROWS}), m AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'BEAR' WHEN 'N' THEN 'BULL' ELSE 'SIDEWAYS' END AS market FROM lineitem) SELECT regime, market, round(CAST(CASE market WHEN 'BEAR' THEN kelly_mult * 0.5 WHEN 'BULL' THEN least(kelly_mult * 1.15, 1.2) ELSE kelly_mult END AS DOUBLE), 6) AS kelly_mult, round(CAST(CASE market WHEN 'BEAR' THEN least(min_confidence + 0.08, 0.85) WHEN 'BULL' THEN greatest(min_confidence - 0.03, 0.50) ELSE min_confidence END AS DOUBLE), 6) AS min_confidence, CAST(CASE market WHEN 'BEAR' THEN greatest(1, max_positions // 2) ELSE max_positions END AS INTEGER) AS max_positions, round(CAST(CASE market WHEN 'BEAR' THEN w_momentum * 0.7 ELSE w_momentum END AS DOUBLE), 6) AS w_momentum, CAST(w_reversion AS DOUBLE) AS w_reversion, round(CAST(CASE market WHEN 'BEAR' THEN w_risk * 1.3 WHEN 'BULL' THEN w_risk * 0.9 ELSE w_risk END AS DOUBLE), 6) AS w_risk, CAST(CASE market WHEN 'BEAR' THEN rsi_buy - 5 ELSE rsi_buy END AS DOUBLE) AS rsi_buy, CAST(CASE market WHEN 'BEAR' THEN rsi_sell - 5 ELSE rsi_sell END AS DOUBLE) AS rsi_sell FROM s, m"
CONTEXT = DAMPED_RETS + rs(QUICK) + QUICK_HURST + VOL + """, x1 AS (SELECT asset, date, price, volume, price - lag(price) OVER w AS ch, ln(price / lag(price) OVER w) AS r FROM damped WINDOW w AS (PARTITION BY asset ORDER BY date)),
x2 AS (SELECT *, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0) END AS up, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0) END AS dn FROM x1),
x3 AS (SELECT asset, date, price, r, CASE WHEN count(up) OVER f14 >= 14 THEN 100 - 100 / (1 + avg(up) OVER f14 / (avg(dn) OVER f14 + 1e-10)) END AS rsi, CASE WHEN count(price) OVER f20 >= 20 THEN (price - (avg(price) OVER f20 - 2 * stddev_samp(price) OVER f20)) / (4 * stddev_samp(price) OVER f20 + 1e-10) - 0.5 END AS bb, volume / nullif(CASE WHEN count(volume) OVER f20 >= 20 THEN avg(volume) OVER f20 END, 0) AS vr, sum(r) OVER f5 * 100 AS r7, sum(r) OVER f21 * 100 AS r1m
 FROM x2 WINDOW f5 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f14 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), f20 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f21 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
x4 AS (SELECT asset, arg_max_null(price, date) AS price, arg_max_null(r, date) * 100 AS ret_24h, arg_max_null(r7, date) AS ret_7d, arg_max_null(r1m, date) AS ret_1m, arg_max_null(rsi, date) AS rsi, arg_max_null(bb, date) AS bb, coalesce(arg_max_null(vr, date), 1.0) AS volume_ratio, stddev_samp(r) * sqrt(252.0) * 100 AS volatility FROM x3 GROUP BY asset),
ctx AS (SELECT x4.*, hq.hurst, vreg.regime AS stress, 0 AS ml_signal, CAST(0.5 AS DOUBLE) AS ml_prob, 'NEUTRAL' AS whales FROM x4 JOIN hq USING (asset) JOIN vreg USING (asset))"""
CTX_COLUMNS = ", ".join(f"round({c}, 5) AS {c}" for c in "price ret_24h ret_7d ret_1m rsi bb volume_ratio volatility hurst ml_prob".split())
SQL["agent_context"] = f"WITH {CONTEXT} SELECT asset, {CTX_COLUMNS}, stress, ml_signal, whales FROM ctx"
AGENTS = """, pt AS (SELECT *, round_even((CASE WHEN hurst > 0.60 THEN 2.0 WHEN hurst > 0.53 THEN 1.0 ELSE 0 END + CASE WHEN stress = 'CALMA' THEN 1.5 ELSE 0 END + CASE WHEN rsi < 30 THEN 2.0 WHEN rsi < 45 THEN 1.0 ELSE 0 END + CASE WHEN bb < -0.6 THEN 1.5 WHEN bb < 0 THEN 0.5 ELSE 0 END + CASE WHEN volume_ratio > 1.5 THEN 0.5 ELSE 0 END + CASE WHEN ret_7d > 3 THEN 1.0 ELSE 0 END) / 12.0, 3) AS bull,
 round_even((CASE WHEN stress <> 'CALMA' THEN 2.0 ELSE 0 END + CASE WHEN rsi > 70 THEN 2.0 WHEN rsi > 60 THEN 0.8 ELSE 0 END + CASE WHEN volatility > 80 THEN 1.5 WHEN volatility > 50 THEN 0.7 ELSE 0 END + CASE WHEN hurst < 0.42 THEN 1.5 WHEN hurst < 0.48 THEN 0.5 ELSE 0 END + CASE WHEN ret_24h < -3 THEN 1.0 WHEN ret_24h > 5 THEN 0.3 ELSE 0 END + CASE WHEN bb > 0.6 THEN 1.0 ELSE 0 END) / 12.5, 3) AS bear FROM ctx),
ve AS (SELECT *, list_filter([CASE WHEN volatility > 100 THEN 'volatility' END, CASE WHEN stress <> 'CALMA' AND volatility > 60 THEN 'stress' END, CASE WHEN abs(bull - bear) < 0.15 THEN 'balanced' END, CASE WHEN bull > 0.5 AND rsi > 78 THEN 'overbought' END, CASE WHEN bear > 0.5 AND rsi < 22 THEN 'oversold' END], lambda x : x IS NOT NULL) AS v FROM pt),
de AS (SELECT *, len(v) > 0 AS vetoed, bull - bear AS edge, CASE WHEN len(v) > 0 OR abs(bull - bear) < 0.15 THEN 'ESPERAR' WHEN bull > bear THEN 'COMPRAR' ELSE 'VENDER' END AS action FROM ve),
ks AS (SELECT *, CASE WHEN action = 'ESPERAR' THEN 0.0 ELSE greatest(0.0, least(0.20, abs(edge) * 0.25 * CASE WHEN volatility > 80 THEN 0.4 WHEN volatility > 60 THEN 0.6 WHEN volatility > 40 THEN 0.8 ELSE 1.0 END * CASE WHEN stress = 'ESTRÉS' THEN 0.5 ELSE 1.0 END)) END AS kelly_share FROM de)"""
SQL["base_agents"] = f"WITH {CONTEXT}{AGENTS} SELECT asset, round(bull, 6) AS bull, round(bear, 6) AS bear, array_to_string(v, ',') AS vetoes, vetoed, action, round(kelly_share, 6) AS kelly_share FROM ks"
SQL["decision_report"] = f"WITH {CONTEXT}{AGENTS} SELECT action, count(*) AS n, count(*) FILTER (vetoed) AS vetoed, round(avg(abs(edge)) FILTER (NOT vetoed), 6) AS mean_edge FROM ks GROUP BY action"
SQL["quick_signals"] = f"WITH {CONTEXT} SELECT asset, round(price, 5) AS price, round(hurst, 5) AS hurst, round(volatility, 5) AS volatility, round(ret_7d, 5) AS ret_7d, round(ret_1m, 5) AS ret_1m, stress, CASE WHEN hurst > 0.55 AND stress = 'CALMA' THEN 'up' WHEN stress = 'ESTRÉS' THEN 'down' ELSE 'flat' END AS signal FROM ctx"
QTY = "CASE WHEN price > 100 THEN floor(1000.0 / price) ELSE round_even(1000.0 / price, 2) END"
SQL["sized_orders"] = f"WITH {CONTEXT}{AGENTS} SELECT asset, action, CASE WHEN vetoed THEN 'veto' WHEN action = 'ESPERAR' THEN 'wait' WHEN abs(edge) < 0.15 THEN 'confidence' ELSE 'execute' END AS reason, CAST(CASE WHEN {QTY} <= 0 THEN 1.0 ELSE {QTY} END AS DOUBLE) AS qty, round_even(price * (1 - CASE WHEN action = 'COMPRAR' THEN 1.0 ELSE -1.0 END * 0.05), 2) AS stop_price, round_even(price * (1 + CASE WHEN action = 'COMPRAR' THEN 1.0 ELSE -1.0 END * 0.10), 2) AS take_price FROM ks"
SQL["kill_switch"] = "WITH t AS (SELECT event_type AS asset, ts, sum(value - 50) AS pnl FROM events GROUP BY 1, 2), x AS (SELECT *, 10000 + sum(pnl) OVER w AS worth, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER w AS wins, count(*) OVER (PARTITION BY asset ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS last_hour FROM t WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), y AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset, wins ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM x), z AS (SELECT *, bool_or((10000 - worth) / 10000 >= 0.20 OR streak >= 8 OR last_hour >= 60) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blocked FROM y) SELECT asset, count(*) AS n, count(*) FILTER (blocked) AS blocked, CAST(max(streak) AS BIGINT) AS longest_streak, max(last_hour) AS busiest_hour FROM z GROUP BY asset"
SQL["cooldown"] = "WITH t AS (SELECT DISTINCT event_type AS asset, ts FROM events), g AS (SELECT *, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY asset ORDER BY ts))) AS gap FROM t) SELECT asset, count(*) AS n, count(*) FILTER (gap < 3600) AS waiting FROM g GROUP BY asset"
LAST = ", la AS (SELECT asset, arg_max(price, date) AS v FROM panel GROUP BY asset), y AS (SELECT max(v) FILTER (asset = '1-URGENT') AS a, max(v) FILTER (asset = '2-HIGH') AS b, max(v) FILTER (asset = '3-MEDIUM') AS c, max(v) FILTER (asset = '4-NOT SPECIFIED') AS d FROM la)"
SQL["yield_curve"] = f"WITH {ORDERS}{LAST} SELECT round(c - a, 4) AS slope, round(c - b, 4) AS slope_10y_5y, round(2 * b - a - d, 4) AS curvature, c - a < 0 AS inverted, CASE WHEN c - a < 0 THEN 'inverted' WHEN c - a < 0.5 THEN 'flat' ELSE 'steep' END AS reading FROM y"
CREDIT = ", ra AS (SELECT a.date, ln((a.price / b.price) / lag(a.price / b.price) OVER (ORDER BY a.date)) AS r FROM panel a JOIN panel b ON a.date = b.date AND a.asset = '3-MEDIUM' AND b.asset = '4-NOT SPECIFIED'), rr AS (SELECT date, CASE WHEN count(r) OVER f >= 20 THEN sum(r) OVER f END AS s20, sum(r) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s60 FROM (SELECT * FROM ra WHERE r IS NOT NULL) WINDOW f AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), cl AS (SELECT arg_max(s20, date) AS s20, arg_max(s60, date) AS s60 FROM rr), cp AS (SELECT first(cl.s20) AS ret_20d, first(cl.s60) AS ret_60d, avg(CAST(rr.s20 < cl.s20 AS INTEGER)) AS percentile FROM rr, cl WHERE rr.s20 IS NOT NULL)"
SQL["credit_proxy"] = f"WITH {ORDERS}{CREDIT} SELECT round(ret_20d, 6) AS ret_20d, round(ret_60d, 6) AS ret_60d, round(percentile, 6) AS percentile, CASE WHEN percentile < 0.2 THEN 'stressed' WHEN percentile > 0.8 THEN 'strong' ELSE 'normal' END AS reading FROM cp"
SQL["macro_regime"] = f"WITH {ORDERS}{LAST}{CREDIT}, dl AS (SELECT arg_max(price, date) / avg(price) AS q FROM (SELECT * FROM panel WHERE asset = '5-LOW' ORDER BY date DESC LIMIT 50)), p AS (SELECT CASE WHEN a / b > 1 THEN -2.0 WHEN a > 25 THEN -1.0 ELSE 1.0 END AS p1, CASE WHEN percentile < 0.20 THEN -2.0 WHEN percentile > 0.70 THEN 1.0 ELSE 0.0 END AS p2, CASE WHEN c - a < 0 THEN -1.0 ELSE 0.5 END AS p3, CASE WHEN q > 1.005 THEN -1.0 WHEN q < 0.995 THEN 0.5 ELSE 0.0 END AS p4 FROM y, cp, dl), s AS (SELECT greatest(-1, least(1, (p1 + p2 + p3 + p4) / 5)) AS score, array_to_string(list_filter([CASE WHEN p1 < 0 THEN '-volatility' WHEN p1 > 0 THEN '+volatility' END, CASE WHEN p2 < 0 THEN '-credit' WHEN p2 > 0 THEN '+credit' END, CASE WHEN p3 < 0 THEN '-curve' WHEN p3 > 0 THEN '+curve' END, CASE WHEN p4 < 0 THEN '-dollar' WHEN p4 > 0 THEN '+dollar' END], lambda x : x IS NOT NULL), ',') AS signals FROM p) SELECT round(CAST(score AS DOUBLE), 6) AS score, signals, CASE WHEN score < -0.3 THEN 'RISK-OFF' WHEN score > 0.3 THEN 'RISK-ON' ELSE 'NEUTRAL' END AS regime FROM s"
SQL["cross_correlations"] = f"WITH {ORDERS}{RET.format('panel')}, j AS (SELECT b.asset AS other, b.r, a.r AS x FROM rets a JOIN rets b ON a.date = b.date AND a.asset = '1-URGENT' AND b.asset IN ('2-HIGH', '3-MEDIUM') QUALIFY row_number() OVER (PARTITION BY b.asset ORDER BY b.date DESC) <= 60) SELECT other, count(*) AS n, round(corr(r, x), 6) AS correlation FROM j GROUP BY other HAVING count(*) >= 20"
SQL["order_book_ratio"] = "SELECT l_returnflag AS symbol, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / l_quantity * l_quantity ELSE 0 END) / (sum(CASE WHEN l_linenumber % 2 <> 0 THEN l_extendedprice / l_quantity * l_quantity ELSE 0 END) + 1e-10), 3) AS ratio FROM lineitem GROUP BY 1"
SQL["large_trades"] = "WITH t AS (SELECT l_returnflag AS symbol, l_extendedprice * l_quantity AS v, l_linestatus = 'F' AS m FROM lineitem WHERE l_extendedprice * l_quantity >= 1000000), g AS (SELECT symbol, count(*) AS n, sum(CASE WHEN NOT m THEN v ELSE 0 END) AS bought, sum(CASE WHEN m THEN v ELSE 0 END) AS sold FROM t GROUP BY symbol) SELECT symbol, n, round(bought, 4) AS bought, round(sold, 4) AS sold, round(bought / (sold + 1e-10), 4) AS ratio, CASE WHEN bought / (sold + 1e-10) > 1.5 THEN 'ALCISTA' WHEN bought / (sold + 1e-10) < 0.67 THEN 'BAJISTA' ELSE 'NEUTRAL' END AS signal FROM g"
SQL["microstructure"] = f"WITH {HOURLY}, f AS (SELECT asset, avg((price - 50) / 50000) AS m FROM (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC) <= 21) GROUP BY asset), b AS (SELECT asset, (arg_max(price, ts) - 50) / 50 AS basis, CASE WHEN arg_max(price / 50, ts) > 1.5 THEN 'LARGOS' WHEN arg_max(price / 50, ts) < 0.8 THEN 'CORTOS' ELSE 'EQUILIBRADO' END AS bias FROM hourly GROUP BY asset), o AS (SELECT asset, arg_max(volume, ts) / arg_min(volume, ts) - 1 AS c FROM (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC) <= 8) GROUP BY asset) SELECT f.asset, round(m, 6) AS funding, CASE WHEN m > 0.0005 THEN 'LONGS SATURADOS' WHEN m < -0.0003 THEN 'SHORTS SATURADOS' ELSE 'NEUTRAL' END AS funding_signal, round(basis, 6) AS basis, round(c, 6) AS oi_change, bias, CASE WHEN m > 0.0005 AND c > 0.05 THEN 'long squeeze risk' WHEN m < -0.0003 THEN 'short squeeze possible' WHEN c < -0.10 THEN 'deleveraging' ELSE 'no extremes' END AS reading FROM f JOIN b ON f.asset = b.asset JOIN o ON f.asset = o.asset"
SQL["breadth"] = f"WITH {RETS}, g AS (SELECT date AS day, count(*) FILTER (r > 0) AS risers, count(*) AS n FROM rets GROUP BY date) SELECT day, risers, n, CASE WHEN risers * 10 > n * 7 THEN 'ALCISTA' WHEN risers * 10 < n * 3 THEN 'BAJISTA' ELSE 'NEUTRAL' END AS mood FROM g"
SQL["parsed_klines"] = f"WITH {OHLC} SELECT asset AS symbol, date, floor(open * 10000 + 0.5) / 10000 AS open, floor(high * 10000 + 0.5) / 10000 AS high, floor(low * 10000 + 0.5) / 10000 AS low, floor(close * 10000 + 0.5) / 10000 AS close, round(volume, 4) AS volume FROM ohlc"
SQL["parsed_props"] = "WITH p AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events) SELECT event_type, key, count(*) AS n, round(avg(try_cast(json_extract_string(props, '$.' || key) AS DOUBLE)), 4) AS mean FROM p GROUP BY 1, 2"
SQL["normalised_tickers"] = "WITH t AS (SELECT DISTINCT ' ' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || CASE WHEN p_size % 2 = 0 THEN '-usd' ELSE '' END AS ticker FROM part), u AS (SELECT ticker, upper(trim(ticker)) AS u FROM t) SELECT ticker, regexp_matches(u, '(-USD|USDT)$') AS is_crypto, CASE WHEN regexp_matches(u, '(-USD|USDT)$') THEN regexp_replace(u, '(-USD|USDT)$', '') || 'USDT' ELSE u END AS symbol, CASE WHEN regexp_matches(u, '(-USD|USDT)$') THEN regexp_replace(u, '(-USD|USDT)$', '') || '-USD' ELSE u END AS yahoo FROM u"
SQL["trade_summary"] = "SELECT o_orderpriority AS asset, count(*) AS trades, count(*) FILTER (o_orderstatus = 'O') AS bought, count(*) FILTER (o_orderstatus = 'F') AS sold, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1"
SQL["last_trades"] = "WITH o AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS ts, count(*) AS n FROM orders GROUP BY 1, 2) SELECT asset, ts, n, CAST(row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS INTEGER) AS place FROM o QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC) <= 15"
SQL["style_factors"] = f"WITH {ORDERS}{RET.format('panel')}, m AS (SELECT date, r AS m FROM rets WHERE asset = '1-URGENT') SELECT date, 'MKT' AS factor, round(m, 6) AS r FROM m UNION ALL SELECT rets.date, asset, round(r - m, 6) FROM rets JOIN m ON rets.date = m.date WHERE asset <> '1-URGENT'"
