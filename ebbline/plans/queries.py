"""Queries of the risk and time-series operators. Doubles are rounded to six decimals for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.operators import backtest, diagnostics, econo, learning, macro, matrices, micro, models, risk, rolling, rules, stress
from ebbline.operators import series as ts
from ebbline.sources import market, sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def returns(spark, d) -> DataFrame:
    return ts.log_returns(market.bars(spark, d))


def damped_returns(spark, d) -> DataFrame:
    return ts.log_returns(market.damped_bars(spark, d))


def book(spark, d) -> DataFrame:
    r = returns(spark, d)
    return ts.portfolio_returns(r, ts.equal_weights(r))


@query
def historical_var(spark, d):
    r = returns(spark, d)
    both = r.unionByName(book(spark, d).withColumn("asset", F.lit("book")))
    return rounded(risk.historical_var(both).select("asset", "n", "tail_n", "var", "es", F.coalesce("note", F.lit("")).alias("note")))


@query
def log_returns(spark, d):
    return rounded(returns(spark, d))


@query
def simple_returns(spark, d):
    return rounded(ts.simple_returns(market.bars(spark, d)))


@query
def monthly_returns(spark, d):
    return rounded(ts.monthly_returns(market.bars(spark, d)))


@query
def portfolio_returns(spark, d):
    return rounded(book(spark, d))


@query
def winsorised_returns(spark, d):
    return rounded(ts.winsorised(ts.simple_returns(market.bars(spark, d)), -0.5, 0.5))


@query
def normal_var(spark, d):
    return rounded(risk.normal_var(returns(spark, d)))


@query
def expected_shortfall_975(spark, d):
    return rounded(risk.tail(returns(spark, d), 0.975).select("asset", "n", "es"))


@query
def scaled_horizon_var(spark, d):
    return rounded(risk.historical_var(returns(spark, d), horizon=10).select("asset", "var", "es"))


@query
def ewma_volatility(spark, d):
    out = risk.ewma_variance(returns(spark, d))
    return rounded(out.select("asset", "date", F.sqrt("variance").alias("sigma"), F.sqrt("next_variance").alias("next_sigma")))


@query
def filtered_var(spark, d):
    return rounded(risk.filtered_var(returns(spark, d)))


@query
def return_summary(spark, d):
    return rounded(risk.summary(returns(spark, d)))


@query
def asset_statistics(spark, d):
    return rounded(risk.asset_statistics(market.damped_bars(spark, d)))


@query
def pair_moments(spark, d):
    return rounded(risk_moments(spark, d))


def risk_moments(spark, d) -> DataFrame:
    return ts.pair_moments(returns(spark, d))


@query
def component_var(spark, d):
    r = returns(spark, d)
    return rounded(risk.component_var(ts.pair_moments(r), ts.equal_weights(r)))


@query
def incremental_var(spark, d):
    r = returns(spark, d)
    return rounded(risk.incremental_var(r, ts.equal_weights(r)))


@query
def rolling_historical_backtest(spark, d):
    return rounded(backtest.rolling_backtest(returns(spark, d)))


@query
def rolling_normal_backtest(spark, d):
    return rounded(backtest.rolling_backtest(returns(spark, d), method="normal"))


@query
def coverage_tests(spark, d):
    counts = backtest.exception_counts(backtest.rolling_backtest(returns(spark, d), confidence=0.95, method="normal"))
    return rounded(backtest.coverage_tests(counts, 0.95), 4)


@query
def traffic_light(spark, d):
    return rounded(backtest.traffic_light(backtest.exception_counts(backtest.rolling_backtest(returns(spark, d)))).select("asset", "days", "exceptions", "zone", "multiplier"))


@query
def shortfall_z2(spark, d):
    return rounded(backtest.shortfall_z2(backtest.rolling_backtest(returns(spark, d), confidence=0.975), 0.975))


@query
def resample_daily(spark, d):
    return rounded(ts.resample_ohlc(market.hourly_events(spark, d), "day").withColumn("bucket", F.to_date("bucket")))


@query
def forward_filled(spark, d):
    """Bars on every date that any asset has, with gaps filled forward and the start filled back."""
    b = market.bars(spark, d).select("asset", "date", "price")
    grid = b.select("date").distinct().join(F.broadcast(b.select("asset").distinct()))
    return rounded(ts.forward_fill(grid.join(b, ["asset", "date"], "left"), ["price"], back=True))


@query
def drawdown_series(spark, d):
    return rounded(ts.drawdowns(market.bars(spark, d)).select("asset", "date", "drawdown"))


@query
def asof_prices(spark, d):
    """Each order with the latest daily price of its clerk group's asset before it: weekday bars against other days."""
    orders = market.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.element_at(F.split(F.lit("A,N,R"), ","), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("asset"))
    quotes = market.bars(spark, d).select("asset", F.col("date").cast("timestamp").alias("ts"), "price")
    return rounded(ts.asof_join(orders, quotes, "price").select("o_orderkey", "asset", "price"))


@query
def last_rows(spark, d):
    return rounded(ts.last_rows(market.bars(spark, d), 20).select("asset", "date", "price"))


@query
def date_slice(spark, d):
    return rounded(ts.date_slice(market.bars(spark, d), "1996-01-01", "1996-03-31").select("asset", "date", "price"))


@query
def assets_without_weight(spark, d):
    r = market.daily_orders(spark, d)
    weights = r.select("asset").distinct().filter("asset not like '1-%'").withColumn("weight", F.lit(1.0))
    return ts.missing_weights(r, weights)


@query
def top_moves(spark, d):
    r = returns(spark, d)
    return rounded(r.orderBy(F.abs("r").desc(), "asset", "date").limit(10))


SCENARIOS = {"first half 1996": ("1996-01-01", "1996-06-30"), "autumn 1997": ("1997-09-01", "1997-11-30"), "1998": ("1998-01-01", "1998-12-31")}


@query
def stress_replay(spark, d):
    r = damped_returns(spark, d)
    return rounded(stress.replay(ts.portfolio_returns(r, ts.equal_weights(r)), stress.scenario_table(spark, SCENARIOS)))


def factor_panel(spark, d) -> DataFrame:
    """Log returns of the mean order price per priority, as factors."""
    names = dict(zip(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ["equity", "rates", "credit", "usd", "gold"], strict=True))
    mapped = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return ts.log_returns(market.daily_orders(spark, d)).select("date", F.coalesce(F.element_at(mapped, F.col("asset")), F.col("asset")).alias("factor"), "r")


@query
def factor_betas(spark, d):
    return rounded(stress.single_betas(book(spark, d), factor_panel(spark, d)))


@query
def stress_hypothetical(spark, d):
    return rounded(stress.hypothetical(stress.single_betas(book(spark, d), factor_panel(spark, d)), stress.shock_table(spark)))


@query
def stress_reverse(spark, d):
    return rounded(stress.reverse(stress.single_betas(book(spark, d), factor_panel(spark, d)), stress.shock_table(spark)), 4)


@query
def factor_model(spark, d):
    return rounded(stress.factor_model(book(spark, d), factor_panel(spark, d), ["credit", "equity", "gold"]))


@query
def probabilistic_sharpe(spark, d):
    return rounded(diagnostics.probabilistic_sharpe(returns(spark, d)))


@query
def deflated_sharpe(spark, d):
    return rounded(diagnostics.deflated_sharpe(returns(spark, d)))


def trial_pnl(spark, d) -> DataFrame:
    """Daily log return of each asset and line number as a trial's profit, on the days that all trials have."""
    lines = market.table(spark, d, "lineitem")
    price = lines.groupBy((F.col("l_linenumber")).alias("trial"), F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    r = ts.aligned(ts.log_returns(price.withColumnRenamed("trial", "asset")))
    days = r.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)
    return r.join(days, "date").select("t", F.col("asset").alias("trial"), F.col("r").alias("pnl"))


@query
def overfitting_splits(spark, d):
    return rounded(diagnostics.overfitting_splits(trial_pnl(spark, d)))


@query
def overfitting_probability(spark, d):
    return rounded(diagnostics.overfitting_probability(trial_pnl(spark, d)))


@query
def purged_folds(spark, d):
    rows = econo.numbered(returns(spark, d)).select("asset", "i", "n")
    return diagnostics.purged_folds(rows, 5, 10, 5).groupBy("asset", "fold", "role").agg(F.count("*").alias("rows"), F.min("i").alias("first"), F.max("i").alias("last"))


@query
def technical_features(spark, d):
    return rounded(rolling.features(market.damped_bars(spark, d)), 5)


@query
def triple_barrier(spark, d):
    return rolling.triple_barrier(market.bars(spark, d)).select("asset", "date", "label")


@query
def fixed_horizon(spark, d):
    return rolling.fixed_horizon(returns(spark, d)).select("asset", "date", "label")


@query
def directional_index(spark, d):
    return rounded(rolling.directional_index(market.damped_ohlcv(spark, d)))


@query
def hurst_rs(spark, d):
    return rounded(econo.hurst_rs(returns(spark, d)), 5)


@query
def hurst_quick(spark, d):
    return rounded(econo.hurst_quick(returns(spark, d)))


@query
def detrended_fluctuation(spark, d):
    return rounded(econo.dfa(returns(spark, d)), 5)


@query
def volatility_regime(spark, d):
    return rounded(econo.volatility_regime(returns(spark, d)))


@query
def pair_spreads(spark, d):
    return rounded(econo.pair_spreads(market.bars(spark, d)), 5)


@query
def return_histogram(spark, d):
    return rounded(econo.histogram(returns(spark, d)), 5)


@query
def short_signal(spark, d):
    r = returns(spark, d)
    sharpes = diagnostics.probabilistic_sharpe(r).select("asset", "sharpe")
    return econo.short_signal(econo.hurst_rs(r), econo.volatility_regime(r), sharpes).select("asset", "points", "signal")


@query
def trend_regression(spark, d):
    return rounded(rules.trend(market.damped_bars(spark, d)))


@query
def average_structure(spark, d):
    return rounded(rules.average_structure(market.damped_bars(spark, d)))


@query
def directional_regime(spark, d):
    return rounded(rules.directional_regime(market.damped_ohlcv(spark, d)), 4)


@query
def strategy_table(spark, d):
    """Strategy parameters of every regime under every market."""
    regimes = rules.strategies(spark).select("regime")
    markets = market.table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "BEAR").when(F.col("l_returnflag") == "N", "BULL").otherwise("SIDEWAYS").alias("market")).distinct()
    return rounded(rules.with_strategy(regimes.join(markets), "market").drop("strategy"))


@query
def agent_context(spark, d):
    return rounded(rules.agent_context(market.damped_bars(spark, d)), 5)


@query
def base_agents(spark, d):
    out = rules.base_agents(rules.agent_context(market.damped_bars(spark, d)))
    return rounded(out.select("asset", "bull", "bear", F.concat_ws(",", "vetoes").alias("vetoes"), "vetoed", "action", "kelly_share"))


@query
def adaptive_agents(spark, d):
    reg = rules.directional_regime(market.damped_ohlcv(spark, d))
    # The regime of asset N is the market's.
    reg = reg.join(F.broadcast(reg.filter("asset = 'N'").select(F.col("regime").alias("market"))))
    out = rules.adaptive_agents(rules.agent_context(market.damped_bars(spark, d)), reg, "market")
    return rounded(out.select("asset", "regime", "bull", "bear", F.concat_ws(",", "vetoes").alias("vetoes"), "vetoed", "action", "kelly_share"))


@query
def decision_report(spark, d):
    return rounded(rules.decision_report(rules.base_agents(rules.agent_context(market.damped_bars(spark, d)))))


@query
def quick_signals(spark, d):
    return rounded(rules.quick_signals(rules.agent_context(market.damped_bars(spark, d))), 5)


@query
def sized_orders(spark, d):
    return rounded(rules.sized_orders(rules.base_agents(rules.agent_context(market.damped_bars(spark, d))), 10_000.0))


def event_trades(spark, d) -> DataFrame:
    """Events as executed trades: profit is the value's distance from 50."""
    return market.table(spark, d, "events").select(F.col("event_type").alias("asset"), "ts", "event_id", (F.col("value") - 50).alias("pnl"))


@query
def kill_switch(spark, d):
    trades = event_trades(spark, d).groupBy("asset", "ts").agg(F.sum("pnl").alias("pnl"))
    out = rules.kill_switch(trades, 10_000.0, per_hour=60)
    return out.groupBy("asset").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), F.max("streak").cast("long").alias("longest_streak"), F.max("last_hour").alias("busiest_hour"))


@query
def cooldown(spark, d):
    out = rules.cooled_down(event_trades(spark, d).select("asset", "ts").distinct(), 1)
    return out.groupBy("asset").agg(F.count("*").alias("n"), F.count_if("waiting").alias("waiting"))


MACRO = {"short": "1-URGENT", "five": "2-HIGH", "ten": "3-MEDIUM", "thirty": "4-NOT SPECIFIED", "other": "5-LOW"}


@query
def macro_regime(spark, d):
    p = market.daily_orders(spark, d)
    vol, credit = macro.volatility_term(p, MACRO["short"], MACRO["five"]), macro.credit_proxy(p, MACRO["ten"], MACRO["thirty"])
    return rounded(macro.macro_regime(vol, credit, macro.yield_curve(p, MACRO["short"], MACRO["five"], MACRO["ten"], MACRO["thirty"]), macro.dollar_trend(p, MACRO["other"])))


@query
def yield_curve(spark, d):
    return rounded(macro.yield_curve(market.daily_orders(spark, d), MACRO["short"], MACRO["five"], MACRO["ten"], MACRO["thirty"]), 4)


@query
def credit_proxy(spark, d):
    return rounded(macro.credit_proxy(market.daily_orders(spark, d), MACRO["ten"], MACRO["thirty"]))


@query
def cross_correlations(spark, d):
    return rounded(macro.cross_correlations(market.daily_orders(spark, d), MACRO["short"], [MACRO["five"], MACRO["ten"]]))


@query
def order_book_ratio(spark, d):
    """Line items as book levels: even line numbers bid."""
    levels = market.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("side"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"))
    return micro.order_book_ratio(levels)


@query
def large_trades(spark, d):
    trades = market.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), (F.col("l_linestatus") == "F").alias("buyer_is_maker"))
    return rounded(micro.large_trades(trades, 1_000_000.0), 4)


def hourly(spark, d) -> DataFrame:
    return market.hourly_events(spark, d)


@query
def microstructure(spark, d):
    """Funding, basis, open interest and crowd readings from hourly series."""
    h = hourly(spark, d)
    fund = micro.funding(h.select("asset", "ts", ((F.col("price") - 50) / 50_000).alias("rate")))
    bas = micro.basis(h.select("asset", "ts", F.col("price").alias("mark"), F.lit(50.0).alias("index_price")))
    interest = micro.open_interest_change(h.select("asset", "ts", F.col("volume").cast("double").alias("value")))
    crowd = micro.crowd_bias(h.select("asset", "ts", (F.col("price") / 50).alias("ratio")))
    return rounded(micro.microstructure(fund, bas, interest, crowd))


@query
def breadth(spark, d):
    r = returns(spark, d)
    return micro.breadth(r.select(F.col("date").alias("day"), "asset", F.col("r").alias("change")), "day")


@query
def parsed_klines(spark, d):
    """Bars through the exchange's JSON form and back."""
    b = market.ohlcv(spark, d).withColumn("ms", F.unix_millis(F.col("date").cast("timestamp")))
    # Rounded by plain arithmetic first, so that no form of printing decides halves.
    b = b.withColumns({c: F.floor(F.col(c) * 10_000 + 0.5) / 10_000 for c in ("open", "high", "low", "close")})
    text = F.format_string("[[%d,\"%.4f\",\"%.4f\",\"%.4f\",\"%.4f\",\"%.2f\"]]", "ms", "open", "high", "low", "close", "volume")
    out = micro.parse_klines(b.select(F.col("asset").alias("symbol"), text.alias("body")))
    return rounded(out.select("symbol", F.to_date("ts").alias("date"), "open", "high", "low", "close", "volume"), 4)


@query
def parsed_props(spark, d):
    """Events per key of their JSON properties, and the mean of numeric ones."""
    props = market.table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rounded(props.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.avg(F.expr("try_cast(value as double)")).alias("mean")), 4)


@query
def normalised_tickers(spark, d):
    names = market.table(spark, d, "part").select(F.concat(F.lit(" "), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.when(F.col("p_size") % 2 == 0, "-usd").otherwise("")).alias("ticker")).distinct()
    return micro.normalised_tickers(names)




@query
def student_var(spark, d):
    return models.student_var(returns(spark, d))


@query
def evt_var(spark, d):
    return models.evt_var(returns(spark, d))


@query
def garch(spark, d):
    return models.garch(returns(spark, d))


@query
def garch_filtered_var(spark, d):
    return models.garch_filtered_var(returns(spark, d))


def simulated(spark, d, nu) -> DataFrame:
    r = returns(spark, d)
    return models.monte_carlo_var(ts.pair_moments(r), ts.aligned(r).groupBy("asset").agg(F.avg("r").alias("mean")), ts.equal_weights(r), nu=nu)


@query
def monte_carlo_var(spark, d):
    return simulated(spark, d, None)


@query
def monte_carlo_student_var(spark, d):
    return simulated(spark, d, 5.0)


@query
def es_bootstrap(spark, d):
    return rounded(backtest.shortfall_test(backtest.rolling_backtest(returns(spark, d), confidence=0.975)))


@query
def compare_methods(spark, d):
    """VaR and ES of every estimator for each asset."""
    r = returns(spark, d)
    parts = {"historical": risk.historical_var(r), "normal": risk.normal_var(r), "student": models.student_var(r), "filtered": risk.filtered_var(r), "evt": models.evt_var(r)}
    out = None
    for name, part in parts.items():
        rows = part.select("asset", F.lit(name).alias("method"), "var", "es")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def shrunk_covariance(spark, d):
    return rounded(models.shrunk_covariance(returns(spark, d)))


@query
def cleaned_correlation(spark, d):
    return matrices.cleaned_correlation(ts.log_returns(market.daily_orders(spark, d)))


@query
def entropy_portfolio(spark, d):
    return models.entropy_portfolio(returns(spark, d))


@query
def spectral_cycles(spark, d):
    return rounded(models.cycles(market.bars(spark, d)))


@query
def tsallis_fit(spark, d):
    return models.tsallis(econo.histogram(returns(spark, d)))


@query
def bubble_fit(spark, d):
    return models.bubble(market.damped_bars(spark, d))


@query
def quantum_well(spark, d):
    return models.quantum_well(returns(spark, d))


@query
def hurst_consensus(spark, d):
    return rounded(econo.hurst_consensus(returns(spark, d)), 5)


@query
def long_signal(spark, d):
    b = market.damped_bars(spark, d)
    return econo.long_signal(econo.hurst_consensus(ts.log_returns(b)), models.bubble(b), risk.asset_statistics(b))


@query
def walk_forward_model(spark, d):
    """Predictions of forests that are trained on the past only, anew each 21 rows."""
    return learning.walk_forward(learning.labelled(market.damped_bars(spark, d)))


@query
def model_backtest(spark, d):
    return models.backtest_engine(learning.walk_forward(learning.labelled(market.damped_bars(spark, d))))


@query
def latest_prediction(spark, d):
    bars = market.damped_bars(spark, d)
    return learning.latest_prediction(learning.labelled(bars), ts.last_rows(rolling.features(bars), 1))


@query
def feature_importance(spark, d):
    return learning.importance(learning.labelled(market.damped_bars(spark, d)))


@query
def trade_summary(spark, d):
    """Orders as trades: open ones bought, filled ones sold."""
    orders = market.table(spark, d, "orders")
    action = F.when(F.col("o_orderstatus") == "O", "COMPRAR").when(F.col("o_orderstatus") == "F", "VENDER").otherwise("ESPERAR")
    return sinks.trade_summary(orders.select(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("ts"), action.alias("action")))


@query
def last_trades(spark, d):
    orders = market.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("ts")).agg(F.count("*").alias("n"))
    return sinks.last_trades(orders, 15)


@query
def style_factors(spark, d):
    from ebbline.sources.factors import excess_over_market

    return rounded(excess_over_market(ts.log_returns(market.daily_orders(spark, d)), "1-URGENT"))
