"""Cross-sectional queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sqltext as S
from tidemark.catalog.registry import query
from tidemark.operators import panel as P
from tidemark.operators.calendar import calendar_of
from tidemark.sources import derive as D
from tidemark.sources.staging import kept, shares_readings, stage

matched = kept("matched")(D.matched_panel)


def stocks(spark, d):
    """The stock panel; a job that shares its readings has it beside flow and capitalisation."""
    return matched(spark, d) if shares_readings() else stage(D.stock_panel(spark, d), "stock")


def users(spark, d):
    return stage(D.dense_panel(spark, d), "dense")

def slotted(bars):
    """Number the eight three-hour bars of a day."""
    return bars.withColumn("slot", F.floor(F.hour(F.col("bar_end") - F.expr("INTERVAL 3 HOURS")) / 3) + 1)


def _breadth_sql(g: str, cond: str) -> str:
    x = f"CASE WHEN {cond} THEN ret END"
    return f"""count({x}) AS {g}_active_rows, avg(CASE WHEN {cond} THEN (ret > 0)::INT END) AS {g}_up_fraction,
  avg(CASE WHEN {cond} THEN (ret < 0)::INT END) AS {g}_down_fraction, avg({x}) AS {g}_mean_return, quantile_cont({x}, 0.5) AS {g}_median_return,
  sum(CASE WHEN {cond} AND ret < 0 THEN amount ELSE 0 END)/nullif(sum(CASE WHEN {cond} THEN amount END), 0) AS {g}_down_amount_fraction,
  avg(CASE WHEN {cond} THEN (ret <= -0.02)::INT END) AS {g}_large_down_fraction"""


BREADTH_DAY = f"""
src AS (SELECT trade_date, count(*) AS source_rows, count(*) FILTER (market NOT IN ('SH','SZ')) AS excluded_exchange_rows FROM stock GROUP BY 1),
brd AS (SELECT trade_date, {_breadth_sql('all', 'true')}, {_breadth_sql('shanghai', "market = 'SH'")} FROM act GROUP BY 1)"""
_G = ("active_rows:i", "up_fraction:f", "down_fraction:f", "mean_return:f", "median_return:f", "down_amount_fraction:f", "large_down_fraction:f")
BREADTH_SPEC = "trade_date:d source_rows:i excluded_exchange_rows:i " + " ".join(f"{g}_{c}" for g in ("all", "shanghai") for c in _G)


@query("a1_market_breadth", BREADTH_SPEC, S.with_(S.STOCK, BREADTH_DAY) + "SELECT * FROM src LEFT JOIN brd USING (trade_date)")
def a1(spark, d):
    """Advance/decline measures per session for the market and one exchange."""
    return P.market_breadth(stocks(spark, d))


DISTRIBUTION_DAY = """
dq AS (SELECT trade_date, count(*) AS active_rows, quantile_cont(ret, 0.01) AS q01, quantile_cont(ret, 0.1) AS q10, quantile_cont(ret, 0.25) AS q25,
    quantile_cont(ret, 0.75) AS q75, quantile_cont(ret, 0.9) AS q90, quantile_cont(ret, 0.99) AS q99 FROM act GROUP BY 1),
dr AS (SELECT act.trade_date, amount, greatest(q01, least(q99, ret)) AS x, row_number() OVER (PARTITION BY act.trade_date ORDER BY amount DESC, code) AS rk, active_rows
  FROM act JOIN dq USING (trade_date)),
dist AS (SELECT dq.trade_date, any_value(dq.active_rows) AS active_rows, any_value(q10) AS q10, any_value(q90) AS q90, any_value(q75 - q25) AS iqr,
    sum(x*amount)/sum(amount) - avg(x) AS amount_return_gap,
    sum(CASE WHEN rk <= greatest(1, ceil(dr.active_rows/10.0)) THEN amount ELSE 0 END)/sum(amount) AS amount_top_decile
  FROM dq JOIN dr USING (trade_date) GROUP BY 1)"""


@query("a2_return_distribution", "trade_date:d active_rows:i q10:f q90:f iqr:f amount_return_gap:f amount_top_decile:f",
       S.with_(S.STOCK, DISTRIBUTION_DAY) + "SELECT * FROM dist")
def a2(spark, d):
    """Return quantiles, turnover tilt of clipped returns and turnover concentration."""
    return P.return_distribution(stocks(spark, d))


TRANSITION_DAY = """
nums AS (SELECT code, session_no, trade_date, ret FROM act JOIN cal USING (trade_date)),
trans AS (SELECT n.trade_date, count(*) AS matched_rows, avg((p.ret > 0 AND n.ret < 0)::INT) AS advance_to_decline,
    avg((p.ret < 0 AND n.ret < 0)::INT) AS decline_persistence, avg((p.ret < 0 AND n.ret > 0)::INT) AS decline_to_advance
  FROM nums n JOIN nums p ON n.code = p.code AND n.session_no = p.session_no + 1 GROUP BY 1)"""
TRANSITION_SPEC = "trade_date:d matched_rows:i advance_to_decline:f decline_persistence:f decline_to_advance:f"


@query("a3_state_transitions", TRANSITION_SPEC, S.with_(S.DENSE, TRANSITION_DAY) + "SELECT * FROM trans")
def a3(spark, d):
    """Direction changes between consecutive sessions."""
    p = D.dense_panel(spark, d)
    return P.state_transitions(p, calendar_of(p))


FLOW_DAY = """
fgate AS (SELECT trade_date, avg(ok::INT) >= 0.98 AND sum(CASE WHEN ok THEN amount ELSE 0 END)/sum(amount) >= 0.98 AS enough FROM mf GROUP BY 1),
frank AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, code) <= greatest(1, ceil(count(*) OVER (PARTITION BY trade_date)/10.0)) AS top FROM mf WHERE ok),
fall AS (SELECT trade_date, count(*) AS active_rows, count(gross) AS matched_rows, avg(ok::INT) AS stock_coverage,
    sum(CASE WHEN ok THEN amount ELSE 0 END)/sum(amount) AS amount_coverage,
    sum(lg)/sum(gross) AS large_net_ratio, sum(sm)/sum(gross) AS small_net_ratio, avg((lg < 0)::INT) AS large_selling_fraction,
    sum(CASE WHEN lg < 0 THEN gross ELSE 0 END)/sum(gross) AS large_selling_amount_fraction, quantile_cont(CASE WHEN ok THEN ratio END, 0.5) AS large_net_median,
    avg((lg < 0 AND sm > 0)::INT) AS large_small_divergence,
    sum(CASE WHEN market = 'SH' THEN lg END)/sum(CASE WHEN market = 'SH' THEN gross END) - sum(lg)/sum(gross) AS shanghai_relative,
    sum(CASE WHEN ret > 0 AND lg < 0 THEN gross ELSE 0 END)/sum(gross) AS up_sell_amount_fraction,
    sum(CASE WHEN ret < 0 AND lg > 0 THEN gross ELSE 0 END)/sum(gross) AS down_buy_amount_fraction,
    sum(CASE WHEN top THEN lg END)/sum(CASE WHEN top THEN gross END) AS high_turnover_large_ratio,
    sum(CASE WHEN NOT top THEN lg END)/sum(CASE WHEN NOT top THEN gross END) AS other_turnover_large_ratio
  FROM mf LEFT JOIN frank USING (code, trade_date) GROUP BY 1),
fday AS (SELECT fall.* REPLACE (""" + ", ".join(f"CASE WHEN enough THEN {m} END AS {m}" for m in (*P.FLOW_MEASURES, *P.PRICE_FLOW_MEASURES)) + """)
  FROM fall JOIN fgate USING (trade_date))"""
_COV = "trade_date:d active_rows:i matched_rows:i stock_coverage:f amount_coverage:f "


@query("a4_order_flow", _COV + " ".join(f"{m}:f" for m in P.FLOW_MEASURES), S.with_(S.STOCK, S.FLOW, FLOW_DAY) + "SELECT * FROM fday")
def a4(spark, d):
    """Order-size flow measures, unknown where coverage is short."""
    return P.order_flow(matched(spark, d))


@query("a5_coverage_gate", "trade_date:d stock_coverage:f amount_coverage:f passes:b",
       S.with_(S.STOCK, S.FLOW, FLOW_DAY) + "SELECT trade_date, stock_coverage, amount_coverage, enough AS passes FROM fall JOIN fgate USING (trade_date)")
def a5(spark, d):
    """Coverage of the flow panel by count and by turnover with its verdict."""
    m = P.matched_flow(D.matched_panel(spark, d))
    ok = F.col("matched")
    day = m.groupBy("trade_date").agg(P.mean_of(ok).alias("stock_coverage"), P.share(P.sum_if(ok, F.col("amount")), F.sum("amount")).alias("amount_coverage"))
    return day.withColumn("passes", F.least("stock_coverage", "amount_coverage") >= P.MIN_COVERAGE)


@query("a6_price_conditioned_flow", _COV + " ".join(f"{m}:f" for m in P.PRICE_FLOW_MEASURES), S.with_(S.STOCK, S.FLOW, FLOW_DAY) + "SELECT * FROM fday")
def a6(spark, d):
    """Flow conditioned on price direction and on turnover rank."""
    return P.order_flow(matched(spark, d), price_context=True)


CAP_DAY = """
cm AS (SELECT mf.*, CASE WHEN total_mv > 0 THEN total_mv END AS cap FROM mf LEFT JOIN cap USING (code, trade_date) WHERE market = 'SH'),
crank AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY cap DESC, code) <= greatest(1, ceil(count(*) OVER (PARTITION BY trade_date)/10.0)) AS top FROM cm WHERE ok AND cap IS NOT NULL),
call AS (SELECT trade_date, count(*) AS active_rows, count(gross) AS matched_rows, avg((cap IS NOT NULL)::INT) AS basic_stock_coverage, avg(ok::INT) AS flow_stock_coverage,
    sum(CASE WHEN ok THEN amount ELSE 0 END)/sum(amount) AS flow_amount_coverage, sum(CASE WHEN ok THEN cap ELSE 0 END)/sum(cap) AS flow_cap_coverage,
    sum(CASE WHEN ok THEN (ret > 0)::INT*cap END)/sum(CASE WHEN ok THEN cap END) AS cap_up_fraction, sum(CASE WHEN ok THEN ret*cap END)/sum(CASE WHEN ok THEN cap END) AS cap_return,
    sum(CASE WHEN ok THEN (ret > 0)::INT*cap END)/sum(CASE WHEN ok THEN cap END) - avg(CASE WHEN ok THEN (ret > 0)::INT END) AS cap_vs_equal_up,
    sum(CASE WHEN ok THEN ratio*cap END)/sum(CASE WHEN ok THEN cap END) AS cap_net_ratio, sum(CASE WHEN ok THEN (lg < 0)::INT*cap END)/sum(CASE WHEN ok THEN cap END) AS cap_selling_fraction,
    sum(CASE WHEN top THEN lg END)/sum(CASE WHEN top THEN gross END) AS large_cap_net_ratio,
    sum(CASE WHEN top IS NOT TRUE THEN lg END)/sum(CASE WHEN top IS NOT TRUE THEN gross END) AS small_cap_net_ratio
  FROM cm LEFT JOIN crank USING (code, trade_date) GROUP BY 1),
cday AS (SELECT trade_date, active_rows, matched_rows, basic_stock_coverage, flow_stock_coverage,
    CASE WHEN basic_stock_coverage = 1 THEN flow_amount_coverage END AS flow_amount_coverage, CASE WHEN basic_stock_coverage = 1 THEN flow_cap_coverage END AS flow_cap_coverage,
    basic_stock_coverage = 1 AND least(flow_stock_coverage, flow_amount_coverage, flow_cap_coverage) >= 0.98 AND matched_rows >= 2 AS ready,
    """ + ", ".join(f"CASE WHEN ready THEN {m} END AS {m}" for m in P.CAP_MEASURES) + """ FROM call),
cpd AS (SELECT trade_date, count(*) AS active_rows, avg((cap IS NOT NULL)::INT) AS basic_stock_coverage,
    sum((ret > 0)::INT*cap)/sum(cap) AS u, sum(ret*cap)/sum(cap) AS r, avg((ret > 0)::INT) AS e FROM cm GROUP BY 1),
cprice AS (SELECT trade_date, active_rows, basic_stock_coverage, CASE WHEN basic_stock_coverage = 1 THEN u END AS cap_up_fraction,
    CASE WHEN basic_stock_coverage = 1 THEN r END AS cap_return, CASE WHEN basic_stock_coverage = 1 THEN u - e END AS cap_vs_equal_up FROM cpd)"""


@query("a7_capital_flow", "trade_date:d active_rows:i matched_rows:i basic_stock_coverage:f flow_amount_coverage:f flow_cap_coverage:f " + " ".join(f"{m}:f" for m in P.CAP_MEASURES),
       S.with_(S.STOCK, S.FLOW, S.CAP, CAP_DAY) + "SELECT * FROM cday")
def a7(spark, d):
    """Capitalisation-weighted breadth and flow of one exchange."""
    return P.capital_flow(matched(spark, d))


@query("a8_capital_prices", "trade_date:d active_rows:i basic_stock_coverage:f cap_up_fraction:f cap_return:f cap_vs_equal_up:f",
       S.with_(S.STOCK, S.FLOW, S.CAP, CAP_DAY) + "SELECT * FROM cprice")
def a8(spark, d):
    """Capitalisation-weighted same-day prices."""
    return P.capital_prices(D.matched_panel(spark, d))


FUTURES_DAY = """
fm AS (SELECT *, row_number() OVER (PARTITION BY product, trade_date ORDER BY vol DESC, ts_code) AS rk, row_number() OVER (PARTITION BY product, trade_date ORDER BY mon) AS mk FROM fut),
fday AS (SELECT fm.product, fm.trade_date, count(*) AS contract_rows, max(CASE WHEN rk = 1 THEN ts_code END) AS main_contract,
    max(CASE WHEN rk = 1 THEN fm.close END)/any_value(spot.close) - 1 AS basis,
    max(CASE WHEN rk = 1 THEN fm.close END)/any_value(spot.close) - max(CASE WHEN rk = 1 THEN fm.pre_close END)/any_value(spot.pre_close) AS basis_change,
    sum(fm.close*oi)/sum(oi)/any_value(spot.close) - 1 AS weighted_basis,
    (max(CASE WHEN mk = 2 THEN fm.close END) - max(CASE WHEN mk = 1 THEN fm.close END))/any_value(spot.close)/(max(CASE WHEN mk = 2 THEN mon END) - max(CASE WHEN mk = 1 THEN mon END)) AS curve_per_month,
    sum(oi) AS open_interest, sum(vol) AS volume, sum(vol)/sum(oi) AS turnover,
    max(CASE WHEN rk = 1 THEN fm.close/fm.pre_close END) - any_value(spot.close)/any_value(spot.pre_close) AS excess_return
  FROM fm JOIN spot USING (trade_date) GROUP BY 1, 2)"""


@query("a9_futures_curve", "product:s trade_date:d contract_rows:i main_contract:s basis:f basis_change:f weighted_basis:f curve_per_month:f open_interest:f2 volume:f2 turnover:f excess_return:f",
       S.with_(S.FUTURES, FUTURES_DAY) + "SELECT * FROM fday")
def a9(spark, d):
    """Basis, curve slope and activity per product from dated contracts."""
    return P.futures_curve(D.futures_daily(spark, d), D.spot_series(spark, d))


OPTION_DAY = """
oday AS (SELECT trade_date, count(*) AS contract_rows, """ + ", ".join(
    f"count(*) FILTER (call_put = '{s}') AS {s}_contract_rows, sum(vol) FILTER (call_put = '{s}') AS {s}_volume, sum(amount) FILTER (call_put = '{s}') AS {s}_amount, sum(oi) FILTER (call_put = '{s}') AS {s}_interest"
    for s in "PC") + " FROM opt GROUP BY 1)"


@query("a10_option_activity", "trade_date:d contract_rows:i P_contract_rows:i P_volume:f2 P_amount:f2 P_interest:f2 C_contract_rows:i C_volume:f2 C_amount:f2 C_interest:f2",
       S.with_(S.OPTION, OPTION_DAY) + "SELECT * FROM oday")
def a10(spark, d):
    """Put and call activity per session."""
    return P.option_activity(D.option_daily(spark, d))


POSITION_DAY = """
op0 AS (SELECT *, delist_date - trade_date <= 30 AS near, call_put = 'P' AS put FROM opt),
pos AS (SELECT trade_date, sum(CASE WHEN near AND put THEN oi ELSE 0 END)/nullif(sum(CASE WHEN near THEN oi ELSE 0 END), 0) AS near_put_interest_share,
    sum(CASE WHEN NOT near AND put THEN oi ELSE 0 END)/nullif(sum(CASE WHEN NOT near THEN oi ELSE 0 END), 0) AS far_put_interest_share,
    CASE WHEN sum(CASE WHEN near THEN oi ELSE 0 END) > 0 THEN sum(CASE WHEN near THEN oi ELSE 0 END)/sum(oi) END AS near_interest_share,
    near_put_interest_share - far_put_interest_share AS put_interest_term_spread FROM op0 GROUP BY 1),
on0 AS (SELECT opt.*, session_no, opt.call_put = 'P' AS put FROM opt JOIN ocal USING (trade_date)),
otot AS (SELECT session_no + 1 AS session_no, sum(oi) AS t FROM on0 GROUP BY 1),
om AS (SELECT n.session_no, count(*) AS k, sum(p.oi) AS prior, sum(CASE WHEN n.put THEN n.oi - p.oi ELSE 0 END) AS dp, sum(CASE WHEN NOT n.put THEN n.oi - p.oi ELSE 0 END) AS dc,
    sum(CASE WHEN n.put THEN p.oi ELSE 0 END) AS pp, sum(CASE WHEN NOT n.put THEN p.oi ELSE 0 END) AS pc
  FROM on0 n JOIN on0 p ON n.ts_code = p.ts_code AND n.session_no = p.session_no + 1 GROUP BY 1),
mint AS (SELECT trade_date, coalesce(k, 0) AS matched_contract_rows, coalesce(prior, 0)/t AS matched_prior_interest_coverage, CASE WHEN pp > 0 THEN dp/pp END AS matched_put_interest_growth,
    CASE WHEN pc > 0 THEN dc/pc END AS matched_call_interest_growth, CASE WHEN prior > 0 THEN (dp - dc)/prior END AS matched_interest_imbalance
  FROM ocal JOIN otot USING (session_no) LEFT JOIN om USING (session_no))"""


@query("a11_option_positions", "trade_date:d near_put_interest_share:f far_put_interest_share:f near_interest_share:f put_interest_term_spread:f",
       S.with_(S.OPTION, POSITION_DAY) + "SELECT * FROM pos")
def a11(spark, d):
    """Put share of open interest by expiry bucket."""
    return P.option_positions(D.option_daily(spark, d))


@query("a12_matched_interest", "trade_date:d matched_contract_rows:i matched_prior_interest_coverage:f matched_put_interest_growth:f matched_call_interest_growth:f matched_interest_imbalance:f",
       S.with_(S.OPTION, POSITION_DAY) + "SELECT * FROM mint")
def a12(spark, d):
    """Open-interest change of contracts matched with the previous session."""
    o = D.option_daily(spark, d)
    return P.matched_interest(o, calendar_of(o))


TREND_DAY = """
tn AS (SELECT act.*, session_no FROM act JOIN cal USING (trade_date) WHERE ret > -1),
tr AS (SELECT *, session_no - row_number() OVER (PARTITION BY code ORDER BY session_no) AS run FROM tn),
tm AS (SELECT *, """ + ", ".join(
    f"CASE WHEN row_number() OVER (PARTITION BY code, run ORDER BY session_no) >= {n} THEN exp(sum(ln(1 + ret)) OVER (PARTITION BY code, run ORDER BY session_no ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) - 1 END AS m{n}"
    for n in (3, 5, 10)) + """ FROM tr),
td AS (SELECT trade_date, session_no, count(*) AS active_rows, """ + ", ".join(
    f"count(m{n}) AS eligible_{n}_rows, count(m{n})/count(*) AS stock_coverage_{n}, sum(CASE WHEN m{n} IS NOT NULL THEN amount ELSE 0 END)/sum(amount) AS amount_coverage_{n}, avg((m{n} > 0)::INT) AS trend_up_{n}_fraction"
    for n in (3, 5, 10)) + """,
    sum(CASE WHEN m5 < 0 THEN amount ELSE 0 END)/nullif(sum(CASE WHEN m5 IS NOT NULL THEN amount END), 0) AS trend_negative_5_amount_fraction,
    avg(CASE WHEN m5 IS NOT NULL THEN coalesce(m3 < 0 AND m5 > 0, false)::INT END) AS trend_weakening_fraction,
    avg(CASE WHEN market = 'SH' THEN (m5 > 0)::INT END) - avg((m5 > 0)::INT) AS trend_shanghai_relative_5, quantile_cont(m5, 0.5) AS trend_return_5_median
  FROM tm GROUP BY 1, 2),
trend AS (SELECT a.*, a.trend_up_5_fraction - b.trend_up_5_fraction AS trend_up_5_change_5,
    least(""" + ", ".join(f"a.{k}_coverage_{n}" for n in (3, 5, 10) for k in ("stock", "amount")) + """) >= 0.9 AND a.trend_up_3_fraction IS NOT NULL AND a.trend_up_5_fraction IS NOT NULL AND a.trend_up_10_fraction IS NOT NULL
      AND a.trend_negative_5_amount_fraction IS NOT NULL AND a.trend_weakening_fraction IS NOT NULL AND a.trend_shanghai_relative_5 IS NOT NULL AND a.trend_return_5_median IS NOT NULL AND trend_up_5_change_5 IS NOT NULL AS trend_available
  FROM td a LEFT JOIN td b ON a.session_no = b.session_no + 5)"""
TREND_FEATURES = ("trend_up_3_fraction", "trend_up_5_fraction", "trend_up_10_fraction", "trend_negative_5_amount_fraction", "trend_weakening_fraction",
                  "trend_shanghai_relative_5", "trend_up_5_change_5", "trend_return_5_median")


@query("a13_trend_breadth", "trade_date:d active_rows:i " + " ".join(f"eligible_{n}_rows:i stock_coverage_{n}:f amount_coverage_{n}:f" for n in (3, 5, 10)) + " "
       + " ".join(f"{c}:f" for c in TREND_FEATURES) + " trend_available:b", S.with_(S.DENSE, TREND_DAY) + "SELECT * FROM trend")
def a13(spark, d):
    """Trend breadth over unbroken runs; windows scaled to the 30-day panel."""
    p = users(spark, d)
    return P.trend_breadth(p, calendar_of(p), (3, 5, 10))


INTRADAY_DAY = """
mv AS (SELECT *, ln(close/coalesce(lag(close) OVER (PARTITION BY series_id, trade_date ORDER BY slot), open)) AS move FROM slots),
path AS (SELECT series_id, trade_date, count(*) AS bar_rows, max(CASE WHEN slot = 8 THEN close END)/max(CASE WHEN slot = 7 THEN close END) - 1 AS last_bar_return,
    max(CASE WHEN slot = 8 THEN close END)/max(CASE WHEN slot = 4 THEN close END) - 1 AS afternoon_return,
    last_bar_return - (max(CASE WHEN slot = 1 THEN close END)/max(CASE WHEN slot = 1 THEN open END) - 1) AS late_minus_early_return,
    sqrt(sum(move*move)) AS realized_vol, CASE WHEN sum(move*move) > 0 THEN sum(CASE WHEN move < 0 THEN move*move ELSE 0 END)/sum(move*move) ELSE 0 END AS downside_variance_share,
    sum(CASE WHEN slot = 8 THEN amount ELSE 0 END)/sum(amount) AS last_bar_amount_share, sum(CASE WHEN slot > 4 THEN amount ELSE 0 END)/sum(amount) AS afternoon_amount_share,
    max(CASE WHEN slot = 8 THEN close END)/avg(close) - 1 AS close_vs_mean FROM mv GROUP BY 1, 2 HAVING count(*) = 8)"""


@query("a14_intraday_path", "series_id:s trade_date:d bar_rows:i " + " ".join(f"{m}:f" for m in P.INTRADAY_MEASURES), S.with_(S.BARS, INTRADAY_DAY) + "SELECT * FROM path")
def a14(spark, d):
    """Path measures from eight interval-end bars per session."""
    return P.intraday_path(slotted(D.intraday_bars(spark, d)))


@query("a15_period_summaries", "grain:s period:s rows:i up_fraction:f mean_return:f",
       S.with_(S.STOCK) + """SELECT CASE WHEN m IS NULL THEN 'year' ELSE 'month' END AS grain, coalesce(m, y) AS period, count(*) AS rows, avg((ret > 0)::INT) AS up_fraction, avg(ret) AS mean_return
  FROM (SELECT strftime(trade_date, '%Y') AS y, strftime(trade_date, '%Y%m') AS m, ret FROM act) GROUP BY GROUPING SETS ((y), (y, m))""")
def a15(spark, d):
    """Year and month summaries; days are reduced to months before the grouping sets expand them."""
    act = P.active_rows(D.stock_panel(spark, d))
    month = act.groupBy(F.date_format("trade_date", "yyyyMM").alias("m")).agg(
        F.count("*").alias("n"), F.sum((F.col("ret") > 0).cast("int")).alias("up"), F.sum("ret").alias("s"))
    month = month.withColumn("y", F.substring("m", 1, 4))
    both = month.groupingSets([["y"], ["y", "m"]], "y", "m").agg(
        F.sum("n").alias("rows"), (F.sum("up") / F.sum("n")).alias("up_fraction"), (F.sum("s") / F.sum("n")).alias("mean_return"))
    return both.select(F.when(F.col("m").isNull(), "year").otherwise("month").alias("grain"), F.coalesce("m", "y").alias("period"), "rows", "up_fraction", "mean_return")


@query("a16_effective_sample", "trade_date:d effective_rows:f largest_share:f",
       S.with_(S.STOCK) + "SELECT trade_date, pow(sum(abs(ret)), 2)/nullif(sum(ret*ret), 0) AS effective_rows, max(abs(ret))/nullif(sum(abs(ret)), 0) AS largest_share FROM act GROUP BY 1")
def a16(spark, d):
    """Effective sample size and largest weight share of magnitude weights."""
    act = P.active_rows(D.stock_panel(spark, d))
    n, top = P.effective_sample(F.abs("ret"))
    return act.groupBy("trade_date").agg(n.alias("effective_rows"), top.alias("largest_share"))
