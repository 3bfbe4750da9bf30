"""Feature-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import panels as C
from tidemark.catalog import sqltext as S
from tidemark.catalog.registry import query
from tidemark.catalog.series import HISTORY
from tidemark.operators import panel as P
from tidemark.operators import series as Q
from tidemark.operators.calendar import calendar_of
from tidemark.plans import features as X
from tidemark.sources import derive as D
from tidemark.sources.staging import kept
from tidemark.sources.streams import STREAM_KEYS, base_stream, forecast_streams


def _f(*names: str) -> str:
    return " ".join(f"{n}:f" for n in names)


def win(agg: str, x: str, n: int, part: str = "") -> str:
    return S.full(agg, x, n, part, "session_no")


def dif(x: str, n: int = 1, part: str = "") -> str:
    return f"({x}) - {S.lag(x, n, part, 'session_no')}"


def gro(x: str, n: int = 1, part: str = "") -> str:
    return S.growth(x, n, part, "session_no")


def aligned(prefix: str, cols: dict[str, str], day: str, lag: int, cal: str = "cal", keys: str = "", signals: str | None = None) -> str:
    """CTEs and final SELECT that compute `cols` over day and align them `lag` sessions back."""
    k = f"{keys}, " if keys else ""
    signals = signals or f"SELECT {k}trade_date FROM {day}"
    feats = ", ".join(f"{e} AS {prefix}_{n}" for n, e in cols.items())
    on = f"f.session_no = c.session_no - {lag}" + "".join(f" AND f.{x.strip()} = g.{x.strip()}" for x in keys.split(",") if x)
    ok = " AND ".join(f"{prefix}_{n} IS NOT NULL" for n in cols)
    gk = "".join(f"g.{x.strip()}, " for x in keys.split(",") if x)
    return f""",
grid_ AS ({f'''SELECT b.*, {cal}.trade_date, session_no FROM (SELECT {keys}, min(session_no) AS lo, max(session_no) AS hi FROM {day} JOIN {cal} USING (trade_date) GROUP BY {keys}) b JOIN {cal} ON session_no BETWEEN lo AND hi''' if keys else f'SELECT * FROM {cal}'}),
dense_ AS (SELECT grid_.session_no, d.*{f' EXCLUDE ({keys}, trade_date), ' + ", ".join("grid_." + x.strip() for x in keys.split(",")) if keys else ''} FROM grid_ LEFT JOIN {day} d ON d.trade_date = grid_.trade_date{"".join(f" AND d.{x.strip()} = grid_.{x.strip()}" for x in keys.split(",") if x)}),
feat_ AS (SELECT {k}session_no, {feats} FROM dense_),
sig_ AS ({signals})
SELECT {gk}g.trade_date, s.trade_date AS {prefix}_source_date, f.* EXCLUDE (session_no{', ' + keys if keys else ''}), {ok} AS {prefix}_available
FROM sig_ g LEFT JOIN {cal} c ON c.trade_date = g.trade_date LEFT JOIN {cal} s ON s.session_no = c.session_no - {lag} LEFT JOIN feat_ f ON {on}"""


def spec(prefix: str, cols: dict[str, str], keys: str = "") -> str:
    return f"{keys}trade_date:d {prefix}_source_date:d {prefix}_available:b " + _f(*[f"{prefix}_{n}" for n in cols])


BREADTH = {}
for _g in ("all", "shanghai"):
    BREADTH |= {f"{_g}_{m}": f"{_g}_{m}" for m in ("up_fraction", "down_fraction", "median_return", "mean_return", "down_amount_fraction", "large_down_fraction")}
    BREADTH |= {f"{_g}_up_change_1": dif(f"{_g}_up_fraction"), f"{_g}_up_mean_5": win("avg", f"{_g}_up_fraction", 5), f"{_g}_up_mean_20": win("avg", f"{_g}_up_fraction", 20)}
BREADTH["shanghai_relative"] = "shanghai_up_fraction - all_up_fraction"


@kept("stock-calendar")
def stock_calendar(spark, d):
    return calendar_of(D.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")))


@query("f1_breadth_features", spec("breadth", BREADTH), S.with_(S.STOCK, C.BREADTH_DAY) + aligned("breadth", BREADTH, "brd", 1, signals="SELECT trade_date FROM cal"))
def f1(spark, d):
    """Market breadth of the session before each signal, with changes and means."""
    cal = stock_calendar(spark, d)
    return X.breadth_features(cal.select("trade_date"), P.market_breadth(C.stocks(spark, d)), cal, lag=1)


DIST = {n: n for n in ("q10", "q90", "iqr", "amount_return_gap", "amount_top_decile", "advance_to_decline", "decline_persistence", "decline_to_advance")}
DIST |= {"q10_change_1": dif("q10"), "advance_to_decline_mean_5": win("avg", "advance_to_decline", 5)}


@query("f2_distribution_features", spec("distribution", DIST),
       S.with_(S.DENSE, C.DISTRIBUTION_DAY, C.TRANSITION_DAY, "both_ AS (SELECT * FROM dist LEFT JOIN trans USING (trade_date))") + aligned("distribution", DIST, "both_", 0, signals="SELECT trade_date FROM cal"))
def f2(spark, d):
    """Return distribution and state transitions of the same session."""
    p = C.users(spark, d)
    cal = calendar_of(p)
    day = P.return_distribution(p).join(P.state_transitions(p, cal).drop("matched_rows"), "trade_date", "left")
    return X.distribution_features(cal.select("trade_date"), day, cal)


FLOW = {n: n for n in (*P.FLOW_MEASURES, *P.PRICE_FLOW_MEASURES)}
FLOW |= {"large_net_change_1": dif("large_net_ratio"), "large_net_mean_5": win("avg", "large_net_ratio", 5), "large_net_mean_20": win("avg", "large_net_ratio", 20),
         "up_sell_mean_5": win("avg", "up_sell_amount_fraction", 5), "down_buy_mean_5": win("avg", "down_buy_amount_fraction", 5)}


@query("f3_moneyflow_features", spec("moneyflow", FLOW), S.with_(S.STOCK, S.FLOW, C.FLOW_DAY) + aligned("moneyflow", FLOW, "fday", 1, signals="SELECT trade_date FROM cal"))
def f3(spark, d):
    """Gated order-flow features of the session before."""
    cal = stock_calendar(spark, d)
    return X.moneyflow_features(cal.select("trade_date"), P.order_flow(C.matched(spark, d), price_context=True), cal, price_context=True)


CAPS = {n: n for n in P.CAP_MEASURES} | {"cap_net_mean_5": win("avg", "cap_net_ratio", 5), "cap_return_mean_5": win("avg", "cap_return", 5), "cap_up_change_1": dif("cap_up_fraction")}


@query("f4_capital_features", spec("capital", CAPS), S.with_(S.STOCK, S.FLOW, S.CAP, C.CAP_DAY) + aligned("capital", CAPS, "cday", 1, signals="SELECT trade_date FROM cal"))
def f4(spark, d):
    """Capitalisation-weighted features of the session before."""
    cal = stock_calendar(spark, d)
    return X.capital_features(cal.select("trade_date"), P.capital_flow(C.matched(spark, d)), cal)


PRICE = {n: n for n in P.CAP_PRICE_MEASURES} | {"cap_return_mean_5": win("avg", "cap_return", 5), "cap_up_change_1": dif("cap_up_fraction")}
_LAGGED = aligned("capital", CAPS, "cday", 1, signals="SELECT trade_date FROM cal")
_CLOSE = (S.with_(S.STOCK, S.FLOW, S.CAP, C.CAP_DAY) + ", lag_ AS (SELECT * FROM (WITH " + _LAGGED.strip().lstrip(",").strip() + ")), now_ AS (SELECT * FROM (WITH "
          + aligned("price", PRICE, "cprice", 0, signals="SELECT trade_date FROM cal").strip().lstrip(",").strip() + ")) SELECT trade_date, capital_source_date, price_source_date AS capital_price_source_date, capital_available AND price_available AS capital_available, "
          + ", ".join(f"price_{n} AS capital_{n}" if n in PRICE else f"capital_{n}" for n in CAPS) + " FROM lag_ JOIN now_ USING (trade_date)")


@query("f5_capital_close_features", spec("capital", CAPS) + " capital_price_source_date:d", _CLOSE)
def f5(spark, d):
    """Same-session capitalisation-weighted prices with lagged flow."""
    s, cal = C.matched(spark, d), stock_calendar(spark, d)
    return X.capital_close_features(cal.select("trade_date"), P.capital_flow(s), P.capital_prices(s), cal)


SHARES = {"share_change_1": gro("fd_share", 1, "asset"), "share_change_5": f"CASE WHEN count(fd_share) {S.over('asset', 'session_no', 6)} = 6 THEN {gro('fd_share', 5, 'asset')} END",
          "share_change_mean_20": win("avg", "sc1", 20, "asset")}


def _shares_sql() -> str:
    body = aligned("etf", SHARES, "shr", 2, keys="asset")
    body = body.replace("feat_ AS (SELECT asset, session_no,", f"pre_ AS (SELECT *, {gro('fd_share', 1, 'asset')} AS sc1 FROM dense_),\nfeat_ AS (SELECT asset, session_no,").replace("FROM dense_),\nsig_", "FROM pre_),\nsig_")
    return S.with_(S.EXTERNAL, "shr AS (SELECT asset, trade_date, qty AS fd_share FROM ext)", "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM ext))") + body


@query("f6_share_change_features", spec("etf", SHARES, "asset:s "), _shares_sql())
def f6(spark, d):
    """Share changes per asset, two sessions late."""
    e = D.external_series(spark, d).select("asset", "trade_date", F.col("qty").alias("fd_share"))
    return X.share_change_features(e.select("asset", "trade_date"), e, calendar_of(e))


FUND = {}
for _c in ("turnover_rate", "turnover_rate_f"):
    FUND |= {_c: _c, f"{_c}_change": gro(_c), f"{_c}_relative_20": f"{_c}/{win('avg', _c, 20)} - 1"}
for _c in ("pe_ttm", "pb"):
    FUND |= {_c: _c, f"{_c}_z252": f"({_c} - {S.full('avg', _c, 252, '', 'session_no', 60)})/greatest({S.full('stddev_samp', _c, 252, '', 'session_no', 60)}, 1e-12)"}
FUND |= {"finance_change_1": gro("rzye"), "finance_change_5": gro("rzye", 5), "finance_net_ratio": f"(rzmre - rzche)/nullif({S.lag('rzye', 1, '', 'session_no')}, 0)",
         "finance_buy_ratio": "rzmre/nullif(rzmre + rzche, 0)", "finance_market_ratio": "rzye/nullif(float_mv, 0)", "lending_share": "rqye/nullif(rzrqye, 0)"}
_FUND = """
bas AS (SELECT trade_date, qty/1000 AS turnover_rate, ticks/10.0 AS turnover_rate_f, close/97 AS pe_ttm, low/97 AS pb, amount*20 AS float_mv FROM ext WHERE asset = 'A'),
mar AS (SELECT trade_date, amount AS rzye, qty AS rzmre, ticks*20.0 AS rzche, low AS rqye, low + high AS rzrqye FROM ext WHERE asset = 'N'),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT trade_date FROM bas UNION SELECT trade_date FROM ical)),
fnd AS (SELECT cal.trade_date, bas.* EXCLUDE (trade_date), mar.* EXCLUDE (trade_date) FROM cal LEFT JOIN bas USING (trade_date) LEFT JOIN mar ON mar.trade_date = cal.trade_date)"""


@query("f7_funding_features", spec("funding", FUND), S.with_(S.INDEX, S.EXTERNAL, _FUND) + aligned("funding", FUND, "fnd", 1, signals="SELECT trade_date FROM ical"))
def f7(spark, d):
    """Valuation and financing features on the union calendar."""
    e = D.external_series(spark, d)
    basic = e.where("asset = 'A'").select("trade_date", (F.col("qty") / 1000).alias("turnover_rate"), (F.col("ticks") / 10.0).alias("turnover_rate_f"),
                                          (F.col("close") / 97).alias("pe_ttm"), (F.col("low") / 97).alias("pb"), (F.col("amount") * 20).alias("float_mv"))
    margin = e.where("asset = 'N'").select("trade_date", F.col("amount").alias("rzye"), F.col("qty").alias("rzmre"), (F.col("ticks") * 20.0).alias("rzche"),
                                           F.col("low").alias("rqye"), (F.col("low") + F.col("high")).alias("rzrqye"))
    signals = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return X.funding_features(signals, basic, margin, calendar_of(basic, signals))


FUT = {n: n for n in X.FUTURES_FEATURES} | {"volume_ratio_20": f"volume/{win('avg', 'volume', 20, 'product')}", "interest_change_1": gro("open_interest", 1, "product")}
_FCAL = "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM fut0))"


@query("f8_futures_features", spec("futures", FUT, "product:s "), S.with_(S.FUTURES, C.FUTURES_DAY, _FCAL) + aligned("futures", FUT, "fday", 1, keys="product"))
def f8(spark, d):
    """Futures curve features per product, one session late."""
    day = P.futures_curve(D.futures_daily(spark, d), D.spot_series(spark, d))
    return X.futures_features(day.select("product", "trade_date"), day, stock_calendar(spark, d))


_Q = ["return_1", "return_5", "return_20", "volatility_20", "bid_range", "close_spread"]
_FX = """
fq0 AS (SELECT *, (close + ask)/2 AS mid FROM ext),
fq1 AS (SELECT *, mid/lag(mid) OVER w - 1 AS r FROM fq0 WINDOW w AS (PARTITION BY asset ORDER BY trade_date)),
fq AS (SELECT asset, trade_date AS q, r AS return_1, mid/lag(mid, 5) OVER w - 1 AS return_5, mid/lag(mid, 20) OVER w - 1 AS return_20,
  """ + S.full("stddev_samp", "r", 20, "asset", "trade_date") + """ AS volatility_20, (high - low)/lag(close) OVER w AS bid_range, (ask - close)/mid AS close_spread FROM fq1 WINDOW w AS (PARTITION BY asset ORDER BY trade_date)),
sig AS (SELECT ical.*, a.asset FROM ical, (SELECT DISTINCT asset FROM ext) a)"""


@query("f9_fx_features", "asset:s trade_date:d fx_source_date:d fx_source_age_days:i fx_available:b " + _f(*[f"fx_{n}" for n in _Q]),
       S.with_(S.INDEX, S.EXTERNAL, _FX) + "SELECT asset, trade_date, fx_source_date, trade_date - fx_source_date AS fx_source_age_days, " + ", ".join(f"fx_{n}" for n in _Q) + ", " + " AND ".join(f"fx_{n} IS NOT NULL" for n in _Q)
       + " AS fx_available FROM (SELECT sig.asset, trade_date, CASE WHEN trade_date - q <= 7 THEN q END AS fx_source_date, " + ", ".join(f"CASE WHEN trade_date - q <= 7 THEN {n} END AS fx_{n}" for n in _Q) + " FROM sig ASOF LEFT JOIN fq ON sig.asset = fq.asset AND sig.trade_date > fq.q)")
def f9(spark, d):
    """Quote features of each external series known strictly before the signal."""
    signals = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return X.fx_features(D.each_asset(signals), D.external_series(spark, d))


_RISK = """
rk1 AS (SELECT asset, trade_date, close, close/lag(close) OVER (PARTITION BY asset ORDER BY trade_date) - 1 AS return_1 FROM ext),
rk AS (SELECT asset, trade_date AS q, return_1, """ + S.growth("close", 5, "asset", "trade_date") + " AS return_5, " + S.full("stddev_samp", "return_1", 20, "asset", "trade_date") + " AS volatility_20, close/" + S.full("max", "close", 20, "asset", "trade_date") + """ - 1 AS drawdown_20 FROM rk1),
""" + ",\n".join(f"r{a} AS (SELECT trade_date, " + ", ".join(f"CASE WHEN trade_date - q <= 7 THEN {'q' if n == 'source_date' else n} END AS {a}_{n}" for n in ("source_date", *X.RISK)) + f" FROM ical ASOF LEFT JOIN (SELECT * FROM rk WHERE asset = '{a}') x ON ical.trade_date > x.q)" for a in "AN")
_RC = [f"{a}_{n}" for a in "AN" for n in X.RISK]
OVERSEAS = ",\novs AS (SELECT rA.*, rN.* EXCLUDE (trade_date), N_return_1 - A_return_1 AS relative_return_1 FROM rA JOIN rN USING (trade_date))"


@query("f10_global_risk_features", "trade_date:d A_source_date:d N_source_date:d relative_return_1:f global_available:b " + _f(*_RC),
       S.with_(S.INDEX, S.EXTERNAL, _RISK + OVERSEAS) + "SELECT *, " + " AND ".join(f"{c} IS NOT NULL" for c in _RC) + " AS global_available FROM ovs")
def f10(spark, d):
    """Overseas risk strictly before the signal and the relative return."""
    signals = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return X.global_risk_features(signals, D.external_series(spark, d), ["A", "N"])


_FB = ["ret1", "ret5", "vol20", "gap", "intraday", "range"]


@query("f11_foreign_close_timing", "asset:s trade_date:d price_source_date:d volume_source_date:d foreign_vol_chg_lag1:f " + _f(*[f"foreign_{n}" for n in _FB]),
       S.with_(S.INDEX, S.EXTERNAL, """
fr AS (SELECT asset, trade_date AS q, close, low AS open, high, low, qty, close/lag(close) OVER (PARTITION BY asset ORDER BY trade_date) - 1 AS ret1 FROM ext),
fb AS (SELECT asset, q, ret1 AS foreign_ret1, close/lag(close, 5) OVER w - 1 AS foreign_ret5, """ + S.full("stddev_samp", "ret1", 20, "asset", "q") + """ AS foreign_vol20, open/lag(close) OVER w - 1 AS foreign_gap, close/open - 1 AS foreign_intraday,
  (high - low)/lag(close) OVER w AS foreign_range, ln(qty) - lag(ln(qty)) OVER w AS foreign_vol_chg FROM fr WINDOW w AS (PARTITION BY asset ORDER BY q)),
sig AS (SELECT ical.trade_date, a.asset FROM ical, (SELECT DISTINCT asset FROM ext) a)""")
       + "SELECT a.* EXCLUDE (q, foreign_vol_chg), a.q AS price_source_date, b.q AS volume_source_date, b.foreign_vol_chg AS foreign_vol_chg_lag1 FROM (SELECT sig.*, fb.* EXCLUDE (asset) FROM sig ASOF LEFT JOIN fb ON sig.asset = fb.asset AND sig.trade_date >= fb.q) a JOIN (SELECT sig.*, fb.* EXCLUDE (asset) FROM sig ASOF LEFT JOIN fb ON sig.asset = fb.asset AND sig.trade_date > fb.q) b USING (asset, trade_date)")
def f11(spark, d):
    """Prices of each foreign series of the same day with the earlier day's volume change."""
    signals = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    bars = D.external_series(spark, d).select("asset", "trade_date", "close", F.col("low").alias("open"), "high", "low", F.col("qty").alias("vol"))
    return X.foreign_close_features(D.each_asset(signals), bars, "current_prices")


@query("f12_intraday_features", "series_id:s trade_date:d intraday_source_date:d intraday_available:b " + _f(*[f"intraday_{m}" for m in P.INTRADAY_MEASURES]),
       S.with_(S.BARS, C.INTRADAY_DAY) + "SELECT s.series_id, s.trade_date, p.trade_date AS intraday_source_date, p.trade_date IS NOT NULL AND downside_variance_share IS NOT NULL AS intraday_available, "
       + ", ".join(f"{m} AS intraday_{m}" for m in P.INTRADAY_MEASURES) + " FROM (SELECT DISTINCT series_id, trade_date FROM slots) s LEFT JOIN path p USING (series_id, trade_date)")
def f12(spark, d):
    """Intraday path of the same session."""
    bars = C.slotted(D.intraday_bars(spark, d))
    return X.intraday_features(bars.select("series_id", "trade_date").distinct(), P.intraday_path(bars))


LIQ = {"overnight": '"on"/100', "overnight_change_1": dif('"on"/100'), "overnight_change_5": dif('"on"/100', 5), "overnight_vs_mean_20": f'"on"/100 - {win("avg", chr(34) + "on" + chr(34) + "/100", 20)}',
       "bank_week_spread": 'w1/100 - "on"/100', "bank_quarter_spread": 'm3/100 - "on"/100', "exchange_bank_overnight_spread": 'o_close/100 - "on"/100',
       "exchange_bank_week_spread": "k_close/100 - w1/100", "exchange_week_spread": "k_close/100 - o_close/100", "exchange_overnight_range": "(o_high - o_low)/100",
       "exchange_overnight_change_1": dif("o_close/100"), "exchange_volume_ratio_20": f"o_amount/{win('avg', 'o_amount', 20)}", "exchange_short_volume_share": "o_amount/(o_amount + k_amount)"}
_LIQ = """
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM ext)),
liq AS (SELECT cal.trade_date, a.low/97.3717 AS "on", a.close/97.3717 AS w1, a.high/97.3717 AS m3, n.close/97.3717 AS o_close, n.high/97.3717 AS o_high, n.low/97.3717 AS o_low, n.amount AS o_amount, r.close/97.3717 AS k_close, r.amount AS k_amount
  FROM cal LEFT JOIN (SELECT * FROM ext WHERE asset = 'A' AND day(trade_date) <> 9) a USING (trade_date) LEFT JOIN (SELECT * FROM ext WHERE asset = 'N') n ON n.trade_date = cal.trade_date
  LEFT JOIN (SELECT * FROM ext WHERE asset = 'R') r ON r.trade_date = cal.trade_date)"""


@query("f13_liquidity_features", spec("liquidity", LIQ), S.with_(S.EXTERNAL, _LIQ) + aligned("liquidity", LIQ, "liq", 1, signals="SELECT trade_date FROM cal"))
def f13(spark, d):
    """Funding spreads and ratios, one session late, unavailable after gaps."""
    e = D.external_series(spark, d)
    cal = calendar_of(e)
    pct = lambda c, n: (F.col(c) / 97.3717).alias(n)
    bank = e.where((F.col("asset") == "A") & (F.dayofmonth("trade_date") != 9)).select("trade_date", pct("low", "on"), pct("close", "w1"), pct("high", "m3"))
    repo = lambda a: e.where(F.col("asset") == a).select("trade_date", pct("close", "close"), pct("high", "high"), pct("low", "low"), "amount")
    return X.liquidity_features(cal.select("trade_date"), bank, repo("N"), repo("R"), cal)


OPT = {}
for _m in ("volume", "amount", "interest"):
    _s = f"P_{_m}/nullif(P_{_m} + C_{_m}, 0)"
    OPT |= {f"put_{_m}_share": _s, f"put_{_m}_change_1": dif(_s), f"put_{_m}_mean_20": win("avg", _s, 20)}


@query("f14_option_features", spec("option", OPT), S.with_(S.OPTION, C.OPTION_DAY) + aligned("option", OPT, "oday", 1, cal="ocal"))
def f14(spark, d):
    """Put shares by volume, amount and open interest, one session late."""
    o = D.option_daily(spark, d)
    day = P.option_activity(o)
    return X.option_features(day.select("trade_date"), day, calendar_of(o))


POSITION = {n: n for n in P.POSITION_MEASURES} | {"matched_imbalance_mean_5": win("avg", "matched_interest_imbalance", 5)}


@query("f15_option_position_features", spec("option_position", POSITION),
       S.with_(S.OPTION, C.POSITION_DAY, "opm AS (SELECT * FROM pos LEFT JOIN mint USING (trade_date))") + aligned("option_position", POSITION, "opm", 1, cal="ocal"))
def f15(spark, d):
    """Expiry buckets and matched open-interest changes, one session late."""
    o = D.option_daily(spark, d)
    cal = calendar_of(o)
    day = P.option_positions(o).join(P.matched_interest(o, cal), "trade_date", "left")
    return X.option_position_features(day.select("trade_date"), day, cal)


@query("f16_trend_features", "trade_date:d trend_source_date:d trend_available:b " + _f(*C.TREND_FEATURES),
       S.with_(S.DENSE, C.TREND_DAY) + "SELECT cal.trade_date, t.trade_date AS trend_source_date, coalesce(trend_available, false) AS trend_available, " + ", ".join(C.TREND_FEATURES) + " FROM cal LEFT JOIN trend t USING (trade_date)")
def f16(spark, d):
    """Trend breadth of the same session."""
    p = C.users(spark, d)
    cal = calendar_of(p)
    return X.trend_features(cal.select("trade_date"), P.trend_breadth(p, cal, (3, 5, 10)), cal)


OTHERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PRICE_BLOCK = ["ret1", "ret5", "vol20", "gap", "intraday", "range", "vol_chg"]
_CTX = f"""
ar AS (SELECT *, {S.growth('close', 1, 'series_id', 'trade_date')} AS ret1 FROM idx),
ab AS (SELECT series_id, trade_date, ret1, {S.growth('close', 5, 'series_id', 'trade_date')} AS ret5, {S.full('stddev_samp', 'ret1', 20, 'series_id', 'trade_date')} AS vol20, open/pre_close - 1 AS gap, close/open - 1 AS intraday,
  (high - low)/pre_close AS range, ln(vol) - lag(ln(vol)) OVER (PARTITION BY series_id ORDER BY trade_date) AS vol_chg FROM ar)"""


@query("f17_index_context", "series_id:s trade_date:d return_1:f momentum_5:f " + _f(*[f"{i}_{n}" for i in (1, 2, 3, 4, 5) for n in (*PRICE_BLOCK, "relative_return_1", "relative_return_5")]),
       S.with_(S.INDEX, _CTX) + "SELECT t.series_id, t.trade_date, t.ret1 AS return_1, t.ret5 AS momentum_5, " + ", ".join(
           ", ".join(f"max(CASE WHEN o.series_id = '{a}' THEN o.{n} END) AS \"{i}_{n}\"" for n in PRICE_BLOCK) + f", max(CASE WHEN o.series_id = '{a}' THEN o.ret1 END) - t.ret1 AS \"{i}_relative_return_1\", max(CASE WHEN o.series_id = '{a}' THEN o.ret5 END) - t.ret5 AS \"{i}_relative_return_5\""
           for i, a in enumerate(OTHERS, 1)) + " FROM ab t LEFT JOIN ab o ON o.trade_date = t.trade_date GROUP BY t.series_id, t.trade_date, t.ret1, t.ret5")
def f17(spark, d):
    """Price blocks of all indices beside each."""
    i = D.index_series(spark, d)
    return X.index_context_features(i, i, OTHERS)


CORE = f"""
co0 AS (SELECT *, {S.growth('close', 1, 'series_id', 'trade_date')} AS return_1 FROM idx),
core AS (SELECT series_id, trade_date, return_1, {S.growth('close', 5, 'series_id', 'trade_date')} AS momentum_5, {S.growth('close', 20, 'series_id', 'trade_date')} AS momentum_20,
  {S.full('stddev_samp', 'return_1', 20, 'series_id', 'trade_date')} AS volatility_20, close/open - 1 AS intraday_return, (close - low)/nullif(high - low, 0) AS close_position FROM co0)"""
_SP = ["confidence", "calibrated_confidence", *X.CORE_COLUMNS, *X.BREADTH_COLUMNS, "A_return_1", "A_return_5", "N_return_1", "N_drawdown_20"]
_F1 = "bft AS (SELECT * FROM (WITH " + aligned("breadth", BREADTH, "brd", 0, signals="SELECT trade_date FROM cal").strip().lstrip(",").strip() + "))"


def specialist(spark, d, stream=None):
    """Specialist base set on an incumbent stream."""
    stream = base_stream(spark, d) if stream is None else stream
    dates = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    cal = stock_calendar(spark, d)
    breadth = X.breadth_features(cal.select("trade_date"), P.market_breadth(C.stocks(spark, d)), cal, lag=0)
    over = X.global_risk_features(dates, D.external_series(spark, d), ["A", "N"])
    return X.specialist_features(stream, Q.core_features(D.index_series(spark, d), ["series_id"]), breadth, over, ["A_return_1", "A_return_5", "N_return_1", "N_drawdown_20"])


SPECIALIST = S.with_(S.STREAMS, S.STOCK, C.BREADTH_DAY, _F1, S.EXTERNAL, _RISK + OVERSEAS, CORE, "spc AS (SELECT b.*, c.* EXCLUDE (series_id, trade_date), f.* EXCLUDE (trade_date), o.* EXCLUDE (trade_date), "
                     + " AND ".join(f"{c} IS NOT NULL" for c in _SP) + " AS specialist_available FROM base b LEFT JOIN core c USING (series_id, trade_date) LEFT JOIN bft f ON f.trade_date = b.trade_date LEFT JOIN ovs o ON o.trade_date = b.trade_date)")


@query("f18_specialist_set", "series_id:s trade_date:d specialist_available:b " + _f(*_SP), SPECIALIST + "SELECT * FROM spc")
def f18(spark, d):
    """Eighteen specialist features, all of which must be known."""
    return specialist(spark, d)


_H = ["raw_confidence", "previous_return", "recent_return", "recent_volatility", "recent_prediction_rate", "recent_up_rate", "side_0_accuracy", "side_1_accuracy"]


@query("f19_incumbent_history", "stream_id:s series_id:s trade_date:d direction:i calibrated_confidence:f " + _f(*_H), S.with_(S.STREAMS, HISTORY) + "SELECT * FROM hist")
def f19(spark, d):
    """Ten features of a stream's own earlier rows."""
    return Q.history_features(forecast_streams(spark, d), STREAM_KEYS)


_LO = "ln(greatest(0.01, least(0.99, p))/(1 - greatest(0.01, least(0.99, p))))"


@query("f20_auxiliary_log_odds", "series_id:s trade_date:d aux_level:f aux_momentum:f aux_fitted:b",
       S.with_(S.STREAMS, f"""aux AS (SELECT series_id, trade_date, stream_id, {_LO} AS lo, pos >= 120 AS fit FROM (SELECT *, CASE WHEN predicted_label = 1 THEN confidence ELSE 1 - confidence END AS p FROM streams WHERE stream_id IN ('level', 'momentum')))""")
       + "SELECT b.series_id, b.trade_date, max(CASE WHEN a.stream_id = 'level' THEN lo END) AS aux_level, max(CASE WHEN a.stream_id = 'momentum' THEN lo END) AS aux_momentum, bool_and(fit) AS aux_fitted FROM base b LEFT JOIN aux a USING (series_id, trade_date) GROUP BY 1, 2")
def f20(spark, d):
    """Log-odds of two other streams, fitted after 120 rows."""
    s = forecast_streams(spark, d)
    p = F.when(F.col("predicted_label") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    aux = s.where(F.col("stream_id").isin("level", "momentum")).select(
        "series_id", "trade_date", F.col("stream_id").alias("name"), p.alias("probability"), F.when(F.col("pos") >= 120, F.col("pos")).otherwise(0).alias("training_rows"), F.date_sub("trade_date", 1).alias("last_training_date"))
    return X.auxiliary_features(s.where("stream_id = 'base'"), aux, ["level", "momentum"], ["series_id"])


@query("f21_direction_interactions", "series_id:s trade_date:d incumbent_direction:f return_1__direction:f confidence__direction:f",
       S.with_(S.STREAMS, CORE) + "SELECT series_id, trade_date, 2*predicted_label - 1 AS incumbent_direction, return_1*(2*predicted_label - 1) AS return_1__direction, confidence*(2*predicted_label - 1) AS confidence__direction FROM base JOIN core USING (series_id, trade_date)")
def f21(spark, d):
    """Features multiplied by the incumbent's direction."""
    j = base_stream(spark, d).join(Q.core_features(D.index_series(spark, d), ["series_id"]), ["series_id", "trade_date"])
    return X.direction_interactions(j, ["return_1", "confidence"])


@query("f23_core_price_features", "series_id:s trade_date:d " + _f(*X.CORE_COLUMNS), S.with_(S.INDEX, CORE) + "SELECT * FROM core")
def f23(spark, d):
    """Six core price features."""
    return Q.core_features(D.index_series(spark, d), ["series_id"])
