"""SQL fragments shared by the checking queries: the derived panels and frame helpers."""

from __future__ import annotations

STOCK = """
stock0 AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY 1, 2),
stock AS (SELECT code, trade_date, vol, amount, amount/vol AS px,
    100*((amount/vol)/lag(amount/vol) OVER (PARTITION BY code ORDER BY trade_date) - 1) AS pct_chg,
    CASE WHEN s_nationkey < 12 THEN 'SH' WHEN s_nationkey < 24 THEN 'SZ' ELSE 'BJ' END AS market
  FROM stock0 JOIN supplier ON code = s_suppkey),
act AS (SELECT *, pct_chg/100 AS ret FROM stock WHERE market IN ('SH','SZ') AND vol > 0 AND amount > 0 AND pct_chg IS NOT NULL),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM stock0))"""

_SLOT = ("CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END || '_' || "
         "CASE WHEN l_quantity <= 12 THEN 'sm' WHEN l_quantity <= 25 THEN 'md' WHEN l_quantity <= 37 THEN 'lg' ELSE 'elg' END")
_AMT = [f"{s}_{z}" for s in ("buy", "sell") for z in ("sm", "md", "lg", "elg")]
FLOW = f""",
flow0 AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, {_SLOT} AS slot, l_extendedprice AS x FROM lineitem
  WHERE (l_suppkey + day(l_shipdate)) % 97 <> 0),
flow AS (SELECT code, trade_date, {', '.join(f"sum(CASE WHEN slot = '{a}' THEN x ELSE 0 END) AS {a}_amount" for a in _AMT)} FROM flow0 GROUP BY 1, 2),
terms AS (SELECT *, {' + '.join(a + '_amount' for a in _AMT)} AS gross,
    buy_lg_amount + buy_elg_amount - sell_lg_amount - sell_elg_amount AS lg, buy_sm_amount - sell_sm_amount AS sm FROM flow),
mf AS (SELECT act.*, coalesce(gross > 0, false) AS ok, CASE WHEN gross > 0 THEN gross END AS gross,
    CASE WHEN gross > 0 THEN lg END AS lg, CASE WHEN gross > 0 THEN sm END AS sm, lg/nullif(gross,0) AS ratio
  FROM act LEFT JOIN terms USING (code, trade_date))"""

CAP = """,
cap AS (SELECT code, trade_date, CASE WHEN NOT (code % 7 = 0 AND day(trade_date) % 4 = 0) THEN s_acctbal + 1000 END AS total_mv
  FROM stock JOIN supplier ON code = s_suppkey)"""

DENSE = """
dense0 AS (SELECT user_id AS code, CAST(ts AS DATE) AS trade_date, count(*)::DOUBLE AS vol, sum(value) AS amount FROM events GROUP BY 1, 2),
stock AS (SELECT code, trade_date, vol, amount, amount/vol AS px, CASE WHEN code % 2 = 0 THEN 'SH' ELSE 'SZ' END AS market,
    100*((amount/vol)/lag(amount/vol) OVER (PARTITION BY code ORDER BY trade_date) - 1) AS pct_chg FROM dense0),
act AS (SELECT *, pct_chg/100 AS ret FROM stock WHERE vol > 0 AND amount > 0 AND pct_chg IS NOT NULL),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM dense0))"""

INDEX = """
idx0 AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS trade_date, arg_min(o_totalprice, o_orderkey) AS open,
    max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS vol, sum(o_totalprice) AS amount
  FROM orders GROUP BY 1, 2),
idx AS (SELECT *, lag(close) OVER (PARTITION BY series_id ORDER BY trade_date) AS pre_close FROM idx0),
ical AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM idx0))"""

EXTERNAL = """
ext AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS trade_date, min(l_extendedprice/l_quantity) AS low, max(l_extendedprice/l_quantity) AS high,
    arg_max(l_extendedprice/l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
    sum(l_quantity) AS qty, sum(l_extendedprice) AS amount, count(*) AS ticks, close*(1 + (ticks % 5)/1000.0) AS ask
  FROM lineitem GROUP BY 1, 2)"""

OPTION = """
opt AS (SELECT *, opt_code || '-' || call_put || '-' || strftime(delist_date, '%Y%m%d') AS ts_code FROM (
  SELECT CAST(l_shipdate AS DATE) AS trade_date, p_brand AS opt_code, CASE WHEN l_partkey % 2 = 0 THEN 'P' ELSE 'C' END AS call_put,
    CAST(last_day(date_trunc('quarter', l_shipdate) + CASE WHEN l_linenumber % 2 = 1 THEN INTERVAL 2 MONTH ELSE INTERVAL 5 MONTH END) AS DATE) AS delist_date,
    sum(l_quantity) AS vol, sum(l_extendedprice) AS amount, sum(l_quantity*l_linenumber) AS oi
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)),
ocal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM opt)),
contracts AS (SELECT ts_code, opt_code, call_put, delist_date, min(trade_date) AS list_date FROM opt GROUP BY 1, 2, 3, 4)"""

FUTURES = """
fut0 AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'IF' ELSE 'IC' END AS product, CAST(l_shipdate AS DATE) AS trade_date,
    date_trunc('month', l_shipdate) + to_months((l_linenumber % 4)::INT) AS m, l_quantity AS q, l_extendedprice AS p, l_linenumber AS n FROM lineitem),
fut1 AS (SELECT product || strftime(m, '%y%m') || '.CFX' AS ts_code, product, year(m) % 100 * 12 + month(m) AS mon, trade_date,
    sum(q) AS vol, sum(q*n) AS oi, min(p/q) AS open, sum(p) AS amount, sum(p)/sum(q) AS close FROM fut0 GROUP BY 1, 2, 3, 4),
fut AS (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close FROM fut1),
spot AS (SELECT *, lag(close) OVER (ORDER BY trade_date) AS pre_close FROM (SELECT trade_date, sum(p)/sum(q) AS close FROM fut0 GROUP BY 1))"""

BARS = """
bars AS (SELECT event_type AS series_id, make_timestamp(CAST((floor(epoch(ts)/10800) + 1)*10800*1000000 AS BIGINT)) AS bar_end, arg_min(value, event_id) AS open,
    max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS vol, sum(value) AS amount
  FROM events GROUP BY 1, 2),
slots AS (SELECT *, CAST(bar_end - INTERVAL 3 HOUR AS DATE) AS trade_date, hour(bar_end - INTERVAL 3 HOUR)//3 + 1 AS slot FROM bars)"""

def with_(*parts: str) -> str:
    """Join CTE groups into one WITH clause."""
    return "WITH " + ",".join(p.strip().strip(",") for p in parts) + "\n"


def over(part: str, order: str, n: int | None = None, kind: str = "trailing") -> str:
    frame = ""
    if kind == "prior":
        frame = f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    elif n is not None:
        frame = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    p = f"PARTITION BY {part} " if part else ""
    return f"OVER ({p}ORDER BY {order}{frame})"


def full(agg: str, x: str, n: int, part: str, order: str, minimum: int | None = None, kind: str = "trailing") -> str:
    o = over(part, order, n, kind)
    return f"CASE WHEN count({x}) {o} >= {minimum or n} THEN {agg}({x}) {o} END"


def lag(x: str, n: int, part: str, order: str) -> str:
    return f"lag({x}, {n}) {over(part, order)}"


def growth(x: str, n: int, part: str, order: str) -> str:
    return f"({x})/nullif({lag(x, n, part, order)}, 0) - 1"

STREAMS = INDEX + """,
str0 AS (SELECT *, close/pre_close - 1 AS r1, coalesce(vol > lag(vol) OVER w, false) AS vol_up, lead(close) OVER w/close - 1 AS real_pct_change,
    row_number() OVER w - 1 AS pos, coalesce((close - low)/nullif(high - low, 0), 0.5) AS place FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY trade_date)),
str1 AS (SELECT s.*, v.stream_id,
    CASE v.stream_id WHEN 'base' THEN r1 <= 0 WHEN 'level' THEN place <= 0.5 WHEN 'momentum' THEN r1 > 0 ELSE vol_up END::INT AS predicted_label,
    CASE v.stream_id WHEN 'base' THEN 0.5 + 0.4*(abs(r1)/(1 + abs(r1))) WHEN 'level' THEN 0.5 + 0.3*abs(place - 0.5)
      WHEN 'momentum' THEN 0.52 + 0.3*(abs(r1)/(1 + abs(r1))) ELSE 0.5 + 0.2*(abs(r1)/(1 + abs(r1))) END AS confidence
  FROM str0 s CROSS JOIN (VALUES ('base'), ('level'), ('momentum'), ('volume')) v(stream_id) WHERE r1 IS NOT NULL),
streams AS (SELECT stream_id, series_id, trade_date, pos, close, predicted_label, confidence, real_pct_change,
    (2*predicted_label - 1)*(least(abs(r1), 0.05)*0.5 + 0.001) AS uncalibrated_predicted_return, uncalibrated_predicted_return AS predicted_pct_change,
    close*(1 + uncalibrated_predicted_return) AS predicted_close, 0.5 + 0.8*(confidence - 0.5) AS calibrated_confidence,
    predicted_label = (real_pct_change > 0)::INT AS correct FROM str1),
base AS (SELECT * FROM streams WHERE stream_id = 'base')"""


def prior_quantile(x: str, q: float, n: int, minimum: int, part: str, order: str) -> str:
    o = over(part, order, n, "prior")
    return f"CASE WHEN count({x}) {o} >= {minimum} THEN quantile_cont({x}, {q}) {o} END"
