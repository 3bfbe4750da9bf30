"""Window and time-series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import sqltext as S
from tidemark.catalog.panels import TREND_DAY
from tidemark.catalog.registry import query
from tidemark.functions import frames as W
from tidemark.functions.frames import ordered
from tidemark.operators import panel as P
from tidemark.operators import series as Q
from tidemark.operators.calendar import calendar_of, densify
from tidemark.sources import derive as D
from tidemark.sources.streams import STREAM_KEYS, base_stream, forecast_streams

SID = ["series_id"]
PART, ORD = "series_id", "trade_date"
KEY = "series_id:s trade_date:d "
SKEY = "stream_id:s series_id:s trade_date:d "
SPART = "stream_id, series_id"


def _w():
    return ordered(SID, "trade_date")


def _s():
    return ordered(STREAM_KEYS, "pos")


def _ret(n):
    return S.growth("close", n, PART, ORD)


RETS = S.with_(S.INDEX, f"r AS (SELECT *, {_ret(1)} AS ret FROM idx)")


@query("w1_simple_returns", KEY + "ret_1:f ret_5:f ret_20:f", S.with_(S.INDEX) + f"SELECT *, {_ret(1)} AS ret_1, {_ret(5)} AS ret_5, {_ret(20)} AS ret_20 FROM idx")
def w1(spark, d):
    """Returns over 1, 5 and 20 observed rows, never filled."""
    c = F.col("close")
    return D.index_series(spark, d).select(*SID, "trade_date", *[W.growth(c, _w(), n).alias(f"ret_{n}") for n in (1, 5, 20)])


@query("w2_differences", KEY + "diff_1:f2 diff_5:f2", S.with_(S.INDEX) + f"SELECT *, close - {S.lag('close', 1, PART, ORD)} AS diff_1, close - {S.lag('close', 5, PART, ORD)} AS diff_5 FROM idx")
def w2(spark, d):
    """First and fifth differences."""
    c = F.col("close")
    return D.index_series(spark, d).select(*SID, "trade_date", W.diff(c, _w()).alias("diff_1"), W.diff(c, _w(), 5).alias("diff_5"))


@query("w3_rolling_means", KEY + "mean_5:f mean_20:f", S.with_(S.INDEX) + f"SELECT *, {S.full('avg', 'close', 5, PART, ORD)}/close AS mean_5, {S.full('avg', 'close', 20, PART, ORD)}/close AS mean_20 FROM idx")
def w3(spark, d):
    """Rolling means that need every row of the frame, relative to the current value."""
    c = F.col("close")
    return D.index_series(spark, d).select(*SID, "trade_date", *[(W.full(c, n, F.avg, _w()) / c).alias(f"mean_{n}") for n in (5, 20)])


@query("w4_zscore", KEY + "z:f", RETS + f"SELECT *, (ret - {S.full('avg', 'ret', 252, PART, ORD, 60)})/greatest({S.full('stddev_samp', 'ret', 252, PART, ORD, 60)}, 1e-12) AS z FROM r")
def w4(spark, d):
    """Rolling z-score with a minimum of 60 of 252 rows and a floored deviation."""
    f = D.index_series(spark, d).withColumn("ret", W.growth(F.col("close"), _w()))
    return f.select(*SID, "trade_date", W.zscore(F.col("ret"), 252, 60, _w()).alias("z"))


@query("w5_ratio_to_mean", KEY + "deviation:f", S.with_(S.INDEX) + f"SELECT *, amount/{S.full('avg', 'amount', 20, PART, ORD)} - 1 AS deviation FROM idx")
def w5(spark, d):
    """Deviation of turnover from its rolling mean."""
    return D.index_series(spark, d).select(*SID, "trade_date", W.deviation(F.col("amount"), 20, _w()).alias("deviation"))


@query("w6_rolling_volatility", KEY + "vol_20:f", RETS + f"SELECT *, {S.full('stddev_samp', 'ret', 20, PART, ORD)} AS vol_20 FROM r")
def w6(spark, d):
    """Sample deviation of 20 returns."""
    f = D.index_series(spark, d).withColumn("ret", W.growth(F.col("close"), _w()))
    return f.select(*SID, "trade_date", W.full(F.col("ret"), 20, F.stddev_samp, _w()).alias("vol_20"))


@query("w7_drawdown", KEY + "drawdown_20:f", S.with_(S.INDEX) + f"SELECT *, close/{S.full('max', 'close', 20, PART, ORD)} - 1 AS drawdown_20 FROM idx")
def w7(spark, d):
    """Distance from the 20-row maximum."""
    return D.index_series(spark, d).select(*SID, "trade_date", W.drawdown(F.col("close"), 20, _w()).alias("drawdown_20"))


@query("w8_prior_normalise", KEY + "scaled:f", RETS + f""", z AS (SELECT *, {S.full('avg', 'ret', 126, PART, ORD, kind='prior')} AS m, {S.full('stddev_pop', 'ret', 126, PART, ORD, kind='prior')} AS s FROM r)
SELECT *, CASE WHEN s > 1e-12 AND ret IS NOT NULL THEN greatest(-5, least(5, (ret - m)/s)) END AS scaled FROM z""")
def w8(spark, d):
    """Scale by the 126 earlier rows, clipped to five deviations."""
    f = D.index_series(spark, d).withColumn("ret", W.growth(F.col("close"), _w()))
    return f.select(*SID, "trade_date", W.prior_scaled(F.col("ret"), 126, _w()).alias("scaled"))


@query("w9_consecutive_momentum", "code:i trade_date:d run_rows:i mom_3:f mom_5:f mom_10:f",
       S.with_(S.DENSE, TREND_DAY) + "SELECT *, m3 AS mom_3, m5 AS mom_5, m10 AS mom_10, row_number() OVER (PARTITION BY code, run ORDER BY session_no) AS run_rows FROM tm")
def w9(spark, d):
    """Compounding over unbroken runs of sessions."""
    p = D.dense_panel(spark, d)
    return P.consecutive_momentum(p, calendar_of(p), (3, 5, 10))


@query("w10_valid_window_change", "code:i trade_date:d change_5:f",
       S.with_(S.DENSE, """b AS (SELECT code, min(session_no) AS lo, max(session_no) AS hi FROM stock JOIN cal USING (trade_date) GROUP BY 1),
g AS (SELECT b.code, cal.trade_date, vol FROM b JOIN cal ON session_no BETWEEN lo AND hi LEFT JOIN stock s ON s.code = b.code AND s.trade_date = cal.trade_date)""")
       + f"SELECT code, trade_date, CASE WHEN count(vol) {S.over('code', ORD, 6)} = 6 THEN {S.growth('vol', 5, 'code', ORD)} END AS change_5 FROM g")
def w10(spark, d):
    """Five-session change only where all six sessions were observed."""
    p = D.dense_panel(spark, d)
    g = densify(p, calendar_of(p), ["code"])
    w = ordered(["code"], "session_no")
    whole = F.count("vol").over(W.trailing(w, 6)) == 6
    return g.select("code", "trade_date", F.when(whole, W.growth(F.col("vol"), w, 5)).alias("change_5"))


QS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


@query("w11_prior_quantiles", KEY + " ".join(f"q{int(q * 10)}:f" for q in QS),
       RETS + "SELECT *, " + ", ".join(f"{S.prior_quantile('ret', q, 756, 40, PART, ORD)} AS q{int(q * 10)}" for q in QS) + " FROM r")
def w11(spark, d):
    """Quantile thresholds of up to 756 earlier rows, at least 40 known."""
    f = D.index_series(spark, d).select(*SID, "trade_date", W.growth(F.col("close"), _w()).alias("ret"))
    q = Q.prior_quantiles(f, SID, "trade_date", ["ret"], QS, 756, 40)
    return q.select(*SID, "trade_date", *[F.col(f"ret_q{i}").alias(f"q{int(x * 10)}") for i, x in enumerate(QS)])


@query("w12_prior_conditional_sums", SKEY + "hits_120:i rows_120:i",
       S.with_(S.STREAMS) + f"""SELECT *, coalesce(sum(coalesce(correct, false)::INT) {S.over(SPART, 'pos', 120, 'prior')}, 0) AS hits_120,
  coalesce(sum((real_pct_change IS NOT NULL)::INT) {S.over(SPART, 'pos', 120, 'prior')}, 0) AS rows_120 FROM streams""")
def w12(spark, d):
    """Counts over 120 earlier rows as differences of running sums."""
    f = Q.with_running(forecast_streams(spark, d), STREAM_KEYS, "pos", {"_h": F.col("correct"), "_n": F.col("real_pct_change").isNotNull()})
    return f.select("stream_id", "series_id", "trade_date", Q.window_sum("_h", _s(), 120).alias("hits_120"), Q.window_sum("_n", _s(), 120).alias("rows_120"))


_P = S.over(SPART, "pos", 20, "prior")
HISTORY = f"""
hist AS (SELECT *, predicted_label AS direction, confidence AS raw_confidence, coalesce(lag(real_pct_change) {S.over(SPART, 'pos')}, 0) AS previous_return,
    coalesce(sum(real_pct_change) {S.over(SPART, 'pos', 5, 'prior')}, 0) AS recent_return,
    coalesce(CASE WHEN count(real_pct_change) {_P} >= 2 THEN stddev_samp(real_pct_change) {_P} END, 0) AS recent_volatility,
    coalesce(avg(predicted_label) {_P}, 0.5) AS recent_prediction_rate, coalesce(avg((real_pct_change > 0)::INT) {_P}, 0.5) AS recent_up_rate,
    """ + ", ".join(f"(coalesce(sum((predicted_label = {s} AND correct)::INT) {S.over(SPART, 'pos', 120, 'prior')}, 0) + 5.0)/(coalesce(sum((predicted_label = {s} AND correct IS NOT NULL)::INT) {S.over(SPART, 'pos', 120, 'prior')}, 0) + 10) AS side_{s}_accuracy" for s in (0, 1)) + " FROM streams)"


@query("w13_smoothed_side_accuracy", SKEY + "side_0_accuracy:f side_1_accuracy:f", S.with_(S.STREAMS, HISTORY) + "SELECT * FROM hist")
def w13(spark, d):
    """Accuracy of each direction over earlier rows, shrunk by ten prior rows."""
    return Q.history_features(forecast_streams(spark, d), STREAM_KEYS)


@query("w14_recent_history_defaults", SKEY + "previous_return:f recent_return:f recent_volatility:f recent_prediction_rate:f recent_up_rate:f", S.with_(S.STREAMS, HISTORY) + "SELECT * FROM hist")
def w14(spark, d):
    """Recent return, volatility and rates with neutral defaults at the start."""
    return Q.history_features(forecast_streams(spark, d), STREAM_KEYS)


SCALE = """
pairs AS (SELECT a.series_id, a.stream_id, a.pos AS apos, h.pos, h.real_pct_change/h.uncalibrated_predicted_return AS ratio, abs(h.uncalibrated_predicted_return) AS w
  FROM {src} a JOIN {src} h ON h.series_id = a.series_id AND h.stream_id = a.stream_id AND h.pos < a.pos AND h.pos >= a.pos - 252
  WHERE h.real_pct_change IS NOT NULL AND abs(h.uncalibrated_predicted_return) > 1e-12),
cumw AS (SELECT *, sum(w) OVER (PARTITION BY stream_id, series_id, apos ORDER BY ratio, pos) AS c, sum(w) OVER (PARTITION BY stream_id, series_id, apos) AS t, count(*) OVER (PARTITION BY stream_id, series_id, apos) AS n FROM pairs),
scales AS (SELECT stream_id, series_id, apos, any_value(n) AS rows, CASE WHEN any_value(n) >= 60 THEN greatest(0, least(1, min(ratio) FILTER (c >= t/2))) ELSE 0 END AS scale FROM cumw GROUP BY 1, 2, 3)"""


@query("w15_weighted_median_scale", SKEY + "scale:f rows:i",
       S.with_(S.STREAMS, SCALE.format(src="base")) + "SELECT b.stream_id, b.series_id, b.trade_date, coalesce(s.scale, 0) AS scale, coalesce(s.rows, 0) AS rows FROM base b LEFT JOIN scales s ON s.series_id = b.series_id AND s.stream_id = b.stream_id AND s.apos = b.pos")
def w15(spark, d):
    """Weighted median of realised over predicted returns on earlier rows."""
    return Q.weighted_median_scale(base_stream(spark, d), STREAM_KEYS, "pos", "uncalibrated_predicted_return", "real_pct_change", 252, 60)


RUNS = f"""
rs AS (SELECT *, sum(CASE WHEN predicted_label IS DISTINCT FROM prev THEN 1 ELSE 0 END) {S.over(SPART, 'pos')} AS run FROM (SELECT *, lag(predicted_label) {S.over(SPART, 'pos')} AS prev FROM streams))"""


@query("w16_state_duration", SKEY + "duration:i", S.with_(S.STREAMS, RUNS) + "SELECT *, row_number() OVER (PARTITION BY stream_id, series_id, run ORDER BY pos) AS duration FROM rs")
def w16(spark, d):
    """Rows since the direction last changed."""
    return Q.state_duration(forecast_streams(spark, d), STREAM_KEYS, "pos", "predicted_label")


@query("w17_direction_runs", "stream_id:s series_id:s longest_up:i longest_down:i switch_rate:f", S.with_(S.STREAMS, RUNS) + """, rl AS (SELECT stream_id, series_id, run, any_value(predicted_label) AS l, count(*) AS n FROM rs GROUP BY 1, 2, 3),
sw AS (SELECT stream_id, series_id, avg((predicted_label <> prev)::INT) AS switch_rate FROM rs GROUP BY 1, 2)
SELECT stream_id, series_id, max(CASE WHEN l = 1 THEN n ELSE 0 END) AS longest_up, max(CASE WHEN l = 0 THEN n ELSE 0 END) AS longest_down, any_value(switch_rate) AS switch_rate FROM rl JOIN sw USING (stream_id, series_id) GROUP BY 1, 2""")
def w17(spark, d):
    """Longest runs by direction and switch rate."""
    runs = Q.direction_runs(forecast_streams(spark, d), STREAM_KEYS, "pos", "predicted_label")
    runs = runs.withColumn("_prev", F.lag("predicted_label").over(_s()))
    per = runs.groupBy(*STREAM_KEYS, "run").agg(F.first("predicted_label").alias("l"), F.count("*").alias("n"),
                                                F.sum((F.col("predicted_label") != F.col("_prev")).cast("int")).alias("s"), F.count("_prev").alias("t"))
    up = F.col("l") == 1
    return per.groupBy(*STREAM_KEYS).agg(F.max(F.when(up, F.col("n")).otherwise(0)).alias("longest_up"), F.max(F.when(~up, F.col("n")).otherwise(0)).alias("longest_down"),
                                         (F.sum("s") / F.sum("t")).alias("switch_rate"))


@query("w18_runs_with_breaks", "stream_id:s series_id:s start_date:d end_date:d direction:i rows:i correct_rows:i",
       S.with_(S.STREAMS, f"""x AS (SELECT s.*, session_no FROM streams s JOIN ical USING (trade_date) WHERE real_pct_change IS NOT NULL),
y AS (SELECT *, sum(CASE WHEN predicted_label IS DISTINCT FROM lp OR session_no IS DISTINCT FROM ln + 1 THEN 1 ELSE 0 END) {S.over(SPART, 'pos')} AS run
  FROM (SELECT *, lag(predicted_label) {S.over(SPART, 'pos')} AS lp, lag(session_no) {S.over(SPART, 'pos')} AS ln FROM x))""")
       + "SELECT stream_id, series_id, min(trade_date) AS start_date, max(trade_date) AS end_date, any_value(predicted_label) AS direction, count(*) AS rows, sum(correct::INT) AS correct_rows FROM y GROUP BY stream_id, series_id, run")
def w18(spark, d):
    """Direction runs that end at a missing outcome or a missing session."""
    s = forecast_streams(spark, d).where(F.col("real_pct_change").isNotNull())
    s = s.join(calendar_of(D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date"))), "trade_date")
    gap = F.col("session_no") != F.lag("session_no").over(_s()) + 1
    runs = Q.direction_runs(s, STREAM_KEYS, "pos", "predicted_label", gap)
    return runs.groupBy(*STREAM_KEYS, "run").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"),
                                                 F.first("predicted_label").alias("direction"), F.count("*").alias("rows"), F.sum(F.col("correct").cast("int")).alias("correct_rows"))


@query("w19_running_accuracy", SKEY + "accuracy:f", S.with_(S.STREAMS) + f"SELECT *, avg(correct::INT) {S.over(SPART, 'pos')} AS accuracy FROM streams")
def w19(spark, d):
    """Accuracy up to each session."""
    return forecast_streams(spark, d).withColumn("accuracy", Q.running_accuracy(F.col("correct"), _s()))


ROLL20 = f"r20 AS (SELECT stream_id, series_id, pos, {S.full('avg', 'correct::INT', 20, SPART, 'pos')} AS a FROM streams)"


@query("w20_rolling_accuracy_stability", "stream_id:s series_id:s rolling_20_accuracy_std:f rolling_20_accuracy_min:f",
       S.with_(S.STREAMS, ROLL20) + "SELECT stream_id, series_id, stddev_pop(a) AS rolling_20_accuracy_std, min(a) AS rolling_20_accuracy_min FROM r20 GROUP BY 1, 2")
def w20(spark, d):
    """Spread and minimum of the rolling 20-row accuracy."""
    f = forecast_streams(spark, d).withColumn("a", Q.rolling_accuracy(F.col("correct"), 20, _s()))
    return f.groupBy(*STREAM_KEYS).agg(F.stddev_pop("a").alias("rolling_20_accuracy_std"), F.min("a").alias("rolling_20_accuracy_min"))


@query("w21_half_life_weights", SKEY + "weight:f",
       S.with_(S.STREAMS) + f"SELECT *, pow(2, -(m - pos)/126.0)/avg(pow(2, -(m - pos)/126.0)) OVER (PARTITION BY {SPART}) AS weight FROM (SELECT *, max(pos) OVER (PARTITION BY {SPART}) AS m FROM streams)")
def w21(spark, d):
    """Half-life weights of a stream's history at its last row, mean one."""
    f = forecast_streams(spark, d)
    f = f.withColumn("_age", F.max("pos").over(Window.partitionBy(*STREAM_KEYS)) - F.col("pos"))
    return Q.half_life_weights(f, STREAM_KEYS, F.col("_age"), 126.0)


@query("w22_log_streak", SKEY + "direction_streak:f", S.with_(S.STREAMS, RUNS) + "SELECT *, ln(1 + row_number() OVER (PARTITION BY stream_id, series_id, run ORDER BY pos)) AS direction_streak FROM rs")
def w22(spark, d):
    """log1p of the current streak."""
    f = Q.state_duration(forecast_streams(spark, d), STREAM_KEYS, "pos", "predicted_label")
    return f.withColumn("direction_streak", F.log1p("duration"))


@query("w23_modular_anchors", SKEY + "anchor_pos:i",
       S.with_(S.STREAMS, f"e AS (SELECT *, coalesce(sum((correct IS NOT NULL)::INT) {S.over(SPART, 'pos', 756, 'prior')}, 0) >= 120 AS ok FROM streams), f AS (SELECT *, min(CASE WHEN ok THEN pos END) OVER (PARTITION BY {SPART}) AS first FROM e)")
       + f"SELECT *, CASE WHEN ok THEN max(CASE WHEN ok AND (pos % 5 = 0 OR pos = first) THEN pos END) {S.over(SPART, 'pos')} END AS anchor_pos FROM f")
def w23(spark, d):
    """Refit anchors every fifth position once 120 earlier rows are resolved."""
    f = Q.with_running(forecast_streams(spark, d), STREAM_KEYS, "pos", {"_n": F.col("correct").isNotNull()})
    f = f.withColumn("_ok", Q.window_sum("_n", _s(), 756) >= 120)
    return Q.modular_anchors(f, STREAM_KEYS, "pos", F.col("_ok"), 5)


CHAIN = f"""
elig AS (SELECT *, predicted_label = 1 AND coalesce(sum((predicted_label = 1 AND correct IS NOT NULL)::INT) {S.over(SPART, 'pos', 756, 'prior')}, 0) >= 120 AS ok FROM streams),
jump AS (SELECT stream_id, series_id, pos, min(pos) OVER (PARTITION BY stream_id, series_id ORDER BY pos RANGE BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM elig WHERE ok),
chain(stream_id, series_id, pos) AS (SELECT stream_id, series_id, min(pos) FROM elig WHERE ok GROUP BY 1, 2
  UNION ALL SELECT j.stream_id, j.series_id, j.nxt FROM chain c JOIN jump j ON j.stream_id = c.stream_id AND j.series_id = c.series_id AND j.pos = c.pos WHERE j.nxt IS NOT NULL)"""


@query("w24_chained_anchors", SKEY + "anchor_pos:i",
       S.with_(S.STREAMS, CHAIN).replace("WITH", "WITH RECURSIVE", 1) + f"SELECT e.*, CASE WHEN e.ok THEN max(c.pos) OVER (PARTITION BY e.stream_id, e.series_id ORDER BY e.pos) END AS anchor_pos FROM elig e LEFT JOIN chain c ON c.stream_id = e.stream_id AND c.series_id = e.series_id AND c.pos = e.pos")
def w24(spark, d):
    """Refit anchors that wait five rows after the last refit, over eligible up-forecasts."""
    up = (F.col("predicted_label") == 1)
    f = Q.with_running(forecast_streams(spark, d), STREAM_KEYS, "pos", {"_n": up & F.col("correct").isNotNull()})
    f = f.withColumn("_ok", up & (Q.window_sum("_n", _s(), 756) >= 120))
    return Q.chained_anchors(f, STREAM_KEYS, "pos", F.col("_ok"), 5)
