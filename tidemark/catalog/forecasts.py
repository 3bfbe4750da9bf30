"""Calibration, overlay and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sqltext as S
from tidemark.catalog.joins import SHARED, THIN, thinned
from tidemark.catalog.registry import query
from tidemark.catalog.series import ROLL20, RUNS, SCALE, SPART
from tidemark.functions.scalars import wilson_lower
from tidemark.operators import calibrate as K
from tidemark.operators import evaluate as E
from tidemark.operators import joins as J
from tidemark.operators import overlay as V
from tidemark.operators import series as Q
from tidemark.operators.calendar import calendar_of
from tidemark.sources import derive as D
from tidemark.sources.streams import STREAM_KEYS, base_stream, forecast_streams

SKEY = "stream_id:s series_id:s trade_date:d "
GKEY = "stream_id:s series_id:s "
G = ["series_id"]


def f(*names):
    return " ".join(f"{n}:f" for n in names)


SHRUNK = """
shr AS (SELECT b.* REPLACE (predicted_pct_change*coalesce(s.scale, 0) AS predicted_pct_change, predicted_close/(1 + predicted_pct_change)*(1 + predicted_pct_change*coalesce(s.scale, 0)) AS predicted_close),
   coalesce(s.scale, 0) AS return_calibration_scale, coalesce(s.rows, 0) AS return_calibration_rows FROM base b LEFT JOIN scales s ON s.series_id = b.series_id AND s.stream_id = b.stream_id AND s.apos = b.pos)"""


@query("c1_return_shrink", SKEY + "predicted_label:i predicted_pct_change:f predicted_close:f2 return_calibration_scale:f return_calibration_rows:i return_calibration_close_fallback:i",
       S.with_(S.STREAMS, SCALE.format(src="base"), SHRUNK) + "SELECT *, 0 AS return_calibration_close_fallback FROM shr")
def c1(spark, d):
    """Forecast sizes shrunk by the weighted median of earlier realised ratios."""
    return K.shrink_returns(base_stream(spark, d), STREAM_KEYS)


def platt_sql(src: str, window: int, minimum: int, name: str = "plt", steps: int = 8, ridge: float = 1e-6) -> str:
    """CTEs that run the same Newton steps over expanded pairs; the last one is `name`."""
    k = "series_id, apos"
    out = [f"""{name}p AS MATERIALIZED (SELECT a.series_id, a.pos AS apos, h.confidence AS x, h.correct::INT AS y FROM {src} a JOIN {src} h ON h.series_id = a.series_id AND h.pos < a.pos AND h.pos >= a.pos - {window} WHERE h.correct IS NOT NULL)""",
           f"{name}c AS (SELECT {k}, count(*) AS n, sum(y) AS u FROM {name}p GROUP BY {k})",
           f"{name}0 AS (SELECT {k}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {name}c WHERE n >= {minimum} AND u > 0 AND u < n)"]
    for i in range(1, steps + 1):
        out.append(f"""{name}{i} AS MATERIALIZED (SELECT {k}, a - (h11*g0 - h01*g1)/(h00*h11 - h01*h01) AS a, b - (h00*g1 - h01*g0)/(h00*h11 - h01*h01) AS b FROM (
  SELECT {k}, any_value(a) AS a, any_value(b) AS b, sum(q - y) + {ridge}*any_value(a) AS g0, sum((q - y)*x) + {ridge}*any_value(b) AS g1, sum(q*(1 - q)) + {ridge} AS h00, sum(q*(1 - q)*x) AS h01, sum(q*(1 - q)*x*x) + {ridge} AS h11
  FROM (SELECT {k}, a, b, x, y, 1/(1 + exp(-(a + b*x))) AS q FROM {name}p JOIN {name}{i - 1} USING ({k})) GROUP BY {k}))""")
    out.append(f"""{name} AS (SELECT s.* REPLACE (CASE WHEN f.a IS NOT NULL THEN 1/(1 + exp(-(f.a + f.b*s.confidence))) ELSE s.confidence END AS calibrated_confidence),
  coalesce(n, 0) AS confidence_calibration_rows, (f.a IS NULL)::INT AS confidence_calibration_fallback FROM {src} s LEFT JOIN {name}c c ON c.series_id = s.series_id AND c.apos = s.pos LEFT JOIN {name}{steps} f ON f.series_id = s.series_id AND f.apos = s.pos)""")
    return ", ".join(out)


@query("c2_platt_calibration", SKEY + "calibrated_confidence:f confidence_calibration_rows:i confidence_calibration_fallback:i", S.with_(S.STREAMS, platt_sql("base", 300, 60)) + "SELECT * FROM plt")
def c2(spark, d):
    """Confidence mapped to the probability of being right on earlier rows."""
    return K.platt_calibrate(base_stream(spark, d), STREAM_KEYS)


@query("c3_compare_calibration_windows", GKEY + "window:i rows:i brier:f selected:b", S.with_(S.STREAMS, platt_sql("base", 60, 30, "pa"), platt_sql("base", 120, 30, "pb"))
       + """SELECT *, row_number() OVER (PARTITION BY stream_id, series_id ORDER BY brier, "window") = 1 AS selected FROM (SELECT stream_id, series_id, "window", count(*) AS rows, avg(pow(calibrated_confidence - correct::INT, 2)) AS brier
  FROM (SELECT *, 60 AS "window" FROM pa UNION ALL SELECT *, 120 FROM pb) WHERE correct IS NOT NULL AND trade_date >= '1999-01-01' GROUP BY 1, 2, 3)""")
def c3(spark, d):
    """Brier score by calibration window; one window per series is selected."""
    return K.compare_windows(base_stream(spark, d), STREAM_KEYS, (60, 120), 30, "1999-01-01")


BINS = """
rb AS (SELECT stream_id, series_id, CASE WHEN confidence > 0.65 THEN 2 WHEN confidence > 0.6 THEN 1 ELSE 0 END AS bin, count(*) AS rows, avg(correct::INT) AS direction_accuracy, avg(confidence) AS mean_confidence
  FROM streams WHERE correct IS NOT NULL AND confidence BETWEEN 0 AND 1 GROUP BY 1, 2, 3)"""


@query("c4_reliability_bins", GKEY + "bin:i rows:i direction_accuracy:f mean_confidence:f", S.with_(S.STREAMS, BINS) + "SELECT * FROM rb")
def c4(spark, d):
    """Accuracy and mean confidence per confidence bin."""
    return K.reliability_bins(forecast_streams(spark, d), STREAM_KEYS, (0.0, 0.6, 0.65, 1.0))


@query("c4_expected_calibration_error", GKEY + "rows_used:i direction_accuracy:f expected_calibration_error:f",
       S.with_(S.STREAMS, BINS) + "SELECT stream_id, series_id, sum(rows) AS rows_used, sum(rows*direction_accuracy)/sum(rows) AS direction_accuracy, sum(rows*abs(direction_accuracy - mean_confidence))/sum(rows) AS expected_calibration_error FROM rb GROUP BY 1, 2")
def c4e(spark, d):
    """Row-weighted gap between accuracy and confidence."""
    return K.calibration_error(K.reliability_bins(forecast_streams(spark, d), STREAM_KEYS, (0.0, 0.6, 0.65, 1.0)), STREAM_KEYS)


def downside(spark, d):
    """Base stream with two downside probabilities taken from other streams' confidence."""
    s = forecast_streams(spark, d)
    p = lambda n: s.where(F.col("stream_id") == n).select("series_id", "pos", F.when(F.col("predicted_label") == 1, 1 - F.col("confidence")).otherwise(F.col("confidence")).alias(n))
    out = s.where("stream_id = 'base'").join(p("level"), ["series_id", "pos"]).join(p("volume"), ["series_id", "pos"])
    return out.withColumn("target", (F.col("real_pct_change") <= 0).cast("int"))


DOWN = """
pl AS (SELECT series_id, pos, CASE WHEN predicted_label = 1 THEN 1 - confidence ELSE confidence END AS p, stream_id FROM streams),
dwn AS (SELECT b.*, l.p AS level, v.p AS volume, (real_pct_change <= 0)::INT AS target FROM base b JOIN pl l ON l.series_id = b.series_id AND l.pos = b.pos AND l.stream_id = 'level' JOIN pl v ON v.series_id = b.series_id AND v.pos = b.pos AND v.stream_id = 'volume')"""


@query("c5_isotonic_calibration", "series_id:s trade_date:d calibrated_probability:f calibration_rows:i calibration_applied:b")
def c5(spark, d):
    """Isotonic map of downside scores on earlier up-forecasts."""
    return K.isotonic_calibrate(downside(spark, d), G, "level", "target", F.col("predicted_label") == 1)


_W = S.over("series_id", "pos", 252, "prior")
POOL = f"""
p0 AS (SELECT *, CASE WHEN predicted_label = 1 AND target IS NOT NULL THEN level - volume END AS dd, CASE WHEN predicted_label = 1 AND target IS NOT NULL THEN volume - target END AS ee FROM dwn),
p1 AS (SELECT *, count(dd) {_W} AS n, avg(dd*dd) {_W} AS s, avg(ee*dd) {_W} AS ed FROM p0),
pool AS (SELECT *, coalesce(predicted_label = 1 AND n >= 60 AND s > 1e-12, false) AS pool_applied, CASE WHEN pool_applied THEN greatest(0, least(1, (20.0/n*s/2 - ed)/(s + 20.0/n*s))) ELSE 0.5 END AS pool_weight,
  CASE WHEN predicted_label = 1 THEN n ELSE 0 END AS pool_rows, pool_weight*level + (1 - pool_weight)*volume AS pooled_probability FROM p1)"""


@query("c6_adaptive_pool", "series_id:s trade_date:d pool_weight:f pool_rows:i pool_applied:b pooled_probability:f", S.with_(S.STREAMS, DOWN, POOL) + "SELECT * FROM pool")
def c6(spark, d):
    """Convex pooling weight minimising the earlier Brier score."""
    return K.adaptive_pool(downside(spark, d), G, "level", "volume", "target", F.col("predicted_label") == 1)


@query("c7_mean_pool", "series_id:s trade_date:d downside_probability:f downside_training_rows:i downside_last_training_date:d",
       S.with_(S.STREAMS, DOWN) + """SELECT series_id, trade_date, CASE WHEN pos >= 120 THEN (level + volume)/2 ELSE 0 END AS downside_probability, CASE WHEN pos >= 120 THEN least(pos, 756) ELSE 0 END AS downside_training_rows,
  CASE WHEN pos >= 120 THEN trade_date - 1 END AS downside_last_training_date FROM dwn""")
def c7(spark, d):
    """Equal mean of two probability streams."""
    x = downside(spark, d)
    one = lambda c, lag, cap: x.select("series_id", "trade_date", F.col(c).alias("downside_probability"), F.when(F.col("pos") >= 120, F.least("pos", F.lit(cap))).otherwise(0).alias("downside_training_rows"),
                                  F.date_sub("trade_date", lag).alias("downside_last_training_date"))
    return K.mean_pool(one("level", 1, 756), one("volume", 2, 900), ["series_id", "trade_date"])


_Z = "3.8416"


@query("c8_wilson_bound", GKEY + "hits:i rows:i lower:f", S.with_(S.STREAMS) + f"""SELECT *, (hits/rows + {_Z}/(2*rows) - 1.96*sqrt((hits/rows)*(1 - hits/rows)/rows + {_Z}/(4*rows*rows)))/(1 + {_Z}/rows) AS lower
  FROM (SELECT stream_id, series_id, sum(correct::INT)::DOUBLE AS hits, count(correct)::DOUBLE AS rows FROM streams GROUP BY 1, 2)""")
def c8(spark, d):
    """Wilson lower bound of each stream's accuracy."""
    g = forecast_streams(spark, d).groupBy(*STREAM_KEYS).agg(F.sum(F.col("correct").cast("int")).alias("hits"), F.count("correct").alias("rows"))
    return g.withColumn("lower", wilson_lower(F.col("hits"), F.col("rows")))


FLIP_SPEC = "series_id:s trade_date:d predicted_label:i predicted_pct_change:f predicted_close:f2 confidence:f correct:b correction_selected:b"


def flipped(sel: str, label: str, conf: str, src: str = "dwn", extra: str = "") -> str:
    return f"""SELECT series_id, trade_date{extra}, {label} AS predicted_label, abs(uncalibrated_predicted_return)*(2*({label}) - 1) AS predicted_pct_change,
  close*(1 + abs(uncalibrated_predicted_return)*(2*({label}) - 1)) AS predicted_close, CASE WHEN {sel} THEN {conf} ELSE confidence END AS confidence,
  real_pct_change, calibrated_confidence, stream_id, pos, uncalibrated_predicted_return, ({label}) = (real_pct_change > 0)::INT AS correct, {sel} AS correction_selected FROM {src}"""


@query("d1_downside_flip", FLIP_SPEC, S.with_(S.STREAMS, DOWN) + flipped("(predicted_label = 1 AND pos >= 120 AND level >= 0.55)", "CASE WHEN predicted_label = 1 AND pos >= 120 AND level >= 0.55 THEN 0 ELSE predicted_label END", "level"))
def d1(spark, d):
    """Up-forecasts flipped where the downside probability reaches 0.55."""
    return V.downside_flip(downside(spark, d).withColumn("n", F.when(F.col("pos") >= 120, 1).otherwise(0)), "level", "n", F.lit(0.55))


_PU = "CASE WHEN m.predicted_label = 1 THEN m.confidence ELSE 1 - m.confidence END"
PROPOSED = f"prop AS (SELECT b.*, m.predicted_label AS nl, {_PU} AS pu, m.confidence AS cert FROM base b JOIN streams m ON m.series_id = b.series_id AND m.pos = b.pos AND m.stream_id = 'level')"


def proposed(spark, d):
    s = forecast_streams(spark, d)
    up = F.when(F.col("predicted_label") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    m = s.where("stream_id = 'level'").select("series_id", "pos", F.col("predicted_label").alias("new_label"), up.alias("probability_up"))
    return s.where("stream_id = 'base'").join(m, ["series_id", "pos"])


@query("d2_selective_replacement", FLIP_SPEC, S.with_(S.STREAMS, PROPOSED) + flipped("(nl <> predicted_label AND (CASE WHEN nl = 1 THEN pu ELSE 1 - pu END) >= 0.6)", "CASE WHEN nl <> predicted_label AND (CASE WHEN nl = 1 THEN pu ELSE 1 - pu END) >= 0.6 THEN nl ELSE predicted_label END", "(CASE WHEN nl = 1 THEN pu ELSE 1 - pu END)", "prop"))
def d2(spark, d):
    """Labels replaced where the challenger is certain enough."""
    return V.selective_replacement(proposed(spark, d), "new_label", "probability_up", F.lit(0.6), STREAM_KEYS, calibrate=False)


D2SQL = "rep AS (" + flipped("(nl <> predicted_label AND (CASE WHEN nl = 1 THEN pu ELSE 1 - pu END) >= 0.6)", "CASE WHEN nl <> predicted_label AND (CASE WHEN nl = 1 THEN pu ELSE 1 - pu END) >= 0.6 THEN nl ELSE predicted_label END", "(CASE WHEN nl = 1 THEN pu ELSE 1 - pu END)", "prop") + ")"
RAW = "raw AS (SELECT * REPLACE (predicted_pct_change AS uncalibrated_predicted_return) FROM plt)"


@query("d2_selective_replacement_calibrated", "series_id:s trade_date:d predicted_label:i predicted_pct_change:f calibrated_confidence:f return_calibration_scale:f correction_selected:b",
       S.with_(S.STREAMS, PROPOSED, D2SQL, platt_sql("rep", 300, 60), RAW, SCALE.format(src="raw"))
       + "SELECT r.* REPLACE (predicted_pct_change*coalesce(s.scale, 0) AS predicted_pct_change), coalesce(s.scale, 0) AS return_calibration_scale FROM raw r LEFT JOIN scales s ON s.series_id = r.series_id AND s.apos = r.pos")
def d2c(spark, d):
    """Selective replacement followed by confidence and return calibration on the mixed stream."""
    return V.selective_replacement(proposed(spark, d), "new_label", "probability_up", F.lit(0.6), STREAM_KEYS)


@query("d3_two_sided_flip", FLIP_SPEC, S.with_(S.STREAMS, DOWN) + flipped("(pos >= 120 AND level >= 0.6)", "CASE WHEN pos >= 120 AND level >= 0.6 THEN 1 - predicted_label ELSE predicted_label END", "level"))
def d3(spark, d):
    """Either direction flipped at a fixed error probability."""
    return V.two_sided_flip(downside(spark, d).withColumn("n", F.when(F.col("pos") >= 120, 1).otherwise(0)), "level", "n", F.lit(0.6))


@query("d4_learned_threshold_flip", FLIP_SPEC, S.with_(S.STREAMS, DOWN) + flipped("(pos >= 120 AND level >= 0.52 + (pos % 3)*0.03)", "CASE WHEN pos >= 120 AND level >= 0.52 + (pos % 3)*0.03 THEN 1 - predicted_label ELSE predicted_label END", "level"))
def d4(spark, d):
    """Flip at a threshold that differs per row."""
    return V.two_sided_flip(downside(spark, d).withColumn("n", F.when(F.col("pos") >= 120, 1).otherwise(0)), "level", "n", 0.52 + (F.col("pos") % 3) * 0.03)


SWEEP = (0.55, 0.60, 0.65, 0.70, 0.75)


def sweep(spark, d):
    return V.selective_replacement(V.threshold_sweep(proposed(spark, d), SWEEP), "new_label", "probability_up", F.col("threshold"), STREAM_KEYS, calibrate=False)


SWEPT = "swp AS (" + flipped("(nl <> predicted_label AND (CASE WHEN nl = 1 THEN pu ELSE 1 - pu END) >= threshold)", "CASE WHEN nl <> predicted_label AND (CASE WHEN nl = 1 THEN pu ELSE 1 - pu END) >= threshold THEN nl ELSE predicted_label END", "(CASE WHEN nl = 1 THEN pu ELSE 1 - pu END)", "(SELECT * FROM prop, unnest([0.55, 0.6, 0.65, 0.7, 0.75]::DOUBLE[]) t(threshold))", ", threshold") + ")"


@query("d5_threshold_sweep", "threshold:f series_id:s changed:i accuracy:f", S.with_(S.STREAMS, PROPOSED, SWEPT) + "SELECT threshold, series_id, sum(correction_selected::INT) AS changed, avg(correct::INT) AS accuracy FROM swp GROUP BY 1, 2")
def d5(spark, d):
    """Changes and accuracy for each certainty threshold."""
    return sweep(spark, d).groupBy("threshold", "series_id").agg(F.sum(F.col("correction_selected").cast("int")).alias("changed"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def _gs(expr: str, n: int) -> str:
    return f"coalesce(sum(({expr})::INT) {S.over('stream_id, series_id', 'pos', n, 'prior')}, 0)"


_DIFF = "coalesce(other <> label AND real IS NOT NULL AND label = {s}, false)"
_RIGHT = "coalesce(other <> label AND label = {s} AND other = (real > 0)::INT, false)"
GUARD = """
gx AS (SELECT s.stream_id, s.series_id, s.pos, s.predicted_label AS other, b.predicted_label AS label, b.real_pct_change AS real FROM streams s JOIN base b ON b.series_id = s.series_id AND b.pos = s.pos WHERE s.stream_id <> 'base'),
gy AS (SELECT *, """ + ", ".join(f"CASE WHEN label = 1 THEN {_gs(e.format(s=1), n)} ELSE {_gs(e.format(s=0), n)} END::DOUBLE AS {a}" for a, e, n in (("n", _DIFF, 252), ("h", _RIGHT, 252), ("rn", _DIFF, 60), ("rh", _RIGHT, 60))) + f""" FROM gx),
gz AS (SELECT *, CASE WHEN n > 0 THEN (h/n + {_Z}/(2*n) - 1.96*sqrt((h/n)*(1 - h/n)/n + {_Z}/(4*n*n)))/(1 + {_Z}/n) ELSE 0 END AS lower FROM gy),
gp AS (SELECT *, row_number() OVER (PARTITION BY series_id, pos ORDER BY lower DESC, n DESC, stream_id DESC) AS rk FROM gz WHERE other <> label AND n >= 20 AND lower > 0.5 AND rn >= 5 AND rh/rn >= 0.5),
grd AS (SELECT b.*, coalesce(g.stream_id, 'baseline') AS guard_source, g.lower AS guard_lower_bound, coalesce(g.n, 0) AS guard_history_rows, g.rh/g.rn AS guard_recent_accuracy, coalesce(g.other, predicted_label) AS guard_label
  FROM base b LEFT JOIN (SELECT * FROM gp WHERE rk = 1) g ON g.series_id = b.series_id AND g.pos = b.pos)"""
GUARD_SPEC = "series_id:s trade_date:d guard_source:s guard_lower_bound:f guard_history_rows:i guard_recent_accuracy:f guard_label:i"


@query("d6_evidence_guard", GUARD_SPEC, S.with_(S.STREAMS, GUARD) + "SELECT * FROM grd")
def d6(spark, d):
    """Challenger adopted where its earlier disagreements were right often enough."""
    s = forecast_streams(spark, d)
    return V.evidence_guard(s.where("stream_id = 'base'"), s.where("stream_id <> 'base'"), G)


_D7 = S.over("series_id", "pos", 756, "prior")


def _q7(side, q):
    x = f"CASE WHEN (real_pct_change > 0)::INT = {side} THEN abs(real_pct_change) END"
    return f"CASE WHEN count({x}) {_D7} >= 60 THEN quantile_cont({x}, {q}) {_D7} END"


@query("d7_magnitude_estimate", "series_id:s trade_date:d directional_median:f range_scaled:f",
       S.with_(S.STREAMS, "m0 AS (SELECT *, " + ", ".join(f"CASE WHEN predicted_label = 1 THEN {_q7(1, q)} ELSE {_q7(0, q)} END AS q{i}" for i, q in enumerate((0.05, 0.5, 0.95))) + " FROM base)")
       + "SELECT *, (2*predicted_label - 1)*q1 AS directional_median, CASE WHEN q1 IS NOT NULL THEN (2*predicted_label - 1)*greatest(q0, least(q2, abs(uncalibrated_predicted_return))) END AS range_scaled FROM m0")
def d7(spark, d):
    """Forecast size from earlier outcomes on the predicted side."""
    return V.magnitude_estimate(base_stream(spark, d), G)


@query("d8_reversed_confidence", "series_id:s trade_date:d reversed:b final_confidence:f",
       S.with_(S.STREAMS) + f"SELECT *, a < 0.5 AS reversed, CASE WHEN a < 0.5 THEN 1 - a ELSE a END AS final_confidence FROM (SELECT *, avg(correct::INT) {S.over('series_id', 'pos', 60, 'prior')} AS a FROM base) WHERE a IS NOT NULL")
def d8(spark, d):
    """Confidence after reversing votes with an accuracy under one half."""
    from tidemark.functions.frames import ordered, prior
    a = F.avg(F.col("correct").cast("double")).over(prior(ordered(G, "pos"), 60))
    x = base_stream(spark, d).withColumn("a", a).where(F.col("a").isNotNull()).withColumn("reversed", F.col("a") < 0.5)
    return x.withColumn("final_confidence", V.reversed_confidence(F.col("a"), F.col("reversed")))


M = """count(*) AS rows, min(trade_date) AS start_date, max(trade_date) AS end_date, sum((predicted_label = (real_pct_change > 0)::INT)::INT) AS correct_rows, avg((predicted_label = (real_pct_change > 0)::INT)::INT) AS accuracy,
 avg(CASE WHEN real_pct_change > 0 THEN (predicted_label = 1)::INT END) AS up_recall, avg(CASE WHEN real_pct_change <= 0 THEN (predicted_label = 0)::INT END) AS down_recall,
 CASE WHEN up_recall IS NULL THEN down_recall WHEN down_recall IS NULL THEN up_recall ELSE (up_recall + down_recall)/2 END AS balanced_accuracy,
 avg(abs(predicted_pct_change - real_pct_change)) AS return_mae, sqrt(avg(pow(predicted_pct_change - real_pct_change, 2))) AS return_rmse,
 avg(pow(calibrated_confidence - (predicted_label = (real_pct_change > 0)::INT)::INT, 2)) AS calibrated_brier, avg(pow(confidence - (predicted_label = (real_pct_change > 0)::INT)::INT, 2)) AS raw_brier,
 sum((real_pct_change > 0)::INT) AS actual_up_rows, sum(predicted_label) AS predicted_up_rows, sum((predicted_pct_change = 0)::INT) AS zero_return_forecasts, avg((real_pct_change > 0)::INT) AS always_up_accuracy,
 avg(abs(real_pct_change)) AS zero_return_mae, sqrt(avg(real_pct_change*real_pct_change)) AS zero_return_rmse, avg(predicted_label) - avg((real_pct_change > 0)::INT) AS up_rate_gap"""
MSPEC = "rows:i start_date:d end_date:d correct_rows:i accuracy:f balanced_accuracy:f return_mae:f return_rmse:f calibrated_brier:f raw_brier:f actual_up_rows:i predicted_up_rows:i zero_return_forecasts:i always_up_accuracy:f zero_return_mae:f zero_return_rmse:f"


@query("m1_stream_metrics", GKEY + MSPEC, S.with_(S.STREAMS) + f"SELECT stream_id, series_id, {M} FROM streams WHERE real_pct_change IS NOT NULL GROUP BY 1, 2")
def m1(spark, d):
    """Accuracy, error, Brier scores and baselines per stream."""
    return E.stream_metrics(forecast_streams(spark, d), STREAM_KEYS)


def windows_sql(src: str, start: str, dev: tuple[str, str], tails, years=True, part=SPART) -> str:
    parts = ["SELECT *, 'all' AS \"window\" FROM wr", f"SELECT *, 'test' FROM wr WHERE trade_date >= '{start}'", f"SELECT *, 'development' FROM wr WHERE trade_date BETWEEN '{dev[0]}' AND '{dev[1]}'"]
    if years:
        parts.append("SELECT *, 'year_' || year(trade_date) FROM wr")
    parts += [f"SELECT *, 'latest_{n}' FROM wr WHERE back <= {n}" for n in tails]
    return f"wr AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY trade_date DESC) AS back FROM {src} WHERE real_pct_change IS NOT NULL), wrows AS ({' UNION ALL '.join(parts)})"


START, DEV = "2000-01-01", ("1998-01-01", "1999-12-31")


@query("m2_direction_metrics", GKEY + "accuracy:f up_recall:f down_recall:f up_rate_gap:f longest_up:i switch_rate:f",
       S.with_(S.STREAMS, RUNS.replace("FROM streams)", "FROM streams WHERE real_pct_change IS NOT NULL)"), f"mm AS (SELECT stream_id, series_id, {M} FROM streams WHERE real_pct_change IS NOT NULL GROUP BY 1, 2)") + """
SELECT mm.*, longest_up, switch_rate FROM mm JOIN (SELECT stream_id, series_id, max(CASE WHEN l = 1 THEN n ELSE 0 END) AS longest_up FROM (SELECT stream_id, series_id, run, any_value(predicted_label) AS l, count(*) AS n FROM rs GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (stream_id, series_id)
  JOIN (SELECT stream_id, series_id, avg((predicted_label <> prev)::INT) AS switch_rate FROM rs GROUP BY 1, 2) USING (stream_id, series_id)""")
def m2(spark, d):
    """Recalls, rate gap, longest up-run and switch rate."""
    return E.direction_metrics(E.resolved(forecast_streams(spark, d)), STREAM_KEYS)


@query("m3_window_metrics", GKEY + "window:s " + MSPEC, S.with_(S.STREAMS, windows_sql("streams", START, DEV, (252, 20))) + f'SELECT stream_id, series_id, "window", {M} FROM wrows GROUP BY 1, 2, 3')
def m3(spark, d):
    """Metrics for the whole stream, test, development, each year and latest rows."""
    return E.windowed_metrics(forecast_streams(spark, d), STREAM_KEYS, START, DEV)


_STAB = ["monthly_accuracy_std", "monthly_accuracy_min", "monthly_balanced_accuracy_std", "rolling_20_accuracy_std", "rolling_20_accuracy_min", "direction_flip_rate"]
STABILITY = f"""
mo AS (SELECT stream_id, series_id, strftime(trade_date, '%Y%m') AS m, {M} FROM streams WHERE real_pct_change IS NOT NULL GROUP BY 1, 2, 3),
stb AS (SELECT * FROM (SELECT stream_id, series_id, count(*) AS monthly_periods, stddev_pop(accuracy) AS monthly_accuracy_std, min(accuracy) AS monthly_accuracy_min, stddev_pop(balanced_accuracy) AS monthly_balanced_accuracy_std FROM mo GROUP BY 1, 2)
  JOIN (SELECT stream_id, series_id, stddev_pop(a) AS rolling_20_accuracy_std, min(a) AS rolling_20_accuracy_min FROM r20 GROUP BY 1, 2) USING (stream_id, series_id)
  JOIN (SELECT stream_id, series_id, coalesce(avg(f), 0) AS direction_flip_rate FROM (SELECT stream_id, series_id, (predicted_label <> lag(predicted_label) {S.over(SPART, 'pos')})::INT AS f FROM streams WHERE real_pct_change IS NOT NULL) GROUP BY 1, 2) USING (stream_id, series_id))"""


@query("m4_stability", GKEY + "monthly_periods:i " + f(*_STAB), S.with_(S.STREAMS, ROLL20.replace("FROM streams)", "FROM streams WHERE real_pct_change IS NOT NULL)"), STABILITY) + "SELECT * FROM stb")
def m4(spark, d):
    """Monthly and rolling stability."""
    return E.stability(forecast_streams(spark, d), STREAM_KEYS)


_SET = """count(*) AS rows, any_value(alln) AS available_rows, sum(correct::INT) AS correct_rows, avg(correct::INT) AS accuracy, avg(CASE WHEN real_pct_change > 0 THEN correct::INT END) AS up_recall, avg(CASE WHEN real_pct_change <= 0 THEN correct::INT END) AS down_recall,
 (up_recall + down_recall)/2 AS balanced_accuracy, sum(predicted_label) AS up_rows, sum(1 - predicted_label) AS down_rows, avg(CASE WHEN predicted_label = 1 THEN correct::INT END) AS up_accuracy, avg(CASE WHEN predicted_label = 0 THEN correct::INT END) AS down_accuracy,
 avg((real_pct_change > 0)::INT) AS baseline_accuracy, avg(correct::INT) - avg((real_pct_change > 0)::INT) AS accuracy_lift, avg(calibrated_confidence) AS mean_confidence, avg(abs(predicted_pct_change - real_pct_change)) AS mae, min(trade_date) AS start_date, max(trade_date) AS end_date"""
_SETSPEC = "rows:i available_rows:i correct_rows:i accuracy:f balanced_accuracy:f up_rows:i down_rows:i up_accuracy:f down_accuracy:f up_recall:f down_recall:f baseline_accuracy:f accuracy_lift:f mean_confidence:f mae:f start_date:d end_date:d"


@query("m5_settled_statistics", GKEY + _SETSPEC, S.with_(S.STREAMS) + f"SELECT stream_id, series_id, {_SET} FROM (SELECT *, row_number() OVER (PARTITION BY {SPART} ORDER BY trade_date DESC) AS b, count(*) OVER (PARTITION BY {SPART}) AS alln FROM streams WHERE real_pct_change IS NOT NULL) WHERE b <= 60 GROUP BY 1, 2")
def m5(spark, d):
    """Statistics of the last 60 settled rows."""
    return E.settled_statistics(forecast_streams(spark, d), STREAM_KEYS, 60)


@query("m6_direction_alerts", GKEY + "rows:i predicted_up_rate:f actual_up_rate:f up_rate_gap:f switch_rows:i transition_rows:i longest_up:i longest_down:i concentrated_up:b concentrated_down:b long_streak:b",
       S.with_(S.STREAMS, f"""x AS (SELECT s.*, session_no FROM streams s JOIN ical USING (trade_date) WHERE real_pct_change IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {SPART} ORDER BY trade_date DESC) <= 250),
y AS (SELECT *, session_no = ln + 1 AS adj, sum(CASE WHEN predicted_label IS DISTINCT FROM lp OR session_no IS DISTINCT FROM ln + 1 THEN 1 ELSE 0 END) {S.over(SPART, 'pos')} AS run FROM (SELECT *, lag(predicted_label) {S.over(SPART, 'pos')} AS lp, lag(session_no) {S.over(SPART, 'pos')} AS ln FROM x)),
r AS (SELECT stream_id, series_id, run, any_value(predicted_label) AS l, count(*) AS n, sum(predicted_label) AS u, sum((real_pct_change > 0)::INT) AS a, coalesce(sum(adj::INT), 0) AS t, coalesce(sum((adj AND predicted_label <> lp)::INT), 0) AS s FROM y GROUP BY 1, 2, 3)""")
       + """SELECT *, rows >= 20 AND predicted_up_rate >= 0.8 AND up_rate_gap >= 0.2 - 1e-12 AS concentrated_up, rows >= 20 AND 1 - predicted_up_rate >= 0.8 AND -up_rate_gap >= 0.2 - 1e-12 AS concentrated_down, greatest(longest_up, longest_down) >= 10 AS long_streak
 FROM (SELECT stream_id, series_id, sum(n) AS rows, sum(u)/sum(n) AS predicted_up_rate, sum(a)/sum(n) AS actual_up_rate, sum(u)/sum(n) - sum(a)/sum(n) AS up_rate_gap, sum(t) AS transition_rows, sum(s) AS switch_rows, max(CASE WHEN l = 1 THEN n ELSE 0 END) AS longest_up, max(CASE WHEN l = 0 THEN n ELSE 0 END) AS longest_down FROM r GROUP BY 1, 2)""")
def m6(spark, d):
    """Concentration and streak alerts over the last 250 settled rows."""
    cal = calendar_of(D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")))
    return E.direction_alerts(forecast_streams(spark, d).join(cal, "trade_date"), STREAM_KEYS, "session_no", 250)


@query("m7_probability_scores", GKEY + "rows:i brier:f log_loss:f", S.with_(S.STREAMS) + "SELECT stream_id, series_id, count(*) AS rows, avg(pow(confidence - correct::INT, 2)) AS brier, avg(-(correct::INT*ln(confidence) + (1 - correct::INT)*ln(1 - confidence))) AS log_loss FROM streams WHERE correct IS NOT NULL GROUP BY 1, 2")
def m7(spark, d):
    """Brier score and log loss of the confidence."""
    return E.probability_scores(forecast_streams(spark, d).where(F.col("correct").isNotNull()), STREAM_KEYS, F.col("confidence"), F.col("correct"))


def gate_sql(part: str) -> str:
    rep = lambda n, src: f""", {n}0 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY trade_date DESC) AS back FROM {src} WHERE real_pct_change IS NOT NULL),
{n}1 AS (SELECT *, 'regression' AS w FROM {n}0 WHERE trade_date >= '{START}' UNION ALL SELECT *, 'latest_252' FROM {n}0 WHERE back <= 252 UNION ALL SELECT *, 'latest_60' FROM {n}0 WHERE back <= 60 UNION ALL SELECT *, 'latest_20' FROM {n}0 WHERE back <= 20),
{n}2 AS (SELECT *, sum(CASE WHEN predicted_label IS DISTINCT FROM pl THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, w ORDER BY trade_date) AS run FROM (SELECT *, lag(predicted_label) OVER (PARTITION BY series_id, w ORDER BY trade_date) AS pl FROM {n}1)),
{n}3 AS (SELECT series_id, w, max(CASE WHEN l = 1 THEN k ELSE 0 END) AS longest_up FROM (SELECT series_id, w, run, any_value(predicted_label) AS l, count(*) AS k FROM {n}2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
{n} AS (SELECT m.*, longest_up FROM (SELECT series_id, w, {M} FROM {n}1 GROUP BY 1, 2) m JOIN {n}3 USING (series_id, w))"""  # noqa: E731
    checks = " UNION ALL ".join(
        [f"SELECT series_id, w AS \"window\", '{m}' AS metric, c.{m} AS candidate, b.{m} AS baseline, coalesce(c.{m} >= b.{m} - 1e-12, false) AS passed FROM cand c JOIN refr b USING (series_id, w)" for m in E.HIGHER]
        + [f"SELECT series_id, w, '{m}', c.{m}, b.{m}, coalesce(c.{m} <= b.{m} + 1e-12, false) FROM cand c JOIN refr b USING (series_id, w)" for m in E.LOWER]
        + [f"SELECT series_id, w, '{m}', c.{m}, b.{m}, abs(c.{m}) < abs(b.{m}) FROM cand c JOIN refr b USING (series_id, w) WHERE w = '{x}'" for x, m in (("latest_20", "up_rate_gap"), ("latest_60", "longest_up"))])
    return rep("cand", part) + rep("refr", "base") + checks


CHECK_SPEC = "series_id:s window:s metric:s candidate:f baseline:f passed:b"
def replaced(spark, d):
    return V.selective_replacement(proposed(spark, d), "new_label", "probability_up", F.lit(0.6), STREAM_KEYS, calibrate=False)


@query("m8_non_regression_gate", CHECK_SPEC, S.with_(S.STREAMS, PROPOSED, D2SQL) + gate_sql("rep"))
def m8(spark, d):
    """Twenty-six checks of a candidate stream against the incumbent."""
    return E.non_regression_gate(base_stream(spark, d), replaced(spark, d), G, START)


@query("m8_paired_changes", "series_id:s corrected:i damaged:i", S.with_(S.STREAMS, PROPOSED, D2SQL) + "SELECT series_id, sum((r.correct AND NOT b.correct)::INT) AS corrected, sum((NOT r.correct AND b.correct)::INT) AS damaged FROM rep r JOIN base b USING (series_id, trade_date) WHERE b.correct IS NOT NULL GROUP BY 1")
def m8p(spark, d):
    """Forecasts the candidate corrected and damaged."""
    return E.paired_changes(base_stream(spark, d), replaced(spark, d), G)


def strict_sql() -> str:
    wins = lambda n, src: f""", {n}0 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY trade_date DESC) AS back FROM {src} WHERE real_pct_change IS NOT NULL),
{n} AS (SELECT series_id, w, {M} FROM (SELECT *, 'test' AS w FROM {n}0 WHERE trade_date >= '{START}' UNION ALL SELECT *, 'latest_252' FROM {n}0 WHERE back <= 252 UNION ALL SELECT *, 'latest_20' FROM {n}0 WHERE back <= 20) GROUP BY 1, 2)"""  # noqa: E731
    rows = [f"SELECT series_id, w AS \"window\", '{m}' AS metric, c.{m} AS candidate, b.{m} AS baseline, c.{m} >= b.{m} AS passed FROM cand c JOIN refr b USING (series_id, w)" for m in ("accuracy", "balanced_accuracy")]
    rows += [f"SELECT series_id, w, '{m}', c.{m}, b.{m}, c.{m} <= b.{m} + 1e-12 FROM cand c JOIN refr b USING (series_id, w)" for m in ("return_mae", "return_rmse")]
    br = lambda n: f"(SELECT series_id, avg(pow(calibrated_confidence - correct::INT, 2)) AS v FROM {n} WHERE trade_date >= '{START}' GROUP BY 1)"
    rows.append(f"SELECT series_id, 'test', 'causal_brier', c.v, b.v, c.v <= b.v + 1e-12 FROM {br('pc')} c JOIN {br('pr')} b USING (series_id)")
    rows += [f"SELECT DISTINCT series_id, '{w}', '{m}', 0.0, 0.0, true FROM base" for w, m in (("all", "exact_date_coverage"), ("test", "complete_baseline_date_coverage"))]
    return wins("cand", "rep") + wins("refr", "base") + " " + " UNION ALL ".join(rows)


@query("m9_strict_gate", CHECK_SPEC, S.with_(S.STREAMS, PROPOSED, D2SQL, "bres AS (SELECT * FROM base WHERE real_pct_change IS NOT NULL)", "rres AS (SELECT * FROM rep WHERE real_pct_change IS NOT NULL)", platt_sql("rres", 300, 60, "pc"), platt_sql("bres", 300, 60, "pr")) + strict_sql())
def m9(spark, d):
    """Coverage, window metrics and fixed-window calibrated Brier against the incumbent."""
    return E.strict_gate(base_stream(spark, d), replaced(spark, d), G, START)


_SEL = f"""
sb AS (SELECT series_id, year(trade_date) AS y, {M} FROM base WHERE real_pct_change IS NOT NULL AND year(trade_date) IN (1998, 1999) GROUP BY 1, 2),
sy AS (SELECT series_id, threshold, year(trade_date) AS y, sum(correction_selected::INT) AS ch, {M} FROM swp WHERE real_pct_change IS NOT NULL AND year(trade_date) IN (1998, 1999) GROUP BY 1, 2, 3),
sw AS (SELECT series_id, threshold, {M} FROM swp WHERE real_pct_change IS NOT NULL AND year(trade_date) IN (1998, 1999) GROUP BY 1, 2),
sg AS (SELECT series_id, threshold, min(least(a.accuracy - b.accuracy, a.balanced_accuracy - b.balanced_accuracy)) AS minimum_gain, sum(ch) AS changed_rows, count(*) AS ny FROM sy a JOIN sb b USING (series_id, y) GROUP BY 1, 2),
se AS (SELECT sg.*, balanced_accuracy, up_rate_gap, minimum_gain >= -1e-12 AND changed_rows >= 5 AND ny = 2 AS eligible FROM sg JOIN sw USING (series_id, threshold))"""
_SELSPEC = "series_id:s threshold:f minimum_gain:f changed_rows:i eligible:b selected:b"


@query("m10_development_selection", _SELSPEC, S.with_(S.STREAMS, PROPOSED, SWEPT, _SEL) + "SELECT *, eligible AND row_number() OVER (PARTITION BY series_id ORDER BY eligible DESC, minimum_gain DESC, balanced_accuracy DESC, changed_rows, threshold) = 1 AS selected FROM se")
def m10(spark, d):
    """Threshold chosen from two development years."""
    return E.development_selection(sweep(spark, d), base_stream(spark, d), G, ["threshold"], (1998, 1999))


@query("m11_selection_by_gap", _SELSPEC, S.with_(S.STREAMS, PROPOSED, SWEPT, _SEL) + "SELECT *, eligible AND row_number() OVER (PARTITION BY series_id ORDER BY eligible DESC, minimum_gain DESC, balanced_accuracy DESC, abs(up_rate_gap), threshold) = 1 AS selected FROM se")
def m11(spark, d):
    """The same choice with the rate gap as the last criterion."""
    return E.development_selection(sweep(spark, d), base_stream(spark, d), G, ["threshold"], (1998, 1999), by_gap=True)


@query("m12_ablation", "variant:s series_id:s rows:i accuracy:f return_mae:f",
       S.with_(S.STREAMS, PROPOSED, D2SQL) + f"SELECT variant, series_id, {M} FROM (SELECT 'control' AS variant, series_id, trade_date, predicted_label, real_pct_change, predicted_pct_change, confidence, calibrated_confidence FROM base UNION ALL SELECT 'candidate', series_id, trade_date, predicted_label, real_pct_change, predicted_pct_change, confidence, calibrated_confidence FROM rep) WHERE real_pct_change IS NOT NULL GROUP BY 1, 2")
def m12(spark, d):
    """Control and candidate measured on identical rows."""
    cols = ["series_id", "trade_date", "predicted_label", "real_pct_change", "predicted_pct_change", "confidence", "calibrated_confidence"]
    both = base_stream(spark, d).select(F.lit("control").alias("variant"), *cols).unionByName(replaced(spark, d).select(F.lit("candidate").alias("variant"), *cols))
    return E.stream_metrics(both, ["variant", "series_id"])


@query("m13_multi_stream_comparison", GKEY + _SETSPEC + " rmse:f brier:f missing_rows:i", S.with_(S.STREAMS, THIN.replace("NOT (stream_id", "real_pct_change IS NOT NULL AND NOT (stream_id", 1), SHARED) + f"""
SELECT * FROM (SELECT stream_id, series_id, {_SET}, sqrt(avg(pow(predicted_pct_change - real_pct_change, 2))) AS rmse, avg(pow(calibrated_confidence - correct::INT, 2)) AS brier FROM (SELECT t.*, count(*) OVER (PARTITION BY {SPART}) AS alln FROM thin t JOIN shared USING (series_id, trade_date)) GROUP BY 1, 2)
 JOIN (SELECT stream_id, series_id, any_value(k) - count(*) AS missing_rows FROM thin JOIN (SELECT series_id, trade_date, count(*) OVER (PARTITION BY series_id) AS k FROM anchor) USING (series_id, trade_date) GROUP BY 1, 2) USING (stream_id, series_id)""")
def m13(spark, d):
    """Streams compared on the incumbent's last 60 settled dates that all share."""
    s = E.resolved(thinned(spark, d))
    window = J.latest_rows(s.where("stream_id = 'base'"), G, 60).select("series_id", "trade_date")
    return E.multi_stream_comparison(J.common_dates(s, "stream_id", G, "base", 60), s, window, G, "stream_id", 60)


@query("m13_running_comparison", GKEY + "trade_date:d predicted_label:i running_accuracy:f disagreement:b", S.with_(S.STREAMS, THIN.replace("NOT (stream_id", "real_pct_change IS NOT NULL AND NOT (stream_id", 1), SHARED)
       + f"SELECT *, avg(correct::INT) {S.over(SPART, 'trade_date')} AS running_accuracy, count(DISTINCT predicted_label) OVER (PARTITION BY series_id, trade_date) > 1 AS disagreement FROM thin JOIN shared USING (series_id, trade_date)")
def m13r(spark, d):
    """Accuracy of each stream up to every shared date, and the dates on which streams disagree."""
    s = E.resolved(thinned(spark, d))
    return E.running_comparison(J.common_dates(s, "stream_id", G, "base", 60), G, "stream_id")


@query("m14_overlay_attribution", "series_id:s sample:s rows:i trigger_rate:f accuracy:f accuracy_lift:f directional_return_lift:f",
       S.with_(S.STREAMS, PROPOSED, D2SQL, """att AS (SELECT r.*, b.predicted_label AS bl, row_number() OVER (PARTITION BY r.series_id ORDER BY r.trade_date DESC) AS back FROM rep r JOIN base b USING (series_id, trade_date) WHERE r.real_pct_change IS NOT NULL)""")
       + " UNION ALL ".join(f"""SELECT series_id, '{n}' AS sample, sum(correction_selected::INT) AS rows, avg(correction_selected::INT) AS trigger_rate, avg(CASE WHEN correction_selected THEN correct::INT END) AS accuracy,
  avg(CASE WHEN correction_selected THEN correct::INT END) - avg(CASE WHEN correction_selected THEN (bl = (real_pct_change > 0)::INT)::INT END) AS accuracy_lift,
  sum(CASE WHEN correction_selected THEN (CASE WHEN predicted_label > 0 THEN real_pct_change ELSE -real_pct_change END) - (CASE WHEN bl > 0 THEN real_pct_change ELSE -real_pct_change END) END) AS directional_return_lift FROM att WHERE {c} GROUP BY 1""" for n, c in (("all", "true"), ("recent", "back <= 20"))))
def m14(spark, d):
    """What the replaced rows contributed."""
    p = proposed(spark, d).withColumn("base_label", F.col("predicted_label"))
    r = V.selective_replacement(p, "new_label", "probability_up", F.lit(0.6), STREAM_KEYS, calibrate=False)
    return E.overlay_attribution(r, G, F.col("correction_selected"), "base_label")


@query("m16_parity_report", "column:s rows:i one_sided:i max_abs:f exact:b", S.with_(S.STREAMS, PROPOSED, D2SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, 0 AS one_sided, max(abs(r.{c} - b.{c})) AS max_abs, bool_and(r.{c} = b.{c}) AS exact FROM rep r JOIN base b USING (series_id, trade_date)" for c in ("predicted_label", "confidence", "predicted_pct_change")))
def m16(spark, d):
    """Largest difference per column of two streams."""
    return E.parity_report(replaced(spark, d), base_stream(spark, d), ["series_id", "trade_date"], ["predicted_label", "confidence", "predicted_pct_change"])


@query("m17_prefix_parity", "column:s rows:i one_sided:i exact:b", S.with_(S.STREAMS) + "SELECT c AS \"column\", count(*) AS rows, 0 AS one_sided, true AS exact FROM base, unnest(['recent_return', 'side_0_accuracy', 'side_1_accuracy']) t(c) WHERE trade_date <= '1999-06-30' GROUP BY 1")
def m17(spark, d):
    """History features recomputed on truncated input equal the full run."""
    s = base_stream(spark, d)
    cols = ["recent_return", "side_0_accuracy", "side_1_accuracy"]
    cut = F.col("trade_date") <= "1999-06-30"
    whole = Q.history_features(s, STREAM_KEYS).where(cut)
    return E.parity_report(whole, Q.history_features(s.where(cut), STREAM_KEYS), ["series_id", "trade_date"], cols)


_DM = ["accuracy", "balanced_accuracy", "calibrated_brier", "return_mae", "return_rmse"]


@query("m18_report_delta", "series_id:s " + f(*_DM), S.with_(S.STREAMS, PROPOSED, D2SQL) + "SELECT series_id, " + ", ".join(f"c.{m} - b.{m} AS {m}" for m in _DM) + f" FROM (SELECT series_id, {M} FROM rep WHERE real_pct_change IS NOT NULL GROUP BY 1) c JOIN (SELECT series_id, {M} FROM base WHERE real_pct_change IS NOT NULL GROUP BY 1) b USING (series_id)")
def m18(spark, d):
    """Metric differences of two reports."""
    return E.report_delta(E.stream_metrics(replaced(spark, d), G), E.stream_metrics(base_stream(spark, d), G), G, _DM)


