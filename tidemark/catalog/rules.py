"""Rule-panel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sqltext as S
from tidemark.catalog.features import CORE
from tidemark.catalog.registry import query
from tidemark.operators import rules as R
from tidemark.operators import series as Q
from tidemark.sources import derive as D
from tidemark.sources.staging import stage
from tidemark.sources.streams import base_stream, forecast_streams

RKEY = "series_id:s pos:i rule_id:i "
PKEY = "series_id:s pos:i "
_BASE = """
rb AS (SELECT series_id, trade_date, row_number() OVER w - 1 AS pos, close/lag(close) OVER w - 1 AS return_1, open/pre_close - 1 AS overnight_gap, close/open - 1 AS intraday_return, (lead(close) OVER w/close - 1 > 0)::INT AS label
  FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY trade_date)),
rf AS (""" + " UNION ALL ".join(f"SELECT series_id, trade_date, pos, label, {i} AS fi, {n} AS x FROM rb" for i, n in enumerate(R.FEATURES)) + """),
rt AS (SELECT *, """ + ", ".join(f"{S.prior_quantile('x', q, 756, 40, 'series_id, fi', 'pos')} AS q{j}" for j, q in enumerate(R.QUANTILES)) + """ FROM rf),
rules AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT series_id, trade_date, pos, label, (fi*7 + {j})*2 + {s} AS rule_id, (x {op} q{j})::INT AS pred FROM rt" for j in range(7) for s, op in ((0, ">"), (1, "<="))) + ")"


def counts(name: str, src: str, lo: int, hi: int) -> str:
    o = f"OVER (PARTITION BY series_id, rule_id ORDER BY pos ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"
    cs = ", ".join(f"coalesce(sum((pred = {p} AND label = {y})::INT) {o}, 0) AS n{p}{y}" for p in (0, 1) for y in (0, 1))
    return f"{name} AS (SELECT *, {cs} FROM {src})"


ACC = "CASE WHEN n00 + n01 + n10 + n11 > 0 THEN (n00 + n11)/(n00 + n01 + n10 + n11) ELSE 0 END"
BAL = "CASE WHEN n01 + n11 > 0 AND n00 + n10 > 0 THEN (n11/(n01 + n11) + n00/(n00 + n10))/2 ELSE 0.5 END"
MCC = "CASE WHEN (n11 + n10)*(n11 + n01)*(n00 + n10)*(n00 + n01) > 0 THEN (n11*n00 - n10*n01)/sqrt((n11 + n10)*(n11 + n01)*(n00 + n10)*(n00 + n01)::DOUBLE) ELSE 0 END"


def scored(name: str, src: str, raw: str, extra: str = "pred IS NOT NULL", mid: float = 0.5) -> str:
    sc = "greatest(raw_score, 1 - raw_score)" if mid else "abs(raw_score)"
    return f"{name} AS (SELECT *, n00 + n01 + n10 + n11 AS calibration_rows, {raw} AS raw_score, raw_score < {mid} AS reverse, {sc} AS score, n00 + n01 + n10 + n11 >= 30 AND {extra} AS eligible FROM {src})"


def top(name: str, src: str, k: int = 5, edge: float = 0.5) -> str:
    return f"{name} AS (SELECT *, greatest(score - {edge}, 0.001) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY series_id, pos ORDER BY score DESC, rule_id) AS rank FROM {src} WHERE eligible) WHERE rank <= {k})"


RULES = S.with_(S.INDEX, _BASE)
SCORED = S.with_(S.INDEX, _BASE, counts("rc", "rules", 120, 1), scored("rs", "rc", ACC))
TOP = S.with_(S.INDEX, _BASE, counts("rc", "rules", 120, 1), scored("rs", "rc", ACC), top("tp", "rs"))


def panel(spark, d):
    return stage(R.threshold_rules(D.index_series(spark, d)), "rules")


@query("r1_threshold_rules", RKEY + "trade_date:d rule:s pred:i label:i", RULES + """SELECT *, ['return_1', 'overnight_gap', 'intraday_return'][rule_id//14 + 1] || CASE WHEN rule_id % 2 = 0 THEN '>rolling_q' ELSE '<=rolling_q' END || ['0.2', '0.3', '0.4', '0.5', '0.6', '0.7', '0.8'][(rule_id % 14)//2 + 1] AS rule FROM rules WHERE pred IS NOT NULL""")
def r1(spark, d):
    """Threshold rules per feature, quantile and side."""
    return R.threshold_rules(D.index_series(spark, d)).where(F.col("pred").isNotNull()).withColumn("rule", R.rule_name(F.col("rule_id")))


_SC = "calibration_rows:i raw_score:f reverse:b score:f"


@query("r2_rule_accuracy", RKEY + _SC, SCORED + "SELECT * FROM rs WHERE eligible")
def r2(spark, d):
    """Accuracy of each rule over 120 earlier rows, reversed below one half."""
    return R.scored(panel(spark, d)).where("eligible")


@query("r3_balanced_accuracy", RKEY + _SC, S.with_(S.INDEX, _BASE, counts("rc", "rules", 120, 1), scored("rs", "rc", BAL)) + "SELECT * FROM rs WHERE eligible")
def r3(spark, d):
    """Mean class recall of each rule."""
    return R.scored(panel(spark, d), method="balanced").where("eligible")


@query("r4_matthews_correlation", RKEY + _SC, S.with_(S.INDEX, _BASE, counts("rc", "rules", 120, 1), scored("rs", "rc", MCC, mid=0)) + "SELECT * FROM rs WHERE eligible")
def r4(spark, d):
    """Matthews correlation of each rule."""
    return R.scored(panel(spark, d), method="correlation").where("eligible")


@query("r5_top_rules", RKEY + "rank:i score:f weight:f", TOP + "SELECT * FROM tp")
def r5(spark, d):
    """Five best rules per position with vote weights."""
    return R.top_rules(R.scored(panel(spark, d)))


# oriented path of each chosen rule as text: one character per position, 'x' unknown
_PATHS = """
pth AS MATERIALIZED (SELECT series_id, rule_id, string_agg(coalesce(pred::VARCHAR, 'x'), '' ORDER BY pos) AS p FROM rules GROUP BY 1, 2),
lab AS MATERIALIZED (SELECT series_id, string_agg(coalesce(label::VARCHAR, 'x'), '' ORDER BY pos) AS y FROM rules WHERE rule_id = 0 GROUP BY 1),
ex AS (SELECT tp.*, CASE WHEN reverse THEN translate(s, '01', '10') ELSE s END AS o FROM (SELECT tp.*, substr(p, (greatest(pos - 120, 0) + 1)::BIGINT, (pos - greatest(pos - 120, 0) + 1)::BIGINT) AS s FROM tp JOIN pth USING (series_id, rule_id)) tp)"""


def merged(sum_weights: bool = True) -> str:
    return f"mg AS MATERIALIZED (SELECT series_id, pos, o, min(rule_id) AS rule_id, count(*) AS members, {'sum' if sum_weights else 'max'}(weight) AS weight FROM ex GROUP BY 1, 2, 3)"


VOTE = """
hv AS (SELECT series_id, pos, i, bool_and(substr(o, i, 1) <> 'x') AS complete, sum(CASE WHEN substr(o, i, 1) = '1' THEN weight ELSE 0 END)/sum(weight) AS v FROM (SELECT *, unnest(range(1, length(o))) AS i FROM mg) GROUP BY 1, 2, 3),
ha AS (SELECT series_id, pos, count(*) AS calibration_rows, avg(((v >= 0.5 - 1e-12)::INT = substr(y, (greatest(pos - 120, 0) + i)::BIGINT, 1)::INT)::INT) AS calibration_accuracy FROM hv JOIN lab USING (series_id) WHERE complete AND substr(y, (greatest(pos - 120, 0) + i)::BIGINT, 1) <> 'x' GROUP BY 1, 2),
vt AS (SELECT series_id, pos, sum(CASE WHEN right(o, 1) = '1' THEN weight ELSE 0 END)/sum(weight) AS vote, count(*) AS experts, sum(members) AS ranked_rules, pow(sum(weight), 2)/sum(weight*weight) AS effective_experts FROM mg GROUP BY 1, 2),
sgn AS (SELECT vt.*, (vote >= 0.5 - 1e-12)::INT AS predicted_label, coalesce(calibration_rows, 0) AS calibration_rows, calibration_accuracy FROM vt LEFT JOIN ha USING (series_id, pos))"""


def vote_sql(raw: str, mid: float, edge: float, sum_weights: bool) -> str:
    return S.with_(S.INDEX, _BASE, counts("rc", "rules", 120, 1), scored("rs", "rc", raw, mid=mid), top("tp", "rs", edge=edge), _PATHS, merged(sum_weights), VOTE)


@query("r6_merged_experts", RKEY + "members:i weight:f", vote_sql(ACC, 0.5, 0.5, True) + "SELECT * FROM mg")
def r6(spark, d):
    """Rules with identical oriented paths collapsed, weights summed."""
    p = panel(spark, d)
    return R.merged_experts(R.oriented_experts(R.top_rules(R.scored(p)), p))


_VS = PKEY + "vote:f predicted_label:i experts:i ranked_rules:i calibration_rows:i calibration_accuracy:f"


@query("r7_weighted_vote", _VS, vote_sql(ACC, 0.5, 0.5, True) + "SELECT * FROM sgn")
def r7(spark, d):
    """Weighted vote of the merged experts and its accuracy over the history."""
    return R.rule_signal(panel(spark, d))


def prequential_sql(raw: str, extra: str) -> str:
    return S.with_(S.INDEX, _BASE, counts("rc", "rules", 120, 1), scored("rs", "rc", ACC), "em AS (SELECT series_id, pos, rule_id, label, CASE WHEN eligible THEN CASE WHEN reverse THEN 1 - pred ELSE pred END END AS pred FROM rs)",
                   counts("ec", "em", 120, 1), scored("es", "ec", raw, extra),
                   "et AS (SELECT *, raw_score - 0.5 AS weight FROM es WHERE eligible AND raw_score > 0.5 QUALIFY row_number() OVER (PARTITION BY series_id, pos ORDER BY raw_score DESC, rule_id) <= 5)") + \
        "SELECT series_id, pos, count(*) AS rules, sum(weight*pred)/sum(weight) AS vote, max(raw_score) AS top_score, (sum(weight*pred)/sum(weight) >= 0.5 - 1e-12)::INT AS predicted_label FROM et GROUP BY 1, 2"


_PS = PKEY + "rules:i vote:f top_score:f predicted_label:i"


@query("r8_prequential_accuracy", _PS, prequential_sql(ACC, "pred IS NOT NULL"))
def r8(spark, d):
    """Rules ranked on predictions oriented before each outcome."""
    return R.prequential_signal(panel(spark, d))


@query("r8_prequential_balanced", _PS, prequential_sql(BAL, "pred IS NOT NULL AND n01 + n11 >= 10 AND n00 + n10 >= 10"))
def r8b(spark, d):
    """The same with balanced accuracy and rows of both classes."""
    return R.prequential_signal(panel(spark, d), balanced=True)


def validated_sql(raw: str, extra: str) -> str:
    return S.with_(S.INDEX, _BASE, counts("rc", "rules", 180, 61), scored("rs", "rc", raw, extra), counts("vc", "(SELECT * EXCLUDE (n00, n01, n10, n11) FROM rs)", 60, 1),
                   "pth AS MATERIALIZED (SELECT series_id, rule_id, string_agg(coalesce(pred::VARCHAR, 'x'), '' ORDER BY pos) AS p FROM rules GROUP BY 1, 2)",
                   """vs AS (SELECT *, CASE WHEN reverse THEN translate(s, '01', '10') ELSE s END AS o FROM (SELECT v.*, substr(p, (greatest(greatest(pos - 60, 0) - 120, 0) + 1)::BIGINT, (greatest(pos - 60, 0) - greatest(greatest(pos - 60, 0) - 120, 0))::BIGINT) AS s FROM vc v JOIN pth USING (series_id, rule_id) WHERE eligible)),
vu AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY series_id, pos, o ORDER BY score DESC, rule_id) = 1),
vk AS (SELECT *, greatest(score - 0.5, 0.001) AS w, CASE WHEN reverse THEN 1 - pred ELSE pred END AS now, (CASE WHEN reverse THEN n01 ELSE n11 END/(n01 + n11) + CASE WHEN reverse THEN n10 ELSE n00 END/(n00 + n10))/2 AS skill
  FROM (SELECT * FROM vu QUALIFY row_number() OVER (PARTITION BY series_id, pos ORDER BY score DESC, rule_id) <= 5) WHERE pred IS NOT NULL AND n01 + n11 >= 10 AND n00 + n10 >= 10)""") + \
        "SELECT series_id, pos, count(*) AS accepted, sum(w*now)/sum(w) AS vote, min(skill) AS minimum_skill, (sum(w*now)/sum(w) >= 0.5 - 1e-12)::INT AS predicted_label FROM vk WHERE skill > 0.5 GROUP BY 1, 2"


_VL = PKEY + "accepted:i vote:f minimum_skill:f predicted_label:i"


@query("r9_validated_accuracy", _VL, validated_sql(ACC, "true"))
def r9(spark, d):
    """Rules ranked on an older period and accepted on the later one."""
    return R.validated_signal(panel(spark, d))


@query("r9_validated_balanced", _VL, validated_sql(BAL, "n01 + n11 >= 10 AND n00 + n10 >= 10"))
def r9b(spark, d):
    """The same ranked by balanced accuracy."""
    return R.validated_signal(panel(spark, d), balanced=True)


def conditional_sql(scale: str, now: str) -> str:
    o = "OVER (PARTITION BY series_id, rule_id, pred ORDER BY pos RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING)"
    return S.with_(S.INDEX, _BASE, f"pr AS (SELECT *, (coalesce(sum(CASE WHEN label = 1 THEN {scale} END) {o}, 0)/{now} + 1)/(coalesce(sum(CASE WHEN label IS NOT NULL THEN {scale} END) {o}, 0)/{now} + 2) AS p_up FROM rules)",
                   counts("rc", "pr", 120, 1), scored("rs", "rc", ACC), top("tp", "rs")) + "SELECT series_id, pos, count(*) AS rules, sum(weight*p_up)/sum(weight) AS probability_up, (sum(weight*p_up)/sum(weight) >= 0.5 - 1e-12)::INT AS predicted_label FROM tp GROUP BY 1, 2"


_CS = PKEY + "rules:i probability_up:f predicted_label:i"


@query("r10_conditional_probability", _CS, conditional_sql("1.0::DOUBLE", "1.0::DOUBLE"))
def r10(spark, d):
    """Probability of up given each chosen rule's state."""
    return R.conditional_probability(panel(spark, d))


@query("r10_recent_conditional_probability", _CS, conditional_sql("pow(2, pos/60.0)", "pow(2, (pos - 1)/60.0)"))
def r10h(spark, d):
    """The same with a half-life of 60 rows."""
    return R.conditional_probability(panel(spark, d), half_life=60.0)


@query("r10_logistic_rule_probability", PKEY + "experts:i probability_up:f4 predicted_label:i")
def r10l(spark, d):
    """Logistic fit over each position's distinct rules."""
    return R.logistic_probability(panel(spark, d))


_DUR = """
du0 AS (SELECT *, sum(CASE WHEN pred IS DISTINCT FROM pp THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, rule_id ORDER BY pos) AS run FROM (SELECT *, lag(pred) OVER (PARTITION BY series_id, rule_id ORDER BY pos) AS pp FROM rules)),
du1 AS (SELECT *, CASE WHEN pred IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY series_id, rule_id, run ORDER BY pos) END AS duration FROM du0),
du2 AS (SELECT *, CASE WHEN duration > 20 THEN 3 WHEN duration > 5 THEN 2 WHEN duration > 1 THEN 1 ELSE 0 END AS bin FROM du1),
du3 AS (SELECT *, (coalesce(sum(label) OVER st, 0) + 1)/(count(label) OVER st + 2) AS p_state, count(label) OVER bn AS bin_rows, coalesce(sum(label) OVER bn, 0) AS bu FROM du2
  WINDOW st AS (PARTITION BY series_id, rule_id, pred ORDER BY pos RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING), bn AS (PARTITION BY series_id, rule_id, pred, bin ORDER BY pos RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING)),
dur AS (SELECT *, (bu + 10*p_state)/(bin_rows + 10) AS p_duration FROM du3)"""


@query("r11_duration_probability", PKEY + "rules:i probability_up:f state_probability_up:f duration_mean:f history_rows_mean:f predicted_label:i",
       S.with_(S.INDEX, _BASE, _DUR, counts("rc", "dur", 120, 1), scored("rs", "rc", ACC), top("tp", "rs")) + """SELECT series_id, pos, count(*) AS rules, sum(weight*p_duration)/sum(weight) AS probability_up, sum(weight*p_state)/sum(weight) AS state_probability_up,
  sum(weight*duration)/sum(weight) AS duration_mean, sum(weight*bin_rows)/sum(weight) AS history_rows_mean, (sum(weight*p_duration)/sum(weight) >= 0.5 - 1e-12)::INT AS predicted_label FROM tp GROUP BY 1, 2""")
def r11(spark, d):
    """Probability of up given the state and its duration."""
    return R.duration_probability(panel(spark, d))


def streams_with(sql: str) -> str:
    """Add the forecast streams to a rule query's WITH clause."""
    return sql.replace(S.INDEX.strip(), S.STREAMS.strip(), 1)


@query("r12_correlation_signal", "series_id:s trade_date:d used_candidate:b final_label:i",
       streams_with(vote_sql(MCC, 0, 0.0, False)) + "SELECT b.series_id, b.trade_date, s.predicted_label IS NOT NULL AS used_candidate, coalesce(s.predicted_label, b.predicted_label) AS final_label FROM base b LEFT JOIN sgn s USING (series_id, pos)")
def r12(spark, d):
    """Correlation-ranked unique rules with the incumbent as fallback."""
    return R.with_fallback(R.rule_signal(panel(spark, d), method="correlation", sum_weights=False), base_stream(spark, d))


_O = "OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
VETO = f"""
ve0 AS (SELECT b.*, volatility_20, volatility_20 <= quantile_cont(volatility_20, 0.4) OVER (PARTITION BY b.series_id ORDER BY b.pos ROWS BETWEEN 360 PRECEDING AND 1 PRECEDING) AS low_state FROM base b LEFT JOIN core USING (series_id, trade_date)),
ve1 AS (SELECT *, count(correct) OVER w AS n, avg(correct::INT) OVER w AS veto_accuracy FROM ve0 WINDOW w AS (PARTITION BY series_id, low_state ORDER BY pos ROWS BETWEEN 75 PRECEDING AND 1 PRECEDING)),
vet AS (SELECT *, coalesce(low_state AND n >= 10 AND veto_accuracy < 0.46, false) AS veto_applied FROM ve1)"""


@query("r13_state_veto", "series_id:s trade_date:d veto_applied:b final_label:i final_confidence:f",
       S.with_(S.STREAMS, CORE, VETO) + "SELECT *, CASE WHEN veto_applied THEN 1 - predicted_label ELSE predicted_label END AS final_label, CASE WHEN veto_applied THEN 1 - veto_accuracy ELSE confidence END AS final_confidence FROM vet")
def r13(spark, d):
    """Reversal in a low-volatility state with poor recent accuracy."""
    vol = Q.core_features(D.index_series(spark, d), ["series_id"]).select("series_id", "trade_date", "volatility_20")
    return R.state_veto(base_stream(spark, d), vol)


@query("r14_failure_guard", "series_id:s trade_date:d guard:s final_label:i final_return:f final_confidence:f",
       S.with_(S.STREAMS) + f"""SELECT *, CASE WHEN a15 < 0.4 AND a5 < 0.4 THEN 'invert' WHEN a15 < 0.45 THEN 'degrade' ELSE 'none' END AS guard, CASE WHEN a15 < 0.4 AND a5 < 0.4 THEN 1 - predicted_label ELSE predicted_label END AS final_label,
  predicted_pct_change*CASE WHEN a15 < 0.4 AND a5 < 0.4 THEN -1 WHEN a15 < 0.45 THEN 0.5 ELSE 1 END AS final_return, CASE WHEN a15 < 0.4 AND a5 < 0.4 THEN 1 - a15 ELSE confidence END AS final_confidence
  FROM (SELECT *, avg(correct::INT) {_O.format(n=15)} AS a15, avg(correct::INT) {_O.format(n=5)} AS a5 FROM base)""")
def r14(spark, d):
    """Inversion or halving after recent failures."""
    return R.failure_guard(base_stream(spark, d))


_RG = lambda c: f"CASE WHEN count(correct) OVER (PARTITION BY series_id, {c}, predicted_label ORDER BY pos RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING) >= 30 THEN avg(correct::INT) OVER (PARTITION BY series_id, {c}, predicted_label ORDER BY pos RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING) END"


@query("r15_regime_flip", "series_id:s trade_date:d regime_accuracy:f regime_flip:b final_label:i",
       S.with_(S.STREAMS, CORE, "rg0 AS (SELECT b.*, CASE WHEN close_position > 0.5 THEN 'high' ELSE 'low' END AS zone, intraday_return > 0 AS up_day FROM base b LEFT JOIN core USING (series_id, trade_date))",
               f"rg AS (SELECT *, least({_RG('zone')}, {_RG('up_day')}) AS regime_accuracy FROM rg0)") + "SELECT *, coalesce(regime_accuracy < 0.42, false) AS regime_flip, CASE WHEN regime_accuracy < 0.42 THEN 1 - predicted_label ELSE predicted_label END AS final_label FROM rg")
def r15(spark, d):
    """Flip in a state and side with a low earlier accuracy."""
    c = Q.core_features(D.index_series(spark, d), ["series_id"])
    s = base_stream(spark, d).join(c.select("series_id", "trade_date", F.when(F.col("close_position") > 0.5, "high").otherwise("low").alias("zone"), (F.col("intraday_return") > 0).alias("up_day")), ["series_id", "trade_date"], "left")
    return R.regime_flip(s, ["zone", "up_day"])


@query("r16_engine_selector", "series_id:s trade_date:d rows:i acc_a:f acc_b:f selected:s final_label:i",
       S.with_(S.STREAMS, f"""es0 AS (SELECT a.series_id, a.trade_date, a.pos, a.predicted_label AS la, b.predicted_label AS lb, a.correct AS ca, b.correct AS cb, a.predicted_label <> b.predicted_label AS df FROM base a JOIN streams b USING (series_id, trade_date) WHERE b.stream_id = 'level'),
es AS (SELECT *, count(ca) OVER w AS rows, avg(ca::INT) OVER w AS acc_a, avg(cb::INT) OVER w AS acc_b, count(CASE WHEN df THEN ca END) OVER w AS dr, avg(CASE WHEN df THEN ca::INT END) OVER w AS da, avg(CASE WHEN df THEN cb::INT END) OVER w AS db
  FROM es0 WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)),
eu AS (SELECT *, coalesce(CASE WHEN df AND dr >= 30 THEN db - da > 0 ELSE rows >= 60 AND acc_b - acc_a > 0 END, false) AS ub FROM es)""") + "SELECT *, CASE WHEN ub THEN 'b' ELSE 'a' END AS selected, CASE WHEN ub THEN lb ELSE la END AS final_label FROM eu")
def r16(spark, d):
    """The stream with the better earlier accuracy, or better earlier disagreements."""
    s = forecast_streams(spark, d)
    return R.engine_selector(s.where("stream_id = 'base'"), s.where("stream_id = 'level'"))


@query("r17_stability_rule", PKEY + "rules:i vote:f predicted_label:i", S.with_(S.INDEX, _BASE, counts("rc", "rules", 120, 1), scored("rs", "rc", ACC), counts("lc", "(SELECT * EXCLUDE (n00, n01, n10, n11) FROM rs)", 756, 1),
       "bl AS (SELECT * EXCLUDE (score, reverse, eligible), 0.65*raw_score + 0.35*(n00 + n11)/nullif(n00 + n01 + n10 + n11, 0) AS b, greatest(b, 1 - b) AS score, b < 0.5 AS reverse, eligible AND greatest(b, 1 - b) - 0.5 >= 0.005 AS eligible FROM lc)", top("tp", "bl", 3))
       + "SELECT series_id, pos, count(*) AS rules, sum(weight*CASE WHEN reverse THEN 1 - pred ELSE pred END)/sum(weight) AS vote, max(score) AS top_score, (sum(weight*CASE WHEN reverse THEN 1 - pred ELSE pred END)/sum(weight) >= 0.5 - 1e-12)::INT AS predicted_label FROM tp GROUP BY 1, 2")
def r17(spark, d):
    """Rules ranked by a blend of recent and long accuracy."""
    return R.stability_signal(panel(spark, d))


CONTEXT = """
cx AS (SELECT series_id, pos, sum(weight*(rule_id//14 = 1)::INT)/sum(weight) AS rule_slow_weight,
    sum(weight*(len(list_filter(string_split(substr(o, greatest(length(o) - 20, 1), least(length(o) - 1, 20)), ''), lambda v: v = right(o, 1)))/greatest(len(list_filter(string_split(substr(o, greatest(length(o) - 20, 1), least(length(o) - 1, 20)), ''), lambda v: v <> 'x')), 1)))/sum(weight) AS rule_persistence_20 FROM ex GROUP BY 1, 2),
rt2 AS (SELECT p.series_id, p.pos, avg(h.label) AS rate FROM rb p JOIN rb h ON h.series_id = p.series_id AND h.pos < p.pos AND h.pos >= p.pos - 120 GROUP BY 1, 2),
sk AS (SELECT *, ln(1 + row_number() OVER (PARTITION BY series_id, run ORDER BY pos)) AS rule_direction_streak FROM (SELECT *, sum(CASE WHEN predicted_label IS DISTINCT FROM pl THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM (SELECT *, lag(predicted_label) OVER (PARTITION BY series_id ORDER BY pos) AS pl FROM base)))"""


@query("f22_rule_vote_context", "series_id:s trade_date:d rule_margin:f rule_effective_experts:f rule_slow_weight:f rule_persistence_20:f rule_majority_edge:f rule_aligned_margin:f rule_direction_streak:f",
       streams_with(vote_sql(ACC, 0.5, 0.5, True)).rstrip() + "," + CONTEXT + """ SELECT sk.series_id, sk.trade_date, abs(2*vote - 1) AS rule_margin, effective_experts AS rule_effective_experts, rule_slow_weight, rule_persistence_20,
  calibration_accuracy - greatest(rate, 1 - rate) AS rule_majority_edge, (2*vote - 1)*(2*sk.predicted_label - 1) AS rule_aligned_margin, rule_direction_streak FROM sk JOIN sgn USING (series_id, pos) JOIN cx USING (series_id, pos) JOIN rt2 USING (series_id, pos)""")
def f22(spark, d):
    """Margin, concentration, persistence and streak of the ranked vote."""
    return R.vote_context(panel(spark, d), base_stream(spark, d))
