"""Job-level queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog import features as FQ
from tidemark.catalog import forecasts as M
from tidemark.catalog import learning as LQ
from tidemark.catalog import ledger as LG
from tidemark.catalog import panels as C
from tidemark.catalog import rules as RQ
from tidemark.catalog import sqltext as S
from tidemark.catalog.features import BREADTH, FUT, OPT, aligned, spec, stock_calendar
from tidemark.catalog.registry import ORACLES, QUERIES, query
from tidemark.functions.scalars import all_known
from tidemark.operators import calibrate as K
from tidemark.operators import evaluate as E
from tidemark.operators import ledger as G
from tidemark.operators import overlay as V
from tidemark.operators import panel as P
from tidemark.operators import residual as N
from tidemark.operators import rules as R
from tidemark.operators import series as Q
from tidemark.operators import walkforward as L
from tidemark.operators.calendar import calendar_of
from tidemark.operators.joins import prepend_history
from tidemark.plans import features as X
from tidemark.plans import jobs as B
from tidemark.plans import publishing as PB
from tidemark.sources import derive as D
from tidemark.sources import scan as A
from tidemark.sources.staging import one_reading, shared_dir, stage
from tidemark.sources.streams import STREAM_KEYS, base_stream, forecast_streams

SID = ["series_id"]
YEARS = (1998, 1999)
SWEEP = M.SWEEP


@query("m15_prospective_audit", "series_id:s side:s window:i rows:i accuracy:f return_mae:f sufficient:b",
       S.with_(S.STREAMS, """pa AS (SELECT a.series_id, a.trade_date, row_number() OVER (PARTITION BY a.series_id ORDER BY a.trade_date DESC) AS back FROM base a JOIN streams b USING (series_id, trade_date) WHERE b.stream_id = 'level' AND a.real_pct_change IS NOT NULL AND day(trade_date) % 7 <> 0),
px AS (SELECT series_id, trade_date, 0 AS w FROM pa UNION ALL SELECT series_id, trade_date, w FROM pa, (VALUES (20), (60), (252)) t(w) WHERE back <= w)""")
       + f"SELECT *, rows >= \"window\" AS sufficient FROM (SELECT series_id, CASE stream_id WHEN 'level' THEN 'candidate' ELSE 'control' END AS side, w AS \"window\", {M.M} FROM px JOIN streams USING (series_id, trade_date) WHERE stream_id IN ('base', 'level') GROUP BY 1, 2, 3)")
def m15(spark, d):
    """Paired statistics of rows generated before the target session opened."""
    s = LG.stamped(spark, d).select("series_id", "trade_date", G.origin(F.col("created_at"), F.col("target_date")).alias("origin"), F.dayofmonth("trade_date").alias("dom"))
    x = forecast_streams(spark, d).join(s.where("dom % 7 <> 0").drop("dom"), ["series_id", "trade_date"]).withColumn("live", F.lit(True))
    return E.prospective_audit(x.where("stream_id = 'level'"), x.where("stream_id = 'base'"), SID, F.col("live"))


@query("m5_live_statistics", "series_id:s rows:i accuracy:f start_date:d end_date:d date_basis:s live_rows:i",
       S.with_(S.STREAMS, LG.STAMP) + """SELECT series_id, count(*) AS rows, avg(correct::INT) AS accuracy, CASE WHEN count(t) = count(*) THEN min(t) ELSE min(trade_date) END AS start_date, CASE WHEN count(t) = count(*) THEN max(t) ELSE max(trade_date) END AS end_date,
  CASE WHEN count(t) = count(*) THEN 'target_trade_date' ELSE 'signal_date' END AS date_basis, count(*) FILTER (created_at < opens) AS live_rows FROM (SELECT *, CASE WHEN NOT (series_id = '5-LOW' AND day(trade_date) = 20) THEN target_date END AS t FROM stp WHERE real_pct_change IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY trade_date DESC) <= 60) GROUP BY 1""")
def m5_live(spark, d):
    """Statistics of the last 60 settled rows by target session, where all are known, with the rows generated live."""
    lost = (F.col("series_id") == "5-LOW") & (F.dayofmonth("trade_date") == 20)
    s = LG.stamped(spark, d).withColumn("origin", G.origin(F.col("created_at"), F.col("target_date"))).withColumn("target_date", F.when(~lost, F.col("target_date")))
    return E.settled_statistics(s, SID, 60, "target_date", "origin")


@query("e1_freeze_baseline", "series_id:s window:s rows:i accuracy:f balanced_accuracy:f return_mae:f",
       S.with_(S.STREAMS, M.windows_sql("base", M.START, M.DEV, (252, 20))) + f"SELECT series_id, \"window\", {M.M} FROM wrows WHERE \"window\" NOT IN ('test', 'development') GROUP BY 1, 2")
def e1(spark, d):
    """Year and latest metrics of a frozen snapshot of the incumbent."""
    return B.freeze_baseline(stage(base_stream(spark, d), "baseline"), SID, M.START, M.DEV)


@query("e2_strict_acceptance", "series_id:s checks:i passed_checks:i violations:i accepted:b",
       S.with_(S.STREAMS, M.PROPOSED, M.D2SQL, "bres AS (SELECT * FROM base WHERE real_pct_change IS NOT NULL)", "rres AS (SELECT * FROM rep WHERE real_pct_change IS NOT NULL)", M.platt_sql("rres", 300, 60, "pc"), M.platt_sql("bres", 300, 60, "pr")).rstrip()
       + M.strict_sql().replace(" SELECT series_id, w AS", ", chk AS (SELECT series_id, w AS", 1) + """), bad AS (SELECT series_id, sum((predicted_label NOT IN (0, 1))::INT + (predicted_pct_change <> 0 AND (predicted_pct_change > 0)::INT <> predicted_label)::INT + (correct IS DISTINCT FROM (predicted_label = (real_pct_change > 0)::INT))::INT
  + (NOT (confidence BETWEEN 0 AND 1 AND calibrated_confidence BETWEEN 0 AND 1))::INT) AS violations FROM (SELECT * REPLACE (CASE WHEN day(trade_date) = 9 THEN 1.5 ELSE calibrated_confidence END AS calibrated_confidence) FROM rres) GROUP BY 1)
SELECT *, violations = 0 AND checks = passed_checks AS accepted FROM (SELECT series_id, count(*) AS checks, sum(passed::INT) AS passed_checks FROM chk GROUP BY 1) JOIN bad USING (series_id)""")
def e2(spark, d):
    """Candidate invariants, broken on some days, and the strict gate."""
    spoiled = F.when(F.dayofmonth("trade_date") == 9, F.lit(1.5)).otherwise(F.col("calibrated_confidence"))
    return B.strict_acceptance(base_stream(spark, d), stage(M.replaced(spark, d).withColumn("calibrated_confidence", spoiled), "candidate"), SID, M.START)


def adopted_sql(sql: str) -> str:
    """Add a stream `ado` that takes the labels of the signal CTE `sgn`."""
    lab = "coalesce(s.predicted_label, b.predicted_label)"
    return RQ.streams_with(sql).rstrip() + f""", ado AS (SELECT b.* REPLACE ({lab} AS predicted_label, abs(b.uncalibrated_predicted_return)*(2*{lab} - 1) AS predicted_pct_change, {lab} = (b.real_pct_change > 0)::INT AS correct) FROM base b LEFT JOIN sgn s ON s.series_id = b.series_id AND s.pos = b.pos)"""


@query("e3_rule_family", M.CHECK_SPEC, adopted_sql(RQ.vote_sql(RQ.BAL, 0.5, 0.5, False)) + M.gate_sql("ado"))
def e3(spark, d):
    """Balanced unique rules adopted over the incumbent, then the gate."""
    p = RQ.panel(spark, d)
    b = base_stream(spark, d)
    return E.non_regression_gate(b, stage(B.adopt_labels(b, R.rule_signal(p, method="balanced", sum_weights=False)), "rules"), SID, M.START)


@query("e4_alternate_engine", M.CHECK_SPEC)
def e4(spark, d):
    """The stability rule and the nested learners as engines; the one that development years choose meets the gate."""
    b = base_stream(spark, d)
    engines = {"stability": R.stability_signal(RQ.panel(spark, d)), "nested_ml": LQ.nested_ml(spark, d).withColumn("predicted_label", (F.col("probability") >= 0.5).cast("int"))}
    adopted = B.by_policy({name: B.adopt_labels(b, signal) for name, signal in engines.items()}, "engine")
    return B.sweep_and_gate(stage(adopted, "engine"), b, SID, ["engine"], YEARS, M.START)


_SEL = "series_id:s threshold:f minimum_gain:f changed_rows:i eligible:b selected:b"


def residual_selection(spark, d, forecasts):
    """Candidates swept over certainty thresholds; development years choose among both."""
    swept = V.selective_replacement(V.threshold_sweep(stage(forecasts, "residual"), SWEEP), "proposed_label", "probability_up", F.col("threshold"), STREAM_KEYS, calibrate=False)
    return E.development_selection(swept, base_stream(spark, d), SID, ["candidate", "threshold"], YEARS)


@query("e5_residual_family", "candidate:s " + _SEL)
def e5(spark, d):
    """Residual candidates on the index context, and those that see funding and valuation too."""
    x = LQ.context_stream(spark, d)
    funding = FQ.f7(spark, d)
    names = [c for c in funding.columns if c.startswith("funding_") and c not in ("funding_available", "funding_source_date")]
    wider = x.join(funding.select("trade_date", *names), "trade_date", "left")
    parts = N.residual_family(x, LQ.RESIDUAL, "context").unionByName(N.residual_family(x, LQ.RESIDUAL, "error"))
    return residual_selection(spark, d, parts.unionByName(N.residual_family(wider, (*LQ.RESIDUAL, *names), "funding").select(*parts.columns)))


def error_family(stream, features, spark, d, **kw):
    p = L.error_probabilities(stream, features, SID, **kw)
    swept = B.error_sweep(stage(p.drop("training_rows", "last_training_date"), "errors"), "correctness_probability", SWEEP, STREAM_KEYS)
    return E.development_selection(swept, base_stream(spark, d), SID, ["threshold"], YEARS)


@query("e6_long_history", "candidate:s " + _SEL)
def e6(spark, d):
    """Residual candidates with a ten-year window on a history prepended with older rows."""
    h = LQ.context_stream(spark, d)
    cols = [c for c in h.columns if c not in ("series_id", "trade_date")]
    merged, _ = prepend_history(h.where("trade_date >= '1997-01-01'"), h.where("trade_date <= '1997-02-01'"), ["series_id", "trade_date"], cols)
    return residual_selection(spark, d, N.residual_family(merged, LQ.RESIDUAL, "history"))


#: Years before the others' development years, in which some challenger improves on the incumbent.
EARLY_YEARS = (1996, 1997)
_CH = "(CASE WHEN nl = 1 THEN pu ELSE 1 - pu END)"
_CHOSEN = f"(nl <> predicted_label AND {_CH} >= threshold)"
_E7 = S.with_(
    S.STREAMS, M.PROPOSED.replace("SELECT b.*, ", "SELECT b.*, m.stream_id AS challenger, ").replace("m.stream_id = 'level'", "m.stream_id <> 'base'"),
    "swp AS (" + M.flipped(_CHOSEN, f"CASE WHEN {_CHOSEN} THEN nl ELSE predicted_label END", _CH, "(SELECT * FROM prop, unnest([0.55, 0.6, 0.65, 0.7, 0.75]::DOUBLE[]) t(threshold))", ", challenger, threshold") + ")",
    f"""dev AS (SELECT * FROM swp WHERE real_pct_change IS NOT NULL AND year(trade_date) IN {EARLY_YEARS}),
sb AS (SELECT series_id, year(trade_date) AS y, {M.M} FROM base WHERE real_pct_change IS NOT NULL AND year(trade_date) IN {EARLY_YEARS} GROUP BY 1, 2),
sy AS (SELECT series_id, challenger, threshold, year(trade_date) AS y, sum(correction_selected::INT) AS ch, {M.M} FROM dev GROUP BY 1, 2, 3, 4),
sw AS (SELECT series_id, challenger, threshold, {M.M} FROM dev GROUP BY 1, 2, 3),
sg AS (SELECT series_id, challenger, threshold, min(least(a.accuracy - b.accuracy, a.balanced_accuracy - b.balanced_accuracy)) AS minimum_gain, sum(ch) AS changed_rows, count(*) AS ny FROM sy a JOIN sb b USING (series_id, y) GROUP BY 1, 2, 3),
pick AS (SELECT series_id, challenger, threshold FROM sg JOIN sw USING (series_id, challenger, threshold) WHERE minimum_gain >= -1e-12 AND changed_rows >= 5 AND ny = 2
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY minimum_gain DESC, balanced_accuracy DESC, changed_rows, challenger, threshold) = 1),
chosen AS (SELECT swp.* FROM swp JOIN pick USING (series_id, challenger, threshold))""")


@query("e7_selective_sweep", M.CHECK_SPEC, _E7 + M.gate_sql("chosen"))
def e7(spark, d):
    """Challenger and threshold selected on development years, gate on the selection."""
    s = forecast_streams(spark, d)
    up = F.when(F.col("predicted_label") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    others = s.where("stream_id <> 'base'").select("series_id", "pos", F.col("stream_id").alias("challenger"), F.col("predicted_label").alias("new_label"), up.alias("probability_up"))
    swept = V.threshold_sweep(base_stream(spark, d).join(others, ["series_id", "pos"]), SWEEP)
    swept = stage(V.selective_replacement(swept, "new_label", "probability_up", F.col("threshold"), STREAM_KEYS, calibrate=False), "sweep")
    return B.sweep_and_gate(swept, base_stream(spark, d), SID, ["challenger", "threshold"], EARLY_YEARS, M.START)


@query("e8_breadth_family", "candidate:s " + _SEL)
def e8(spark, d):
    """Residual candidates with market breadth beside the index context."""
    cal = stock_calendar(spark, d)
    br = X.breadth_features(cal.select("trade_date"), P.market_breadth(C.stocks(spark, d)), cal).select("trade_date", *X.BREADTH_COLUMNS)
    h = LQ.context_stream(spark, d).join(br, "trade_date", "left")
    return residual_selection(spark, d, N.residual_family(h, (*LQ.RESIDUAL, *X.BREADTH_COLUMNS), "breadth"))


@query("e9_directional_error_family", _SEL)
def e9(spark, d):
    """Error model with overseas risk before the signal."""
    dates = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    over = X.global_risk_features(dates, D.external_series(spark, d), ["A", "N"])
    names = [f"{a}_{n}" for a in "AN" for n in X.RISK]
    h = LQ.history(spark, d).join(over.select("trade_date", *names), "trade_date", "left")
    return error_family(h, (*LQ.HIST, *names), spark, d, fitted=all_known(*[F.col(c) for c in names]), minimum=252)


@query("e10_stacked_family", _SEL)
def e10(spark, d):
    """Error model stacked on the log-odds of three other streams."""
    s = forecast_streams(spark, d)
    p = F.when(F.col("predicted_label") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    names = ["level", "momentum", "volume"]
    aux = s.where(F.col("stream_id").isin(*names)).select("series_id", "trade_date", F.col("stream_id").alias("name"), p.alias("probability"), F.col("pos").alias("training_rows"), F.date_sub("trade_date", 1).alias("last_training_date"))
    h = X.auxiliary_features(LQ.history(spark, d), aux, names, ["series_id"])
    return error_family(h, (*LQ.HIST, *[f"aux_{n}" for n in names]), spark, d, fitted=F.col("aux_fitted"))


@query("e11_guard_family", M.CHECK_SPEC,
       S.with_(S.STREAMS, M.GUARD).rstrip() + """, gl AS (SELECT g.* REPLACE (coalesce(o.confidence, g.confidence) AS confidence, coalesce(o.uncalibrated_predicted_return, g.uncalibrated_predicted_return) AS uncalibrated_predicted_return) FROM grd g LEFT JOIN streams o ON o.series_id = g.series_id AND o.pos = g.pos AND o.stream_id = g.guard_source),
ado AS (SELECT * REPLACE (guard_label AS predicted_label, abs(uncalibrated_predicted_return)*(2*guard_label - 1) AS predicted_pct_change, guard_label = (real_pct_change > 0)::INT AS correct) FROM gl)""" + M.gate_sql("ado"))
def e11(spark, d):
    """Guarded stream against the incumbent."""
    s = forecast_streams(spark, d)
    b = s.where("stream_id = 'base'")
    other = s.where("stream_id <> 'base'")
    g = V.evidence_guard(b, other, SID)
    alt = other.select("series_id", "pos", F.col("stream_id").alias("guard_source"), F.col("confidence").alias("_c"), F.col("uncalibrated_predicted_return").alias("_u"))
    j = g.join(alt, ["series_id", "pos", "guard_source"], "left").withColumn("uncalibrated_predicted_return", F.coalesce("_u", "uncalibrated_predicted_return"))
    out = V.relabel(j, F.col("guard_label"), F.col("guard_source") != "baseline", F.col("_c"))
    return E.non_regression_gate(b, stage(out, "guard"), SID, M.START)


_DUR_SQL = S.with_(S.INDEX, RQ._BASE, RQ._DUR, RQ.counts("rc", "dur", 120, 1), RQ.scored("rs", "rc", RQ.ACC), RQ.top("tp", "rs"), "sgn AS (SELECT series_id, pos, (sum(weight*p_duration)/sum(weight) >= 0.5 - 1e-12)::INT AS predicted_label FROM tp GROUP BY 1, 2)")


@query("e12_duration_hypothesis", "series_id:s rows:i accuracy:f balanced_accuracy:f predicted_up_rows:i", adopted_sql(_DUR_SQL) + f" SELECT series_id, {M.M} FROM ado WHERE real_pct_change IS NOT NULL GROUP BY 1")
def e12(spark, d):
    """Duration-conditioned rules adopted over the incumbent, measured."""
    return E.stream_metrics(B.adopt_labels(base_stream(spark, d), R.duration_probability(RQ.panel(spark, d))), SID)


@query("e13_timing_policies", "policy:s asset:s series_id:s rows:i accuracy:f")
def e13(spark, d):
    """Direction by the sign of the foreign return under three timing policies."""
    signals = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    signals = D.each_asset(signals)
    bars = D.external_series(spark, d).select("asset", "trade_date", "close", F.col("low").alias("open"), "high", "low", F.col("qty").alias("vol"))
    b = base_stream(spark, d)
    parts = {}
    for p in ("previous_available", "current_prices", "augment_current_prices"):
        f = X.foreign_close_features(signals, bars, p)
        name = "foreign_ret1_lag1" if p == "previous_available" else "foreign_ret1"
        lab = f.where(F.col(name).isNotNull()).select("asset", "trade_date", B.sign_label(F.col(name)).alias("predicted_label"))
        parts[p] = E.stream_metrics(b.drop("predicted_label").join(lab, "trade_date"), ["asset", *SID])
    return B.by_policy(parts)


@query("e14_specialist_family", M.CHECK_SPEC)
def e14(spark, d):
    """Two specialists pooled adaptively, calibrated, applied and gated."""
    s = LQ.core_stream(spark, d)
    k = ["series_id", "pos"]
    a = L.downside_probabilities(s, X.CORE_COLUMNS, F.col("core_available"))
    b = L.downside_probabilities(s, X.CORE_COLUMNS[:3], F.col("core_available"), weight="recent").select(*k, F.col("downside_probability").alias("right_p"), F.col("downside_training_rows").alias("right_n"))
    j = stage(a.join(b, k).withColumn("target", (F.col("real_pct_change") <= 0).cast("int")).withColumn("n", F.least("downside_training_rows", "right_n")), "pair")
    ok = (F.col("predicted_label") == 1) & (F.col("n") > 0)
    pooled = K.adaptive_pool(j, SID, "downside_probability", "right_p", "target", ok)
    cal = K.isotonic_calibrate(pooled, SID, "pooled_probability", "target", ok)
    return E.non_regression_gate(base_stream(spark, d), stage(V.downside_flip(cal, "calibrated_probability", "n", F.lit(0.55)), "specialist"), SID, M.START)


@query("e15_fx_family", "series_id:s variant:s rows:i accuracy:f balanced_accuracy:f")
def e15(spark, d):
    """Quote features admitted as one block: nested, paired and learned-threshold choice, and the pooled error model, control beside them."""
    with one_reading():
        signals = D.index_series(spark, d).select("trade_date").distinct()
        fx = X.fx_features(D.each_asset(signals), D.external_series(spark, d))
        base = stage(base_stream(spark, d), "incumbent")
        core = LQ.core_stream(spark, d, base)
    each = {f"{a}_{n}": (a, n) for a in D.ASSETS for n in ("fx_return_1", "fx_volatility_20", "fx_close_spread")}
    names = list(each)
    wide = fx.groupBy("trade_date").agg(*[F.max(F.when(F.col("asset") == a, F.col(n))).alias(k) for k, (a, n) in each.items()])
    s = stage(core.join(wide, "trade_date", "left"), "fx-stream")
    sets = {"base": LQ.SETS["base"], "extended": (*LQ.SETS["base"], *names)}
    known, real, label = all_known(*[F.col(n) for n in sets["extended"]]), F.col("real_pct_change"), F.col("predicted_label")
    up = (label == 1) & known
    f = stage(L.folds(s, SID, up, up & real.isNotNull(), real <= 0, minimum=240), "fx")
    attempts = stage(L.nested_attempts(f, SID, sets, thresholds=(0.55, 0.6, 0.65)), "fx-attempts")
    at = attempts.where("correction_threshold = 0.6")
    both = {k: LQ.both_ways(v) for k, v in sets.items()}
    g = stage(L.folds(X.direction_interactions(s, sets["extended"]), SID, known, known & real.isNotNull(), (label != (real > 0).cast("int")).cast("int"), minimum=240), "fx-error")
    wrong = L.nested_attempts(g, SID, both, thresholds=(0.55, 0.6, 0.65))
    choices = {
        "nested": (f, sets, L.select_choice(at, SID)), "paired": (f, sets, L.select_choice(at, SID, paired=True)),
        "learned_threshold": (f, sets, L.select_choice(attempts, SID, paired=True, learn_threshold=True)),
        "pooled_error": (g, both, L.select_choice(wrong, SID, paired=True, learn_threshold=True)),
    }
    cols = ["series_id", "trade_date", "predicted_label", "predicted_pct_change", "real_pct_change", "confidence", "calibrated_confidence"]
    variants = {"control": base.select(*cols)}
    for name, (folded, features, choice) in choices.items():
        p = L.nested_probabilities(folded, choice, SID, features)
        j = base.join(p.select("series_id", "pos", "probability", "training_rows", "selected_threshold"), ["series_id", "pos"], "left").fillna(0, ["training_rows"])
        flip = V.two_sided_flip if name == "pooled_error" else V.downside_flip
        variants[name] = flip(j, "probability", "training_rows", F.coalesce("selected_threshold", F.lit(2.0))).select(*cols)
    return E.stream_metrics(B.by_policy(variants, "variant"), ["series_id", "variant"])


@query("e16_context_ablation", "variant:s series_id:s rows:i brier:f4 log_loss:f4")
def e16(spark, d):
    """Specialist with and without the breadth block, scored on identical rows; trend breadth has no session in common with the streams here."""
    s = LQ.special(spark, d)
    y = (F.col("real_pct_change") <= 0).cast("int")
    parts = {}
    for name, cols in (("control", [c for c in LQ.SPECIAL if not c.startswith("breadth_")]), ("candidate", LQ.SPECIAL)):
        p = L.downside_probabilities(s, cols, F.col("specialist_available")).where("downside_training_rows > 0 AND real_pct_change IS NOT NULL")
        parts[name] = E.probability_scores(p, SID, F.col("downside_probability"), y)
    return B.by_policy(parts, "variant")


_CMP = ["accuracy", "balanced_accuracy", "calibrated_brier", "return_mae", "return_rmse", *M._STAB]


@query("e17_stream_comparison", "stream_id:s series_id:s " + M.f(*_CMP),
       S.with_(S.STREAMS, M.ROLL20.replace("FROM streams)", "FROM streams WHERE real_pct_change IS NOT NULL)"), M.STABILITY, f"mx AS (SELECT * FROM (SELECT stream_id, series_id, {M.M} FROM streams WHERE real_pct_change IS NOT NULL GROUP BY 1, 2) JOIN stb USING (stream_id, series_id))")
       + "SELECT a.stream_id, a.series_id, " + ", ".join(f"a.{m} - b.{m} AS {m}" for m in _CMP) + " FROM mx a JOIN mx b ON a.series_id = b.series_id AND b.stream_id = 'base' WHERE a.stream_id <> 'base'")
def e17(spark, d):
    """Metric and stability differences of every engine from the base one."""
    s = stage(forecast_streams(spark, d), "engines")
    r = E.stream_metrics(s, STREAM_KEYS).join(E.stability(s, STREAM_KEYS), list(STREAM_KEYS))
    base = r.where("stream_id = 'base'").drop("stream_id")
    names = [n for (n,) in s.select("stream_id").distinct().where("stream_id <> 'base'").collect()]
    return B.by_policy({n: E.report_delta(r.where(F.col("stream_id") == n).drop("stream_id"), base, SID, _CMP) for n in sorted(names)}, "stream_id")


@query("e18_daily_panel_build", spec("breadth", BREADTH), S.with_(S.STOCK, C.BREADTH_DAY) + aligned("breadth", BREADTH, "brd", 0, signals="SELECT trade_date FROM cal"))
def e18(spark, d):
    """Breadth panel built, landed as a table and turned into same-day features."""
    day = stage(P.market_breadth(C.stocks(spark, d)), "breadth_day")
    cal = calendar_of(day)
    return X.breadth_features(cal.select("trade_date"), day, cal, lag=0)


#: What the daily builds make: name, feature query and its availability column.
PANELS = (("breadth", "f1_breadth_features", "breadth_available"), ("distribution", "f2_distribution_features", "distribution_available"), ("moneyflow", "f3_moneyflow_features", "moneyflow_available"),
          ("capital", "f4_capital_features", "capital_available"), ("intraday", "f12_intraday_features", "intraday_available"), ("trend", "f16_trend_features", "trend_available"))
CONTEXTS = (("moneyflow", "f3_moneyflow_features", "moneyflow_available"), ("capital", "f5_capital_close_features", "capital_available"), ("shares", "f6_share_change_features", "etf_available"),
            ("funding", "f7_funding_features", "funding_available"), ("futures", "f8_futures_features", "futures_available"), ("fx", "f9_fx_features", "fx_available"),
            ("overseas", "f10_global_risk_features", "global_available"), ("liquidity", "f13_liquidity_features", "liquidity_available"), ("option", "f14_option_features", "option_available"),
            ("option_position", "f15_option_position_features", "option_position_available"))


def builds_sql(parts):
    return " UNION ALL ".join(f"SELECT '{name}' AS build, trade_date, count(*) AS rows, sum({available}) AS available_rows FROM ({ORACLES[source]}) GROUP BY 2" for name, source, available in parts)


def builds(spark, d, parts):
    """Each set built and landed as a table, then counted by session from the landed rows; the sets share what they derive from the inputs."""
    with one_reading():
        landed = {name: stage(QUERIES[source](spark, d), f"build-{name}") for name, source, _ in parts}
    counted = {name: landed[name].groupBy("trade_date").agg(F.count("*").alias("rows"), F.sum(available).alias("available_rows")) for name, _, available in parts}
    return B.by_policy(counted, "build")


@query("e18_all_panels", "build:s trade_date:d rows:i available_rows:i", builds_sql(PANELS))
def e18_all(spark, d):
    """Six daily panels built and landed, with their rows and available rows by session."""
    return builds(spark, d, PANELS)


@query("e19_all_contexts", "build:s trade_date:d rows:i available_rows:i", builds_sql(CONTEXTS))
def e19_all(spark, d):
    """Ten derived contexts built and landed, with their rows and available rows by session."""
    return builds(spark, d, CONTEXTS)


@query("e19_derived_context_build", "context:s trade_date:d available:b", S.with_(S.FUTURES, C.FUTURES_DAY, "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM fut0))",
       "fx_ AS (SELECT * FROM (WITH " + aligned("futures", FUT, "fday", 1, keys="product").strip().lstrip(",").strip() + "))", S.OPTION, C.OPTION_DAY, "ox_ AS (SELECT * FROM (WITH " + aligned("option", OPT, "oday", 1, cal="ocal").strip().lstrip(",").strip() + "))")
       + "SELECT 'futures_' || product AS context, trade_date, futures_available AS available FROM fx_ UNION ALL SELECT 'option', trade_date, option_available FROM ox_")
def e19(spark, d):
    """Futures and option contexts from landed contracts."""
    f = stage(P.futures_curve(D.futures_daily(spark, d), D.spot_series(spark, d)), "futures_day")
    o = stage(P.option_activity(D.option_daily(spark, d)), "option_day")
    cal = calendar_of(o)
    fx = X.futures_features(f.select("product", "trade_date"), f, cal)
    ox = X.option_features(o.select("trade_date"), o, cal)
    return fx.select(F.concat(F.lit("futures_"), "product").alias("context"), "trade_date", F.col("futures_available").alias("available")).unionByName(
        ox.select(F.lit("option").alias("context"), "trade_date", F.col("option_available").alias("available")))


@query("e20_merged_features", "series_id:s trade_date:d foreign_id:s close:f2 target_next_return:f foreign_ret1_lag1:f",
       S.with_(S.INDEX) + f"SELECT t.series_id, t.trade_date, h.series_id AS foreign_id, t.close, t.n/t.close - 1 AS target_next_return, h.r AS foreign_ret1_lag1 FROM (SELECT *, lead(close) OVER (PARTITION BY series_id ORDER BY trade_date) AS n FROM idx) t LEFT JOIN (SELECT series_id, trade_date, lag(r) OVER (PARTITION BY series_id ORDER BY trade_date) AS r FROM (SELECT series_id, trade_date, {S.growth('close', 1, 'series_id', 'trade_date')} AS r FROM idx)) h USING (trade_date)")
def e20(spark, d):
    """Each series' targets joined to the lagged block of each other market's series."""
    i = D.index_series(spark, d)
    h = Q.price_features(i, SID, "foreign_", lag=A.default_lag(True, "after_close")).withColumnRenamed("series_id", "foreign_id")
    return Q.next_session_target(i, SID).join(h, "trade_date", "left")


@query("e21_paired_live_audit", "series_id:s side:s window:i rows:i accuracy:f sufficient:b",
       S.with_(S.STREAMS, LG.STAMP, """pa AS (SELECT a.series_id, a.trade_date, row_number() OVER (PARTITION BY a.series_id ORDER BY a.trade_date DESC) AS back FROM stp a WHERE a.real_pct_change IS NOT NULL AND created_at < opens),
px AS (SELECT series_id, trade_date, 0 AS w FROM pa UNION ALL SELECT series_id, trade_date, w FROM pa, (VALUES (20), (60), (252)) t(w) WHERE back <= w)""")
       + f"SELECT *, rows >= \"window\" AS sufficient FROM (SELECT series_id, CASE stream_id WHEN 'momentum' THEN 'candidate' ELSE 'control' END AS side, w AS \"window\", {M.M} FROM px JOIN streams USING (series_id, trade_date) WHERE stream_id IN ('base', 'momentum') GROUP BY 1, 2, 3)")
def e21(spark, d):
    """Candidate and control on live rows only."""
    s = LG.stamped(spark, d).select("series_id", "trade_date", G.origin(F.col("created_at"), F.col("target_date")).alias("origin"))
    x = forecast_streams(spark, d).join(s, ["series_id", "trade_date"])
    return E.prospective_audit(x.where("stream_id = 'momentum'"), x.where("stream_id = 'base'"), SID, F.col("origin") == "live")


@query("e22_replay_and_pending", "series_id:s signal_date:d record_type:s direction:s complete:b", S.with_(S.STREAMS) + "SELECT *, count(*) OVER w = 253 AND count(*) FILTER (record_type = 'validated') OVER w = 252 AND max_by(record_type, signal_date) OVER w = 'pending' AS complete FROM (SELECT series_id, trade_date AS signal_date, CASE WHEN real_pct_change IS NULL THEN 'pending' ELSE 'validated' END AS record_type, CASE predicted_label WHEN 1 THEN 'up' ELSE 'down' END AS direction FROM base QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY trade_date DESC) <= 253) WINDOW w AS (PARTITION BY series_id)")
def e22(spark, d):
    """The last 252 validated sessions and the pending forecast, and whether a series has all of them."""
    tail, short = B.replay_with_pending(base_stream(spark, d), SID, 252)
    flagged = A.public_projection(tail).join(short.select("series_id", F.lit(False).alias("complete")), "series_id", "left")
    return flagged.fillna(True, ["complete"])


@query("e23_single_stream_publish", "series_id:s trade_date:d predicted_label:i run_id:s target_date:d actual_return:f settled_by:s",
       S.with_(S.STREAMS) + f"SELECT *, CASE WHEN {LG._IN} THEN 'first' ELSE 'second' END AS run_id, real_pct_change AS actual_return, CASE WHEN target_date <= DATE '{LG.CUT}' THEN 'first' WHEN target_date IS NOT NULL THEN 'second' END AS settled_by FROM base LEFT JOIN (SELECT series_id, trade_date, lead(trade_date) OVER (PARTITION BY series_id ORDER BY trade_date) AS target_date FROM idx) USING (series_id, trade_date)")
def e23(spark, d):
    """Two publishes of one stream and a repeat of the second: forecasts, the run that added each, and the run that settled it."""
    b = stage(base_stream(spark, d).select("series_id", "trade_date", "close", "predicted_label", "predicted_pct_change", "predicted_close", "confidence", "calibrated_confidence"), "to-publish")
    i = stage(D.index_series(spark, d).select("series_id", "trade_date", "close"), "bars")
    common = calendar_of(i.groupBy("trade_date").agg(F.count("*").alias("n")).where(F.col("n") == i.agg(F.count_distinct("series_id")).scalar()))
    root = f"{shared_dir(spark)}/landed/publish-{uuid.uuid4().hex}"

    def forecast(history):
        return G.forecast_fingerprint(b.join(history.select("series_id", "trade_date"), ["series_id", "trade_date"], "left_semi"))

    for run, rows in (("first", i.where(F.col("trade_date") <= LG.CUT)), ("second", i), ("second", i)):
        done = PB.publish_stream(spark, root, run, rows, common, forecast, SID, ["close"])
    return PB.published_forecasts(done, SID)
