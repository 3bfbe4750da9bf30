"""Threshold-rule panels: generation, scoring, merging and voting.

The panel is long, one row per (series, rule, position) with `pred` in {0, 1}
or null, and the row's `label` (null while unresolved).  Scores are differences
of running counts, so their cost does not depend on the window.  Where a vote
needs whole paths, each (series, rule) path is kept as one array over the
session axis and sliced per chosen rule; history is never joined row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import ordered, prior
from tidemark.operators.series import prior_quantiles, state_duration, window_sum, with_running

FEATURES = ("return_1", "overnight_gap", "intraday_return")
QUANTILES = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
CALIBRATION, MINIMUM, TOP_K = 120, 30, 5
MAJORITY = 0.5 - 1e-12  # an even vote counts as up whatever the order of its additions


def threshold_rules(bars: DataFrame, keys: Sequence[str] = ("series_id",), window: int = 756, minimum: int = 40) -> DataFrame:
    """Rules feature > quantile and feature <= quantile of earlier rows, for each feature and quantile."""
    w = ordered(keys, "trade_date")
    c = F.col("close")
    base = bars.select(
        *keys, "trade_date", (F.row_number().over(w) - 1).alias("pos"), ((F.lead(c).over(w) / c - 1) > 0).cast("int").alias("label"),
        (c / F.lag(c).over(w) - 1).alias("return_1"), (F.col("open") / F.col("pre_close") - 1).alias("overnight_gap"), (c / F.col("open") - 1).alias("intraday_return"))
    base = prior_quantiles(base, keys, "pos", FEATURES, QUANTILES, window, minimum)
    items = []
    for i, n in enumerate(FEATURES):
        for j, _ in enumerate(QUANTILES):
            above = (F.col(n) > F.nanvl(F.col(f"{n}_q{j}"), F.lit(None))).cast("int")
            first = (i * len(QUANTILES) + j) * 2
            items += [F.struct(F.lit(first).alias("rule_id"), above.alias("pred")), F.struct(F.lit(first + 1).alias("rule_id"), (1 - above).alias("pred"))]
    return base.select(*keys, "trade_date", "pos", "label", F.explode(F.array(*items)).alias("r")).select(*keys, "trade_date", "pos", "label", "r.*")


def rule_name(rule: Column) -> Column:
    """Readable name of a generated rule."""
    n = len(QUANTILES)
    feature = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), (F.floor(rule / (2 * n)) + 1).cast("int"))
    q = F.element_at(F.array(*[F.lit(f"{x:.1f}") for x in QUANTILES]), (F.floor((rule % (2 * n)) / 2) + 1).cast("int"))
    return F.concat(feature, F.when(rule % 2 == 0, ">rolling_q").otherwise("<=rolling_q"), q)


def _counts(panel: DataFrame, keys: Sequence[str], pred: str = "pred") -> DataFrame:
    """Running counts of the four prediction/outcome combinations of each rule."""
    k = F.col(pred).isNotNull() & F.col("label").isNotNull()
    flags = {f"_{p}{y}": k & (F.col(pred) == p) & (F.col("label") == y) for p in (0, 1) for y in (0, 1)}
    return with_running(panel, [*keys, "rule_id"], "pos", flags)


def scored(panel: DataFrame, keys: Sequence[str] = ("series_id",), method: str = "accuracy", window: int = CALIBRATION, minimum: int = MINIMUM,
           skip: int = 0, class_minimum: int = 0, pred: str = "pred", today: bool = True) -> DataFrame:
    """Score of each rule on its earlier window: accuracy, balanced or correlation.

    Rules with a score on the wrong side are reversed.  `skip` leaves the most
    recent rows out of the window; `class_minimum` asks for rows of both classes.
    """
    w = ordered([*keys, "rule_id"], "pos")
    c = {x: window_sum(f"_{x}", w, window, skip).alias(f"n{x}") for x in ("00", "01", "10", "11")}
    f = _counts(panel, keys, pred).select(*panel.columns, *c.values())
    n00, n01, n10, n11 = (F.col(f"n{x}").cast("double") for x in ("00", "01", "10", "11"))
    rows = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    up, down = n01 + n11, n00 + n10
    if method == "accuracy":
        raw = F.coalesce(F.try_divide(n00 + n11, rows), F.lit(0.0))
        reverse, score = raw < 0.5, F.greatest(raw, 1 - raw)
    elif method == "balanced":
        both = (F.coalesce(F.try_divide(n11, up), F.lit(0.0)) + F.coalesce(F.try_divide(n00, down), F.lit(0.0))) / 2
        raw = F.when((up > 0) & (down > 0), both).otherwise(0.5)
        reverse, score = raw < 0.5, F.greatest(raw, 1 - raw)
    else:
        den = F.sqrt((n11 + n10) * up * down * (n00 + n01))
        raw = F.coalesce(F.try_divide(n11 * n00 - n10 * n01, den), F.lit(0.0))
        reverse, score = raw < 0, F.abs(raw)
    ok = rows >= minimum
    if today:
        ok = ok & F.col(pred).isNotNull()
    if class_minimum:
        ok = ok & (up >= class_minimum) & (down >= class_minimum)
    return f.select(*panel.columns, rows.alias("calibration_rows"), raw.alias("raw_score"), reverse.alias("reverse"), score.alias("score"), ok.alias("eligible"))


def top_rules(scores: DataFrame, keys: Sequence[str] = ("series_id",), k: int = TOP_K, edge: float = 0.5) -> DataFrame:
    """Best k eligible rules per position, ties to the smaller rule id, with vote weights."""
    w = Window.partitionBy(*keys, "pos").orderBy(F.desc("score"), "rule_id")
    best = scores.where("eligible").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumn("weight", F.greatest(F.col("score") - edge, F.lit(0.001)))


def rule_paths(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One array per (series, rule) over the session axis: -1 unknown, else the prediction."""
    p = F.struct("pos", F.coalesce("pred", F.lit(-1)).alias("v"))
    return panel.groupBy(*keys, "rule_id").agg(F.transform(F.array_sort(F.collect_list(p)), lambda x: x["v"]).alias("path"))


def label_paths(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    one = panel.where("rule_id = 0").select(*keys, F.struct("pos", F.coalesce("label", F.lit(-1)).alias("v")).alias("p"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["v"]).alias("labels"))


def _window_of(path: Column, pos: Column, window: int, current: bool) -> Column:
    start = F.greatest(pos - window, F.lit(0))
    return F.slice(path, start + 1, pos - start + (1 if current else 0))


def oriented_experts(top: DataFrame, panel: DataFrame, keys: Sequence[str] = ("series_id",), window: int = CALIBRATION) -> DataFrame:
    """Chosen rules with their oriented path over the history and today."""
    j = top.join(rule_paths(panel, keys), [*keys, "rule_id"])
    raw = _window_of(F.col("path"), F.col("pos"), window, True)
    flip = F.transform(raw, lambda v: F.when(v >= 0, 1 - v).otherwise(v))
    return j.withColumn("oriented", F.when(F.col("reverse"), flip).otherwise(raw)).drop("path")


def merged_experts(experts: DataFrame, keys: Sequence[str] = ("series_id",), sum_weights: bool = True) -> DataFrame:
    """Collapse rules with identical oriented paths; weights are summed or the best rule kept."""
    weight = F.sum("weight") if sum_weights else F.max("weight")
    return experts.groupBy(*keys, "pos", "oriented").agg(F.min("rule_id").alias("rule_id"), F.count("*").alias("members"), weight.alias("weight"))


def weighted_vote(merged: DataFrame, labels: DataFrame, keys: Sequence[str] = ("series_id",), window: int = CALIBRATION) -> DataFrame:
    """Today's weighted vote and the accuracy of the same vote over the history.

    A historical date counts only where every expert was known.  The experts of
    one position (at most k) are folded into a vote per date, which turns to -1
    at the first unknown expert.
    """
    last = F.element_at("oriented", -1)
    today = (F.sum(F.col("weight") * last) / F.sum("weight")).alias("vote")
    g = merged.groupBy(*keys, "pos").agg(today, F.count("*").alias("experts"), F.sum("members").alias("ranked_rules"), F.sum("weight").alias("total"),
                                         (F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("effective_experts"),
                                         F.collect_list(F.struct("oriented", "weight")).alias("e"))
    g = g.join(labels, list(keys))
    zero = F.transform(F.element_at("e", 1)["oriented"], lambda _: F.lit(0.0))
    votes = F.aggregate("e", zero, lambda acc, x: F.zip_with(acc, x["oriented"], lambda a, v: F.when((a >= 0) & (v >= 0), a + x["weight"] * v).otherwise(-1.0)))
    g = g.withColumn("_v", votes).withColumn("_y", _window_of(F.col("labels"), F.col("pos"), window, False))
    right = F.zip_with(F.slice("_v", 1, F.size("_y")), "_y", lambda v, y: F.when((v >= 0) & (y >= 0), (v / F.col("total") >= MAJORITY).cast("int") == y))
    g = g.withColumn("_r", F.filter(right, lambda x: x.isNotNull()))
    n = F.size("_r")
    return g.select(*keys, "pos", "vote", (F.col("vote") >= MAJORITY).cast("int").alias("predicted_label"), "experts", "ranked_rules", "effective_experts",
                    n.alias("calibration_rows"), F.when(n > 0, F.size(F.filter("_r", lambda x: x)) / n).alias("calibration_accuracy"), "_y")


def rule_signal(panel: DataFrame, keys: Sequence[str] = ("series_id",), method: str = "accuracy", sum_weights: bool = True) -> DataFrame:
    """Ranked-rule signal: score, choose, merge and vote."""
    edge = 0.0 if method == "correlation" else 0.5
    top = top_rules(scored(panel, keys, method), keys, edge=edge)
    merged = merged_experts(oriented_experts(top, panel, keys), keys, sum_weights)
    return weighted_vote(merged, label_paths(panel, keys), keys).drop("_y")


def prequential_signal(panel: DataFrame, keys: Sequence[str] = ("series_id",), balanced: bool = False, window: int = CALIBRATION,
                       minimum: int = MINIMUM, k: int = TOP_K, class_minimum: int = 10) -> DataFrame:
    """Orient each historical prediction with what was known then, rank on the emitted predictions."""
    first = scored(panel, keys, "accuracy", window, minimum)
    emitted = F.when(F.col("eligible"), F.when(F.col("reverse"), 1 - F.col("pred")).otherwise(F.col("pred")))
    paths = first.select(*keys, "trade_date", "pos", "label", "rule_id", emitted.alias("pred"))
    second = scored(paths, keys, "balanced" if balanced else "accuracy", window, minimum, class_minimum=class_minimum if balanced else 0)
    edge = second.where(F.col("eligible") & (F.col("raw_score") > 0.5))
    w = Window.partitionBy(*keys, "pos").orderBy(F.desc("raw_score"), "rule_id")
    top = edge.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("weight", F.col("raw_score") - 0.5)
    vote = top.groupBy(*keys, "pos").agg(F.count("*").alias("rules"), (F.sum(F.col("weight") * F.col("pred")) / F.sum("weight")).alias("vote"), F.max("raw_score").alias("top_score"))
    return vote.withColumn("predicted_label", (F.col("vote") >= MAJORITY).cast("int"))


def validated_signal(panel: DataFrame, keys: Sequence[str] = ("series_id",), balanced: bool = False, validation: int = 60, class_minimum: int = 10, k: int = TOP_K) -> DataFrame:
    """Rank on an older period, accept only rules that kept balanced skill in the later one."""
    rank = scored(panel, keys, "balanced" if balanced else "accuracy", CALIBRATION, MINIMUM, skip=validation, class_minimum=class_minimum if balanced else 0, today=False)
    w = Window.partitionBy(*keys, "pos").orderBy(F.desc("score"), "rule_id")
    later = _counts(rank, keys).select(*rank.columns, *[window_sum(f"_{x}", ordered([*keys, "rule_id"], "pos"), validation).alias(f"v{x}") for x in ("00", "01", "10", "11")])
    path = rule_paths(panel, keys)
    known = later.where("eligible").join(path, [*keys, "rule_id"])
    end = F.greatest(F.col("pos") - validation, F.lit(0))
    raw = _window_of(F.col("path"), end, CALIBRATION, False)
    flip = F.transform(raw, lambda v: F.when(v >= 0, 1 - v).otherwise(v))
    known = known.withColumn("_sig", F.when(F.col("reverse"), flip).otherwise(raw)).drop("path")
    dup = Window.partitionBy(*keys, "pos", "_sig").orderBy(F.desc("score"), "rule_id")
    unique = known.withColumn("_d", F.row_number().over(dup)).where("_d = 1")
    chosen = unique.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    up, down = F.col("v01") + F.col("v11"), F.col("v00") + F.col("v10")
    hit_up = F.when(F.col("reverse"), F.col("v01")).otherwise(F.col("v11"))
    hit_down = F.when(F.col("reverse"), F.col("v10")).otherwise(F.col("v00"))
    skill = (F.try_divide(hit_up, up) + F.try_divide(hit_down, down)) / 2
    good = chosen.withColumn("skill", skill).where(F.col("pred").isNotNull() & (up >= class_minimum) & (down >= class_minimum) & (F.col("skill") > 0.5))
    now = F.when(F.col("reverse"), 1 - F.col("pred")).otherwise(F.col("pred"))
    weight = F.greatest(F.col("score") - 0.5, F.lit(0.001))
    out = good.withColumn("_n", now).withColumn("_w", weight).groupBy(*keys, "pos").agg(
        F.count("*").alias("accepted"), (F.sum(F.col("_w") * F.col("_n")) / F.sum("_w")).alias("vote"), F.min("skill").alias("minimum_skill"))
    return out.withColumn("predicted_label", (F.col("vote") >= MAJORITY).cast("int"))


def conditional_probability(panel: DataFrame, keys: Sequence[str] = ("series_id",), half_life: float | None = None, prior_count: float = 2.0) -> DataFrame:
    """Probability of up given each chosen rule's state today, averaged by rule weight.

    The frame is a position range inside one (series, rule, state) partition, so
    only equal-state history is read.
    """
    w = Window.partitionBy(*keys, "rule_id", "pred").orderBy("pos").rangeBetween(-CALIBRATION, -1)
    scale = F.lit(1.0) if half_life is None else F.pow(F.lit(2.0), F.col("pos") / half_life)
    known = F.when(F.col("label").isNotNull(), scale)
    now = F.lit(1.0) if half_life is None else F.pow(F.lit(2.0), (F.col("pos") - 1) / half_life)
    mass = F.coalesce(F.sum(known).over(w), F.lit(0.0)) / now
    ups = F.coalesce(F.sum(F.when(F.col("label") == 1, scale)).over(w), F.lit(0.0)) / now
    p = panel.withColumn("p_up", (ups + prior_count / 2) / (mass + prior_count))
    top = top_rules(scored(p, keys), keys)
    out = top.groupBy(*keys, "pos").agg(F.count("*").alias("rules"), (F.sum(F.col("weight") * F.col("p_up")) / F.sum("weight")).alias("probability_up"))
    return out.withColumn("predicted_label", (F.col("probability_up") >= MAJORITY).cast("int"))


def logistic_probability(panel: DataFrame, keys: Sequence[str] = ("series_id",), window: int = CALIBRATION, minimum: int = MINIMUM, c: float = 0.1) -> DataFrame:
    """Probability of up from a logistic fit over each position's distinct oriented rules.

    Each row carries at most k paths of `window` outcomes, so the fits are
    independent rows of an Arrow batch.
    """
    from tidemark.operators.walkforward import logistic

    fit = logistic(c, scale=False)
    merged = merged_experts(oriented_experts(top_rules(scored(panel, keys), keys), panel, keys, window), keys)
    g = merged.groupBy(*keys, "pos").agg(F.sort_array(F.collect_list(F.struct("rule_id", "oriented"))).alias("_e"), F.count("*").alias("experts"))
    g = g.join(label_paths(panel, keys), list(keys)).withColumn("_y", _window_of(F.col("labels"), F.col("pos"), window, False))

    @F.pandas_udf(T.DoubleType())
    def solve(paths: pd.Series, labels: pd.Series) -> pd.Series:
        out = []
        for rows, y in zip(paths, labels):
            x, y = np.array([np.asarray(r, dtype=float) for r in rows]).T, np.asarray(y, dtype=float)
            past = x[: len(y)]
            ok = (past >= 0).all(axis=1) & (y >= 0)
            if ok.sum() < minimum or len(np.unique(y[ok])) < 2:
                out.append(None)
            else:
                out.append(float(fit(past[ok], y[ok], np.ones(ok.sum()))(x[-1:])[0]))
        return pd.Series(out, dtype="float64")

    p = g.withColumn("probability_up", F.nanvl(solve(F.col("_e.oriented"), F.col("_y")), F.lit(None)))
    return p.select(*keys, "pos", "experts", "probability_up", (F.col("probability_up") >= MAJORITY).cast("int").alias("predicted_label"))


def duration_probability(panel: DataFrame, keys: Sequence[str] = ("series_id",), bounds: Sequence[int] = (1, 5, 20), mass: float = 10.0) -> DataFrame:
    """Probability of up given state and how long it has lasted, shrunk to the state's own probability."""
    d = state_duration(panel, [*keys, "rule_id"], "pos", "pred")
    b = F.lit(0)
    for x in bounds:
        b = b + (F.col("duration") > x).cast("int")
    d = d.withColumn("_bin", b)
    state = Window.partitionBy(*keys, "rule_id", "pred").orderBy("pos").rangeBetween(-CALIBRATION, -1)
    binned = Window.partitionBy(*keys, "rule_id", "pred", "_bin").orderBy("pos").rangeBetween(-CALIBRATION, -1)
    ups = lambda w: F.coalesce(F.sum("label").over(w), F.lit(0))
    d = d.withColumn("p_state", (ups(state) + 1) / (F.count("label").over(state) + 2)).withColumn("bin_rows", F.count("label").over(binned)).withColumn("_bu", ups(binned))
    d = d.withColumn("p_duration", (F.col("_bu") + mass * F.col("p_state")) / (F.col("bin_rows") + mass)).drop("_bu", "_bin")
    top = top_rules(scored(d, keys), keys)
    avg = lambda c: F.sum(F.col("weight") * F.col(c)) / F.sum("weight")
    out = top.groupBy(*keys, "pos").agg(F.count("*").alias("rules"), avg("p_duration").alias("probability_up"), avg("p_state").alias("state_probability_up"),
                                        avg("duration").alias("duration_mean"), avg("bin_rows").alias("history_rows_mean"))
    return out.withColumn("predicted_label", (F.col("probability_up") >= MAJORITY).cast("int"))


def with_fallback(candidate: DataFrame, incumbent: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Candidate's label where it exists, the incumbent's elsewhere."""
    c = candidate.select(*keys, "pos", F.col("predicted_label").alias("_c"))
    return incumbent.join(c, [*keys, "pos"], "left").withColumn("used_candidate", F.col("_c").isNotNull()).withColumn(
        "final_label", F.coalesce("_c", "predicted_label")).drop("_c")


def vote_context(panel: DataFrame, incumbent: DataFrame, keys: Sequence[str] = ("series_id",), slow: Sequence[str] = ("overnight_gap",), recent: int = 20) -> DataFrame:
    """Context of the incumbent's ranked vote: margin, concentration, persistence and streak."""
    top = top_rules(scored(panel, keys), keys)
    experts = oriented_experts(top, panel, keys)
    vote = weighted_vote(merged_experts(experts, keys), label_paths(panel, keys), keys)
    feature = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), (F.floor(F.col("rule_id") / (2 * len(QUANTILES))) + 1).cast("int"))
    n = F.size("oriented")
    back = F.slice(F.col("oriented"), F.greatest(n - recent, F.lit(1)), F.least(n - 1, F.lit(recent)))
    now = F.element_at("oriented", -1)
    same = F.size(F.filter(back, lambda v: v == now)) / F.greatest(F.size(F.filter(back, lambda v: v >= 0)), F.lit(1))
    e = experts.withColumn("_same", same).withColumn("_slow", feature.isin(*slow).cast("double"))
    shares = e.groupBy(*keys, "pos").agg((F.sum(F.col("weight") * F.col("_slow")) / F.sum("weight")).alias("rule_slow_weight"),
                                         (F.sum(F.col("weight") * F.col("_same")) / F.sum("weight")).alias("rule_persistence_20"))
    v = vote.withColumn("_rate", F.size(F.filter("_y", lambda y: y == 1)) / F.size(F.filter("_y", lambda y: y >= 0)))
    v = v.select(*keys, "pos", F.abs(2 * F.col("vote") - 1).alias("rule_margin"), F.col("vote").alias("rule_vote_up"), F.col("effective_experts").alias("rule_effective_experts"),
                 (F.col("calibration_accuracy") - F.greatest(F.col("_rate"), 1 - F.col("_rate"))).alias("rule_majority_edge"))
    s = state_duration(incumbent, keys, "pos", "predicted_label", "_streak")
    out = s.join(v, [*keys, "pos"]).join(shares, [*keys, "pos"])
    return out.withColumn("rule_aligned_margin", (2 * F.col("rule_vote_up") - 1) * (2 * F.col("predicted_label") - 1)).withColumn(
        "rule_direction_streak", F.log1p("_streak")).drop("_streak")


def _recent_accuracy(n: int, w) -> Column:
    return F.avg(F.col("correct").cast("double")).over(prior(w, n))


def state_veto(stream: DataFrame, volatility: DataFrame, keys: Sequence[str] = ("series_id",), quantile: float = 0.4, state_window: int = 360,
               window: int = 75, minimum: int = 10, bad: float = 0.46) -> DataFrame:
    """Reverse in a low-volatility state whose recent rows were mostly wrong (own definition).

    State: volatility at or below its earlier quantile.  Accuracy: the last
    `window` earlier rows of the same state.
    """
    w = ordered(keys, "pos")
    s = stream.join(volatility, [*keys, "trade_date"], "left")
    limit = F.percentile("volatility_20", F.lit(quantile)).over(prior(w, state_window))
    s = s.withColumn("low_state", F.col("volatility_20") <= limit)
    sw = Window.partitionBy(*keys, "low_state").orderBy("pos")
    h = prior(sw, window)
    s = s.withColumn("_n", F.count("correct").over(h)).withColumn("veto_accuracy", F.avg(F.col("correct").cast("double")).over(h))
    veto = F.coalesce(F.col("low_state") & (F.col("_n") >= minimum) & (F.col("veto_accuracy") < bad), F.lit(False))
    return s.withColumn("veto_applied", veto).withColumn("final_label", F.when(veto, 1 - F.col("predicted_label")).otherwise(F.col("predicted_label"))).withColumn(
        "final_confidence", F.when(veto, 1 - F.col("veto_accuracy")).otherwise(F.col("confidence"))).drop("_n")


def failure_guard(stream: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Invert after repeated failures, halve the size after milder ones (own definition)."""
    w = ordered(keys, "pos")
    s = stream.withColumn("acc_15", _recent_accuracy(15, w)).withColumn("acc_5", _recent_accuracy(5, w))
    invert = F.coalesce((F.col("acc_15") < 0.40) & (F.col("acc_5") < 0.40), F.lit(False))
    mild = F.coalesce(F.col("acc_15") < 0.45, F.lit(False)) & ~invert
    return s.withColumn("guard", F.when(invert, "invert").when(mild, "degrade").otherwise("none")).withColumn(
        "final_label", F.when(invert, 1 - F.col("predicted_label")).otherwise(F.col("predicted_label"))).withColumn(
        "final_return", F.col("predicted_pct_change") * F.when(invert, -1.0).when(mild, 0.5).otherwise(1.0)).withColumn(
        "final_confidence", F.when(invert, 1 - F.col("acc_15")).otherwise(F.col("confidence")))


def regime_flip(stream: DataFrame, states: Sequence[str], keys: Sequence[str] = ("series_id",), window: int = 180, minimum: int = 30, bad: float = 0.42) -> DataFrame:
    """Flip where any state column's (value, side) had a low accuracy over earlier positions."""
    out = stream
    worst = []
    for c in states:
        w = Window.partitionBy(*keys, c, "predicted_label").orderBy("pos").rangeBetween(-window, -1)
        out = out.withColumn(f"_a_{c}", F.when(F.count("correct").over(w) >= minimum, F.avg(F.col("correct").cast("double")).over(w)))
        worst.append(F.col(f"_a_{c}"))
    low = F.least(*worst) if len(worst) > 1 else worst[0]
    out = out.withColumn("regime_accuracy", low).withColumn("regime_flip", F.coalesce(F.col("regime_accuracy") < bad, F.lit(False)))
    return out.withColumn("final_label", F.when(F.col("regime_flip"), 1 - F.col("predicted_label")).otherwise(F.col("predicted_label"))).drop(*[f"_a_{c}" for c in states])


def engine_selector(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("series_id",), window: int = 240, minimum: int = 60, edge: float = 0.0,
                    disagreement_minimum: int = 30) -> DataFrame:
    """Follow the stream with the better earlier accuracy; where labels differ, the better one on earlier disagreements."""
    k = [*keys, "trade_date", "pos"]
    j = a.select(*k, F.col("predicted_label").alias("label_a"), F.col("correct").alias("_ca")).join(b.select(*k, F.col("predicted_label").alias("label_b"), F.col("correct").alias("_cb")), k)
    w = ordered(keys, "pos")
    h = prior(w, window)
    diff = F.col("label_a") != F.col("label_b")
    acc = lambda c: F.avg(F.col(c).cast("double")).over(h)
    dis = lambda c: F.avg(F.when(diff, F.col(c).cast("double"))).over(h)
    j = j.withColumn("rows", F.count("_ca").over(h)).withColumn("acc_a", acc("_ca")).withColumn("acc_b", acc("_cb")).withColumn(
        "dis_rows", F.count(F.when(diff, F.col("_ca"))).over(h)).withColumn("dis_a", dis("_ca")).withColumn("dis_b", dis("_cb"))
    whole = (F.col("rows") >= minimum) & (F.col("acc_b") - F.col("acc_a") > edge)
    split = F.col("dis_rows") >= disagreement_minimum
    use_b = F.when(diff & split, F.col("dis_b") - F.col("dis_a") > edge).otherwise(whole)
    return j.withColumn("selected", F.when(F.coalesce(use_b, F.lit(False)), "b").otherwise("a")).withColumn(
        "final_label", F.when(F.col("selected") == "b", F.col("label_b")).otherwise(F.col("label_a"))).drop("_ca", "_cb")


def stability_signal(panel: DataFrame, keys: Sequence[str] = ("series_id",), long_window: int = 756, recent_weight: float = 0.65, edge: float = 0.005, k: int = 3) -> DataFrame:
    """Rank by a blend of recent and long accuracy with a minimum edge (own definition)."""
    short = scored(panel, keys, "accuracy", CALIBRATION, MINIMUM).select(*panel.columns, "eligible", F.col("raw_score").alias("_s"))
    w = ordered([*keys, "rule_id"], "pos")
    c = _counts(short, keys)
    hits = window_sum("_00", w, long_window) + window_sum("_11", w, long_window)
    rows = hits + window_sum("_01", w, long_window) + window_sum("_10", w, long_window)
    # the long part is weighted as a decimal before it is divided: scores of opposite rules differ in the last bit only, and their rank follows it
    share = (F.lit(1 - Decimal(str(recent_weight))) * hits).cast("double")
    x = c.withColumn("_b", recent_weight * F.col("_s") + F.try_divide(share, rows.cast("double"))).withColumn("score", F.greatest(F.col("_b"), 1 - F.col("_b"))).withColumn("reverse", F.col("_b") < 0.5)
    x = x.withColumn("eligible", F.col("eligible") & (F.col("score") - 0.5 >= edge))
    top = top_rules(x, keys, k)
    now = F.when(F.col("reverse"), 1 - F.col("pred")).otherwise(F.col("pred"))
    out = top.withColumn("_n", now).groupBy(*keys, "pos").agg(F.count("*").alias("rules"), (F.sum(F.col("weight") * F.col("_n")) / F.sum("weight")).alias("vote"), F.max("score").alias("top_score"))
    return out.withColumn("predicted_label", (F.col("vote") >= MAJORITY).cast("int"))
