"""Decision overlays on a forecast stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import ordered
from tidemark.functions.scalars import wilson_lower
from tidemark.operators.calibrate import platt_calibrate, shrink_returns
from tidemark.operators.series import prior_quantiles, window_sum, with_running


def relabel(df: DataFrame, label: Column, selected: Column, confidence: Column, magnitude: str = "uncalibrated_predicted_return") -> DataFrame:
    """Apply new labels: re-sign the raw forecast, reprice the close, swap confidence, recompute correctness."""
    base = F.try_divide(F.col("predicted_close"), 1 + F.col("predicted_pct_change"))
    out = df.withColumn("_base", base).withColumn("_label", label.cast("int")).withColumn("_sel", selected).withColumn("_conf", confidence)
    signed = F.abs(F.col(magnitude)) * F.when(F.col("_label") == 1, 1.0).otherwise(-1.0)
    rest = [c for c in df.columns if c not in ("predicted_label", "predicted_pct_change", "predicted_close", "confidence", "correct", "correction_selected")]
    return out.select(
        *rest, F.col("_label").alias("predicted_label"), signed.alias("predicted_pct_change"), (F.col("_base") * (1 + signed)).alias("predicted_close"),
        F.when(F.col("_sel"), F.col("_conf")).otherwise(F.col("confidence")).alias("confidence"),
        (F.col("_label") == (F.col("real_pct_change") > 0).cast("int")).alias("correct"), F.col("_sel").alias("correction_selected"))


def selective_replacement(df: DataFrame, proposal: str, probability_up: str, threshold: Column, keys: Sequence[str], calibrate: bool = True) -> DataFrame:
    """Take the proposed label where it differs and its certainty reaches the threshold."""
    new, p = F.col(proposal), F.col(probability_up)
    certainty = F.when(new == 1, p).otherwise(1 - p)
    selected = (new != F.col("predicted_label")) & (certainty >= threshold)
    label = F.when(selected, new).otherwise(F.col("predicted_label"))
    out = relabel(df, label, selected, certainty)
    if calibrate:
        out = shrink_returns(platt_calibrate(out, keys), keys)
    return out


def downside_flip(df: DataFrame, probability: str, rows: str, threshold: Column) -> DataFrame:
    """Flip up-forecasts only, where fitted and the downside probability reaches the threshold."""
    selected = (F.col("predicted_label") == 1) & (F.col(rows) > 0) & (F.col(probability) >= threshold)
    return relabel(df, F.when(selected, 0).otherwise(F.col("predicted_label")), selected, F.col(probability))


def two_sided_flip(df: DataFrame, probability: str, rows: str, threshold: Column) -> DataFrame:
    """Flip either direction where the error probability reaches the threshold (a column may differ per row)."""
    selected = (F.col(rows) > 0) & (F.col(probability) >= threshold)
    return relabel(df, F.when(selected, 1 - F.col("predicted_label")).otherwise(F.col("predicted_label")), selected, F.col(probability))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One copy of each row per threshold; a narrow expansion."""
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def evidence_guard(champion: DataFrame, challengers: DataFrame, keys: Sequence[str], name: str = "stream_id", window: int = 252,
                   minimum: int = 20, recent: int = 60, recent_minimum: int = 5, recent_accuracy: float = 0.5) -> DataFrame:
    """Adopt a challenger only where its earlier disagreements with the champion were right.

    Evidence is counted against the champion's original labels, separately for
    each champion direction.  Returns one row per champion row with the source
    chosen by (lower bound, rows, name).
    """
    k = [*keys, "pos"]
    c = champion.select(*k, F.col("predicted_label").alias("label"), F.col("real_pct_change").alias("real"))
    x = challengers.select(name, *k, F.col("predicted_label").alias("other")).join(c, k)
    differ = (F.col("other") != F.col("label")) & F.col("real").isNotNull()
    right = differ & (F.col("other") == (F.col("real") > 0).cast("int"))
    flags = {}
    for side in (0, 1):
        flags[f"_n{side}"] = differ & (F.col("label") == side)
        flags[f"_h{side}"] = right & (F.col("label") == side)
    part = [name, *keys]
    x = with_running(x, part, "pos", flags)
    w = ordered(part, "pos")

    def by_side(prefix, n):
        return F.when(F.col("label") == 1, window_sum(f"{prefix}1", w, n)).otherwise(window_sum(f"{prefix}0", w, n))

    x = x.withColumn("rows", by_side("_n", window)).withColumn("hits", by_side("_h", window)).withColumn(
        "rrows", by_side("_n", recent)).withColumn("rhits", by_side("_h", recent))
    lower = wilson_lower(F.col("hits"), F.col("rows"))
    x = x.withColumn("lower", lower)
    ok = (F.col("other") != F.col("label")) & (F.col("rows") >= minimum) & (F.col("lower") > 0.5) & (F.col("rrows") >= recent_minimum) & (
        F.try_divide(F.col("rhits"), F.col("rrows")) >= recent_accuracy)
    best = F.max(F.when(ok, F.struct("lower", "rows", F.col(name).alias("source"), F.try_divide(F.col("rhits"), F.col("rrows")).alias("recent_accuracy"), "other")))
    chosen = x.groupBy(*k).agg(best.alias("b"))
    out = champion.join(chosen, k, "left")
    return out.select(*champion.columns, F.coalesce("b.source", F.lit("baseline")).alias("guard_source"), F.col("b.lower").alias("guard_lower_bound"),
                      F.coalesce("b.rows", F.lit(0)).alias("guard_history_rows"), F.col("b.recent_accuracy").alias("guard_recent_accuracy"),
                      F.coalesce("b.other", "predicted_label").alias("guard_label"))


def apply_guard(champion: DataFrame, challengers: DataFrame, keys: Sequence[str], name: str = "stream_id") -> DataFrame:
    """Stream with the guard's choices applied, then calibrated on its own earlier rows."""
    g = evidence_guard(champion, challengers, keys, name)
    alt = challengers.select(*keys, "pos", F.col(name).alias("guard_source"), F.col("confidence").alias("_conf"), F.col("uncalibrated_predicted_return").alias("_raw"))
    j = g.join(alt, [*keys, "pos", "guard_source"], "left").withColumn("uncalibrated_predicted_return", F.coalesce("_raw", "uncalibrated_predicted_return"))
    chosen = F.col("guard_source") != "baseline"
    out = relabel(j, F.col("guard_label"), chosen, F.col("_conf")).drop("_conf", "_raw")
    return shrink_returns(platt_calibrate(out, keys), keys)


def magnitude_estimate(df: DataFrame, keys: Sequence[str], window: int = 756, minimum: int = 60, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Size of the forecast: median absolute outcome of earlier rows on the predicted side, clipped to earlier quantiles.

    Earlier rows are those whose realised direction equals the predicted one.
    """
    out = df
    for side in (0, 1):
        out = out.withColumn(f"_s{side}", F.when((F.col("real_pct_change") > 0).cast("int") == side, F.abs("real_pct_change")))
    out = prior_quantiles(out, keys, "pos", ["_s0", "_s1"], [low, 0.5, high], window, minimum)
    q = [F.when(F.col("predicted_label") == 1, F.col(f"_s1_q{i}")).otherwise(F.col(f"_s0_q{i}")) for i in range(3)]
    sign = F.when(F.col("predicted_label") == 1, 1.0).otherwise(-1.0)
    size = F.abs("uncalibrated_predicted_return")
    scaled = F.when(q[1].isNotNull(), F.greatest(q[0], F.least(q[2], size)))
    return out.select(*df.columns, (sign * q[1]).alias("directional_median"), (sign * scaled).alias("range_scaled"))


def reversed_confidence(accuracy: Column, reversed_: Column) -> Column:
    """Confidence of a vote: its accuracy, or one minus it where the vote was reversed."""
    return F.when(reversed_, 1 - accuracy).otherwise(accuracy)
