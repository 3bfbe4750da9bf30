"""Job-level compositions: each is one plan over candidate, threshold and window columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import ledger as G
from tidemark.operators import overlay as V
from tidemark.operators import quality as Q
from tidemark.operators.joins import latest_rows


def adopt_labels(incumbent: DataFrame, signal: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Incumbent stream with a signal's labels where it has one, re-signed and repriced."""
    s = signal.select(*keys, "pos", F.col("predicted_label").alias("_new"))
    j = incumbent.join(s, [*keys, "pos"], "left").withColumn("_new", F.coalesce("_new", "predicted_label"))
    changed = F.col("_new") != F.col("predicted_label")
    return V.relabel(j, F.col("_new"), changed, F.col("confidence")).drop("_new")


def freeze_baseline(stream: DataFrame, keys: Sequence[str], start: str, development: tuple[str, str]) -> DataFrame:
    """Year and latest-window metrics of a stream."""
    rows = E.windowed_metrics(stream, keys, start, development)
    return rows.where(~F.col("window").isin("test", "development"))


def strict_acceptance(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """Invariant violations of the candidate and the verdict of the strict gate."""
    bad = Q.flag_rows(E.resolved(candidate), Q.prediction_rules(), list(keys)).groupBy(*keys).agg(F.count("*").alias("violations"))
    checks = E.strict_gate(baseline, candidate, keys, start).groupBy(*keys).agg(
        F.count("*").alias("checks"), F.sum(F.col("passed").cast("int")).alias("passed_checks"))
    out = checks.join(bad, list(keys), "left").fillna(0, ["violations"])
    return out.withColumn("accepted", (F.col("violations") == 0) & (F.col("checks") == F.col("passed_checks")))


def sweep_and_gate(swept: DataFrame, baseline: DataFrame, keys: Sequence[str], choice: Sequence[str], years: Sequence[int], start: str) -> DataFrame:
    """Select on development years, then run the gate on the selected choice only."""
    picked = E.development_selection(swept, baseline, keys, choice, years).where("selected").select(*keys, *choice)
    return E.non_regression_gate(baseline, swept.join(picked, [*keys, *choice], "left_semi"), keys, start)


def error_sweep(stream: DataFrame, correctness: str, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Error-model corrections at several thresholds from one probability."""
    p = F.col(correctness)
    label = F.col("predicted_label")
    prop = stream.withColumn("_proposal", F.when(p < 0.5, 1 - label).otherwise(label)).withColumn("_up", F.when(label == 1, p).otherwise(1 - p))
    return V.selective_replacement(V.threshold_sweep(prop, thresholds), "_proposal", "_up", F.col("threshold"), keys, calibrate=False).drop("_proposal", "_up")


def replay_with_pending(stream: DataFrame, keys: Sequence[str], validated: int) -> tuple[DataFrame, DataFrame]:
    """The last n validated sessions and exactly one pending forecast per series, with violations."""
    tail = latest_rows(stream, keys, validated + 1)
    last = F.max("trade_date").alias("_last")
    per = tail.groupBy(*keys).agg(last, F.count("*").alias("rows"), F.count("real_pct_change").alias("resolved_rows"), F.max_by(F.col("real_pct_change").isNull(), "trade_date").alias("ends_pending"))
    bad = per.where((F.col("rows") != validated + 1) | (F.col("resolved_rows") != validated) | ~F.col("ends_pending")).drop("_last")
    return tail, bad


def publish(candidate: DataFrame, ledger: DataFrame, targets: DataFrame, closes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to insert and outcomes to settle for one stream snapshot."""
    plan = G.insert_plan(candidate, ledger, keys)
    group = [k for k in keys if k not in ("trade_date", "stream_id")]
    return G.rows_to_insert(plan), G.settle(candidate.drop("real_pct_change", "correct"), targets, closes, group)


def by_policy(frames: dict[str, DataFrame], name: str = "policy") -> DataFrame:
    out = None
    for k, f in frames.items():
        one = f.withColumn(name, F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def sign_label(x: Column) -> Column:
    return (x > 0).cast("int")
