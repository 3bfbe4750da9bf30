"""Boosted corrections of an incumbent stream, walked forward per series.

A candidate starts every row from the incumbent's log-odds and learns, on the
window before each refit, what to add to them: toward the outcome's direction,
or toward the incumbent being right.  Refits fall on positions divisible by five
of the whole history, so a later start or a shorter replay fits the same models.
Rows without enough history keep the incumbent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import trees
from tidemark.operators.walkforward import SHORT_BLOCK, folds, walk_forward


@dataclass(frozen=True)
class Candidate:
    depth: int = 2
    target: str = "direction"
    weight: str = "uniform"
    window: int = 756
    minimum: int = 252
    least_hessian: float = 20


#: Families of declared candidates; every job names one and reads it here.
FAMILIES: dict[str, dict[str, Candidate]] = {
    "context": {"stumps": Candidate(depth=1), "shallow": Candidate(), "balanced": Candidate(weight="classes")},
    "error": {
        "long": Candidate(target="correctness"),
        "year": Candidate(target="correctness", window=252, minimum=120, least_hessian=5),
        "quarter": Candidate(target="correctness", window=120, minimum=60, least_hessian=5),
    },
    "funding": {"direction": Candidate(), "balanced": Candidate(weight="classes"), "correctness": Candidate(target="correctness")},
    "history": {"direction": Candidate(window=2520), "balanced": Candidate(weight="classes", window=2520), "correctness": Candidate(target="correctness", window=2520)},
    "breadth": {"direction": Candidate(), "balanced": Candidate(weight="classes"), "correctness": Candidate(target="correctness")},
}


def residual_forecasts(stream: DataFrame, features: Sequence[str], candidate: Candidate, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The stream with proposed_label, probability_up, training_rows and last_training_date of one candidate.

    Features may be null; boosting sends such rows to the side that gains more.
    The proposal is up from a probability of one half on.
    """
    correct = F.least(F.greatest(F.col("calibrated_confidence"), F.lit(0.01)), F.lit(0.99))
    up = F.when(F.col("predicted_label") == 1, correct).otherwise(1 - correct)
    on_correct = candidate.target == "correctness"
    start = correct if on_correct else up
    rows = stream.withColumn("_margin", F.ln(start / (1 - start))).withColumn("_up", up).withColumn("_correct", correct)
    columns = ["_margin", *features, "predicted_label", "_up", *(["_correct"] if on_correct else [])]
    outcome = (F.col("real_pct_change") > 0).cast("int")
    target = (F.col("predicted_label") == outcome).cast("int") if on_correct else outcome
    f = folds(rows, keys, F.lit(True), F.col("real_pct_change").isNotNull(), target, chained=False, window=candidate.window, minimum=candidate.minimum)
    learner = trees.boosted(depth=candidate.depth, least_hessian=candidate.least_hessian)
    scores = walk_forward(f, keys, columns, learner, weight=candidate.weight, window=candidate.window, block=SHORT_BLOCK).drop("effective_rows", "largest_weight_share")
    j = rows.join(scores, [*keys, "pos"], "left")
    fitted = F.when(F.col("predicted_label") == 1, F.col("probability")).otherwise(1 - F.col("probability")) if on_correct else F.col("probability")
    p = F.coalesce(fitted, F.col("_up"))
    label = F.when(F.col("probability").isNull(), F.col("predicted_label")).otherwise((p >= 0.5).cast("int"))
    return j.select(*stream.columns, p.alias("probability_up"), label.alias("proposed_label"), F.coalesce("training_rows", F.lit(0)).alias("training_rows"), "last_training_date")


def residual_family(stream: DataFrame, features: Sequence[str], family: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The forecasts of every candidate of a family, with a column `candidate`."""
    out = None
    for name, candidate in FAMILIES[family].items():
        part = residual_forecasts(stream, features, candidate, keys).withColumn("candidate", F.lit(f"{family}_{name}"))
        out = part if out is None else out.unionByName(part)
    return out
