"""Rolling calibration and pooling that only sees resolved history.

Fits over a fixed number of earlier rows run in blocks of a series with a halo
(`operators/blocks.py`); the fits of a block are solved together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import ordered, prior
from tidemark.operators.blocks import earlier, in_blocks
from tidemark.operators.series import weighted_median_scale

NEWTON_STEPS = 8
RIDGE = 1e-6


def shrink_returns(df: DataFrame, keys: Sequence[str], pos: str = "pos", window: int = 252, minimum: int = 60) -> DataFrame:
    """Scale signed forecasts by the weighted median of realised over predicted returns.

    The direction label is kept; the forecast close is repriced from the implied
    base close, or kept where a forecast of -100 % leaves no base.
    """
    x = F.col("predicted_pct_change")
    lost = F.abs(1 + x) <= 1e-12
    out = weighted_median_scale(df, keys, pos, "predicted_pct_change", "real_pct_change", window, minimum, ("_scale", "_rows")).withColumn("_x", x)
    base = F.try_divide(F.col("predicted_close"), 1 + F.col("_x"))
    return out.select(
        *[c for c in df.columns if c not in ("predicted_pct_change", "predicted_close", "uncalibrated_predicted_return", "return_calibration_scale", "return_calibration_rows", "return_calibration_close_fallback")],
        F.col("_x").alias("uncalibrated_predicted_return"), F.col("_scale").alias("return_calibration_scale"), F.col("_rows").alias("return_calibration_rows"),
        (F.col("_x") * F.col("_scale")).alias("predicted_pct_change"),
        F.when(lost, F.col("predicted_close")).otherwise(base * (1 + F.col("_x") * F.col("_scale"))).alias("predicted_close"),
        lost.cast("int").alias("return_calibration_close_fallback"))


def _newton(x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intercept and slope of a ridge logistic fit per row of x and y: a fixed number of Newton steps for all rows together."""
    x, y = np.where(used, x, 0.0), np.where(used, y, 0.0)
    a, b = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(NEWTON_STEPS):
        q = used / (1 + np.exp(-(a[:, None] + b[:, None] * x)))
        v = q * (used - q)
        error, slope = q - y, v * x
        g0, g1 = error.sum(1) + RIDGE * a, np.einsum("ij,ij->i", error, x) + RIDGE * b
        h00, h01, h11 = v.sum(1) + RIDGE, slope.sum(1), np.einsum("ij,ij->i", slope, x) + RIDGE
        det = h00 * h11 - h01 * h01
        a, b = a - (h11 * g0 - h01 * g1) / det, b - (h00 * g1 - h01 * g0) / det
    return a, b


def _isotonic(x: np.ndarray, y: np.ndarray, at: float) -> float:
    """Isotonic fit of the pairs, evaluated at one score."""
    u, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, weights=y) / weight
    blocks: list[list[float]] = []
    for m, k in zip(mean.tolist(), weight.tolist()):
        block = [m, k, 1]
        while blocks and blocks[-1][0] >= block[0]:
            last = blocks.pop()
            mass = last[1] + block[1]
            block = [(last[0] * last[1] + block[0] * block[1]) / mass, mass, last[2] + block[2]]
        blocks.append(block)
    return float(np.interp(at, u, np.repeat([k[0] for k in blocks], [k[2] for k in blocks])))


def platt_calibrate(df: DataFrame, keys: Sequence[str], pos: str = "pos", window: int = 300, minimum: int = 60, name: str = "calibrated_confidence") -> DataFrame:
    """Map raw confidence to the probability of being right, fitted on earlier resolved rows.

    Identity, flagged as fallback, with fewer than `minimum` rows or one class.
    """
    added = [T.StructField("_p", T.DoubleType()), T.StructField("confidence_calibration_rows", T.IntegerType()), T.StructField("confidence_calibration_fallback", T.IntegerType())]

    def fit(values, start):
        x, y = earlier(values["confidence"], start, window), earlier(values["_hit"], start, window)
        used = ~np.isnan(x) & ~np.isnan(y)
        rows, ups = used.sum(1), np.where(used, y, 0.0).sum(1)
        ready = (rows >= minimum) & (ups > 0) & (ups < rows)
        p = np.full(len(x), np.nan)
        a, b = _newton(x[ready], y[ready], used[ready])
        p[ready] = 1 / (1 + np.exp(-(a + b * values["confidence"][start:][ready])))
        return {"_p": p, "confidence_calibration_rows": rows, "confidence_calibration_fallback": (~ready).astype(int)}

    rest = [c for c in df.columns if c not in {name, "confidence_calibration_rows", "confidence_calibration_fallback"}]
    out = in_blocks(df.select(*rest, F.col("correct").cast("int").alias("_hit")), keys, pos, window, ["confidence", "_hit"], added, fit)
    return out.select(*rest, F.when(F.col("confidence_calibration_fallback") == 0, F.col("_p")).otherwise(F.col("confidence")).alias(name), "confidence_calibration_rows", "confidence_calibration_fallback")


def reliability_bins(df: DataFrame, keys: Sequence[str], edges: Sequence[float], confidence: str = "confidence") -> DataFrame:
    """Rows, accuracy and mean confidence per bin (lower edge open, upper closed; the first bin is closed)."""
    c = F.col(confidence)
    which = F.lit(0)
    for e in edges[1:-1]:
        which = which + (c > e).cast("int")
    known = df.where(F.col("correct").isNotNull() & c.between(edges[0], edges[-1]))
    return known.groupBy(*keys, which.alias("bin")).agg(
        F.count("*").alias("rows"), F.avg(F.col("correct").cast("double")).alias("direction_accuracy"), F.avg(c).alias("mean_confidence"))


def calibration_error(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("direction_accuracy") - F.col("mean_confidence"))
    total = F.sum("rows")
    return bins.groupBy(*keys).agg(total.alias("rows_used"), (F.sum(F.col("rows") * F.col("direction_accuracy")) / total).alias("direction_accuracy"),
                                   (F.sum(F.col("rows") * gap) / total).alias("expected_calibration_error"))


def compare_windows(df: DataFrame, keys: Sequence[str], windows: Sequence[int], minimum: int, start, pos: str = "pos") -> DataFrame:
    """Brier score of each calibration window from a start date; one window per key is selected."""
    parts = None
    for n in windows:
        one = platt_calibrate(df, keys, pos, n, minimum).select(*keys, F.lit(n).alias("window"), "trade_date", "correct", "calibrated_confidence")
        parts = one if parts is None else parts.unionByName(one)
    known = parts.where((F.col("trade_date") >= start) & F.col("correct").isNotNull())
    err = F.col("calibrated_confidence") - F.col("correct").cast("double")
    per = known.groupBy(*keys, "window").agg(F.count("*").alias("rows"), F.avg(err * err).alias("brier"))
    first = F.row_number().over(ordered(keys, ["brier", "window"]))
    return per.withColumn("selected", first == 1)


def adaptive_pool(df: DataFrame, keys: Sequence[str], left: str, right: str, target: str, eligible: Column, pos: str = "pos",
                  window: int = 252, minimum: int = 60, prior_rows: int = 20) -> DataFrame:
    """Convex weight of two probabilities minimising the Brier score with a ridge toward one half.

    The loss is quadratic in the weight, so the minimum is closed form on frame averages.
    """
    w = prior(ordered(keys, pos), window)
    known = eligible & F.col(target).isNotNull()
    d = F.when(known, F.col(left) - F.col(right))
    e = F.when(known, F.col(right) - F.col(target))
    n, s, ed = F.count(d).over(w), F.avg(d * d).over(w), F.avg(e * d).over(w)
    out = df.withColumn("_n", n).withColumn("_s", s).withColumn("_ed", ed).withColumn("_el", eligible)
    lam = prior_rows / F.col("_n") * F.col("_s")
    best = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(lam / 2 - F.col("_ed"), F.col("_s") + lam)))
    applied = F.col("_el") & (F.col("_n") >= minimum) & (F.col("_s") > 1e-12)
    out = out.withColumn("pool_applied", F.coalesce(applied, F.lit(False))).withColumn("pool_weight", F.when(F.col("pool_applied"), best).otherwise(0.5))
    return out.withColumn("pool_rows", F.when(F.col("_el"), F.col("_n")).otherwise(0)).withColumn(
        "pooled_probability", F.col("pool_weight") * F.col(left) + (1 - F.col("pool_weight")) * F.col(right)).drop("_n", "_s", "_ed", "_el")


def mean_pool(base: DataFrame, extended: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal mean of two probability streams; fitted only where both are."""
    cols = ("downside_probability", "downside_training_rows", "downside_last_training_date")
    b = base.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    e = extended.select(*keys, *[F.col(c).alias(f"e_{c}") for c in cols])
    rows = F.least("b_downside_training_rows", "e_downside_training_rows")
    ready = rows > 0
    return b.join(e, list(keys)).select(
        *keys, F.when(ready, (F.col("b_downside_probability") + F.col("e_downside_probability")) / 2).otherwise(0.0).alias("downside_probability"),
        rows.alias("downside_training_rows"), F.when(ready, F.greatest("b_downside_last_training_date", "e_downside_last_training_date")).alias("downside_last_training_date"),
        F.col("b_downside_probability").alias("downside_base_probability"), F.col("e_downside_probability").alias("downside_extended_probability"))


def isotonic_calibrate(df: DataFrame, keys: Sequence[str], score: str, target: str, eligible: Column, pos: str = "pos",
                       window: int = 252, minimum: int = 60) -> DataFrame:
    """Isotonic map of scores fitted on earlier eligible resolved rows; identity where too few or one class.

    Rows without a score are not fitted on.
    """
    known = F.coalesce(eligible & F.col(target).isNotNull(), F.lit(False))
    rows = df.withColumn("_el", F.coalesce(eligible, F.lit(False)).cast("int")).withColumn("_y", F.when(known, F.col(target).cast("double")))
    added = [T.StructField("_f", T.DoubleType()), T.StructField("_n", T.IntegerType()), T.StructField("_ready", T.IntegerType())]

    def fit(values, start):
        own, at = values["_el"][start:] > 0, values[score][start:]
        x, y = earlier(values[score], start, window), earlier(values["_y"], start, window)
        used = ~np.isnan(x) & ~np.isnan(y)
        size, ups = used.sum(1), np.where(used, y, 0.0).sum(1)
        ready = own & (size >= minimum) & (ups > 0) & (ups < size)
        f = np.full(len(at), np.nan)
        for i in np.flatnonzero(ready):
            f[i] = _isotonic(x[i][used[i]], y[i][used[i]], at[i])
        return {"_f": f, "_n": size, "_ready": ready.astype(int)}

    out = in_blocks(rows, keys, pos, window, [score, "_y", "_el"], added, fit)
    ready = F.col("_ready") == 1
    return out.select(*df.columns, F.when(ready, F.col("_f")).otherwise(F.col(score)).alias("calibrated_probability"),
                      F.when(F.col("_el") == 1, F.col("_n")).otherwise(0).alias("calibration_rows"), ready.alias("calibration_applied"))
