"""Time-series operators over one row per series and session."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import diff, full, growth, ordered, prior
from tidemark.operators.blocks import earlier, in_blocks


def price_features(df: DataFrame, keys: Sequence[str], prefix: str = "", lag: int = 0) -> DataFrame:
    """Per-asset block: returns, volatility, gap, intraday move, range, log-volume change.

    A lag shifts the whole block by observed rows and renames it.
    """
    w = ordered(keys, "trade_date")
    c = F.col("close")
    df = df.withColumn("_r", growth(c, w))
    vol = F.when(F.col("vol") != 0, F.col("vol"))
    block = {
        "ret1": F.col("_r"), "ret5": growth(c, w, 5), "vol20": full(F.col("_r"), 20, F.stddev_samp, w),
        "gap": F.try_divide(F.col("open"), F.lag(c).over(w)) - 1, "intraday": F.try_divide(c, F.col("open")) - 1,
        "range": F.try_divide(F.col("high") - F.col("low"), F.lag(c).over(w)), "vol_chg": diff(F.ln(vol), w),
    }
    names = {k: f"{prefix}{k}" for k in block}
    out = df.select(*keys, "trade_date", *[e.alias(names[k]) for k, e in block.items()])
    if lag:
        out = out.select(*keys, "trade_date", *[F.lag(n, lag).over(w).alias(f"{n}_lag{lag}") for n in names.values()])
    return out


def core_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Six price features used by the learners."""
    w = ordered(keys, "trade_date")
    c = F.col("close")
    out = df.withColumn("return_1", growth(c, w))
    return out.select(
        *keys, "trade_date", "return_1", growth(c, w, 5).alias("momentum_5"), growth(c, w, 20).alias("momentum_20"),
        full(F.col("return_1"), 20, F.stddev_samp, w).alias("volatility_20"),
        (F.try_divide(c, F.col("open")) - 1).alias("intraday_return"),
        F.try_divide(c - F.col("low"), F.col("high") - F.col("low")).alias("close_position"))


def next_session_target(df: DataFrame, keys: Sequence[str], close: str = "close") -> DataFrame:
    """Return to the following row and its direction; up only if strictly positive."""
    r = F.lead(close).over(ordered(keys, "trade_date")) / F.col(close) - 1
    return df.withColumn("target_next_return", r).withColumn("target_next_direction", (F.col("target_next_return") > 0).cast("int"))


def with_running(df: DataFrame, keys: Sequence[str], pos: str, flags: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of 0/1 flags under the given names."""
    w = ordered(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.sum(F.coalesce(x.cast("int"), F.lit(0))).over(w).alias(n) for n, x in flags.items()])


def window_sum(running: str, w: WindowSpec, n: int, skip: int = 0) -> Column:
    """Sum over the n rows that end `skip` rows before the previous row, from a running sum."""
    r = F.col(running)
    return F.coalesce(F.lag(r, 1 + skip).over(w), F.lit(0)) - F.coalesce(F.lag(r, 1 + skip + n).over(w), F.lit(0))


def state_duration(df: DataFrame, keys: Sequence[str], pos: str, state: str, name: str = "duration") -> DataFrame:
    """Length of the current run of an unchanged known state; 0 while unknown."""
    w = ordered(keys, pos)
    s = F.col(state)
    starts = (~s.eqNullSafe(F.lag(s).over(w))).cast("int")
    df = df.withColumn("_start", starts)
    df = df.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(ordered([*keys, "_run"], pos))
    return df.withColumn(name, F.when(s.isNull(), 0).otherwise(n)).drop("_start", "_run")


def direction_runs(df: DataFrame, keys: Sequence[str], pos: str, label: str, broken: Column | None = None) -> DataFrame:
    """One row per run of equal directions; `broken` adds further run breaks."""
    w = ordered(keys, pos)
    start = ~F.col(label).eqNullSafe(F.lag(label).over(w))
    if broken is not None:
        start = start | F.coalesce(broken, F.lit(False))
    runs = df.withColumn("_start", start.cast("int"))
    runs = runs.withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs


def weighted_median_scale(df: DataFrame, keys: Sequence[str], pos: str, x: str, y: str, window: int, minimum: int, names: tuple[str, str] = ("scale", "rows")) -> DataFrame:
    """Add the weighted median of y/x (weights |x|) over earlier resolved rows, clipped to [0, 1], and their number; 0 below `minimum`."""

    def medians(values, start):
        xs, ys = earlier(values[x], start, window), earlier(values[y], start, window)
        usable = ~np.isnan(ys) & (np.abs(xs) > 1e-12)
        ratio = np.divide(ys, xs, out=np.full(xs.shape, np.inf), where=usable)
        weight = np.where(usable, np.abs(xs), 0.0)
        ratio, weight = ratio.ravel(), weight.ravel()
        order = np.lexsort((weight, ratio, np.repeat(np.arange(len(xs)), window))).reshape(len(xs), window)
        mass = weight[order].cumsum(1)
        size = usable.sum(1)
        middle = np.minimum((mass < mass[:, -1:] / 2).sum(1), np.maximum(size - 1, 0))
        value = np.clip(ratio[order[np.arange(len(xs)), middle]], 0.0, 1.0)
        return {names[0]: np.where(size >= max(minimum, 1), value, 0.0), names[1]: size}

    return in_blocks(df, keys, pos, window, [x, y], [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], medians)


def prior_quantiles(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], probs: Sequence[float],
                    window: int, minimum: int) -> DataFrame:
    """Add <column>_q<i>: linear quantiles of up to `window` earlier rows, at least `minimum` known.

    A percentile over a sliding frame re-reads the frame for every row; here a
    block is swept once by an ordered rolling window that starts on its halo.
    """
    cols = list(columns)

    def sweep(values, start):
        made = {}
        for c in cols:
            seen = pd.Series(values[c]).shift(1).rolling(window, min_periods=minimum)
            made |= {f"{c}_q{i}": seen.quantile(p).to_numpy()[start:] for i, p in enumerate(probs)}
        return made

    return in_blocks(df, keys, order, window, cols, [T.StructField(f"{c}_q{i}", T.DoubleType()) for c in cols for i in range(len(probs))], sweep)


def half_life_weights(df: DataFrame, group: Sequence[str], age: Column, half_life: float, name: str = "weight") -> DataFrame:
    """2^(-age/half_life) scaled to mean one within each group."""
    raw = F.pow(F.lit(2.0), -age / half_life)
    df = df.withColumn("_raw", raw)
    return df.withColumn(name, F.col("_raw") / F.avg("_raw").over(Window.partitionBy(*group))).drop("_raw")


def modular_anchors(df: DataFrame, keys: Sequence[str], pos: str, eligible: Column, interval: int, name: str = "anchor_pos") -> DataFrame:
    """Position of the fit in force: refit where pos % interval == 0, or at the first eligible row."""
    w = ordered(keys, pos)
    df = df.withColumn("_e", eligible)
    first = F.min(F.when(F.col("_e"), F.col(pos))).over(Window.partitionBy(*keys))
    fit = F.when(F.col("_e") & ((F.col(pos) % interval == 0) | (F.col(pos) == first)), F.col(pos))
    df = df.withColumn("_fit", fit)
    upto = F.last("_fit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col("_e"), upto)).drop("_e", "_fit")


def chained_anchors(df: DataFrame, keys: Sequence[str], pos: str, eligible: Column, interval: int, name: str = "anchor_pos") -> DataFrame:
    """Position of the fit in force when each refit waits `interval` rows after the last one.

    The chain is sequential, so each series' eligible positions (at most one per
    session) are folded into its list of refits.
    """
    rows = df.withColumn("_e", eligible)
    listed = rows.where("_e").groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(pos).cast("int"))).alias("_p"))
    none = F.array().cast("array<int>")
    fits = F.aggregate("_p", none, lambda a, p: F.when(
        (F.size(a) == 0) | (p - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) >= interval), F.array_append(a, p)).otherwise(a))
    marks = listed.select(*keys, F.explode(fits).alias(pos)).withColumn("_fit", F.col(pos))
    out = rows.join(marks, [*keys, pos], "left")
    upto = F.last("_fit", ignorenulls=True).over(ordered(keys, pos).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.when(F.col("_e"), upto)).drop("_e", "_fit")


def rolling_accuracy(hit: Column, n: int, w: WindowSpec) -> Column:
    return full(hit.cast("double"), n, F.avg, w)


def running_accuracy(hit: Column, w: WindowSpec) -> Column:
    return F.avg(hit.cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def history_features(df: DataFrame, keys: Sequence[str], pos: str = "pos", side_window: int = 120, recent: int = 20, prior_rows: int = 10) -> DataFrame:
    """Ten features of an incumbent stream that only see earlier rows, with neutral defaults."""
    w = ordered(keys, pos)
    r, label = F.col("real_pct_change"), F.col("predicted_label")
    flags = {}
    for side in (0, 1):
        match = (label == side) & r.isNotNull()
        flags[f"_n{side}"] = match
        flags[f"_h{side}"] = match & (label == (r > 0).cast("int"))
    df = with_running(df, keys, pos, flags)
    p5, pr = prior(w, 5), prior(w, recent)
    out = df.select(
        *[c for c in df.columns if not c.startswith("_")],
        label.alias("direction"), F.col("confidence").alias("raw_confidence"),
        F.coalesce(F.lag(r).over(w), F.lit(0.0)).alias("previous_return"),
        F.coalesce(F.sum(r).over(p5), F.lit(0.0)).alias("recent_return"),
        F.coalesce(F.when(F.count(r).over(pr) >= 2, F.stddev_samp(r).over(pr)), F.lit(0.0)).alias("recent_volatility"),
        F.coalesce(F.avg(label.cast("double")).over(pr), F.lit(0.5)).alias("recent_prediction_rate"),
        F.coalesce(F.avg((r > 0).cast("double")).over(pr), F.lit(0.5)).alias("recent_up_rate"),
        *[((window_sum(f"_h{s}", w, side_window) + prior_rows / 2) / (window_sum(f"_n{s}", w, side_window) + prior_rows)).alias(f"side_{s}_accuracy") for s in (0, 1)])
    return out


