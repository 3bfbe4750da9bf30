"""Backward as-of joins.

Both sides are tagged and unioned, and the last right row before each left row
is carried forward in one sort: linear, one exchange.  For series that may hold
many rows per key (ticks), the time axis is cut into spans so that no key is
sorted by a single task; each span starts from the last value of the spans
before it, which makes the result identical.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import before, ordered, upto


def _day(c: Column) -> Column:
    return F.unix_date(F.to_date(c))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              payload: Sequence[str], strict: bool = True, source: str = "source_date",
              max_age_days: int | None = None, span_days: int | None = None) -> DataFrame:
    """Attach the last right row at (or, if strict, before) each left time.

    The right side must be unique per keys and time.  A match older than
    `max_age_days` is dropped, not replaced.  `span_days` turns on span cutting.
    """
    keys = list(keys)
    left_side, right_side = (0, 1) if strict else (1, 0)
    pay = F.struct(F.col(right_time).alias(source), *[F.col(c) for c in payload])
    cells = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    lt = left.select(*keys, F.col(left_time).alias("_t"), F.lit(left_side).alias("_s"), cells.alias("_l"), F.lit(True).alias("_left"))
    rt = right.select(*keys, F.col(right_time).alias("_t"), F.lit(right_side).alias("_s"), pay.alias("_r"), F.lit(False).alias("_left"))
    both = lt.unionByName(rt, allowMissingColumns=True)
    if span_days is None:
        got = both.withColumn("_m", F.last("_r", ignorenulls=True).over(upto(ordered(keys, ["_t", "_s"]))))
    else:
        both = both.withColumn("_span", F.floor(_day(F.col("_t")) / span_days))
        spans = both.groupBy(*keys, "_span").agg(F.max_by("_r", F.when(~F.col("_left"), F.col("_t"))).alias("_tail"))
        carried = spans.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before(ordered(keys, "_span")))).drop("_tail")
        here = F.last("_r", ignorenulls=True).over(upto(ordered([*keys, "_span"], ["_t", "_s"])))
        got = both.withColumn("_here", here).where("_left").join(carried, [*keys, "_span"], "left")
        got = got.withColumn("_m", F.coalesce("_here", "_carry"))
    matched = got.where("_left").select(*keys, "_l.*", "_m")
    if max_age_days is not None:
        age = F.datediff(F.to_date(F.col(left_time)), F.to_date(F.col(f"_m.{source}")))
        matched = matched.withColumn("_m", F.when(age <= max_age_days, F.col("_m")))
    return matched.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in (source, *payload)])


def range_expand(anchors: DataFrame, history: DataFrame, keys: Sequence[str], window: int,
                 anchor_pos: str = "anchor_pos", pos: str = "pos") -> DataFrame:
    """Join every anchor to the rows in its `window` preceding positions.

    Positions are dense per key, so they are bucketed by window length and an
    anchor meets exactly two buckets: an equality join, not a range scan.
    """
    keys = list(keys)
    a = anchors.withColumn("_k", F.explode(F.array(
        F.floor(F.col(anchor_pos) / window), F.floor(F.col(anchor_pos) / window) - 1)))
    h = history.withColumn("_k", F.floor(F.col(pos) / window))
    joined = a.join(h, [*keys, "_k"])
    return joined.where((F.col(pos) < F.col(anchor_pos)) & (F.col(pos) >= F.col(anchor_pos) - window)).drop("_k")
