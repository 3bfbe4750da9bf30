"""Session calendar: numbering, densifying, lag alignment and signal mapping.

A calendar holds at most one row per day, so it stays tiny whatever the size of
the panel; it is joined without a hint and Spark broadcasts it only when its
measured size is below the session's broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import ordered


def calendar_of(*frames: DataFrame, date: str = "trade_date") -> DataFrame:
    """Distinct sessions of the frames with a dense session_no from 1.

    Sessions are deduplicated map-side before they meet; the collected array has
    one entry per calendar day.
    """
    days = frames[0].select(F.col(date).alias("trade_date"))
    for f in frames[1:]:
        days = days.union(f.select(F.col(date).alias("trade_date")))
    listed = days.agg(F.sort_array(F.collect_set("trade_date")).alias("d"))
    return listed.select(F.posexplode("d").alias("p", "trade_date")).select("trade_date", (F.col("p") + 1).alias("session_no"))


def with_session(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return df.join(calendar, "trade_date")


def with_previous_session(df: DataFrame, column: str, name: str) -> DataFrame:
    """Attach a per-session value of the previous session of the frame's own calendar."""
    cal = calendar_of(df)
    numbered = df.join(cal, "trade_date")
    prev = numbered.select((F.col("session_no") + 1).alias("session_no"), F.col(column).alias(name))
    return numbered.join(prev, "session_no", "left").drop("session_no")


def densify(df: DataFrame, calendar: DataFrame, keys: Sequence[str] = (), last: int | None = None) -> DataFrame:
    """One row per key and session from the key's first to its last session; gaps are null.

    The rows are generated per key from its own bounds, so no cross product of
    keys and calendar is formed.  With no keys the whole calendar is returned.
    """
    keys = list(keys)
    if not keys:
        return calendar.join(df, "trade_date", "left")
    numbered = df.join(calendar, "trade_date")
    hi = F.max("session_no") if last is None else F.lit(last)
    span = numbered.groupBy(*keys).agg(F.min("session_no").alias("_lo"), hi.alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("session_no"))
    grid = grid.join(calendar, "session_no")
    return grid.join(numbered.drop("trade_date"), [*keys, "session_no"], "left")


def lag_align(signals: DataFrame, features: DataFrame, calendar: DataFrame, lag: int, prefix: str,
              columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Attach to each signal date the features of `lag` calendar sessions earlier.

    Equality on the shifted session number: nothing is sorted and no row falls
    back to an older session.  Adds <prefix>_source_date and <prefix>_available.
    """
    keys = list(keys)
    src = features.select(*keys, (F.col("session_no") + lag).alias("session_no"), *columns)
    sources = calendar.select((F.col("session_no") + lag).alias("session_no"), F.col("trade_date").alias(f"{prefix}_source_date"))
    out = signals.join(calendar, "trade_date", "left").join(sources, "session_no", "left").join(src, [*keys, "session_no"], "left")
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return out.withColumn(f"{prefix}_available", ok)


def next_session(calendar: DataFrame) -> DataFrame:
    """trade_date with the following session, null at the end of the calendar."""
    nxt = calendar.select((F.col("session_no") - 1).alias("session_no"), F.col("trade_date").alias("target_date"))
    return calendar.join(nxt, "session_no", "left")


def covered_sessions(days: DataFrame, start: str, end: str) -> DataFrame:
    """Open sessions of a day table between two dates, empty unless every day is known."""
    grid = days.sparkSession.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS cal_date")
    joined = grid.join(days.select("cal_date", "is_open"), "cal_date", "left")
    gaps = joined.agg(F.count(F.when(F.col("is_open").isNull(), 1))).scalar()
    return joined.where((gaps == 0) & (F.col("is_open") == 1)).select(F.col("cal_date").alias("trade_date"))


def invalid_calendar(days: DataFrame) -> DataFrame:
    bad = days.where(~F.col("is_open").isin(0, 1) | F.col("is_open").isNull()).select(F.lit("flag").alias("rule"), "cal_date")
    dup = days.groupBy("cal_date").count().where("count > 1").select(F.lit("duplicate").alias("rule"), "cal_date")
    return bad.unionByName(dup)


def missing_sessions(df: DataFrame, calendar: DataFrame, first: int | None = None) -> DataFrame:
    """Calendar sessions within the frame's span for which it has no row."""
    b = df.join(calendar, "trade_date").agg(F.struct(F.min("session_no").alias("lo"), F.max("session_no").alias("hi"))).scalar()
    span = calendar.where(F.col("session_no").between(b["lo"], b["hi"]))
    return span.join(df.select("trade_date").distinct(), "trade_date", "left_anti")
