"""Alignment joins on keys and sessions.

None of these forces a strategy: small dimensions are broadcast by Spark when
their measured size is under the session's threshold, and skewed keys are split
by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import stage


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join after dropping keys that are not unique on both sides."""
    keys = list(keys)
    single = lambda d: d.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").select(*keys)
    return left.join(right, keys).join(single(left), keys, "left_semi").join(single(right), keys, "left_semi")


def validity_expand(dim: DataFrame, calendar: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row per contract and session inside its validity interval.

    The calendar, written once, is spread to one row per calendar day with the
    last session up to it.  Both ends of an interval look their session up by
    equality on the day, and the sessions between are counted out, so neither
    contracts nor days are compared by range.  Days after the last session count
    as that session's, days before the first have none.
    """
    sessions = stage(calendar.select("trade_date", "session_no"), "sessions")
    following = F.lead("trade_date").over(Window.orderBy("session_no"))
    spread = sessions.withColumn("_next", F.coalesce(F.date_sub(following, 1), "trade_date"))
    days = spread.select(F.explode(F.sequence("trade_date", "_next")).alias("_day"), F.col("session_no").alias("_no"))
    last = sessions.agg(F.max("trade_date")).scalar()

    def session_upto(rows: DataFrame, day: Column, name: str) -> DataFrame:
        looked = rows.withColumn("_at", F.least(day, last)).join(days, F.col("_at") == F.col("_day"), "left")
        return looked.withColumn(name, F.coalesce("_no", F.lit(0))).drop("_at", "_day", "_no")

    spans = session_upto(session_upto(dim.select(key, start, end), F.date_sub(start, 1), "_lo"), F.col(end), "_hi")
    live = spans.where(F.col("_lo") < F.col("_hi")).select(key, F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("session_no"))
    return live.join(sessions, "session_no")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], equal: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of two streams on identical keys, and the pairs whose shared facts differ."""
    l = left.select(*keys, *[F.col(c).alias(f"left_{c}") for c in left.columns if c not in keys])  # noqa: E741
    r = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys])
    both = l.join(r, list(keys))
    same = F.lit(True)
    for c in equal:
        same = same & F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    return both.where(same), both.where(~same)


def common_dates(streams: DataFrame, stream: str, keys: Sequence[str], anchor: str, days: int, order: str = "trade_date") -> DataFrame:
    """Rows of every stream on the anchor's last `days` dates that all streams share.

    Dates missing from a stream are dropped for all; none is replaced by an older one.
    """
    keys = list(keys)
    total = streams.select(*keys, stream).distinct().groupBy(*keys).agg(F.count("*").alias("_total"))
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    window = streams.where(F.col(stream) == anchor).withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= days).select(*keys, order)
    inside = streams.join(window, [*keys, order], "left_semi")
    shared = inside.groupBy(*keys, order).agg(F.count_distinct(stream).alias("_n")).join(total, keys).where("_n = _total").select(*keys, order)
    return inside.join(shared, [*keys, order], "left_semi")


def prepend_history(frozen: DataFrame, older: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Older rows put before a frozen history, with the overlapping rows that disagree."""
    keys = list(keys)
    new = older.join(frozen.select(*keys), keys, "left_anti")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_o.{c}").eqNullSafe(F.col(f"_f.{c}"))
    both = older.select(*keys, F.struct(*columns).alias("_o")).join(frozen.select(*keys, F.struct(*columns).alias("_f")), keys)
    return new.select(*keys, *columns).unionByName(frozen.select(*keys, *columns)), both.where(~same).select(*keys)


def latest_rows(df: DataFrame, keys: Sequence[str], n: int, order: str = "trade_date") -> DataFrame:
    """The last n rows per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def even_sample(df: DataFrame, keys: Sequence[str], m: int, order: str = "trade_date") -> DataFrame:
    """m evenly spaced rows per key including both ends."""
    w = Window.partitionBy(*keys)
    pos = F.row_number().over(w.orderBy(order)) - 1
    out = df.withColumn("_p", pos).withColumn("_n", F.count("*").over(w))
    k = F.least(F.lit(m), F.col("_n"))
    steps = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k > 1, F.floor(i * (F.col("_n") - 1) / (k - 1))).otherwise(F.lit(0)))
    return out.where(F.array_contains(steps, F.col("_p").cast("bigint"))).drop("_p", "_n")


