"""Data-quality gates as violation tables.

Each gate returns the offending rows as (rule, detail...) instead of raising, so
a whole set of gates is one job; `require_none` turns any table into an abort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import ordered


class QualityError(ValueError):
    """A strict gate found violations."""


def require_none(violations: DataFrame, message: str) -> None:
    first = violations.limit(3).collect()
    if first:
        raise QualityError(f"{message}: {[tuple(r) for r in first]}")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def flag_rows(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule; a rule is a column that must be true, null counts as broken."""
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("rule"), *keys)


def finite(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ohlc_rules(tolerance: float = 0.0) -> dict[str, Column]:
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))  # noqa: E741
    return {
        "positive": (o > 0) & (h > 0) & (l > 0) & (c > 0), "range": h >= l,
        "open_inside": o.between(l - tolerance, h + tolerance), "close_inside": c.between(l - tolerance, h + tolerance)}


def unordered(df: DataFrame, keys: Sequence[str], arrival: str, date: str) -> DataFrame:
    """Rows whose date does not advance on the row that arrived before them."""
    w = ordered(keys, arrival)
    return df.withColumn("previous", F.lag(date).over(w)).where(F.col("previous") >= F.col(date)).drop(arrival)


def gaps(df: DataFrame, keys: Sequence[str], date: str, days: int) -> DataFrame:
    """Rows that follow the previous one by more than `days` calendar days."""
    prev = F.lag(date).over(ordered(keys, date))
    return df.withColumn("previous", prev).withColumn("gap_days", F.datediff(date, "previous")).where(F.col("gap_days") > days)


def truncated(df: DataFrame, keys: Sequence[str], date: str, start: str, end: str, days: int = 7) -> DataFrame:
    """Per key: whether a landed series starts and ends near the asked range without long gaps."""
    prev = F.lag(date).over(ordered(keys, date))
    g = df.withColumn("_gap", F.datediff(F.col(date), prev))
    out = g.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap"))
    ok = (F.datediff(F.col("first_date"), F.lit(start).cast("date")) <= days) & (F.datediff(F.lit(end).cast("date"), F.col("last_date")) <= days) & (F.col("longest_gap") <= days)
    return out.withColumn("complete", ok)


def warmup_violations(signals: DataFrame, calendar: DataFrame, sessions: int) -> DataFrame:
    """Signals off the calendar or with fewer than `sessions` earlier sessions."""
    j = signals.join(calendar, "trade_date", "left")
    return j.where(F.col("session_no").isNull() | (F.col("session_no") <= sessions))


def universe_mismatch(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    o = observed.select(*keys).distinct().withColumn("_o", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    j = o.join(e, list(keys), "full").where(F.col("_o").isNull() | F.col("_e").isNull())
    return j.select(*keys, F.when(F.col("_o").isNull(), "unobserved").otherwise("unlisted").alias("rule"))


def bars_disagree(bars: DataFrame, daily: DataFrame, keys: Sequence[str], price: float = 0.01, total: float = 1e-4) -> DataFrame:
    """Sessions whose bars do not add up to the daily bar."""
    k = [*keys, "trade_date"]
    b = bars.groupBy(*k).agg(F.max_by("close", "bar_end").alias("b_close"), F.max("high").alias("b_high"), F.min("low").alias("b_low"), F.sum("vol").alias("b_vol"), F.sum("amount").alias("b_amount"))
    j = b.join(daily.select(*k, "close", "high", "low", "vol", "amount"), k)
    near = lambda a, c: F.abs(F.col(a) - F.col(c)) <= price
    rel = lambda a, c: F.abs(F.col(a) - F.col(c)) <= total * F.abs(F.col(c))
    return flag_rows(j, {"close": near("b_close", "close"), "high": near("b_high", "high"), "low": near("b_low", "low"), "volume": rel("b_vol", "vol"), "amount": rel("b_amount", "amount")}, k)


def grid_mismatch(bars: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """Missing slots of each session's expected bar grid."""
    k = [*keys, "trade_date"]
    want = bars.select(*k).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(slots).cast("bigint"))))
    return want.join(bars.select(*k, F.col("slot").cast("bigint").alias("slot")), [*k, "slot"], "left_anti")


def prediction_rules() -> dict[str, Column]:
    """Invariants of a forecast row; the outcome may still be unknown."""
    p, label, y = F.col("predicted_pct_change"), F.col("predicted_label"), F.col("real_pct_change")
    right = label == (y > 0).cast("int")
    return {
        "binary_label": label.isin(0, 1), "sign_matches_label": (p == 0) | ((p > 0).cast("int") == label),
        "correct_recomputes": F.col("correct").eqNullSafe(F.when(y.isNotNull(), right)),
        "confidence_range": F.col("confidence").between(0, 1) & F.col("calibrated_confidence").between(0, 1)}


def causality_violations(df: DataFrame, rows: str, last_date: str, date: str = "trade_date") -> DataFrame:
    """Fitted rows whose last training date is not before the signal."""
    return df.where((F.col(rows) > 0) & (F.col(last_date).isNull() | (F.col(last_date) >= F.col(date))))


def contract_rules(underlying: str = "Brand#%") -> dict[str, Column]:
    return {"underlying": F.col("opt_code").like(underlying), "right": F.col("call_put").isin("P", "C"), "interval": F.col("list_date") <= F.col("delist_date"), "code": F.col("ts_code").isNotNull()}
