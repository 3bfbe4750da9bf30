"""Append-only forecast ledgers: drift detection, settlement, provenance and publication.

Tables are immutable: every operator classifies rows or returns the rows to
append.  All comparisons are equality joins on (series, date), so a publish job
only touches the partitions of the dates it carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import close_to

RTOL, ATOL = 1e-14, 1e-12
OPEN_TIME = "09:30:00"
ZONE = "Asia/Shanghai"


def append_only_merge(frozen: DataFrame, provider: DataFrame, keys: Sequence[str], date: str, columns: Sequence[str],
                      late_optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows to append and the violations that forbid it.

    A frozen row must still be supplied with equal values; a frozen null of a
    late-optional column may be answered later (the stored null stays); a new row
    must follow its series' frozen end.
    """
    keys = list(keys)
    group = [k for k in keys if k != date]
    f = frozen.select(*keys, F.struct(*columns).alias("_f"))
    p = provider.select(*keys, F.struct(*columns).alias("_p"))
    end = frozen.groupBy(*group).agg(F.max(date).alias("_end"))
    j = f.join(p, keys, "full").join(end, group, "left")
    checks = [F.when(F.col("_p").isNull(), F.lit("missing")), F.when(F.col("_f").isNull() & (F.col(date) <= F.col("_end")), F.lit("inserted"))]
    both = F.col("_f").isNotNull() & F.col("_p").isNotNull()
    for c in columns:
        same = close_to(F.col(f"_p.{c}"), F.col(f"_f.{c}"), RTOL, ATOL)
        if c in late_optional:
            same = same | (F.col(f"_f.{c}").isNull() & F.col(f"_p.{c}").isNotNull())
        checks.append(F.when(both & ~same, F.lit(f"revised_{c}")))
    bad = j.select(*keys, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("rule"))
    new = j.where(F.col("_f").isNull() & (F.col("_end").isNull() | (F.col(date) > F.col("_end")))).select(*keys, "_p.*")
    return new, bad


def fingerprint(fields: dict[str, Column]) -> Column:
    """sha256 of a canonical JSON payload: sorted names, fixed number text, explicit nulls."""
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def number_text(c: Column) -> Column:
    """Fifteen significant digits as a whole number, and the power of ten of the first; 0 is "0".

    Scaling by an exact power of ten and one rounding is the same in every
    engine, which formatting a double is not.
    """
    x = c.cast("double")
    power = F.floor(F.log10(F.abs(x)))
    digits = F.floor(F.abs(x) * F.pow(F.lit(10.0), 14 - power) + 0.5).cast("bigint")
    text = F.concat(F.when(x < 0, "-").otherwise(""), digits.cast("string"), F.lit("e"), power.cast("string"))
    return F.when(x == 0, "0").when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("string")).otherwise(text)


def forecast_fingerprint(df: DataFrame) -> DataFrame:
    fields = {n: number_text(F.col(n)) for n in ("predicted_pct_change", "predicted_close", "confidence", "calibrated_confidence")}
    fields |= {"signal_date": F.date_format("trade_date", "yyyyMMdd"), "predicted_label": F.col("predicted_label").cast("string")}
    return df.withColumn("fingerprint", fingerprint(fields))


def insert_plan(candidate: DataFrame, ledger: DataFrame, keys: Sequence[str], date: str = "trade_date") -> DataFrame:
    """Classify candidate rows as matching, drifted, gap (would fill history) or new."""
    group = [k for k in keys if k != date]
    last = ledger.groupBy(*group).agg(F.max(date).alias("_last"))
    j = candidate.join(ledger.select(*keys, F.col("fingerprint").alias("_stored")), list(keys), "left").join(last, group, "left")
    status = F.when(F.col("_stored") == F.col("fingerprint"), "matching").when(F.col("_stored").isNotNull(), "drifted").when(F.col(date) <= F.col("_last"), "gap").otherwise("new")
    return j.withColumn("status", status).drop("_stored", "_last")


def rows_to_insert(plan: DataFrame) -> DataFrame:
    """New rows, only where no row of the same stream drifted or filled a gap."""
    group = [c for c in ("stream_id", "series_id") if c in plan.columns]
    bad = plan.where(F.col("status").isin("drifted", "gap")).select(*group).distinct()
    return plan.where("status = 'new'").join(bad, group, "left_anti")


def settle(pending: DataFrame, targets: DataFrame, closes: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Outcomes of pending forecasts whose target session has a close."""
    c = closes.select(*keys, F.col("trade_date").alias("target_date"), F.col("close").alias("actual_close"))
    j = pending.join(targets, [*keys, "trade_date"]).join(c, [*keys, "target_date"])
    r = F.col("actual_close") / F.col("close") - 1
    return j.withColumn("actual_return", r).withColumn("settled_correct", F.col("predicted_label") == (F.col("actual_return") > 0).cast("int"))


def opening(date: Column, zone: str = ZONE) -> Column:
    """Instant (UTC) of a session's opening."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" " + OPEN_TIME))), zone)


def origin(generated: Column, target: Column) -> Column:
    """live if generated before the target session opened, backfill after, unknown without a target."""
    return F.when(target.isNull(), "unknown").when(generated < opening(target), "live").otherwise("backfill")


def admitted(generated: Column, signal: Column, target: Column, zone: str = ZONE, hour: int = 18, allow_backfill: bool = False) -> Column:
    """Whether a forecast may be recorded: after the publication hour of its day and before the next open."""
    local = F.from_utc_timestamp(generated, zone)
    ready = (F.to_date(local) > signal) | ((F.to_date(local) == signal) & (F.hour(local) >= hour))
    ok = ready if allow_backfill else ready & (generated < opening(target))
    return F.coalesce(ok, F.lit(False))


def inherited_times(candidate: DataFrame, previous: DataFrame, keys: Sequence[str], now: Column) -> DataFrame:
    """Earliest generation time of an identical forecast, else now."""
    first = previous.groupBy(*keys, "fingerprint").agg(F.min("created_at").alias("_first"))
    return candidate.join(first, [*keys, "fingerprint"], "left").withColumn("generated_at", F.coalesce("_first", now)).drop("_first")


def extend_context(frozen: DataFrame, provider: DataFrame, calendar: DataFrame, columns: Sequence[str], date: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """Only the sessions after the frozen end, and the boundary row if it disagrees."""
    end = frozen.agg(F.max(date)).scalar()
    new = provider.join(calendar.select(date), date, "left_semi").join(frozen.select(date), date, "left_anti").where(F.col(date) > end)
    same = F.lit(True)
    for c in columns:
        same = same & close_to(F.col(f"_p.{c}"), F.col(f"_f.{c}"), RTOL, ATOL)
    edge = frozen.where(F.col(date) == end).select(date, F.struct(*columns).alias("_f")).join(provider.select(date, F.struct(*columns).alias("_p")), date)
    return new.select(date, *columns), edge.where(~same).select(date)


def freshness(published: DataFrame, calendar: DataFrame, now: Column, hour: int, minute: int, keys: Sequence[str]) -> DataFrame:
    """Expected as-of session at `now` against the last published one."""
    day = F.when((F.hour(now) * 60 + F.minute(now)) >= hour * 60 + minute, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))
    expected = calendar.where(F.col("trade_date") <= day).agg(F.max("trade_date")).scalar()
    last = published.groupBy(*keys).agg(F.max("trade_date").alias("published_as_of"))
    return last.withColumn("expected_as_of", expected).withColumn("fresh", F.col("published_as_of") >= F.col("expected_as_of"))


def publish_once(candidate: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate rows not yet published; repeating a publish adds nothing."""
    return candidate.dropDuplicates(list(keys)).join(published.select(*keys), list(keys), "left_anti")


def atomic_dates(streams: DataFrame, stream: str, keys: Sequence[str], date: str, members: int) -> DataFrame:
    """Publish verdict per series: every stream must carry the same dates."""
    per = streams.groupBy(*keys, date).agg(F.count_distinct(stream).alias("_n"))
    return per.groupBy(*keys).agg(F.count("*").alias("dates"), F.sum((F.col("_n") != members).cast("int")).alias("incomplete_dates")).withColumn("publish", F.col("incomplete_dates") == 0)


def missed_sessions(calendar: DataFrame, ledger: DataFrame, now: Column, keys: Sequence[str]) -> DataFrame:
    """Open sessions not later than now and after each series' first entry that the ledger lacks."""
    span = ledger.groupBy(*keys).agg(F.min("trade_date").alias("_a"))
    numbered = span.join(calendar.withColumnRenamed("trade_date", "_a"), "_a").select(*keys, F.col("session_no").alias("_lo"))
    last = calendar.where(F.col("trade_date") <= F.to_date(now)).agg(F.max("session_no")).scalar()
    grid = numbered.withColumn("_hi", last).select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("session_no")).join(calendar, "session_no")
    return grid.select(*keys, "trade_date").join(ledger.select(*keys, "trade_date"), [*keys, "trade_date"], "left_anti")


def reseed(pinned: DataFrame, current: DataFrame, keys: Sequence[str], date: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Pinned rows up to their end and newer current rows, with the proof that no known value changed."""
    new, bad = append_only_merge(pinned, current, keys, date, columns)
    return pinned.select(*keys, *columns).unionByName(new), bad


def replay_differences(replayed: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either side without an identical counterpart."""
    a = replayed.select(*keys, F.col("fingerprint").alias("_a"))
    b = ledger.select(*keys, F.col("fingerprint").alias("_b"))
    j = a.join(b, list(keys), "full")
    rule = F.when(F.col("_b").isNull(), "not_in_ledger").when(F.col("_a").isNull(), "not_replayed").when(F.col("_a") != F.col("_b"), "different")
    return j.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(*keys, "rule")


def upgrade_verdict(candidate: DataFrame, ledger: DataFrame, keys: Sequence[str], series: Sequence[str]) -> DataFrame:
    """A new release may publish only where every row equals the old ledger."""
    d = replay_differences(candidate, ledger, keys).groupBy(*series).agg(F.count("*").alias("differences"))
    return ledger.groupBy(*series).agg(F.count("*").alias("rows")).join(d, list(series), "left").fillna(0, ["differences"]).withColumn("compatible", F.col("differences") == 0)
