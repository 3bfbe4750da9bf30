"""Stream metrics, stability, diagnostics and acceptance gates.

Each report is a grouped aggregation over (stream, series, window); windows are
columns, so all of them are computed in one pass instead of one job per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import ordered
from tidemark.operators.series import direction_runs, rolling_accuracy

TOLERANCE = 1e-12


def _rate(cond: Column, given: Column) -> Column:
    return F.avg(F.when(given, cond.cast("double")))


def metric_columns() -> list[Column]:
    y, p, label = F.col("real_pct_change"), F.col("predicted_pct_change"), F.col("predicted_label")
    up = y > 0
    hit = label == up.cast("int")
    e = p - y
    up_recall, down_recall = _rate(hit, up), _rate(hit, ~up)
    h = hit.cast("double")
    return [
        F.count("*").alias("rows"), F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"),
        F.sum(hit.cast("int")).alias("correct_rows"), F.avg(h).alias("accuracy"),
        F.when(up_recall.isNull(), down_recall).when(down_recall.isNull(), up_recall).otherwise((up_recall + down_recall) / 2).alias("balanced_accuracy"),
        up_recall.alias("up_recall"), down_recall.alias("down_recall"),
        F.avg(F.abs(e)).alias("return_mae"), F.sqrt(F.avg(e * e)).alias("return_rmse"),
        F.avg((F.col("calibrated_confidence") - h) * (F.col("calibrated_confidence") - h)).alias("calibrated_brier"),
        F.avg((F.col("confidence") - h) * (F.col("confidence") - h)).alias("raw_brier"),
        F.sum(up.cast("int")).alias("actual_up_rows"), F.sum(label).alias("predicted_up_rows"), F.sum((p == 0).cast("int")).alias("zero_return_forecasts"),
        F.avg(up.cast("double")).alias("always_up_accuracy"), F.avg(F.abs(y)).alias("zero_return_mae"), F.sqrt(F.avg(y * y)).alias("zero_return_rmse"),
        (F.avg(label.cast("double")) - F.avg(up.cast("double"))).alias("up_rate_gap")]


def resolved(df: DataFrame) -> DataFrame:
    return df.where(F.col("real_pct_change").isNotNull())


def stream_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return resolved(df).groupBy(*keys).agg(*metric_columns())


def window_rows(df: DataFrame, keys: Sequence[str], test_start: str, development: tuple[str, str], tails: Sequence[int], years: bool = True) -> DataFrame:
    """Each resolved row once per report window it belongs to (at most a handful)."""
    t = F.col("trade_date")
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trade_date")))
    d = resolved(df).withColumn("_back", back)
    names = [F.lit("all"), F.when(t >= test_start, F.lit("test")), F.when(t.between(*development), F.lit("development"))]
    if years:
        names.append(F.concat(F.lit("year_"), F.date_format(t, "yyyy")))
    names += [F.when(F.col("_back") <= n, F.lit(f"latest_{n}")) for n in tails]
    return d.withColumn("window", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull()))).drop("_back")


def windowed_metrics(df: DataFrame, keys: Sequence[str], test_start: str, development: tuple[str, str], tails: Sequence[int] = (252, 20)) -> DataFrame:
    rows = window_rows(df, keys, test_start, development, tails)
    return rows.groupBy(*keys, "window").agg(*metric_columns())


def direction_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics plus longest up-run and switch rate of each group."""
    w = ordered(keys, "trade_date")
    runs = direction_runs(rows, keys, "trade_date", "predicted_label").withColumn("_prev", F.lag("predicted_label").over(w))
    per = runs.groupBy(*keys, "run").agg(F.first("predicted_label").alias("_l"), F.count("*").alias("_n"),
                                         F.sum((F.col("predicted_label") != F.col("_prev")).cast("int")).alias("_s"), F.count("_prev").alias("_t"))
    longest = per.groupBy(*keys).agg(F.max(F.when(F.col("_l") == 1, F.col("_n")).otherwise(0)).alias("longest_up"), F.try_divide(F.sum("_s"), F.sum("_t")).alias("switch_rate"))
    return rows.groupBy(*keys).agg(*metric_columns()).join(longest, list(keys))


def stability(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monthly spread, rolling-20 spread and flip rate."""
    d = resolved(df)
    month = d.groupBy(*keys, F.date_format("trade_date", "yyyyMM").alias("month")).agg(*metric_columns())
    monthly = month.groupBy(*keys).agg(F.count("*").alias("monthly_periods"), F.stddev_pop("accuracy").alias("monthly_accuracy_std"),
                                       F.min("accuracy").alias("monthly_accuracy_min"), F.stddev_pop("balanced_accuracy").alias("monthly_balanced_accuracy_std"))
    w = ordered(keys, "trade_date")
    hit = F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")
    r = d.withColumn("_a", rolling_accuracy(hit, 20, w)).withColumn("_f", (F.col("predicted_label") != F.lag("predicted_label").over(w)).cast("double"))
    rolled = r.groupBy(*keys).agg(F.stddev_pop("_a").alias("rolling_20_accuracy_std"), F.min("_a").alias("rolling_20_accuracy_min"),
                                  F.coalesce(F.avg("_f"), F.lit(0.0)).alias("direction_flip_rate"))
    return monthly.join(rolled, list(keys))


def settled_statistics(df: DataFrame, keys: Sequence[str], days: int, target: str | None = None, origin: str | None = None) -> DataFrame:
    """Statistics over the last `days` settled rows of each stream.

    With `target`, a column of target sessions, dates are those sessions where
    every row of the stream has one, else signal dates, and `date_basis` tells
    which.  With `origin`, `live_rows` counts rows that were generated live.
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trade_date")))
    d = resolved(df).withColumn("_back", back).withColumn("_all", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_back") <= days)
    up, pup = F.col("real_pct_change") > 0, F.col("predicted_label") == 1
    hit = F.col("predicted_label") == up.cast("int")
    return d.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.max("_all").alias("available_rows"), F.sum(hit.cast("int")).alias("correct_rows"), F.avg(hit.cast("double")).alias("accuracy"),
        ((_rate(hit, up) + _rate(hit, ~up)) / 2).alias("balanced_accuracy"), F.sum(pup.cast("int")).alias("up_rows"), F.sum((~pup).cast("int")).alias("down_rows"),
        _rate(hit, pup).alias("up_accuracy"), _rate(hit, ~pup).alias("down_accuracy"), _rate(hit, up).alias("up_recall"), _rate(hit, ~up).alias("down_recall"),
        F.avg(up.cast("double")).alias("baseline_accuracy"), (F.avg(hit.cast("double")) - F.avg(up.cast("double"))).alias("accuracy_lift"),
        F.avg("calibrated_confidence").alias("mean_confidence"), F.avg(F.abs(F.col("predicted_pct_change") - F.col("real_pct_change"))).alias("mae"),
        *_dated(target), *([F.sum((F.col(origin) == "live").cast("int")).alias("live_rows")] if origin else []))


def _dated(target: str | None) -> list[Column]:
    first, last = F.min("trade_date"), F.max("trade_date")
    if target is None:
        return [first.alias("start_date"), last.alias("end_date")]
    whole = F.count(target) == F.count("*")
    return [F.when(whole, F.min(target)).otherwise(first).alias("start_date"), F.when(whole, F.max(target)).otherwise(last).alias("end_date"),
            F.when(whole, "target_trade_date").otherwise("signal_date").alias("date_basis")]


def running_comparison(common: DataFrame, keys: Sequence[str], stream: str) -> DataFrame:
    """Of every stream and shared date: accuracy up to it, and whether the streams of the date disagree."""
    hit = (F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")).cast("double")
    day = Window.partitionBy(*keys, "trade_date")
    upto = ordered([*keys, stream], "trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return resolved(common).select(*keys, stream, "trade_date", "predicted_label", "real_pct_change", F.avg(hit).over(upto).alias("running_accuracy"),
                                   (F.min("predicted_label").over(day) != F.max("predicted_label").over(day)).alias("disagreement"))


def direction_alerts(df: DataFrame, keys: Sequence[str], session: str, days: int, minimum: int = 20, rate: float = 0.8, gap: float = 0.2, streak: int = 10) -> DataFrame:
    """Direction concentration and long-streak flags over the last settled rows."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trade_date")))
    d = resolved(df).withColumn("_back", back).where(F.col("_back") <= days)
    w = ordered(keys, "trade_date")
    gone = F.col(session) != F.lag(session).over(w) + 1
    runs = direction_runs(d, keys, "trade_date", "predicted_label", gone)
    adj = F.col(session) == F.lag(session).over(w) + 1
    runs = runs.withColumn("_t", adj).withColumn("_s", adj & (F.col("predicted_label") != F.lag("predicted_label").over(w)))
    hit = (F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")).cast("int")
    per = runs.groupBy(*keys, "run").agg(F.first("predicted_label").alias("l"), F.count("*").alias("n"), F.sum("predicted_label").alias("u"),
                                         F.sum((F.col("real_pct_change") > 0).cast("int")).alias("a"), F.sum(hit).alias("h"),
                                         F.sum(F.col("_t").cast("int")).alias("t"), F.sum(F.col("_s").cast("int")).alias("s"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum("u").alias("_u"), F.sum("a").alias("_a"), F.sum("t").alias("transition_rows"), F.sum("s").alias("switch_rows"),
                                 F.max(F.when(F.col("l") == 1, F.col("n")).otherwise(0)).alias("longest_up"), F.max(F.when(F.col("l") == 0, F.col("n")).otherwise(0)).alias("longest_down"))
    ur, ar = F.col("_u") / F.col("rows"), F.col("_a") / F.col("rows")
    out = out.withColumn("predicted_up_rate", ur).withColumn("actual_up_rate", ar).withColumn("up_rate_gap", ur - ar)
    big = F.col("rows") >= minimum
    up = big & (F.col("predicted_up_rate") >= rate) & (F.col("up_rate_gap") >= gap - TOLERANCE)
    down = big & (1 - F.col("predicted_up_rate") >= rate) & (-F.col("up_rate_gap") >= gap - TOLERANCE)
    return out.withColumn("concentrated_up", up).withColumn("concentrated_down", down).withColumn(
        "long_streak", F.greatest("longest_up", "longest_down") >= streak).drop("_u", "_a")


def probability_scores(df: DataFrame, keys: Sequence[str], probability: Column, target: Column) -> DataFrame:
    """Brier score and log loss of a binary probability."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), probability))
    y = target.cast("double")
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg((probability - y) * (probability - y)).alias("brier"), F.avg(loss).alias("log_loss"))


HIGHER = ("accuracy", "balanced_accuracy", "down_recall")
LOWER = ("return_mae", "return_rmse", "calibrated_brier")


def _checks(left: DataFrame, right: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str | None, str, str]]) -> DataFrame:
    """Long table of checks from wide candidate and baseline reports keyed by window."""
    k = [*keys, "window"]
    c = left.select(*k, F.struct(*[x for x in left.columns if x not in k]).alias("c"))
    b = right.select(*k, F.struct(*[x for x in right.columns if x not in k]).alias("b"))
    items = []
    for window, metric, op in rules:
        x, y = F.col(f"c.{metric}").cast("double"), F.col(f"b.{metric}").cast("double")
        ok = {"ge": x >= y - TOLERANCE, "ge_strict": x >= y, "le": x <= y + TOLERANCE, "smaller_abs": F.abs(x) < F.abs(y)}[op]
        item = F.struct(F.lit(metric).alias("metric"), x.alias("candidate"), y.alias("baseline"), F.coalesce(ok, F.lit(False)).alias("passed"))
        items.append(item if window is None else F.when(F.col("window") == window, item))
    rows = c.join(b, k).withColumn("k", F.explode(F.filter(F.array(*items), lambda z: z.isNotNull())))
    return rows.select(*k, "k.*")


def non_regression_gate(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """26 checks: six metrics in four windows and two strict improvements."""
    def report(df):
        rows = window_rows(df, keys, start, (start, start), (252, 60, 20), years=False)
        rows = rows.where(F.col("window").isin("test", "latest_252", "latest_60", "latest_20"))
        return direction_metrics(rows.withColumn("window", F.when(F.col("window") == "test", "regression").otherwise(F.col("window"))), [*keys, "window"])

    rules = [(None, m, "ge") for m in HIGHER] + [(None, m, "le") for m in LOWER] + [("latest_20", "up_rate_gap", "smaller_abs"), ("latest_60", "longest_up", "smaller_abs")]
    return _checks(report(candidate), report(baseline), keys, rules)


def strict_gate(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """Coverage, three windows of four metrics, and the fixed-window calibrated Brier score."""
    from tidemark.operators.calibrate import platt_calibrate

    k = [*keys, "trade_date"]
    ref = resolved(baseline).join(resolved(candidate).select(*k), k, "left_semi")
    new = resolved(candidate).join(resolved(baseline).select(*k), k, "left_semi")

    def report(df):
        rows = window_rows(df, keys, start, (start, start), (252, 20), years=False)
        return rows.where(F.col("window").isin("test", "latest_252", "latest_20")).groupBy(*keys, "window").agg(*metric_columns())

    rules = [(None, "accuracy", "ge_strict"), (None, "balanced_accuracy", "ge_strict"), (None, "return_mae", "le"), (None, "return_rmse", "le")]
    checks = _checks(report(new), report(ref), keys, rules)

    def brier(df):
        fair = platt_calibrate(df, keys).where(F.col("trade_date") >= start)
        e = F.col("calibrated_confidence") - F.col("correct").cast("double")
        return fair.groupBy(*keys).agg(F.avg(e * e).alias("causal_brier")).withColumn("window", F.lit("test"))

    fair = _checks(brier(new), brier(ref), keys, [(None, "causal_brier", "le")])
    b = resolved(baseline).select(*k, F.lit(1).alias("_b"))
    c = resolved(candidate).select(*k, F.lit(1).alias("_c"))
    cover = b.join(c, k, "full").groupBy(*keys).agg(F.count(F.when(F.col("_c").isNull(), 1)).alias("_m"), F.count(F.when(F.col("_b").isNull(), 1)).alias("_e"),
                                                    F.count(F.when(F.col("_c").isNull() & (F.col("trade_date") >= start), 1)).alias("_t"))
    coverage = cover.select(*keys, F.explode(F.array(
        F.struct(F.lit("all").alias("window"), F.lit("exact_date_coverage").alias("metric"), (F.col("_m") + F.col("_e")).cast("double").alias("candidate"), F.lit(0.0).alias("baseline"), ((F.col("_m") + F.col("_e")) == 0).alias("passed")),
        F.struct(F.lit("test").alias("window"), F.lit("complete_baseline_date_coverage").alias("metric"), F.col("_t").cast("double").alias("candidate"), F.lit(0.0).alias("baseline"), (F.col("_t") == 0).alias("passed")))).alias("x")).select(*keys, "x.*")
    return checks.unionByName(fair).unionByName(coverage)


def paired_changes(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows the candidate corrected and damaged."""
    k = [*keys, "trade_date"]
    b = resolved(baseline).select(*k, F.col("correct").cast("int").alias("_b"))
    j = resolved(candidate).select(*k, F.col("correct").cast("int").alias("_c")).join(b, k)
    return j.groupBy(*keys).agg(F.sum((F.col("_c") > F.col("_b")).cast("int")).alias("corrected"), F.sum((F.col("_c") < F.col("_b")).cast("int")).alias("damaged"))


def development_selection(candidates: DataFrame, baseline: DataFrame, keys: Sequence[str], choice: Sequence[str], years: Sequence[int],
                          minimum_changes: int = 5, by_gap: bool = False) -> DataFrame:
    """Choose among candidate x threshold by development years only.

    Every year must not lose accuracy or balanced accuracy and enough rows must
    change; the best has the largest (minimum gain, balanced accuracy, fewer changes).
    """
    y = F.year("trade_date")
    base = resolved(baseline).where(y.isin(*years)).groupBy(*keys, y.alias("year")).agg(*metric_columns())
    base = base.select(*keys, "year", F.col("accuracy").alias("_ba"), F.col("balanced_accuracy").alias("_bb"))
    dev = resolved(candidates).where(y.isin(*years))
    k = [*keys, *choice]
    changed = F.sum(F.col("correction_selected").cast("int")).alias("_changed")
    yearly = dev.groupBy(*k, y.alias("year")).agg(*metric_columns(), changed).join(base, [*keys, "year"])
    gain = F.least(F.col("accuracy") - F.col("_ba"), F.col("balanced_accuracy") - F.col("_bb"))
    per = yearly.groupBy(*k).agg(F.min(gain).alias("minimum_gain"), F.sum("_changed").alias("changed_rows"), F.count("*").alias("_y"))
    whole = dev.groupBy(*k).agg(*metric_columns()).select(*k, "balanced_accuracy", "up_rate_gap")
    out = per.join(whole, k).withColumn("eligible", (F.col("minimum_gain") >= -TOLERANCE) & (F.col("changed_rows") >= minimum_changes) & (F.col("_y") == len(years)))
    last = F.asc(F.abs("up_rate_gap")) if by_gap else F.asc("changed_rows")
    order = Window.partitionBy(*keys).orderBy(F.desc("eligible"), F.desc("minimum_gain"), F.desc("balanced_accuracy"), last, *choice)
    return out.withColumn("selected", F.col("eligible") & (F.row_number().over(order) == 1)).drop("_y")


def multi_stream_comparison(common: DataFrame, streams: DataFrame, window: DataFrame, keys: Sequence[str], stream: str, days: int) -> DataFrame:
    """Per-stream statistics on shared dates with missing counts."""
    k = [*keys, stream]
    stats = settled_statistics(common, k, days)
    hit = (F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")).cast("double")
    e = F.col("predicted_pct_change") - F.col("real_pct_change")
    extra = resolved(common).groupBy(*k).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.col("calibrated_confidence") - hit) * (F.col("calibrated_confidence") - hit)).alias("brier"))
    have = streams.join(window, [*keys, "trade_date"], "left_semi").groupBy(*k).agg(F.count("*").alias("_have"))
    size = window.groupBy(*keys).agg(F.count("*").alias("_size"))
    return stats.join(extra, k).join(have, k).join(size, list(keys)).withColumn("missing_rows", F.col("_size") - F.col("_have")).drop("_have", "_size")


def overlay_attribution(df: DataFrame, keys: Sequence[str], applied: Column, base_label: str, recent: int = 20) -> DataFrame:
    """Trigger rate, accuracy and directional-return lift of an overlay, over all and recent rows."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trade_date")))
    d = resolved(df).withColumn("_on", F.coalesce(applied, F.lit(False))).withColumn("_back", back)
    d = d.withColumn("sample", F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("_back") <= recent, F.lit("recent"))), lambda x: x.isNotNull())))
    y = F.col("real_pct_change")
    side = lambda c: F.when(F.col(c) > 0, y).otherwise(-y)
    up = (y > 0).cast("int")
    fin, bas = (F.col("predicted_label") == up).cast("double"), (F.col(base_label) == up).cast("double")
    on = F.col("_on")
    return d.groupBy(*keys, "sample").agg(
        F.sum(on.cast("int")).alias("rows"), F.avg(on.cast("double")).alias("trigger_rate"), F.avg(F.when(on, fin)).alias("accuracy"),
        (F.avg(F.when(on, fin)) - F.avg(F.when(on, bas))).alias("accuracy_lift"),
        F.sum(F.when(on, side("predicted_label") - side(base_label))).alias("directional_return_lift"))


def parity_report(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: compared rows, rows on one side only, largest difference, exactness."""
    l = left.select(*keys, F.struct(*columns).alias("_l"))  # noqa: E741
    r = right.select(*keys, F.struct(*columns).alias("_r"))
    j = l.join(r, list(keys), "full")
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_l.{c}").cast("double").alias("a"), F.col(f"_r.{c}").cast("double").alias("b")) for c in columns])
    x = j.withColumn("_one", F.col("_l").isNull() | F.col("_r").isNull()).select("_one", F.explode(items).alias("x")).select("_one", "x.*")
    return x.groupBy("column").agg(
        F.count(F.when(~F.col("_one"), 1)).alias("rows"), F.count(F.when(F.col("_one"), 1)).alias("one_sided"),
        F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_abs"),
        F.min((F.col("a").eqNullSafe(F.col("b")) & ~F.col("_one")).cast("int")).alias("exact"))


def report_delta(left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Candidate minus baseline for each metric of two reports."""
    l = left.select(*keys, F.struct(*metrics).alias("_l"))  # noqa: E741
    r = right.select(*keys, F.struct(*metrics).alias("_r"))
    return l.join(r, list(keys)).select(*keys, *[(F.col(f"_l.{m}") - F.col(f"_r.{m}")).alias(m) for m in metrics])


def prospective_audit(candidate: DataFrame, control: DataFrame, keys: Sequence[str], live: Column, tails: Sequence[int] = (20, 60, 252)) -> DataFrame:
    """Both streams on rows generated before the target opened and settled in both.

    Windows are the last n paired rows, flagged sufficient when n rows exist.
    """
    k = [*keys, "trade_date"]
    cols = ["predicted_label", "predicted_pct_change", "real_pct_change", "confidence", "calibrated_confidence"]
    a = candidate.where(live).select(*k, F.struct(*cols).alias("candidate"))
    b = control.where(live).select(*k, F.struct(*cols).alias("control"))
    both = a.join(b, k).where(F.col("candidate.real_pct_change").isNotNull() & F.col("candidate.real_pct_change").eqNullSafe(F.col("control.real_pct_change")))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trade_date")))
    both = both.withColumn("_back", back)
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(n).alias("v")) for n in ("candidate", "control")])
    windows = F.filter(F.array(F.lit(0), *[F.when(F.col("_back") <= n, F.lit(n)) for n in tails]), lambda x: x.isNotNull())
    rows = both.withColumn("window", F.explode(windows)).withColumn("_s", F.explode(sides)).select(*k, "window", "_s.side", "_s.v.*")
    out = rows.groupBy(*keys, "side", "window").agg(*metric_columns())
    return out.withColumn("sufficient", F.col("rows") >= F.col("window"))
