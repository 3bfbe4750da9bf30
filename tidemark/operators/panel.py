"""Cross-sectional aggregations: one row per session.

Sums and averages use map-side partial aggregation; medians, quantiles and
leading tenths go through rank selection, so that no session is gathered in one
task however many rows it holds.
Operators with ranks read their input more than once: pass a staged panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import ordered
from tidemark.functions.scalars import exponential, natural_log, quotient
from tidemark.operators.ranks import aggregate_with_quantiles, flag_top, tenth
from tidemark.sources.derive import AMOUNTS
from tidemark.sources.staging import stage

DAY = ["trade_date"]
MIN_COVERAGE = 0.98
TREND_COVERAGE = 0.90
COVERED = ("SH", "SZ")


def mean_of(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def sum_if(cond: Column, x: Column) -> Column:
    return F.sum(F.when(cond, x).otherwise(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def wavg(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def is_active() -> Column:
    """Traded row of a covered exchange with a known return."""
    return F.col("market").isin(*COVERED) & (F.col("vol") > 0) & (F.col("amount") > 0) & F.col("pct_chg").isNotNull()


def active_rows(stock: DataFrame) -> DataFrame:
    """Active rows with their return as a fraction."""
    return stock.where(is_active()).withColumn("ret", F.col("pct_chg") / 100)


def market_breadth(stock: DataFrame, first_market: str = "SH") -> DataFrame:
    """Advance/decline measures for the whole market and one exchange, in one aggregation."""
    live = is_active()
    groups = {"all": live, "shanghai": live & (F.col("market") == first_market)}
    aggs = [F.count("*").alias("source_rows"), F.count(F.when(~F.col("market").isin(*COVERED), 1)).alias("excluded_exchange_rows")]
    medians = []
    traded = F.count(F.when(live, 1))
    for g, member in groups.items():
        x, amt = F.when(member, F.col("pct_chg") / 100), F.when(member, F.col("amount"))
        medians.append((f"{g}_median_return", x, 0.5))
        aggs += [
            F.when(traded > 0, F.count(x)).alias(f"{g}_active_rows"),
            F.avg((x > 0).cast("double")).alias(f"{g}_up_fraction"),
            F.avg((x < 0).cast("double")).alias(f"{g}_down_fraction"),
            F.avg(x).alias(f"{g}_mean_return"),
            share(sum_if(x < 0, amt), F.sum(amt)).alias(f"{g}_down_amount_fraction"),
            F.avg((x <= -0.02).cast("double")).alias(f"{g}_large_down_fraction"),
        ]
    return aggregate_with_quantiles(stock, DAY, aggs, medians)


def return_distribution(stock: DataFrame) -> DataFrame:
    """Quantiles, spread, turnover-weighted tilt and turnover concentration."""
    act = active_rows(stock)
    probs = {"q01": .01, "q10": .1, "q25": .25, "q75": .75, "q90": .9, "q99": .99}
    q = aggregate_with_quantiles(act, DAY, [F.count("*").alias("active_rows")], [(n, F.col("ret"), p) for n, p in probs.items()])
    clipped = act.join(q.select("trade_date", "q01", "q99"), DAY).withColumn(
        "robust", F.greatest(F.col("q01"), F.least(F.col("q99"), F.col("ret"))))
    flagged = flag_top(clipped, DAY, "amount", "code", tenth)
    day = flagged.groupBy(*DAY).agg(
        (wavg(F.col("robust"), F.col("amount")) - F.avg("robust")).alias("amount_return_gap"),
        share(sum_if(F.col("is_top"), F.col("amount")), F.sum("amount")).alias("amount_top_decile"),
    )
    return day.join(q, DAY).withColumn("iqr", F.col("q75") - F.col("q25"))


def state_transitions(stock: DataFrame, calendar: DataFrame) -> DataFrame:
    """Direction changes of stocks active in two consecutive sessions.

    The previous cross-section is an equality join on session_no - 1.
    """
    act = active_rows(stock).join(calendar, "trade_date").select("code", "session_no", "trade_date", "ret")
    prev = act.select("code", (F.col("session_no") + 1).alias("session_no"), F.col("ret").alias("prev_ret"))
    m = act.join(prev, ["code", "session_no"])
    r, p = F.col("ret"), F.col("prev_ret")
    return m.groupBy(*DAY).agg(
        F.count("*").alias("matched_rows"),
        mean_of((p > 0) & (r < 0)).alias("advance_to_decline"),
        mean_of((p < 0) & (r < 0)).alias("decline_persistence"),
        mean_of((p < 0) & (r > 0)).alias("decline_to_advance"),
    )


def _flow_terms(df: DataFrame) -> DataFrame:
    gross = sum((F.col(a) for a in AMOUNTS[1:]), F.col(AMOUNTS[0]))
    large = F.col("buy_lg_amount") + F.col("buy_elg_amount") - F.col("sell_lg_amount") - F.col("sell_elg_amount")
    return df.withColumn("gross", gross).withColumn("large", large).withColumn(
        "small", F.col("buy_sm_amount") - F.col("sell_sm_amount")).withColumn("ratio", share(F.col("large"), F.col("gross")))


def matched_flow(stock: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """Active stocks with their flow; `matched` is false where the flow is missing or empty.

    Without `flow`, the rows of `stock` carry its amounts themselves.
    """
    act = active_rows(stock)
    joined = _flow_terms(act) if flow is None else act.join(_flow_terms(flow), ["code", "trade_date"], "left")
    return joined.withColumn("matched", F.coalesce(F.col("gross") > 0, F.lit(False)))


FLOW_MEASURES = ("large_net_ratio", "small_net_ratio", "large_selling_fraction", "large_selling_amount_fraction",
                 "large_net_median", "large_small_divergence", "shanghai_relative")
PRICE_FLOW_MEASURES = ("up_sell_amount_fraction", "down_buy_amount_fraction", "high_turnover_large_ratio", "other_turnover_large_ratio")


def coverage_gate(df: DataFrame, measures: Sequence[str], coverages: Sequence[str], minimum: float = MIN_COVERAGE) -> DataFrame:
    """Null every measure of a session whose coverage is short."""
    enough = F.least(*[F.col(c) for c in coverages]) >= minimum if len(coverages) > 1 else F.col(coverages[0]) >= minimum
    return df.select(*[F.when(enough, F.col(c)).alias(c) if c in measures else F.col(c) for c in df.columns])


def order_flow(stock: DataFrame, flow: DataFrame | None = None, price_context: bool = False) -> DataFrame:
    """Order-size flow measures with stock and turnover coverage, gated at 98 %."""
    m = matched_flow(stock, flow)
    if flow is not None:
        m = stage(m, "matched-flow")
    ok = F.col("matched")
    if price_context:
        m = flag_top(m.withColumn("_ranked", F.when(ok, F.col("amount"))), DAY, "_ranked", "code", tenth)
    g, lg, sm = F.when(ok, F.col("gross")), F.when(ok, F.col("large")), F.when(ok, F.col("small"))
    sh = F.col("market") == "SH"
    total = F.sum(g)
    aggs = [
        F.count("*").alias("active_rows"), F.count(g).alias("matched_rows"),
        mean_of(ok).alias("stock_coverage"), share(sum_if(ok, F.col("amount")), F.sum("amount")).alias("amount_coverage"),
        share(F.sum(lg), total).alias("large_net_ratio"), share(F.sum(sm), total).alias("small_net_ratio"),
        F.avg((lg < 0).cast("double")).alias("large_selling_fraction"),
        share(sum_if(lg < 0, g), total).alias("large_selling_amount_fraction"),
        F.avg(((lg < 0) & (sm > 0)).cast("double")).alias("large_small_divergence"),
        (share(F.sum(F.when(sh, lg)), F.sum(F.when(sh, g))) - share(F.sum(lg), total)).alias("shanghai_relative"),
    ]
    if price_context:
        r, top = F.col("ret"), F.col("is_top")
        aggs += [
            share(sum_if((r > 0) & (lg < 0), g), total).alias("up_sell_amount_fraction"),
            share(sum_if((r < 0) & (lg > 0), g), total).alias("down_buy_amount_fraction"),
            share(F.sum(F.when(top, lg)), F.sum(F.when(top, g))).alias("high_turnover_large_ratio"),
            share(F.sum(F.when(~top, lg)), F.sum(F.when(~top, g))).alias("other_turnover_large_ratio"),
        ]
    day = aggregate_with_quantiles(m, DAY, aggs, [("large_net_median", F.when(ok, F.col("ratio")), 0.5)])
    return coverage_gate(day, (*FLOW_MEASURES, *PRICE_FLOW_MEASURES), ("stock_coverage", "amount_coverage"))


CAP_MEASURES = ("cap_up_fraction", "cap_return", "cap_vs_equal_up", "cap_net_ratio", "cap_selling_fraction",
                "large_cap_net_ratio", "small_cap_net_ratio")
CAP_PRICE_MEASURES = CAP_MEASURES[:3]


def capital_flow(stock: DataFrame, flow: DataFrame | None = None, cap: DataFrame | None = None, market: str = "SH") -> DataFrame:
    """Capitalisation-weighted breadth and flow of one exchange.

    Without `flow` or `cap`, the rows of `stock` carry those columns themselves.

    Every active stock must have a positive capitalisation and each of the three
    flow coverages must reach 98 %; otherwise the measures are unknown.
    """
    m = matched_flow(stock, flow).where(F.col("market") == market)
    m = m if cap is None else m.join(cap, ["code", "trade_date"], "left")
    ok = F.col("matched")
    c = F.when(F.col("total_mv") > 0, F.col("total_mv"))
    m = m.withColumn("cap", c)
    if flow is not None or cap is not None:
        m = stage(m, "capital-flow")
    m = flag_top(m.withColumn("_ranked", F.when(ok, F.col("cap"))), DAY, "_ranked", "code", tenth)
    cm, lg, g = F.when(ok, F.col("cap")), F.when(ok, F.col("large")), F.when(ok, F.col("gross"))
    up = F.when(ok, (F.col("ret") > 0).cast("double"))
    big = F.col("is_top")
    day = m.groupBy(*DAY).agg(
        F.count("*").alias("active_rows"), F.count(g).alias("matched_rows"),
        F.avg(F.col("cap").isNotNull().cast("double")).alias("basic_stock_coverage"),
        mean_of(ok).alias("flow_stock_coverage"),
        share(sum_if(ok, F.col("amount")), F.sum("amount")).alias("flow_amount_coverage"),
        share(sum_if(ok, F.col("cap")), F.sum("cap")).alias("flow_cap_coverage"),
        wavg(up, cm).alias("cap_up_fraction"), wavg(F.when(ok, F.col("ret")), cm).alias("cap_return"),
        (wavg(up, cm) - F.avg(up)).alias("cap_vs_equal_up"),
        wavg(F.when(ok, F.col("ratio")), cm).alias("cap_net_ratio"),
        wavg((lg < 0).cast("double"), cm).alias("cap_selling_fraction"),
        share(F.sum(F.when(big, lg)), F.sum(F.when(big, g))).alias("large_cap_net_ratio"),
        share(F.sum(F.when(~big, lg)), F.sum(F.when(~big, g))).alias("small_cap_net_ratio"),
    )
    cov = ["flow_stock_coverage", "flow_amount_coverage", "flow_cap_coverage"]
    full_caps = F.col("basic_stock_coverage") == 1
    ready = full_caps & (F.least(*[F.col(x) for x in cov]) >= MIN_COVERAGE) & (F.col("matched_rows") >= 2)
    return day.select(*[
        F.when(ready, F.col(x)).alias(x) if x in CAP_MEASURES else F.when(full_caps, F.col(x)).alias(x) if x in cov else F.col(x)
        for x in day.columns])


def capital_prices(stock: DataFrame, cap: DataFrame | None = None, market: str = "SH") -> DataFrame:
    """Capitalisation-weighted same-day price measures, complete coverage only."""
    m = active_rows(stock).where(F.col("market") == market)
    m = m if cap is None else m.join(cap, ["code", "trade_date"], "left")
    c = F.when(F.col("total_mv") > 0, F.col("total_mv"))
    up = (F.col("ret") > 0).cast("double")
    day = m.groupBy(*DAY).agg(
        F.count("*").alias("active_rows"), F.avg(c.isNotNull().cast("double")).alias("basic_stock_coverage"),
        wavg(up, c).alias("cap_up_fraction"), wavg(F.col("ret"), c).alias("cap_return"), (wavg(up, c) - F.avg(up)).alias("cap_vs_equal_up"))
    return coverage_gate(day, CAP_PRICE_MEASURES, ["basic_stock_coverage"], 1.0)


FUTURES_MEASURES = ("basis", "basis_change", "weighted_basis", "curve_per_month", "open_interest", "volume", "turnover", "excess_return")


def futures_curve(contracts: DataFrame, spot: DataFrame) -> DataFrame:
    """Basis, curve and activity per product and session from dated contracts.

    The main contract is the one with the largest volume, ties to the smaller
    code; a roll compares each contract with its own previous close.
    """
    parsed = contracts.select(
        "*", F.regexp_extract("ts_code", r"^(IF|IC)(\d{2})(\d{2})\.CFX$", 1).alias("product"),
        ((F.regexp_extract("ts_code", r"^(IF|IC)(\d{2})(\d{2})\.CFX$", 2).cast("int")) * 12
         + F.regexp_extract("ts_code", r"^(IF|IC)(\d{2})(\d{2})\.CFX$", 3).cast("int")).alias("month"))
    s = spot.select("trade_date", F.col("close").alias("spot"), F.col("pre_close").alias("spot_prev"))
    # smaller code wins a tie, so the ordering key carries the negated month number of the code
    best = F.max_by(F.struct("ts_code", "close", "pre_close"), F.struct(F.col("vol"), -F.col("month")))
    two = F.slice(F.array_sort(F.collect_list(F.struct("month", "close"))), 1, 2)
    day = parsed.groupBy("product", "trade_date").agg(
        best.alias("m"), two.alias("c"), F.count("*").alias("contract_rows"), F.sum("oi").alias("open_interest"), F.sum("vol").alias("volume"),
        F.sum(F.col("close") * F.col("oi")).alias("_wc"))
    day = day.join(s, DAY)
    sp, pv = F.col("spot"), F.col("spot_prev")
    second, first = F.try_element_at("c", F.lit(2)), F.try_element_at("c", F.lit(1))
    return day.select(
        "product", "trade_date", "contract_rows", F.col("m.ts_code").alias("main_contract"),
        (F.col("m.close") / sp - 1).alias("basis"),
        (F.col("m.close") / sp - F.col("m.pre_close") / pv).alias("basis_change"),
        (F.col("_wc") / F.col("open_interest") / sp - 1).alias("weighted_basis"),
        ((second["close"] - first["close"]) / sp / (second["month"] - first["month"])).alias("curve_per_month"),
        "open_interest", "volume", (F.col("volume") / F.col("open_interest")).alias("turnover"),
        (F.col("m.close") / F.col("m.pre_close") - sp / pv).alias("excess_return"))


def option_activity(daily: DataFrame) -> DataFrame:
    """Put and call totals per session."""
    aggs = []
    for side in ("P", "C"):
        here = F.col("call_put") == side
        aggs += [F.count(F.when(here, 1)).alias(f"{side}_contract_rows"), F.sum(F.when(here, F.col("vol"))).alias(f"{side}_volume"),
                 F.sum(F.when(here, F.col("amount"))).alias(f"{side}_amount"), F.sum(F.when(here, F.col("oi"))).alias(f"{side}_interest")]
    return daily.groupBy(*DAY).agg(F.count("*").alias("contract_rows"), *aggs)


POSITION_MEASURES = ("near_put_interest_share", "far_put_interest_share", "near_interest_share", "put_interest_term_spread",
                     "matched_put_interest_growth", "matched_call_interest_growth", "matched_interest_imbalance")


def option_positions(daily: DataFrame, near_days: int = 30) -> DataFrame:
    """Put share of open interest near and far from expiry."""
    near = F.datediff("delist_date", "trade_date") <= near_days
    put, oi = F.col("call_put") == "P", F.col("oi")
    day = daily.groupBy(*DAY).agg(
        share(sum_if(near & put, oi), sum_if(near, oi)).alias("near_put_interest_share"),
        share(sum_if(~near & put, oi), sum_if(~near, oi)).alias("far_put_interest_share"),
        share(sum_if(near, oi), F.sum(oi)).alias("_near"), F.count(F.when(near, 1)).alias("_rows"),
        sum_if(near, oi).alias("_near_oi"))
    return day.withColumn("near_interest_share", F.when(F.col("_near_oi") > 0, F.col("_near"))).withColumn(
        "put_interest_term_spread", F.col("near_put_interest_share") - F.col("far_put_interest_share")).drop("_near", "_rows", "_near_oi")


def matched_interest(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Open-interest change of contracts seen in this and the previous session of the panel."""
    now = daily.join(calendar, "trade_date")
    prev = now.select("ts_code", (F.col("session_no") + 1).alias("session_no"), F.col("oi").alias("prev_oi"))
    total = now.groupBy((F.col("session_no") + 1).alias("session_no")).agg(F.sum("oi").alias("_prev_total"))
    m = now.join(prev, ["ts_code", "session_no"])
    put = F.col("call_put") == "P"
    d = F.col("oi") - F.col("prev_oi")
    day = m.groupBy("session_no").agg(
        F.count("*").alias("matched_contract_rows"), F.sum("prev_oi").alias("_prior"),
        sum_if(put, d).alias("_dp"), sum_if(~put, d).alias("_dc"),
        sum_if(put, F.col("prev_oi")).alias("_pp"), sum_if(~put, F.col("prev_oi")).alias("_pc"))
    out = calendar.join(total, "session_no").join(day, "session_no", "left")
    return out.select(
        "trade_date", F.coalesce("matched_contract_rows", F.lit(0)).alias("matched_contract_rows"),
        share(F.coalesce(F.col("_prior"), F.lit(0.0)), F.col("_prev_total")).alias("matched_prior_interest_coverage"),
        F.when(F.col("_pp") > 0, share(F.col("_dp"), F.col("_pp"))).alias("matched_put_interest_growth"),
        F.when(F.col("_pc") > 0, share(F.col("_dc"), F.col("_pc"))).alias("matched_call_interest_growth"),
        F.when(F.col("_prior") > 0, share(F.col("_dp") - F.col("_dc"), F.col("_prior"))).alias("matched_interest_imbalance"))


def consecutive_momentum(stock: DataFrame, calendar: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Compounded return over w sessions of an unbroken run; a missed session starts a new run."""
    act = active_rows(stock).join(calendar, "trade_date").where(F.col("ret") > -1).withColumn("_ln", natural_log(1 + F.col("ret")))
    w = ordered(["code"], "session_no")
    runs = act.withColumn("run", F.col("session_no") - F.row_number().over(w))
    rw = ordered(["code", "run"], "session_no")
    runs = runs.withColumn("run_rows", F.row_number().over(rw))
    for n in windows:
        total = F.sum("_ln").over(rw.rowsBetween(-(n - 1), 0))
        runs = runs.withColumn(f"mom_{n}", F.when(F.col("run_rows") >= n, exponential(total) - 1))
    return runs.drop("_ln")


def trend_breadth(stock: DataFrame, calendar: DataFrame, windows: Sequence[int] = (5, 20, 60), change: int = 5) -> DataFrame:
    """Share of stocks trending up over several horizons with coverage of each."""
    short, mid, _ = windows
    runs = consecutive_momentum(stock, calendar, windows)
    amt = F.col("amount")
    aggs = [F.count("*").alias("active_rows")]
    for n in windows:
        m = F.col(f"mom_{n}")
        aggs += [
            F.count(m).alias(f"eligible_{n}_rows"), F.avg(m.isNotNull().cast("double")).alias(f"stock_coverage_{n}"),
            share(sum_if(m.isNotNull(), amt), F.sum(amt)).alias(f"amount_coverage_{n}"),
            F.avg((m > 0).cast("double")).alias(f"trend_up_{n}_fraction")]
    s, m = F.col(f"mom_{short}"), F.col(f"mom_{mid}")
    known = m.isNotNull()
    aggs += [
        share(sum_if(m < 0, amt), F.sum(F.when(known, amt))).alias(f"trend_negative_{mid}_amount_fraction"),
        F.avg(F.when(known, F.coalesce((s < 0) & (m > 0), F.lit(False)).cast("double"))).alias("trend_weakening_fraction"),
        (F.avg(F.when(F.col("market") == "SH", (m > 0).cast("double"))) - F.avg((m > 0).cast("double"))).alias(f"trend_shanghai_relative_{mid}")]
    median = [(f"trend_return_{mid}_median", m, 0.5)]
    day = aggregate_with_quantiles(runs, ["trade_date", "session_no"], aggs, median)
    old = day.select((F.col("session_no") + change).alias("session_no"), F.col(f"trend_up_{mid}_fraction").alias("_old"))
    day = day.join(old, "session_no", "left").withColumn(f"trend_up_{mid}_change_{change}", F.col(f"trend_up_{mid}_fraction") - F.col("_old")).drop("_old")
    cov = F.least(*[F.col(f"{k}_coverage_{n}") for n in windows for k in ("stock", "amount")])
    feats = [c for c in day.columns if c.startswith("trend_") and c != "trade_date"]
    ok = cov >= TREND_COVERAGE
    for c in feats:
        ok = ok & F.col(c).isNotNull()
    return day.withColumn("trend_available", ok)


INTRADAY_MEASURES = ("last_bar_return", "afternoon_return", "late_minus_early_return", "realized_vol", "downside_variance_share",
                     "last_bar_amount_share", "afternoon_amount_share", "close_vs_mean")


def intraday_path(bars: DataFrame, keys: Sequence[str] = ("series_id",), slots: int = 8) -> DataFrame:
    """Path measures of a session from its `slots` interval-end bars; incomplete sessions are dropped.

    Bars carry `slot` 1..slots.  A session has a fixed number of bars, so the
    window over one session is bounded.
    """
    k = [*keys, "trade_date"]
    w = ordered(k, "slot")
    start = F.coalesce(F.lag("close").over(w), F.col("open"))
    grown = quotient(F.col("close"), start)
    b = bars.withColumn("move", F.when(grown == 0, F.lit(float("-inf"))).otherwise(F.ln(grown)))
    half, last = slots // 2, slots
    at = lambda n, c="close": F.max(F.when(F.col("slot") == n, F.col(c)))
    sq = F.col("move") * F.col("move")
    total = F.sum(sq)
    day = b.groupBy(*k).agg(
        F.count("*").alias("bar_rows"),
        (quotient(at(last), at(last - 1)) - 1).alias("last_bar_return"), (quotient(at(last), at(half)) - 1).alias("afternoon_return"),
        ((quotient(at(last), at(last - 1)) - 1) - (quotient(at(1), at(1, "open")) - 1)).alias("late_minus_early_return"),
        F.sqrt(total).alias("realized_vol"),
        F.when(total > 0, share(sum_if(F.col("move") < 0, sq), total)).otherwise(0.0).alias("downside_variance_share"),
        share(sum_if(F.col("slot") == last, F.col("amount")), F.sum("amount")).alias("last_bar_amount_share"),
        share(sum_if(F.col("slot") > half, F.col("amount")), F.sum("amount")).alias("afternoon_amount_share"),
        (quotient(at(last), F.avg("close")) - 1).alias("close_vs_mean"))
    return day.where(F.col("bar_rows") == slots)


def effective_sample(weight: Column) -> tuple[Column, Column]:
    """Effective number of rows of a weighted sample and its largest single share."""
    return F.try_divide(F.sum(weight) * F.sum(weight), F.sum(weight * weight)), F.try_divide(F.max(weight), F.sum(weight))


