"""Feature sets: windows over one row per session, aligned to signals by policy.

Tables here hold one row per session (and asset), so their windows are bounded by
the calendar even where there is a single series.

Every set returns the signal rows with <prefix>_source_date, <prefix>_available
and its features.  Rows are never dropped and nothing is filled: a feature that
needs an unobserved session is null and the row is marked unavailable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import deviation, diff, drawdown, full, growth, ordered, prior_scaled, trailing, zscore
from tidemark.functions.scalars import all_known
from tidemark.operators import panel as P
from tidemark.operators import series as Q
from tidemark.operators.asof import asof_join
from tidemark.operators.calendar import densify, lag_align

# Earliest publication hour (and minute) at which a same-session source may be used.
PUBLICATION = {
    "breadth": (17, 0), "distribution": (17, 0), "capital_close": (18, 0), "futures": (18, 0),
    "intraday": (18, 0), "option": (18, 30), "option_position": (18, 30), "trend": (18, 0), "foreign_close": (17, 0),
}

FEATURE_SETS: dict[str, Callable[..., DataFrame]] = {}


def register_feature_set(name: str, fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Make a feature set available by name; fn(inputs..., calendar, policy) -> DataFrame."""
    FEATURE_SETS[name] = fn
    return fn


def check_policy(source: str, lag: int, hour: int, minute: int = 0) -> None:
    """Reject a same-session use before the source is published."""
    if lag == 0 and (hour, minute) < PUBLICATION[source]:
        raise ValueError(f"{source} cannot be used in the same session before {PUBLICATION[source]}")


def daily_frame(df: DataFrame, calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The per-session table on the whole calendar."""
    return densify(df, calendar, keys)


def _w(keys: Sequence[str] = ()):
    return ordered(list(keys), "session_no")


def _finish(day: DataFrame, cols: dict[str, Column], prefix: str, signals: DataFrame, calendar: DataFrame, lag: int,
            keys: Sequence[str] = ()) -> DataFrame:
    named = {f"{prefix}_{n}": c for n, c in cols.items()}
    feats = day.select(*keys, "session_no", *[c.alias(n) for n, c in named.items()])
    return lag_align(signals, feats, calendar, lag, prefix, list(named), keys)


def breadth_features(signals: DataFrame, breadth: DataFrame, calendar: DataFrame, lag: int = 1, hour: int = 18) -> DataFrame:
    check_policy("breadth", lag, hour)
    d, w = daily_frame(breadth, calendar), _w()
    cols: dict[str, Column] = {}
    for g in ("all", "shanghai"):
        up = F.col(f"{g}_up_fraction")
        for m in ("up_fraction", "down_fraction", "median_return", "mean_return", "down_amount_fraction", "large_down_fraction"):
            cols[f"{g}_{m}"] = F.col(f"{g}_{m}")
        cols[f"{g}_up_change_1"] = diff(up, w)
        cols[f"{g}_up_mean_5"] = full(up, 5, F.avg, w)
        cols[f"{g}_up_mean_20"] = full(up, 20, F.avg, w)
    cols["shanghai_relative"] = F.col("shanghai_up_fraction") - F.col("all_up_fraction")
    return _finish(d, cols, "breadth", signals, calendar, lag)


def distribution_features(signals: DataFrame, daily: DataFrame, calendar: DataFrame, hour: int = 18) -> DataFrame:
    check_policy("distribution", 0, hour)
    d, w = daily_frame(daily, calendar), _w()
    names = ("q10", "q90", "iqr", "amount_return_gap", "amount_top_decile", "advance_to_decline", "decline_persistence", "decline_to_advance")
    cols = {n: F.col(n) for n in names}
    cols["q10_change_1"] = diff(F.col("q10"), w)
    cols["advance_to_decline_mean_5"] = full(F.col("advance_to_decline"), 5, F.avg, w)
    return _finish(d, cols, "distribution", signals, calendar, 0)


def moneyflow_features(signals: DataFrame, daily: DataFrame, calendar: DataFrame, price_context: bool = False, normalize: bool = False) -> DataFrame:
    d, w = daily_frame(daily, calendar), _w()
    names = [*P.FLOW_MEASURES, *(P.PRICE_FLOW_MEASURES if price_context else ())]
    net = F.col("large_net_ratio")
    cols = {n: F.col(n) for n in names}
    cols |= {"large_net_change_1": diff(net, w), "large_net_mean_5": full(net, 5, F.avg, w), "large_net_mean_20": full(net, 20, F.avg, w)}
    if price_context:
        cols |= {"up_sell_mean_5": full(F.col("up_sell_amount_fraction"), 5, F.avg, w), "down_buy_mean_5": full(F.col("down_buy_amount_fraction"), 5, F.avg, w)}
    if normalize:
        d = d.select("session_no", *[c.alias(n) for n, c in cols.items()])
        cols = {n: prior_scaled(F.col(n), 126, w) for n in cols}
    return _finish(d, cols, "moneyflow", signals, calendar, 1)


def _capital_columns(w) -> dict[str, Column]:
    cols = {n: F.col(n) for n in P.CAP_MEASURES}
    cols["cap_net_mean_5"] = full(F.col("cap_net_ratio"), 5, F.avg, w)
    cols["cap_return_mean_5"] = full(F.col("cap_return"), 5, F.avg, w)
    cols["cap_up_change_1"] = diff(F.col("cap_up_fraction"), w)
    return cols


def capital_features(signals: DataFrame, daily: DataFrame, calendar: DataFrame) -> DataFrame:
    return _finish(daily_frame(daily, calendar), _capital_columns(_w()), "capital", signals, calendar, 1)


PRICE_COLUMNS = ("capital_cap_up_fraction", "capital_cap_return", "capital_cap_vs_equal_up", "capital_cap_return_mean_5", "capital_cap_up_change_1")


def capital_close_features(signals: DataFrame, flow_daily: DataFrame, price_daily: DataFrame, calendar: DataFrame, hour: int = 18) -> DataFrame:
    """Price columns of the same session, flow columns of the session before."""
    check_policy("capital_close", 0, hour)
    lagged = capital_features(signals, flow_daily, calendar)
    w = _w()
    cols = {n: F.col(n) for n in P.CAP_PRICE_MEASURES}
    cols |= {"cap_return_mean_5": full(F.col("cap_return"), 5, F.avg, w), "cap_up_change_1": diff(F.col("cap_up_fraction"), w)}
    now = _finish(daily_frame(price_daily, calendar), cols, "price", signals, calendar, 0)
    now = now.select("trade_date", F.col("price_source_date").alias("capital_price_source_date"), F.col("price_available").alias("_p"),
                     *[F.col(f"price_{n}").alias(f"capital_{n}") for n in cols])
    out = lagged.drop(*PRICE_COLUMNS).join(now, "trade_date")
    # a row also needs the lagged price measures to have been known
    return out.withColumn("capital_available", F.col("capital_available") & F.col("_p")).drop("_p")


def share_change_features(signals: DataFrame, shares: DataFrame, calendar: DataFrame, asset: str = "asset", lag: int = 2) -> DataFrame:
    """Fund share changes per asset, published two sessions late."""
    d, w = densify(shares, calendar, [asset]), _w([asset])
    s = F.col("fd_share")
    d = d.withColumn("_c", growth(s, w))
    whole = F.count(s).over(trailing(w, 6)) == 6
    cols = {"share_change_1": F.col("_c"), "share_change_5": F.when(whole, growth(s, w, 5)), "share_change_mean_20": full(F.col("_c"), 20, F.avg, w)}
    return _finish(d, cols, "etf", signals, calendar, lag, [asset])


def funding_features(signals: DataFrame, basic: DataFrame, margin: DataFrame, calendar: DataFrame) -> DataFrame:
    """Valuation, turnover and margin financing on the union calendar, one session late."""
    d = daily_frame(basic, calendar).join(margin, "trade_date", "left")
    w = _w()
    cols: dict[str, Column] = {}
    for c in ("turnover_rate", "turnover_rate_f"):
        x = F.col(c)
        cols |= {c: x, f"{c}_change": growth(x, w), f"{c}_relative_20": deviation(x, 20, w)}
    for c in ("pe_ttm", "pb"):
        cols |= {c: F.col(c), f"{c}_z252": zscore(F.col(c), 252, 60, w)}
    bal, buy, rep = F.col("rzye"), F.col("rzmre"), F.col("rzche")
    cols |= {
        "finance_change_1": growth(bal, w), "finance_change_5": growth(bal, w, 5), "finance_net_ratio": F.try_divide(buy - rep, F.lag(bal).over(w)),
        "finance_buy_ratio": F.try_divide(buy, buy + rep), "finance_market_ratio": F.try_divide(bal, F.col("float_mv")),
        "lending_share": F.try_divide(F.col("rqye"), F.col("rzrqye"))}
    return _finish(d, cols, "funding", signals, calendar, 1)


FUTURES_FEATURES = ("basis", "basis_change", "weighted_basis", "curve_per_month", "turnover", "excess_return")


def futures_features(signals: DataFrame, daily: DataFrame, calendar: DataFrame, lag: int = 1, hour: int = 18) -> DataFrame:
    check_policy("futures", lag, hour)
    d, w = densify(daily, calendar, ["product"]), _w(["product"])
    cols = {n: F.col(n) for n in FUTURES_FEATURES}
    cols |= {"volume_ratio_20": F.try_divide(F.col("volume"), full(F.col("volume"), 20, F.avg, w)), "interest_change_1": growth(F.col("open_interest"), w)}
    return _finish(d, cols, "futures", signals, calendar, lag, ["product"])


def fx_features(signals: DataFrame, quotes: DataFrame, keys: Sequence[str] = ("asset",), max_age: int = 7) -> DataFrame:
    """Quote-bar features of completed days before the signal, at most a week old, per key of both sides."""
    k = list(keys)
    w = ordered(k, "trade_date")
    q = quotes.withColumn("mid", (F.col("close") + F.col("ask")) / 2).withColumn("_r", growth(F.col("mid"), w))
    m = F.col("mid")
    cols = {
        "return_1": F.col("_r"), "return_5": growth(m, w, 5), "return_20": growth(m, w, 20), "volatility_20": full(F.col("_r"), 20, F.stddev_samp, w),
        "bid_range": F.try_divide(F.col("high") - F.col("low"), F.lag("close").over(w)), "close_spread": (F.col("ask") - F.col("close")) / m}
    feats = q.select(*k, F.col("trade_date").alias("_q"), *[c.alias(f"fx_{n}") for n, c in cols.items()])
    out = asof_join(signals, feats, k, "trade_date", "_q", [f"fx_{n}" for n in cols], True, "fx_source_date", max_age, span_days=120)
    return out.withColumn("fx_source_age_days", F.datediff("trade_date", "fx_source_date")).withColumn(
        "fx_available", all_known(*[F.col(f"fx_{n}") for n in cols]))


RISK = ("return_1", "return_5", "volatility_20", "drawdown_20")


def global_risk_features(signals: DataFrame, closes: DataFrame, assets: Sequence[str], asset: str = "asset", max_age: int = 7) -> DataFrame:
    """Risk of two overseas closes before the signal and their relative return."""
    w = ordered([asset], "trade_date")
    c = F.col("close")
    r = closes.withColumn("_r", growth(c, w))
    feats = r.select(asset, F.col("trade_date").alias("_q"), F.col("_r").alias("return_1"), growth(c, w, 5).alias("return_5"),
                     full(F.col("_r"), 20, F.stddev_samp, w).alias("volatility_20"), drawdown(c, 20, w).alias("drawdown_20"))
    left = signals.withColumn(asset, F.explode(F.array(*[F.lit(a) for a in assets])))
    got = asof_join(left, feats, [asset], "trade_date", "_q", RISK, True, "source_date", max_age, span_days=120)
    keys = signals.columns
    wide = got.groupBy(*keys).agg(*[F.max(F.when(F.col(asset) == a, F.col(n))).alias(f"{a}_{n}") for a in assets for n in ("source_date", *RISK)])
    a, b = assets
    wide = wide.withColumn("relative_return_1", F.col(f"{b}_return_1") - F.col(f"{a}_return_1"))
    return wide.withColumn("global_available", all_known(*[F.col(f"{x}_{n}") for x in assets for n in RISK]))


def foreign_close_features(signals: DataFrame, bars: DataFrame, policy: str, hour: int = 18, prefix: str = "foreign_", keys: Sequence[str] = ("asset",)) -> DataFrame:
    """A foreign market's price block under three timing policies.

    previous_available: everything strictly earlier, renamed _lag1.  current_prices:
    prices may be of the same day, volume change stays strictly earlier.
    augment_current_prices: current prices beside the caller's existing columns.
    """
    if policy != "previous_available":
        check_policy("foreign_close", 0, hour)
    k = list(keys)
    block = Q.price_features(bars, k, prefix).withColumnRenamed("trade_date", "_q")
    prices = [c for c in block.columns if c.startswith(prefix) and not c.endswith("vol_chg")]
    vol = f"{prefix}vol_chg"
    strict = policy == "previous_available"
    out = asof_join(signals, block, k, "trade_date", "_q", prices, strict, "price_source_date", span_days=120)
    if policy != "augment_current_prices":
        out = asof_join(out, block, k, "trade_date", "_q", [vol], True, "volume_source_date", span_days=120)
        out = out.withColumnRenamed(vol, f"{vol}_lag1")
    if strict:
        for c in prices:
            out = out.withColumnRenamed(c, f"{c}_lag1")
    return out


def intraday_features(signals: DataFrame, paths: DataFrame, keys: Sequence[str] = ("series_id",), hour: int = 18) -> DataFrame:
    check_policy("intraday", 0, hour)
    feats = paths.select(*keys, "trade_date", F.col("trade_date").alias("intraday_source_date"), *[F.col(m).alias(f"intraday_{m}") for m in P.INTRADAY_MEASURES])
    out = signals.join(feats, [*keys, "trade_date"], "left")
    return out.withColumn("intraday_available", all_known(*[F.col(f"intraday_{m}") for m in P.INTRADAY_MEASURES]))


def liquidity_features(signals: DataFrame, bank: DataFrame, overnight: DataFrame, week: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bank and exchange funding spreads, changes and volume ratios, one session late.

    bank: on, w1, m3; overnight and week: close, high, low, amount (rates in percent).
    """
    o = overnight.select("trade_date", *[F.col(c).alias(f"o_{c}") for c in ("close", "high", "low", "amount")])
    k = week.select("trade_date", *[F.col(c).alias(f"k_{c}") for c in ("close", "amount")])
    d = daily_frame(bank, calendar).join(o, "trade_date", "left").join(k, "trade_date", "left")
    w = _w()
    bank_on, over, wk = F.col("on") / 100, F.col("o_close") / 100, F.col("k_close") / 100
    cols = {
        "overnight": bank_on, "overnight_change_1": diff(bank_on, w), "overnight_change_5": diff(bank_on, w, 5),
        "overnight_vs_mean_20": bank_on - full(bank_on, 20, F.avg, w), "bank_week_spread": F.col("w1") / 100 - bank_on,
        "bank_quarter_spread": F.col("m3") / 100 - bank_on, "exchange_bank_overnight_spread": over - bank_on,
        "exchange_bank_week_spread": wk - F.col("w1") / 100, "exchange_week_spread": wk - over,
        "exchange_overnight_range": (F.col("o_high") - F.col("o_low")) / 100, "exchange_overnight_change_1": diff(over, w),
        "exchange_volume_ratio_20": F.try_divide(F.col("o_amount"), full(F.col("o_amount"), 20, F.avg, w)),
        "exchange_short_volume_share": F.try_divide(F.col("o_amount"), F.col("o_amount") + F.col("k_amount"))}
    return _finish(d, cols, "liquidity", signals, calendar, 1)


def option_features(signals: DataFrame, daily: DataFrame, calendar: DataFrame, lag: int = 1, hour: int = 18, minute: int = 0) -> DataFrame:
    check_policy("option", lag, hour, minute)
    d, w = daily_frame(daily, calendar), _w()
    cols: dict[str, Column] = {}
    for m in ("volume", "amount", "interest"):
        put, call = F.col(f"P_{m}"), F.col(f"C_{m}")
        s = F.try_divide(put, put + call)
        cols |= {f"put_{m}_share": s, f"put_{m}_change_1": diff(s, w), f"put_{m}_mean_20": full(s, 20, F.avg, w)}
    return _finish(d, cols, "option", signals, calendar, lag)


def option_position_features(signals: DataFrame, daily: DataFrame, calendar: DataFrame, lag: int = 1, hour: int = 18, minute: int = 0) -> DataFrame:
    check_policy("option_position", lag, hour, minute)
    d, w = daily_frame(daily, calendar), _w()
    cols = {n: F.col(n) for n in P.POSITION_MEASURES}
    cols["matched_imbalance_mean_5"] = full(F.col("matched_interest_imbalance"), 5, F.avg, w)
    return _finish(d, cols, "option_position", signals, calendar, lag)


def trend_features(signals: DataFrame, daily: DataFrame, calendar: DataFrame, hour: int = 18) -> DataFrame:
    """Same-session trend breadth; its own coverage decides the availability."""
    check_policy("trend", 0, hour)
    cols = [c for c in daily.columns if c.startswith("trend_") and c not in ("trend_available",)]
    feats = daily.select("trade_date", F.col("trade_date").alias("trend_source_date"), *cols, "trend_available")
    return signals.join(feats, "trade_date", "left").fillna(False, ["trend_available"])


def index_context_features(target: DataFrame, others: DataFrame, assets: Sequence[str], asset: str = "series_id") -> DataFrame:
    """Price block of several indices beside each target series with their relative returns."""
    own = Q.core_features(target, [asset]).select(asset, "trade_date", "return_1", "momentum_5")
    block = Q.price_features(others.where(F.col(asset).isin(*assets)), [asset])
    names = [c for c in block.columns if c not in (asset, "trade_date")]
    wide = block.groupBy("trade_date").agg(*[F.max(F.when(F.col(asset) == a, F.col(n))).alias(f"{i}_{n}") for i, a in enumerate(assets, 1) for n in names])
    out = own.join(wide, "trade_date", "left")
    for i in range(1, len(assets) + 1):
        out = out.withColumn(f"{i}_relative_return_1", F.col(f"{i}_ret1") - F.col("return_1")).withColumn(
            f"{i}_relative_return_5", F.col(f"{i}_ret5") - F.col("momentum_5"))
    return out


BREADTH_COLUMNS = ("breadth_all_up_fraction", "breadth_all_down_amount_fraction", "breadth_all_large_down_fraction",
                   "breadth_all_up_change_1", "breadth_all_up_mean_5", "breadth_shanghai_relative")
CORE_COLUMNS = ("return_1", "momentum_5", "momentum_20", "volatility_20", "intraday_return", "close_position")


def specialist_features(stream: DataFrame, prices: DataFrame, breadth: DataFrame, overseas: DataFrame, overseas_columns: Sequence[str],
                        keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Confidences, price, breadth and overseas features of the same dates; all must be known."""
    names = ["confidence", "calibrated_confidence", *CORE_COLUMNS, *BREADTH_COLUMNS, *overseas_columns]
    out = stream.join(prices.select(*keys, "trade_date", *CORE_COLUMNS), [*keys, "trade_date"], "left")
    out = out.join(breadth.select("trade_date", *BREADTH_COLUMNS), "trade_date", "left")
    out = out.join(overseas.select("trade_date", *overseas_columns), "trade_date", "left")
    return out.withColumn("specialist_available", all_known(*[F.col(n) for n in names]))


def auxiliary_features(stream: DataFrame, auxiliary: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Log-odds of other models' probability that the incumbent is right.

    `auxiliary` is long: keys, trade_date, name, probability, training_rows,
    last_training_date.  A row is fitted only if every named model was, on data
    that precedes the signal.
    """
    from tidemark.functions.scalars import logit

    ok = (F.col("training_rows") > 0) & (F.col("last_training_date") < F.col("trade_date"))
    k = [*keys, "trade_date"]
    wide = auxiliary.groupBy(*k).agg(
        *[F.max(F.when(F.col("name") == n, logit(F.col("probability")))).alias(f"aux_{n}") for n in names],
        F.sum(F.when(F.col("name").isin(*names) & ok, 1).otherwise(0)).alias("_fit"))
    return stream.join(wide, k, "left").withColumn("aux_fitted", F.coalesce(F.col("_fit") == len(names), F.lit(False))).drop("_fit")


def direction_interactions(df: DataFrame, names: Sequence[str], label: str = "predicted_label") -> DataFrame:
    """Append every feature times the incumbent's signed direction."""
    sign = (2 * F.col(label) - 1).cast("double")
    return df.select("*", sign.alias("incumbent_direction"), *[(F.col(n) * sign).alias(f"{n}__direction") for n in names])


for _fn in (breadth_features, distribution_features, moneyflow_features, capital_features, capital_close_features, share_change_features, funding_features,
            futures_features, fx_features, global_risk_features, foreign_close_features, intraday_features, liquidity_features, option_features,
            option_position_features, trend_features, index_context_features, specialist_features, auxiliary_features):
    register_feature_set(_fn.__name__, _fn)
