"""Hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate as K
from tidemark.operators import panel as P
from tidemark.operators import quality as V
from tidemark.operators import rules as R
from tidemark.operators.calendar import calendar_of
from tidemark.plans import features as X
from tidemark.sources.derive import AMOUNTS

DAY = dt.date(2024, 1, 2)


def days(n, start=DAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_weighted_median_shrink(spark):
    rows = [("s", i, d, x, 1, 100 * (1 + x), y, 0.5, None) for i, (d, x, y) in enumerate(zip(days(4), [.01, .01, .08, .04], [.001, .002, .04, None]))]
    df = spark.createDataFrame(rows, "series_id string, pos int, trade_date date, predicted_pct_change double, predicted_label int, predicted_close double, real_pct_change double, confidence double, correct boolean")
    last = K.shrink_returns(df, ["series_id"], window=3, minimum=3).where("pos = 3").first()
    assert last.return_calibration_scale == pytest.approx(.5)
    assert last.predicted_pct_change == pytest.approx(.02)
    assert last.predicted_close == pytest.approx(102)
    assert last.predicted_label == 1


def test_reliability_bins_and_error(spark):
    rows = [("a", .6, c) for c in (True, True, True, False)] + [("a", 2 / 3, c) for c in (True, False)]
    df = spark.createDataFrame(rows, "k string, confidence double, correct boolean")
    bins = K.reliability_bins(df, ["k"], (0.0, .6, .65, 1.0))
    assert {r["rows"]: r.direction_accuracy for r in bins.collect()} == {4: .75, 2: .5}
    e = K.calibration_error(bins, ["k"]).first()
    assert e.expected_calibration_error == pytest.approx((4 / 6) * .15 + (2 / 6) * (2 / 3 - .5))


def flow_frames(spark, codes, flow_codes):
    stock = spark.createDataFrame([(c, DAY, 1.0 if i % 2 == 0 else -1.0, 10.0, 100.0, "SH" if i % 2 == 0 else "SZ") for i, c in enumerate(codes)],
                                  "code long, trade_date date, pct_chg double, vol double, amount double, market string")
    amounts = {1: (10, 0, 30, 0, 20, 0, 10, 0), 2: (20, 0, 10, 0, 10, 0, 30, 0)}
    flow = spark.createDataFrame([(c, DAY, *map(float, amounts[c])) for c in flow_codes], "code long, trade_date date, " + ", ".join(f"{a} double" for a in AMOUNTS))
    return stock, flow


def test_flow_ratios(spark):
    r = P.order_flow(*flow_frames(spark, [1, 2], [1, 2])).first()
    assert r.large_net_ratio == pytest.approx(0)
    assert r.large_selling_fraction == pytest.approx(.5)
    assert r.shanghai_relative == pytest.approx(20 / 70)


def test_partial_flow_is_unknown(spark):
    r = P.order_flow(*flow_frames(spark, [1, 2], [1])).first()
    assert r.stock_coverage == pytest.approx(.5)
    assert all(r[m] is None for m in P.FLOW_MEASURES)


def test_intraday_path(spark):
    closes = [103, 106, 101, 106, 104, 102, 101, 100]
    rows = [("x", DAY, i + 1, 100.0, float(c), 10.0 if i < 7 else 30.0) for i, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "series_id string, trade_date date, slot int, open double, close double, amount double")
    r = P.intraday_path(bars).first()
    assert r.last_bar_return == pytest.approx(100 / 101 - 1)
    assert r.afternoon_return == pytest.approx(100 / 106 - 1)
    assert r.last_bar_amount_share == pytest.approx(.3)
    assert P.intraday_path(bars.where("slot < 8")).count() == 0


def test_futures_roll_uses_each_contracts_own_close(spark):
    rows = []
    for i, d in enumerate(days(3)):
        for m, basis in ((3, .03), (4, .04)):
            vol = 100.0 if (m == 3) == (i < 2) else 10.0
            rows.append((f"IF24{m:02d}.CFX", d, 100 * (1 + basis), 100 * (1 + basis), vol, 50.0))
    f = spark.createDataFrame(rows, "ts_code string, trade_date date, close double, pre_close double, vol double, oi double")
    spot = spark.createDataFrame([(d, 100.0, 100.0) for d in days(3)], "trade_date date, close double, pre_close double")
    out = {r.trade_date: r for r in P.futures_curve(f, spot).collect()}
    assert [round(out[d].basis, 6) for d in days(3)] == [.03, .03, .04]
    assert all(abs(r.basis_change) < 1e-12 for r in out.values())


def rule_panel(spark, paths, labels):
    rows = [("s", DAY + dt.timedelta(days=p), p, labels[p] if p < len(labels) - 1 else None, r, path[p]) for r, path in enumerate(paths) for p in range(len(path))]
    return spark.createDataFrame(rows, "series_id string, trade_date date, pos int, label int, rule_id int, pred int")


def vote(spark, monkeypatch, paths):
    monkeypatch.setattr(R, "CALIBRATION", 10)
    monkeypatch.setattr(R, "MINIMUM", 10)
    p = rule_panel(spark, paths, [1] * 11)
    top = R.top_rules(R.scored(p, window=10, minimum=10), k=3)
    merged = R.merged_experts(R.oriented_experts(top, p, window=10))
    return R.weighted_vote(merged, R.label_paths(p), window=10).where("pos = 10").first()


STRONG, WEAK, WEAK2 = [1] * 9 + [0, 1], [1] * 6 + [0] * 5, [1] * 5 + [0, 1] + [0] * 4


def test_strong_rule_outweighs_two_weak_ones(spark, monkeypatch):
    r = vote(spark, monkeypatch, [STRONG, WEAK, WEAK2])
    assert r.predicted_label == 1 and r.experts == 3
    assert r.calibration_accuracy == pytest.approx(.9)


def test_complement_merges_with_its_rule(spark, monkeypatch):
    r = vote(spark, monkeypatch, [STRONG, [1 - v for v in STRONG], WEAK])
    assert (r.ranked_rules, r.experts) == (3, 2)


def test_put_share_is_lagged_one_session(spark):
    daily = spark.createDataFrame([(d, 100.0 + i, 300.0 - i, 1.0, 1.0, 1.0, 1.0) for i, d in enumerate(days(30))],
                                  "trade_date date, P_volume double, C_volume double, P_amount double, C_amount double, P_interest double, C_interest double")
    out = X.option_features(daily.select("trade_date"), daily, calendar_of(daily)).where(F.col("trade_date") == days(30)[20]).first()
    assert out.option_put_volume_share == pytest.approx(119 / 400)
    assert out.option_put_volume_change_1 == pytest.approx(1 / 400)
    assert out.option_source_date == days(30)[19] and out.option_available


def test_missing_session_is_not_filled(spark):
    daily = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days(10)) if i != 5], "trade_date date, v double")
    cal = calendar_of(spark.createDataFrame([(d,) for d in days(10)], "trade_date date"))
    from tidemark.operators.calendar import densify, lag_align

    feats = densify(daily, cal).select("session_no", F.col("v").alias("x_v"))
    got = {r.trade_date: r for r in lag_align(cal.select("trade_date"), feats, cal, 1, "x", ["x_v"]).collect()}
    assert got[days(10)[6]].x_v is None and not got[days(10)[6]].x_available
    assert got[days(10)[7]].x_v == 6.0 and got[days(10)[7]].x_source_date == days(10)[6]


def test_publication_policy_and_strict_gate(spark):
    with pytest.raises(ValueError):
        X.check_policy("option", 0, 18, 0)
    X.check_policy("option", 0, 18, 30)
    X.check_policy("option", 1, 9)
    bad = V.duplicate_keys(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    with pytest.raises(V.QualityError):
        V.require_none(bad, "unique key")


def test_unknown_target_has_no_origin(spark):
    from tidemark.operators import ledger as G

    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 11), DAY, None)], "at timestamp, signal date, target date")
    r = df.select(G.origin(F.col("at"), F.col("target")).alias("o"), G.admitted(F.col("at"), F.col("signal"), F.col("target")).alias("a")).first()
    assert (r.o, r.a) == ("unknown", False)
