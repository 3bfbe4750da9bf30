"""Solvers against independent computations, and independence of later rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate as K
from tidemark.operators import series as Q
from tidemark.operators import walkforward as L
from tidemark.operators.rules import scored, threshold_rules

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=(n, 2))
    real = .01 * (x[:, 0] + rng.normal(size=n))
    label = (rng.random(n) < .7).astype(int)
    rows = [("s", i, dt.date(2020, 1, 1) + dt.timedelta(days=i), int(label[i]), float(real[i]) if i < n - 1 else None, float(x[i, 0]), float(x[i, 1]), float(.5 + .3 * rng.random())) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, pos int, trade_date date, predicted_label int, real_pct_change double, a double, b double, confidence double")
    return df.withColumn("correct", F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")).withColumn("calibrated_confidence", F.col("confidence")).cache()


def test_logistic_reaches_the_stationary_point():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(300, 3)) * [1, 10, .1] + [0, 5, 1], rng.random(300) + .2
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    p = L.logistic(.1)(x, y, w)(x)
    z = (x - np.average(x, axis=0, weights=w)) / np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w))
    m = np.log(p / (1 - p))
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(300), z]), m, rcond=None)
    assert abs((w * (p - y)).sum()) < 1e-6
    assert np.allclose(.1 * z.T @ (w * (p - y)), -beta[1:], atol=1e-6)


def test_fits_use_the_declared_training_rows(stream):
    up = F.col("predicted_label") == 1
    out = {r.pos: r for r in L.downside_probabilities(stream, ["a", "b"], F.lit(True)).collect()}
    known = [r.pos for r in stream.where(up & F.col("real_pct_change").isNotNull()).select("pos").collect()]
    folded = {r.pos: r for r in L.folds(stream, KEYS, up, up & F.col("real_pct_change").isNotNull(), F.col("real_pct_change") <= 0).collect()}
    checked = 0
    for p, r in out.items():
        anchor = folded[p].anchor_pos
        if anchor is None:
            assert r.downside_training_rows == 0
            continue
        assert r.downside_training_rows == sum(anchor - 756 <= k < anchor for k in known)
        assert 0 <= p - anchor < 5
        checked += 1
    assert checked > 300


def test_later_rows_do_not_matter(stream):
    cut = 700
    altered = stream.withColumn("real_pct_change", F.when(F.col("pos") >= cut, -1.7 * F.col("real_pct_change")).otherwise(F.col("real_pct_change"))).withColumn(
        "a", F.when(F.col("pos") > cut, F.col("a") + 1).otherwise(F.col("a"))).withColumn("correct", F.when(F.col("pos") >= cut, ~F.col("correct")).otherwise(F.col("correct")))
    jobs = {
        "downside": lambda s: L.downside_probabilities(s, ["a", "b"], F.lit(True)).select("pos", "downside_probability"),
        "error": lambda s: L.error_probabilities(s, ["a", "confidence"], KEYS).select("pos", "correctness_probability"),
        "history": lambda s: Q.history_features(s, KEYS).select("pos", "recent_return", "side_1_accuracy", "recent_volatility"),
        "platt": lambda s: K.platt_calibrate(s, KEYS).select("pos", "calibrated_confidence"),
        "isotonic": lambda s: K.isotonic_calibrate(s.withColumn("y", (F.col("real_pct_change") <= 0).cast("int")), KEYS, "confidence", "y", F.col("predicted_label") == 1).select("pos", "calibrated_probability"),
    }
    for name, job in jobs.items():
        whole = sorted(map(tuple, job(stream).where(F.col("pos") <= cut).collect()))
        changed = sorted(map(tuple, job(altered).where(F.col("pos") <= cut).collect()))
        prefix = sorted(map(tuple, job(stream.where(F.col("pos") <= cut)).collect()))
        assert whole == changed, name
        assert whole == prefix, name


def test_isotonic_is_the_max_min_of_means(stream):
    s = stream.where("pos < 120").withColumn("y", (F.col("real_pct_change") <= 0).cast("int"))
    out = {r.pos: r for r in K.isotonic_calibrate(s, KEYS, "confidence", "y", F.lit(True), window=80, minimum=60).collect()}
    rows = sorted(s.collect(), key=lambda r: r.pos)
    for at in (70, 100, 119):
        h = sorted((r.confidence, r.y) for r in rows[at - 80 if at >= 80 else 0: at])
        x, y = np.array([a for a, _ in h]), np.array([b for _, b in h], dtype=float)
        c = np.concatenate([[0], np.cumsum(y)])
        fit = [max(min((c[k + 1] - c[j]) / (k + 1 - j) for k in range(i, len(y))) for j in range(i + 1)) for i in range(len(y))]
        assert out[at].calibrated_probability == pytest.approx(np.interp(out[at].confidence, x, fit), abs=1e-12)


def test_adaptive_weight_minimises_the_loss(stream):
    s = stream.withColumn("y", (F.col("real_pct_change") <= 0).cast("int")).withColumn("l", 1 / (1 + F.exp(F.col("a")))).withColumn("r", F.lit(.5) + .1 * F.col("b") / 5)
    out = K.adaptive_pool(s, KEYS, "l", "r", "y", F.col("predicted_label") == 1).where("pos = 640 OR pos = 641 OR pos = 642").where("pool_applied").first()
    h = s.where((F.col("pos") < out.pos) & (F.col("pos") >= out.pos - 252) & (F.col("predicted_label") == 1)).toPandas()
    d, e = h.l - h.r, h.r - h.y
    lam = 20 / len(h) * (d ** 2).mean()
    grid = np.linspace(0, 1, 10001)
    loss = [((e + g * d) ** 2).mean() + lam * (g - .5) ** 2 for g in grid]
    assert out.pool_weight == pytest.approx(grid[int(np.argmin(loss))], abs=1e-4)


def test_nested_choice_prefers_lower_loss(stream):
    up = F.col("predicted_label") == 1
    f = L.folds(stream, KEYS, up, up & F.col("real_pct_change").isNotNull(), F.col("real_pct_change") <= 0, minimum=240, interval=100)
    sets = {"base": ("b",), "extended": ("b", "a")}
    att = L.nested_attempts(f, KEYS, sets)
    chosen = L.select_choice(att, KEYS).collect()
    per = att.groupBy("anchor_pos", "features", "inverse_penalty").agg(F.avg("log_loss").alias("l")).collect()
    assert chosen and all(c.log_loss <= min(r.l for r in per if r.anchor_pos == c.anchor_pos) + 1e-12 for c in chosen)
    assert all(c.features == "extended" for c in chosen)


def test_rule_scores_ignore_unresolved_rows(spark):
    rng = np.random.default_rng(2)
    rows, close = [], 100.0
    for i in range(200):
        pre, close = close, close * (1 + .004 * rng.normal())
        rows.append(("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), pre * 1.001, close, pre))
    bars = spark.createDataFrame(rows, "series_id string, trade_date date, open double, close double, pre_close double")
    full = threshold_rules(bars)
    cut = threshold_rules(bars.where(F.col("trade_date") <= rows[150][1]))
    pick = lambda p: sorted(map(str, scored(p).where("pos <= 149").select("pos", "rule_id", "raw_score", "eligible", "pred").collect()))
    assert pick(full) == pick(cut)
    both = full.where("rule_id IN (0, 1) AND pred IS NOT NULL").groupBy("pos").agg(F.sum("pred").alias("s")).where("s <> 1").count()
    assert both == 0
