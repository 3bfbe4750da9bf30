"""Walk-forward tree learners: training rows, fallbacks, and independence of later rows and of a series' split into blocks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import residual as N
from tidemark.operators import trees as T
from tidemark.operators import walkforward as L

KEYS = ["series_id"]
SMALL = {"trees": 8, "depth": 2, "least_leaf": 5}


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(6)
    n = 420
    x = rng.normal(size=(n, 2))
    real = 0.01 * (x[:, 0] + rng.normal(size=n))
    label = (rng.random(n) < 0.6).astype(int)
    rows = [(s, i, dt.date(2020, 1, 1) + dt.timedelta(days=i), int(label[i]), float(real[i]) if i % 50 != 7 and i < n - 1 else None, float(x[i, 0]) if i % 40 != 3 else None, float(x[i, 1]), float(0.5 + 0.3 * rng.random())) for s in ("s", "t") for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, pos int, trade_date date, predicted_label int, real_pct_change double, a double, b double, calibrated_confidence double")
    return df.withColumn("correct", F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")).cache()


def up(df=None):
    return F.when(F.col("real_pct_change").isNotNull(), (F.col("real_pct_change") > 0).cast("int"))


def jobs(block):
    quick = N.Candidate(window=120, minimum=60, least_hessian=2, target="correctness")
    return {
        "residual": lambda s: N.residual_forecasts(s, ["a", "b"], quick, KEYS).select("series_id", "pos", "probability_up", "proposed_label", "training_rows"),
        "forest": lambda s: L.downside_probabilities(s, ["b"], F.lit(True), KEYS, learner=T.forest(**SMALL), block=block).select("series_id", "pos", "downside_probability", "downside_training_rows"),
        "rolling": lambda s: L.rolling_probabilities(s, ["a", "b"], up(), KEYS, learner=T.extra_trees(**SMALL), window=100, minimum=60, block=block).select("series_id", "pos", "probability", "training_rows", "fallback"),
    }


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["residual", "forest", "rolling"])
def test_later_rows_and_blocks_do_not_matter(stream, name):
    cut = 333
    altered = stream.withColumn("real_pct_change", F.when(F.col("pos") >= cut, -2 * F.col("real_pct_change")).otherwise(F.col("real_pct_change"))).withColumn("b", F.when(F.col("pos") > cut, 9.0).otherwise(F.col("b")))
    job = jobs(252)[name]
    whole = rows_of(job(stream).where(F.col("pos") <= cut))
    assert whole == rows_of(job(altered).where(F.col("pos") <= cut))
    assert whole == rows_of(job(stream.where(F.col("pos") <= cut)))
    if name != "residual":
        assert whole == rows_of(jobs(37)[name](stream).where(F.col("pos") <= cut))


def test_rolling_probabilities_fall_back_and_refit_on_anchors(stream):
    got = {r.pos: r for r in jobs(252)["rolling"](stream).where("series_id = 's'").collect()}
    data = {r.pos: r for r in stream.where("series_id = 's'").collect()}
    assert len(got) == len(data)
    x = {p: (r.a, r.b) for p, r in data.items() if r.a is not None}
    usable = [p for p, r in data.items() if p in x and r.real_pct_change is not None]
    anchor = None
    for pos in sorted(data):
        r = got[pos]
        if pos not in x:
            assert r.probability is None
            continue
        h = [p for p in usable if pos - 100 <= p < pos]
        y = np.array([data[p].real_pct_change > 0 for p in h], float)
        if len(h) < 60:
            assert r.fallback and r.training_rows == len(h) and r.probability == pytest.approx((y.sum() + 1) / (len(h) + 2))
            continue
        if anchor is None or pos % 5 == 0:
            anchor, fitted, size = pos, T.extra_trees(**SMALL)(np.array([x[p] for p in h]), y, None), len(h)
        assert not r.fallback and r.training_rows == size and r.probability == pytest.approx(fitted(np.array([x[pos]]))[0])


def test_residual_keeps_the_incumbent_without_history(stream):
    got = {r.pos: r for r in jobs(252)["residual"](stream).where("series_id = 's'").collect()}
    data = {r.pos: r for r in stream.where("series_id = 's'").collect()}
    assert len(got) == len(data)
    early = [r for p, r in got.items() if p < 60]
    assert all(r.training_rows == 0 and r.proposed_label == data[r.pos].predicted_label for r in early)
    assert all(r.probability_up == pytest.approx(data[r.pos].calibrated_confidence if data[r.pos].predicted_label else 1 - data[r.pos].calibrated_confidence) for r in early)
    late = [r for p, r in got.items() if p > 200]
    assert all(r.training_rows > 60 for r in late) and any(r.proposed_label != data[r.pos].predicted_label for r in late)


def test_residual_fit_equals_a_fit_of_its_window(stream):
    candidate = N.Candidate(window=120, minimum=60, least_hessian=2, weight="classes")
    got = {r.pos: r for r in N.residual_forecasts(stream.where("series_id = 't'"), ["a", "b"], candidate, KEYS).collect()}
    data = {r.pos: r for r in stream.where("series_id = 't'").collect()}
    at = 300
    h = [p for p, r in data.items() if at - 120 <= p < at and r.real_pct_change is not None]
    h.sort()

    def columns(p):
        r = data[p]
        c = min(max(r.calibrated_confidence, 0.01), 0.99)
        q = c if r.predicted_label == 1 else 1 - c
        return [np.log(q / (1 - q)), np.nan if r.a is None else r.a, r.b, r.predicted_label, q]

    x, y = np.array([columns(p) for p in h]), np.array([data[p].real_pct_change > 0 for p in h], float)
    w = len(h) / (2 * np.bincount(y.astype(int))[y.astype(int)])
    fitted = T.boosted(least_hessian=2)(x, y, w)
    for p in (300, 302, 304):
        assert got[p].probability_up == pytest.approx(fitted(np.array([columns(p)]))[0], abs=1e-12) and got[p].training_rows == len(h)


def test_best_engines_average_the_three_with_the_least_earlier_loss(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(60) < 0.5).astype(int)
    p = {e: np.clip(y * s + rng.random(60) * (1 - s), 0.02, 0.98) for e, s in zip("abcd", (0.1, 0.6, 0.3, 0.0))}
    rows = [("s", k, e, float(p[e][k]), int(y[k]) if k < 59 else None) for e in p for k in range(60)]
    got = {r.pos: r for r in L.best_engines(spark.createDataFrame(rows, "series_id string, pos int, engine string, probability double, label int"), F.col("label"), KEYS, window=20).collect()}
    loss = {e: -(y * np.log(p[e]) + (1 - y) * np.log(1 - p[e])) for e in p}
    for k in range(1, 60):
        best = sorted(p, key=lambda e: (loss[e][max(0, k - 20):k].mean(), e))[:3]
        assert got[k].engines == "+".join(sorted(best)) and got[k].probability == pytest.approx(np.mean([p[e][k] for e in best]))
    assert got[0].engines == "a+b+c"


def test_warm_starts_reach_the_cold_solution_in_fewer_steps():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6)) * [1, 5, 0.1, 1, 1, 2] + [0, 3, 1, 0, 0, 1]
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0] + 0.3 * x[:, 3]))).astype(float)
    last, steps = None, [0, 0]
    for a in range(0, 140, 5):
        h = slice(a, a + 700)
        cold, last = L.Logistic(x[h], y[h], np.ones(700), 0.1), L.Logistic(x[h], y[h], np.ones(700), 0.1, start=last)
        assert np.abs(cold(x) - last(x)).max() < 1e-8
        steps = [steps[0] + cold.steps, steps[1] + last.steps]
    assert steps[1] < steps[0] * 0.8
