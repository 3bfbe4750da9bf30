"""Sliding computations: any cut of a series into blocks gives the same rows, equal to plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators import calibrate as K
from tidemark.operators import series as Q

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s, n in (("s", 260), ("t", 1), ("u", 90)):
        for i in range(n):
            hit = None if i % 17 == 5 else bool(rng.random() < 0.6)
            rows.append((s, i, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if i % 13 == 2 else round(float(rng.normal()), 2), float(rng.normal()) / 50 if i % 11 else 0.0, None if hit is None else float(rng.normal()) / 40, hit, round(float(0.5 + 0.4 * rng.random()), 2)))
    return spark.createDataFrame(rows, "series_id string, pos int, trade_date date, x double, predicted_pct_change double, real_pct_change double, correct boolean, confidence double").withColumn("predicted_close", F.lit(10.0)).cache()


JOBS = {
    "quantiles": lambda s: Q.prior_quantiles(s, KEYS, "pos", ["x", "confidence"], [0.2, 0.5], 40, 7),
    "median": lambda s: Q.weighted_median_scale(s, KEYS, "pos", "predicted_pct_change", "real_pct_change", 30, 5),
    "platt": lambda s: K.platt_calibrate(s, KEYS, "pos", 50, 12),
    "isotonic": lambda s: K.isotonic_calibrate(s.withColumn("y", F.col("correct").cast("int")), KEYS, "confidence", "y", F.col("pos") % 3 != 1, "pos", 45, 10),
    "shrink": lambda s: K.shrink_returns(s, KEYS, "pos", 30, 5),
}


@pytest.mark.parametrize("name", JOBS)
def test_cuts_do_not_matter(stream, name, monkeypatch):
    whole = sorted(map(str, JOBS[name](stream).collect()))
    assert len(whole) == 351
    for size in (7, 64):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        assert sorted(map(str, JOBS[name](stream).collect())) == whole


def _series(stream):
    rows = sorted(stream.where("series_id = 's'").collect(), key=lambda r: r.pos)
    return rows, lambda name: {r.pos: r for r in JOBS[name](stream).where("series_id = 's'").collect()}


def test_quantiles_and_medians_equal_loops(stream):
    rows, got = _series(stream)
    quantiles, medians = got("quantiles"), got("median")
    for i, r in enumerate(rows):
        seen = [p.x for p in rows[max(0, i - 40):i] if p.x is not None]
        want = [float(np.quantile(seen, q)) for q in (0.2, 0.5)] if len(seen) >= 7 else [None, None]
        assert [quantiles[i].x_q0, quantiles[i].x_q1] == pytest.approx(want) if want[0] is not None else [quantiles[i].x_q0, quantiles[i].x_q1] == want
        pairs = sorted((p.real_pct_change / p.predicted_pct_change, abs(p.predicted_pct_change)) for p in rows[max(0, i - 30):i] if p.real_pct_change is not None and abs(p.predicted_pct_change) > 1e-12)
        scale = 0.0
        if len(pairs) >= 5:
            mass = np.cumsum([w for _, w in pairs])
            scale = min(1.0, max(0.0, next(v for (v, _), c in zip(pairs, mass) if c >= mass[-1] / 2)))
        assert medians[i].rows == len(pairs) and medians[i].scale == pytest.approx(scale)


def test_platt_is_the_ridge_fit(stream):
    rows, got = _series(stream)
    out = got("platt")
    for i in (5, 20, 120, 259):
        h = [(p.confidence, float(p.correct)) for p in rows[max(0, i - 50):i] if p.correct is not None]
        r = out[i]
        assert r.confidence_calibration_rows == len(h)
        if len(h) < 12:
            assert r.confidence_calibration_fallback == 1 and r.calibrated_confidence == rows[i].confidence
            continue
        x, y = np.array(h).T
        a = b = 0.0
        for _ in range(60):
            q = 1 / (1 + np.exp(-(a + b * x)))
            g = np.array([(q - y).sum() + 1e-6 * a, ((q - y) * x).sum() + 1e-6 * b])
            v = q * (1 - q)
            step = np.linalg.solve(np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-6]]), g)
            a, b = a - step[0], b - step[1]
        assert r.calibrated_confidence == pytest.approx(1 / (1 + np.exp(-(a + b * rows[i].confidence))), abs=1e-6)
