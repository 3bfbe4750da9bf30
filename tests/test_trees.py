"""Tree learners against plain versions that try every split by loops."""

import numpy as np
import pytest

from tidemark.operators import trees


def sample(n, features, seed, missing=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 1)
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] + x[:, 1] ** 2 - 0.5))).astype(float)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y, rng.random(n) + 0.5, rng.normal(size=n) * 0.4


def plain_boosting(x, y, w, margin, depth, rounds, rate, least, l2, l1):
    """Probabilities on the training rows, by trying every cut of every feature and both sides for unknown values."""
    total = margin.copy()
    shrink = lambda g: np.sign(g) * max(abs(g) - l1, 0)
    score = lambda g, h: shrink(g) ** 2 / (h + l2)

    def grow(rows, level, g, h):
        out = {i: -rate * shrink(g[rows].sum()) / (h[rows].sum() + l2) for i in rows}
        if level == depth:
            return out
        best, found = 1e-6, None
        for f in range(x.shape[1]):
            seen = np.unique(x[~np.isnan(x[:, f]), f])
            for cut in [*((seen[1:] + seen[:-1]) / 2), np.inf]:
                for gone in (False, True):
                    left = np.array([i for i in rows if (gone if np.isnan(x[i, f]) else x[i, f] <= cut)], int)
                    right = np.setdiff1d(rows, left)
                    if h[left].sum() < least or h[right].sum() < least:
                        continue
                    gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum())
                    if gain > best + 1e-12:
                        best, found = gain, (left, right)
        if found is None:
            return out
        return grow(found[0], level + 1, g, h) | grow(found[1], level + 1, g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        values = grow(np.arange(len(y)), 0, w * (p - y), w * p * (1 - p))
        total = total + np.array([values[i] for i in range(len(y))])
    return 1 / (1 + np.exp(-total))


@pytest.mark.parametrize("depth, missing", [(1, 0.0), (2, 0.0), (2, 0.2), (3, 0.1)])
def test_boosting_is_exact_where_every_value_has_a_bin(depth, missing):
    x, y, w, margin = sample(120, 3, depth, missing)
    settings = {"depth": depth, "rounds": 6, "rate": 0.3, "l2": 2.0, "l1": 0.1}
    got = trees.boosted(least_hessian=3, **settings)(np.column_stack([margin, x]), y, w)(np.column_stack([margin, x]))
    assert got == pytest.approx(plain_boosting(x, y, w, margin, least=3, **settings), abs=1e-9)


def test_boosting_without_a_split_keeps_the_margin_s_order():
    x, y, w, margin = sample(60, 2, 1)
    p = trees.boosted(least_hessian=1e9, rounds=5)(np.column_stack([margin, x]), y, w)(np.column_stack([margin, x]))
    assert (np.argsort(p) == np.argsort(margin)).all()


def test_quantile_bins_cut_training_rows_evenly():
    x = np.random.default_rng(0).normal(size=(1000, 1))
    counts = np.bincount(trees.Bins(x, 10).codes(x)[:, 0])
    assert len(counts) == 10 and counts.min() >= 90


def plain_forest(x, y, depth, least, share, n_trees, seed):
    """The same draws as trees.forest, each tree grown by recursion over every cut."""
    rng = np.random.default_rng(seed)
    n, features = x.shape
    counts = rng.multinomial(n, np.full(n, 1 / n), size=n_trees)
    choice = [trees._feature_choice(rng, n_trees * 2**level, features, share) for level in range(depth)]
    kept = lambda w: (w * y).sum() ** 2 / w.sum() + (w * (1 - y)).sum() ** 2 / w.sum()
    out = np.zeros(n)

    def grow(t, w, inside, level, place):
        rate = (w * y).sum() / w.sum()
        value = np.full(n, rate)
        if level == depth or rate in (0, 1):
            return value
        best, found = -np.inf, None
        for f in np.flatnonzero(choice[level][t * 2**level + place]):
            for cut in (lambda s: (s[1:] + s[:-1]) / 2)(np.unique(x[:, f])):
                left, right = w * (x[:, f] <= cut), w * (x[:, f] > cut)
                if min(left.sum(), right.sum()) >= least and kept(left) + kept(right) > max(best + 1e-9, kept(w) * (1 + 1e-12)):
                    best, found = kept(left) + kept(right), (f, cut)
        if found is None:
            return value
        low = x[:, found[0]] <= found[1]
        a, b = grow(t, w * low, inside & low, level + 1, 2 * place), grow(t, w * ~low, inside & ~low, level + 1, 2 * place + 1)
        return np.where(low, a, b)

    for t in range(n_trees):
        out += grow(t, counts[t].astype(float), np.ones(n, bool), 0, 0)
    return out / n_trees


def test_forest_equals_recursion():
    x, y, w, _ = sample(150, 4, 9)
    got = trees.forest(trees=12, depth=3, least_leaf=8, share=0.5, bins=1000, seed=5)(x, y, w)(x)
    assert got == pytest.approx(plain_forest(x, y, 3, 8, 0.5, 12, 5), abs=1e-12)


def test_extra_trees_cut_within_the_node_and_respect_leaves():
    x, y, w, _ = sample(300, 3, 4)
    made = {}
    original, trees.Trees = trees.Trees, lambda *a: made.setdefault("trees", original(*a))
    try:
        predict = trees.extra_trees(trees=25, depth=4, least_leaf=20, seed=3)(x, y, w)
    finally:
        trees.Trees = original
    grown = made["trees"]
    for t in range(25):
        stack = [(0, np.arange(300))]
        while stack:
            node, rows = stack.pop()
            assert grown.value[t, node] == pytest.approx(y[rows].mean()) and len(rows) >= 20
            f = grown.feature[t, node]
            if f >= 0:
                v, cut = x[rows, f], grown.threshold[t, node]
                assert v.min() <= cut < v.max()
                stack += [(2 * node + 1, rows[v <= cut]), (2 * node + 2, rows[v > cut])]
    assert len({float(c) for c in grown.threshold[:, 0]}) > 20
    assert predict(x) == pytest.approx(grown.predict(x).mean(0))
    again = trees.extra_trees(trees=25, depth=4, least_leaf=20, seed=3)(x, y, w)(x)
    assert (again == predict(x)).all()
    log_loss = -np.mean(y * np.log(again) + (1 - y) * np.log(1 - again))
    assert log_loss < -np.mean(y * np.log(y.mean()) + (1 - y) * np.log(1 - y.mean()))
