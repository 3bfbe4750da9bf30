"""Tree learners for windows of some hundred rows, as factories of fit(X, y, w) -> predict(X).

Boosted trees add to a margin given per row, so a model corrects the incumbent
instead of replacing it.  Forests and extremely randomised trees grow all their
trees together, one level at a time: the nodes of a level are groups of one
histogram or one segmented reduction, and no tree is walked by itself.  A fit
depends on its rows and seed alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BINS = 64
NO_SPLIT = -1


class Trees:
    """Complete binary trees: node i has children 2i + 1 and 2i + 2; a node without a feature is a leaf."""

    def __init__(self, trees: int, depth: int):
        shape = (trees, 2 ** (depth + 1) - 1)
        self.depth = depth
        self.feature = np.full(shape, NO_SPLIT)
        self.threshold = np.zeros(shape)
        self.missing_left = np.zeros(shape, bool)
        self.value = np.zeros(shape)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Leaf value of every (tree, row)."""
        tree, row = np.arange(len(self.feature))[:, None], np.arange(len(x))[None, :]
        node = np.zeros((len(self.feature), len(x)), int)
        for _ in range(self.depth):
            feature = self.feature[tree, node]
            v = x[row, feature]
            left = np.where(np.isnan(v), self.missing_left[tree, node], v <= self.threshold[tree, node])
            node = np.where(feature == NO_SPLIT, node, 2 * node + 2 - left)
        return self.value[tree, node]


class Bins:
    """Codes of feature values: the number of cuts below a value, or `missing`.

    A feature of at most `limit` distinct values is cut between all of them,
    others at the quantiles of the training rows.
    """

    def __init__(self, x: np.ndarray, limit: int = BINS):
        self.cuts = []
        for column in x.T:
            seen = np.unique(column[~np.isnan(column)])
            exact = (seen[1:] + seen[:-1]) / 2
            self.cuts.append(exact if len(seen) <= limit else np.unique(np.quantile(column[~np.isnan(column)], np.arange(1, limit) / limit, method="lower")))
        self.missing = max([len(c) for c in self.cuts], default=0) + 1
        self.table = np.full((len(self.cuts), self.missing + 1), np.inf)
        for f, cuts in enumerate(self.cuts):
            self.table[f, : len(cuts)] = cuts

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)]) if self.cuts else np.zeros((len(x), 0), int)
        out[np.isnan(x)] = self.missing
        return out


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def in_order(values: np.ndarray) -> np.ndarray:
    """Sum over trees, one after the other, so that a row's sum does not depend on the rows beside it."""
    return values.cumsum(0)[-1]


def boosted(depth: int = 2, rounds: int = 60, rate: float = 0.05, least_hessian: float = 20, l2: float = 20, l1: float = 1, bins: int = BINS, margin: bool = True) -> Callable:
    """Second-order boosting of the logistic loss with histograms.

    With `margin` the first column of X is the log-odds that every row starts
    from and is no feature; else all rows start from zero.  A split needs
    `least_hessian` on both sides and a gain of the L1 and L2 penalised
    objective; rows without a value go to the side that gains more, to the right
    where it makes no difference.
    """

    def shrunk(g):
        return np.sign(g) * np.maximum(np.abs(g) - l1, 0)

    def score(g, h):
        return shrunk(g) ** 2 / (h + l2)

    def gains(left, whole):
        """Gain of every cut; sums are gradient + i * hessian."""
        right = whole - left
        gain = score(left.real, left.imag) + score(right.real, right.imag) - score(whole.real, whole.imag)
        return np.where((left.imag >= least_hessian) & (right.imag >= least_hessian), gain, -np.inf)

    def fit(x, y, w):
        start, x = (x[:, 0], x[:, 1:]) if margin else (np.zeros(len(x)), x)
        b = Bins(x, bins)
        codes = b.codes(x)
        n, n_features = codes.shape
        # Rows by (feature, code), and the bins of that order: equal codes of one feature.
        by_code = codes.argsort(0, kind="stable").T
        key = (np.take_along_axis(codes.T, by_code, 1) + np.arange(n_features)[:, None] * (b.missing + 1)).ravel()
        rows, first = by_code.ravel(), np.flatnonzero(np.diff(key, prepend=-1))
        feature, code = np.divmod(key[first], b.missing + 1)
        is_gone = code == b.missing
        has_gone = np.zeros(n_features, bool)
        has_gone[feature[is_gone]] = True
        begins = np.searchsorted(feature, np.arange(n_features))
        trees, total = Trees(rounds, depth), start.astype(float)

        def sums(z):
            """Of every bin: the sum over its feature's rows up to it, and over those without a value."""
            binned = np.add.reduceat(z[rows], first)
            running = binned.cumsum()
            gone = np.zeros(n_features, complex)
            gone[feature[is_gone]] = binned[is_gone]
            return running - (running[begins] - binned[begins])[feature], gone[feature]

        def best_split(known, gone, whole):
            gain = gains(known, whole)
            gain[is_gone] = -np.inf
            j, other = gain.argmax(), None
            if has_gone.any():
                other = gains(known + gone, whole)
                other[is_gone | ~has_gone[feature]] = -np.inf
                if other.max() > gain[j]:
                    return other.max(), other.argmax(), True
            return gain[j], j, False

        def grow(k, z):
            """Fill tree k; return the value each row gets."""
            gained, everything = np.zeros(n), np.ones(n, bool)
            open_nodes = [(0, everything, z.sum(), sums(z) if depth and n_features else None)]
            while open_nodes:
                node, mask, whole, table = open_nodes.pop()
                trees.value[k, node] = -rate * shrunk(whole.real) / (whole.imag + l2)
                gained[mask] = trees.value[k, node]
                if table is None:
                    continue
                gain, j, missing_left = best_split(*table, whole)
                if not gain > 1e-6:
                    continue
                f, cut = feature[j], code[j]
                trees.feature[k, node], trees.threshold[k, node], trees.missing_left[k, node] = f, b.table[f, cut], missing_left
                left = mask & np.where(codes[:, f] == b.missing, missing_left, codes[:, f] <= cut)
                part = table[0][j] + (table[1][j] if missing_left else 0)
                deeper = node < 2 ** (depth - 1) - 1
                low = sums(np.where(left, z, 0)) if deeper else None
                high = (table[0] - low[0], table[1] - low[1]) if deeper else None
                open_nodes += [(2 * node + 1, left, part, low), (2 * node + 2, mask & ~left, whole - part, high)]
            return gained

        for k in range(rounds):
            p = _sigmoid(total)
            total = total + grow(k, w * (p - y) + 1j * w * np.maximum(p * (1 - p), 1e-16))

        def predict(v):
            begin, v = (v[:, 0], v[:, 1:]) if margin else (0.0, v)
            return _sigmoid(begin + in_order(trees.predict(v)))

        return predict

    return fit


def _feature_choice(rng: np.random.Generator, nodes: int, n_features: int, share: float) -> np.ndarray:
    """A random subset of the features for every node."""
    return rng.random((nodes, n_features)).argsort(1).argsort(1) < max(1, int(share * n_features))


def _grown(trees: Trees, x: np.ndarray, y: np.ndarray, counts: np.ndarray, split_level: Callable) -> None:
    """Grow class trees over rows repeated counts[tree, row] times; split_level proposes (feature, threshold) of each node of a level, or no feature."""
    n_trees, n = counts.shape
    node = np.zeros((n_trees, n), int)
    active = counts > 0
    for level in range(trees.depth + 1):
        first, width = 2**level - 1, 2**level
        group = np.arange(n_trees)[:, None] * width + node - first
        t, r = np.nonzero(active)
        if not len(t):
            break
        at, weight = group[t, r], counts[t, r]
        rows = np.bincount(at, weight, n_trees * width)
        ups = np.bincount(at, weight * y[r], n_trees * width)
        trees.value[:, first : first + width] = np.divide(ups, rows, out=np.zeros_like(ups), where=rows > 0).reshape(n_trees, width)
        if level == trees.depth:
            break
        feature, threshold = split_level(at, r, weight, rows, ups)
        feature = np.where((ups > 0) & (ups < rows), feature, NO_SPLIT)
        trees.feature[:, first : first + width] = feature.reshape(n_trees, width)
        trees.threshold[:, first : first + width] = threshold.reshape(n_trees, width)
        goes = feature[at] != NO_SPLIT
        active[t[~goes], r[~goes]] = False
        t, r, at = t[goes], r[goes], at[goes]
        node[t, r] = 2 * node[t, r] + 2 - (x[r, feature[at]] <= threshold[at])


def _purity(left_n, left_up, rows, ups, least_leaf):
    """What a split leaves of the squared class sums (more is purer); -inf where a side is too small or nothing is gained."""
    right_n, right_up = rows - left_n, ups - left_up
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (left_up**2 + (left_n - left_up) ** 2) / left_n + (right_up**2 + (right_n - right_up) ** 2) / right_n
        before = (ups**2 + (rows - ups) ** 2) / rows
    return np.where((left_n >= least_leaf) & (right_n >= least_leaf) & (kept > before * (1 + 1e-12)), kept, -np.inf)


def forest(trees: int = 200, depth: int = 3, least_leaf: int = 20, share: float = 0.5, bins: int = BINS, seed: int = 42) -> Callable:
    """Mean of class trees on bootstrap samples, each node split at its best cut among a random share of the features; sample weights are not used."""

    def fit(x, y, w):
        rng = np.random.default_rng(seed)
        b = Bins(x, bins)
        codes, slots, n_features = b.codes(x), b.table.shape[1], x.shape[1]
        flat = codes + np.arange(n_features) * slots
        made = Trees(trees, depth)

        def split_level(at, r, weight, rows, ups):
            size = len(rows) * n_features * slots
            key = (at[:, None] * (n_features * slots) + flat[r]).ravel()
            left_n, left_up = (np.bincount(key, np.repeat(v, n_features), size).reshape(len(rows), n_features, slots).cumsum(2) for v in (weight, weight * y[r]))
            pure = _purity(left_n, left_up, rows[:, None, None], ups[:, None, None], least_leaf)
            pure[~_feature_choice(rng, len(rows), n_features, share)] = -np.inf
            best = pure.reshape(len(rows), -1).argmax(1)
            f, cut = np.unravel_index(best, pure.shape[1:])
            return np.where(np.isfinite(pure[np.arange(len(rows)), f, cut]), f, NO_SPLIT), b.table[f, cut]

        counts = rng.multinomial(len(x), np.full(len(x), 1 / len(x)), size=trees)
        _grown(made, x, y, counts, split_level)
        return lambda v: in_order(made.predict(v)) / trees

    return fit


def extra_trees(trees: int = 200, depth: int = 4, least_leaf: int = 30, share: float = 0.7, seed: int = 42) -> Callable:
    """Mean of class trees on all rows, each node split at the best of one uniform random cut per feature of a random share; sample weights are not used."""

    def fit(x, y, w):
        rng = np.random.default_rng(seed)
        made, n_features = Trees(trees, depth), x.shape[1]

        def split_level(at, r, weight, rows, ups):
            order = np.argsort(at, kind="stable")
            at, r = at[order], r[order]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            present = at[starts]
            values = x[r]
            low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
            threshold = np.zeros((len(rows), n_features))
            threshold[present] = low + rng.random((len(rows), n_features))[present] * (high - low)
            left = values <= threshold[at]
            left_n, left_up = np.zeros_like(threshold), np.zeros_like(threshold)
            left_n[present] = np.add.reduceat(left, starts, dtype=float)
            left_up[present] = np.add.reduceat(left * y[r][:, None], starts)
            pure = _purity(left_n, left_up, rows[:, None], ups[:, None], least_leaf)
            pure[~_feature_choice(rng, len(rows), n_features, share)] = -np.inf
            f = pure.argmax(1)
            return np.where(np.isfinite(pure[np.arange(len(rows)), f]), f, NO_SPLIT), threshold[np.arange(len(rows)), f]

        _grown(made, x, y, np.ones((trees, len(x)), int), split_level)
        return lambda v: in_order(made.predict(v)) / trees

    return fit
