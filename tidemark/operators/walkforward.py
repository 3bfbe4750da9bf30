"""Walk-forward learning.

Eligibility, refit anchors and training counts are plain window expressions.
Fits run in grouped maps keyed by (series, block of positions).  A block holds
the training history of its anchors, at most one window before it, and the rows
its anchors serve, so a row is shipped a fixed number of times, a group's size
is fixed by the block and window length, and the number of groups grows with
series x history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from tidemark.functions.frames import ordered
from tidemark.operators.series import chained_anchors, modular_anchors, window_sum, with_running

WINDOW, MINIMUM, INTERVAL, BLOCK = 756, 120, 5, 756
SHORT_BLOCK = 252

class Logistic:
    """Solution of an L2-penalised weighted logistic regression with a free intercept.

    Minimises c * sum(w * loss) + |b|^2 / 2, by default on features scaled by the
    weighted mean and population deviation of the training rows.  `start` is the
    solution for a neighbouring window: its coefficients are carried over to the
    new scale, which leaves Newton's method a step or two; the minimum is the
    same from any start.
    """

    def __init__(self, x, y, w, c: float, scale: bool = True, start: Logistic | None = None):
        total = w.sum()
        self.mean = (w[:, None] * x).sum(0) / total
        self.spread = np.sqrt((w[:, None] * (x - self.mean) ** 2).sum(0) / total)
        self.spread[self.spread <= 1e-12] = 1.0
        if not scale:
            self.mean, self.spread = np.zeros_like(self.mean), np.ones_like(self.spread)
        z = self._scaled(x)
        ridge = np.ones(z.shape[1])
        ridge[0] = 0.0
        beta = np.zeros(z.shape[1])
        if start is not None:
            slope = start.beta[1:] / start.spread
            beta = np.concatenate(([start.beta[0] + slope @ (self.mean - start.mean)], slope * self.spread))

        def loss(b):
            m = z @ b
            return c * (w * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (ridge * b * b).sum()

        now, self.steps = loss(beta), 0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
            grad = c * (z.T @ (w * (q - y))) + ridge * beta
            if np.abs(grad).max() < 1e-9:
                break
            hess = c * (z.T * (w * q * (1 - q))) @ z + np.diag(ridge + 1e-12)
            step, length = np.linalg.solve(hess, grad), 1.0
            while (new := loss(beta - length * step)) > now + 1e-12 and length > 1e-6:
                length /= 2
            beta = beta - length * step
            self.steps += 1
            if now - new < 1e-14:
                break
            now = new
        self.beta = beta

    def _scaled(self, v):
        return np.column_stack([np.ones(len(v)), (v - self.mean) / self.spread])

    def __call__(self, v):
        return 1 / (1 + np.exp(-np.clip(self._scaled(v) @ self.beta, -500, 500)))


def logistic(c: float = 0.1, scale: bool = True) -> Callable:
    """fit(X, y, w) -> predict(X) of `Logistic`."""
    return lambda x, y, w: Logistic(x, y, w, c, scale)


def folds(df: DataFrame, keys: Sequence[str], eligible: Column, known: Column, target: Column, *, chained: bool = True,
          window: int = WINDOW, minimum: int = MINIMUM, interval: int = INTERVAL) -> DataFrame:
    """Add target, training counts, fit eligibility and the anchor in force.

    A row can be fitted when at least `minimum` known rows of both classes lie in
    the `window` positions before it.
    """
    base = df.withColumn("fold_eligible", F.coalesce(eligible, F.lit(False))).withColumn("fold_known", F.coalesce(known, F.lit(False))).withColumn("fold_target", target.cast("int"))
    base = with_running(base, keys, "pos", {"_k": F.col("fold_known"), "_p": F.col("fold_known") & (F.col("fold_target") == 1)})
    w = ordered(keys, "pos")
    base = base.withColumn("fold_rows", window_sum("_k", w, window)).withColumn("fold_positives", window_sum("_p", w, window)).drop("_k", "_p")
    ready = F.col("fold_eligible") & (F.col("fold_rows") >= minimum) & (F.col("fold_positives") > 0) & (F.col("fold_positives") < F.col("fold_rows"))
    assign = chained_anchors if chained else modular_anchors
    return assign(base, keys, "pos", ready, interval)


def _blocks(df: DataFrame, keys: Sequence[str], window: int, block: int) -> DataFrame:
    """Training copies of each row for every block with an anchor at most `window` later, and a scoring copy in its anchor's block."""
    b = F.floor(F.col("pos") / block)
    role = lambda k, own: F.struct(k.alias("_block"), F.lit(own).alias("_own"))
    ahead = [role(b + k, False) for k in range(2 + (window - 1) // block)]
    roles = F.array(*ahead, F.when(F.col("anchor_pos").isNotNull(), role(F.floor(F.col("anchor_pos") / block), True)))
    return df.withColumn("_role", F.explode(F.filter(roles, lambda r: r.isNotNull()))).select("*", "_role.*").drop("_role")


def _groups(rows: DataFrame, keys: Sequence[str]) -> GroupedData:
    """Blocks dealt over all partitions: fits cost time, not bytes, and adaptive execution would pack groups of few bytes into one task."""
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys, "_block").groupBy(*keys, "_block")


RESULT = (T.StructField("probability", T.DoubleType()), T.StructField("training_rows", T.LongType()), T.StructField("last_training_date", T.DateType()),
          T.StructField("effective_rows", T.DoubleType()), T.StructField("largest_weight_share", T.DoubleType()))


def walk_forward(folded: DataFrame, keys: Sequence[str], features: Sequence[str], learner: Callable, *, weight: str = "uniform",
                 magnitude: str = "real_pct_change", half_life: float = 126.0, window: int = WINDOW, block: int | None = None) -> DataFrame:
    """Score every anchored row with the model fitted at its anchor.

    weight: uniform, recent (half-life by age), magnitude (absolute outcome, zero
    excluded), balanced (by outcome direction) or classes (by target).  `block`
    is the length of a group; slow learners take short ones, so that more tasks
    share the fits.  Returns keys, pos and RESULT.
    """
    keys = list(keys)
    block = block or max(BLOCK, window)
    need = [*keys, "pos", "trade_date", "fold_known", "fold_target", "anchor_pos", magnitude, *features]
    rows = _blocks(folded.select(*dict.fromkeys(need)), keys, window, block)
    out = T.StructType([*[f for f in folded.schema.fields if f.name in keys or f.name == "pos"], *RESULT])
    cols, names, fit = list(features), [f.name for f in out.fields], learner

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        own, part = part[part["_own"]], part[~part["_own"]]
        pos, x = part["pos"].to_numpy(), part[cols].to_numpy(dtype=float)
        known, y = part["fold_known"].to_numpy(dtype=bool), part["fold_target"].to_numpy(dtype=float)
        size = part[magnitude].to_numpy(dtype=float)
        done = []
        for anchor, now in own.groupby("anchor_pos"):
            anchor = int(anchor)
            h = np.flatnonzero(known & (pos < anchor) & (pos >= anchor - window))
            if weight == "magnitude":
                h = h[size[h] != 0]
            if len(h) < 2 or len(np.unique(y[h])) < 2:
                continue
            w = np.ones(len(h))
            if weight == "recent":
                w = np.exp2(-(anchor - 1 - pos[h]) / half_life)
            elif weight == "magnitude":
                w = np.abs(size[h])
            elif weight == "balanced":
                up = (size[h] > 0).astype(int)
                w = len(h) / (2 * np.maximum(np.bincount(up, minlength=2)[up], 1))
            elif weight == "classes":
                w = len(h) / (2 * np.bincount(y[h].astype(int), minlength=2)[y[h].astype(int)])
            w = w / w.mean()
            p = fit(x[h], y[h], w)(now[cols].to_numpy(dtype=float))
            done.append(now[[*keys, "pos"]].assign(
                probability=p, training_rows=len(h), last_training_date=part["trade_date"].iloc[h[-1]],
                effective_rows=float(w.sum() ** 2 / (w * w).sum()), largest_weight_share=float(w.max() / w.sum())))
        return pd.concat(done)[names] if done else pd.DataFrame(columns=names)

    return _groups(rows, keys).applyInPandas(run, out)


def downside_probabilities(stream: DataFrame, features: Sequence[str], available: Column, keys: Sequence[str] = ("series_id",), *, weight: str = "uniform",
                           learner: Callable | None = None, block: int | None = None) -> DataFrame:
    """Probability that an up-forecast fails, learned on earlier up-forecasts (by default a logistic model)."""
    up = F.col("predicted_label") == 1
    known = up & available & F.col("real_pct_change").isNotNull()
    if weight == "magnitude":
        known = known & (F.col("real_pct_change") != 0)
    f = folds(stream, keys, up & available, known, F.col("real_pct_change") <= 0)
    return _attach(stream, walk_forward(f, keys, features, learner or logistic(), weight=weight, block=block), keys)


def _attach(stream: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = scores.withColumnsRenamed({"probability": "downside_probability", "training_rows": "downside_training_rows", "last_training_date": "downside_last_training_date"})
    return stream.join(s, [*keys, "pos"], "left").fillna(0.0, ["downside_probability"]).fillna(0, ["downside_training_rows"])


def two_sided_probabilities(stream: DataFrame, features: Sequence[str], available: Column, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Error probability in either direction: the mirrored problem serves down-forecasts."""
    down = downside_probabilities(stream, features, available, keys)
    r = F.col("real_pct_change")
    mirrored = stream.withColumn("predicted_label", 1 - F.col("predicted_label")).withColumn("real_pct_change", F.when(r.isNotNull(), F.when(r > 0, -1.0).otherwise(1.0)))
    up = downside_probabilities(mirrored, features, available, keys)
    cols = ("downside_probability", "downside_training_rows", "downside_last_training_date")
    k = [*keys, "pos"]
    d = down.select(*k, F.struct(*cols).alias("_d"))
    u = up.select(*k, F.struct(*cols).alias("_u"))
    j = stream.join(d, k).join(u, k)
    pick = F.when(F.col("predicted_label") == 1, F.col("_d")).otherwise(F.col("_u"))
    return j.withColumn("_x", pick).select(*stream.columns, *[F.col(f"_x.{c}").alias(c.replace("downside", "error")) for c in cols])


def error_probabilities(stream: DataFrame, features: Sequence[str], keys: Sequence[str], *, fitted: Column | None = None, window: int = WINDOW, minimum: int = MINIMUM,
                        c: float = 1.0, balanced: bool = False) -> DataFrame:
    """Probability that the incumbent is right; 1 while there is too little history."""
    ok = F.lit(True) if fitted is None else fitted
    known = F.col("real_pct_change").isNotNull() & ok
    right = F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")
    f = folds(stream, keys, ok, known, right, chained=False, window=window, minimum=minimum)
    scores = walk_forward(f, keys, features, logistic(c), weight="balanced" if balanced else "uniform", window=window)
    out = stream.join(scores.drop("effective_rows", "largest_weight_share"), [*keys, "pos"], "left")
    return out.withColumn("correctness_probability", F.coalesce("probability", F.lit(1.0))).drop("probability").fillna(0, ["training_rows"])


def laplace_fallback(df: DataFrame, keys: Sequence[str], label: Column, window: int = WINDOW) -> DataFrame:
    """(ups + 1) / (rows + 2) over earlier known rows, for rows without enough history to fit."""
    d = with_running(df, keys, "pos", {"_n": label.isNotNull(), "_u": label == 1})
    w = ordered(keys, "pos")
    return d.withColumn("history_rows", window_sum("_n", w, window)).withColumn("fallback_probability", (window_sum("_u", w, window) + 1) / (F.col("history_rows") + 2)).drop("_n", "_u")


def rolling_probabilities(df: DataFrame, features: Sequence[str], label: Column, keys: Sequence[str] = ("series_id",), *, learner: Callable, window: int = WINDOW,
                          minimum: int = 252, interval: int = INTERVAL, block: int = SHORT_BLOCK) -> DataFrame:
    """Probability of label 1 for every row with known features, refitted where pos % interval == 0.

    Adds probability, training_rows, last_training_date and fallback.  Where
    earlier labelled rows are too few or of one class, the probability is the
    smoothed rate (ups + 1) / (rows + 2); a row with an unknown feature has none.
    """
    known = F.lit(True)
    for name in features:
        known = known & F.col(name).isNotNull() & ~F.isnan(name)
    rows = df.withColumn("_label", F.when(known, label.cast("int")))
    f = folds(rows, keys, known, F.col("_label").isNotNull(), F.col("_label"), chained=False, window=window, minimum=minimum, interval=interval)
    scores = walk_forward(f, keys, features, learner, window=window, block=block).drop("effective_rows", "largest_weight_share")
    j = laplace_fallback(rows, keys, F.col("_label"), window).join(scores, [*keys, "pos"], "left").withColumn("fallback", F.col("probability").isNull())
    rate = F.when(known, F.col("fallback_probability"))
    return j.withColumn("probability", F.coalesce("probability", rate)).withColumn("training_rows", F.when(known, F.coalesce("training_rows", "history_rows"))).drop("_label", "fallback_probability", "history_rows")


def best_engines(engines: DataFrame, label: Column, keys: Sequence[str] = ("series_id",), *, name: str = "engine", top: int = 3, window: int = 252) -> DataFrame:
    """Mean probability of the `top` engines by log loss on earlier out-of-sample rows.

    `engines` has one row per engine, key and position.  An engine's own
    probabilities are walked forward, so ranking them by earlier rows selects
    without looking ahead; engines without a scored row come last, equals by name.
    """
    from pyspark.sql import Window

    p = F.least(F.greatest(F.col("probability"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = F.when(label.isNotNull(), -F.when(label == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    own = Window.partitionBy(name, *keys).orderBy("pos").rowsBetween(-window, -1)
    ranked = engines.where("probability IS NOT NULL").withColumn("_l", F.avg(loss).over(own))
    place = F.row_number().over(Window.partitionBy(*keys, "pos").orderBy(F.col("_l").asc_nulls_last(), name))
    chosen = ranked.withColumn("_r", place).where(F.col("_r") <= top)
    return chosen.groupBy(*keys, "pos").agg(F.avg("probability").alias("probability"), F.array_join(F.sort_array(F.collect_list(name)), "+").alias("engines"), F.min("_l").alias("best_log_loss"))


CHOICE = (T.StructField("anchor_pos", T.IntegerType()), T.StructField("features", T.StringType()), T.StructField("inverse_penalty", T.DoubleType()), T.StructField("correction_threshold", T.DoubleType()),
          T.StructField("block", T.IntegerType()), T.StructField("log_loss", T.DoubleType()), T.StructField("brier", T.DoubleType()), T.StructField("corrected", T.LongType()), T.StructField("damaged", T.LongType()),
          T.StructField("up_rows", T.LongType()), T.StructField("down_rows", T.LongType()), T.StructField("up_delta", T.LongType()), T.StructField("down_delta", T.LongType()),
          T.StructField("training_rows", T.LongType()), T.StructField("last_validation_date", T.DateType()))


def nested_attempts(folded: DataFrame, keys: Sequence[str], feature_sets: dict[str, Sequence[str]], penalties: Sequence[float] = (0.001, 0.01, 0.1),
                    thresholds: Sequence[float] = (0.6,), blocks: int = 3, block_rows: int = 40, minimum: int = MINIMUM, window: int = WINDOW) -> DataFrame:
    """One row per anchor, feature set, penalty, threshold and validation block.

    The last blocks of known rows before an anchor are validated in order, each on
    the rows before it; paired counts compare corrections with the incumbent on
    all resolved rows between the block's ends.  Each fit starts from the last
    one of its feature set, penalty and validation block.
    """
    keys = list(keys)
    modes = {k: list(v) for k, v in feature_sets.items()}
    allf = list(dict.fromkeys(n for v in modes.values() for n in v))
    need = [*keys, "pos", "trade_date", "fold_known", "fold_target", "anchor_pos", "predicted_label", "real_pct_change", *allf]
    rows = _blocks(folded.select(*dict.fromkeys(need)), keys, window, SHORT_BLOCK)
    out = T.StructType([*[f for f in folded.schema.fields if f.name in keys], *CHOICE])
    names = [f.name for f in out.fields]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        own, part = part[part["_own"] & (part["anchor_pos"] == part["pos"])], part[~part["_own"]].reset_index(drop=True)
        pos, known, y = part["pos"].to_numpy(), part["fold_known"].to_numpy(dtype=bool), part["fold_target"].to_numpy(dtype=float)
        label, real = part["predicted_label"].to_numpy(dtype=int), part["real_pct_change"].to_numpy(dtype=float)
        x = {m: part[cols].to_numpy(dtype=float) for m, cols in modes.items()}
        key, dates = tuple(own[keys].iloc[0]) if len(own) else (), part["trade_date"].tolist()
        done, last = [], {}
        for anchor in own["pos"]:
            h = np.flatnonzero(known & (pos < anchor) & (pos >= anchor - window))
            first = len(h) - blocks * block_rows
            if first < minimum or any(len(np.unique(y[h[: first + b * block_rows]])) < 2 for b in range(blocks)):
                continue
            for b in range(blocks):
                train, test = h[: first + b * block_rows], h[first + b * block_rows: first + (b + 1) * block_rows]
                span = np.arange(test[0], test[-1] + 1)
                res = span[np.isfinite(real[span])]
                truth = real[res] > 0
                for m in modes:
                    for c in penalties:
                        model = last[m, c, b] = Logistic(x[m][train], y[train], np.ones(len(train)), c, start=last.get((m, c, b)))
                        p = np.clip(model(x[m][test]), 1e-12, 1 - 1e-12)
                        loss = float(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log1p(-p)))
                        for t in thresholds:
                            flip = np.isin(res, test[p >= t])
                            delta = ((label[res] ^ flip) == truth).astype(int) - (label[res] == truth).astype(int)
                            done.append((*key, anchor, m, c, t, b, loss, float(np.mean((p - y[test]) ** 2)), int((delta > 0).sum()), int((delta < 0).sum()),
                                         int(truth.sum()), int((~truth).sum()), int(delta[truth].sum()), int(delta[~truth].sum()), len(h), dates[test[-1]]))
        return pd.DataFrame(done, columns=names)

    return _groups(rows, keys).applyInPandas(run, out)


def paired_report(attempts: DataFrame) -> DataFrame:
    """Accuracy and balanced-accuracy change of each validated block."""
    acc = (F.col("corrected") - F.col("damaged")) / (F.col("up_rows") + F.col("down_rows"))
    bal = (F.try_divide(F.col("up_delta"), F.col("up_rows")) + F.try_divide(F.col("down_delta"), F.col("down_rows"))) / 2
    out = attempts.withColumn("accuracy_delta", acc).withColumn("balanced_accuracy_delta", bal)
    return out.withColumn("nondecreasing", F.coalesce((F.col("accuracy_delta") >= -1e-12) & (F.col("balanced_accuracy_delta") >= -1e-12), F.lit(False)))


def select_choice(attempts: DataFrame, keys: Sequence[str], *, paired: bool = False, learn_threshold: bool = False) -> DataFrame:
    """The choice in force at each anchor, by log loss or by paired accuracy gain.

    Loss ties within 1e-12 go to the base features, then to the stronger penalty.
    """
    from pyspark.sql import Window

    k = [*keys, "anchor_pos"]
    choice = ["features", "inverse_penalty", "correction_threshold"]
    per = paired_report(attempts).groupBy(*k, *choice).agg(
        F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.sum("corrected").alias("corrected"), F.sum("damaged").alias("damaged"),
        F.sum("up_rows").alias("up_rows"), F.sum("down_rows").alias("down_rows"), F.sum("up_delta").alias("up_delta"), F.sum("down_delta").alias("down_delta"),
        F.min(F.col("nondecreasing").cast("int")).alias("_nd"), F.max("training_rows").alias("training_rows"), F.max("last_validation_date").alias("last_validation_date"))
    admissible = (F.col("_nd") == 1) & (F.col("corrected") > F.col("damaged")) if paired else F.lit(True)
    per = per.withColumn("admissible", admissible).withColumn("pooled_accuracy_gain", (F.col("corrected") - F.col("damaged")) / (F.col("up_rows") + F.col("down_rows"))).withColumn(
        "pooled_balanced_gain", (F.try_divide(F.col("down_delta"), F.col("down_rows")) + F.try_divide(F.col("up_delta"), F.col("up_rows"))) / 2).drop("_nd")
    ok = per.where("admissible")
    base = (F.col("features") != "base").cast("int")
    if learn_threshold:
        order = [F.desc("pooled_accuracy_gain"), F.desc("pooled_balanced_gain"), F.col("corrected") + F.col("damaged"), F.col("log_loss"), base, F.col("inverse_penalty"), F.desc("correction_threshold")]
    else:
        ok = ok.withColumn("_best", F.min("log_loss").over(Window.partitionBy(*k))).where(F.col("log_loss") <= F.col("_best") + 1e-12).drop("_best")
        order = [base, F.col("inverse_penalty"), F.col("correction_threshold")]
    return ok.withColumn("_r", F.row_number().over(Window.partitionBy(*k).orderBy(*order))).where("_r = 1").drop("_r")


def nested_probabilities(folded: DataFrame, selected: DataFrame, keys: Sequence[str], feature_sets: dict[str, Sequence[str]], window: int = WINDOW) -> DataFrame:
    """Score rows with the choice selected at their anchor; one pass per declared choice."""
    chosen = selected.select(*keys, "anchor_pos", F.col("features").alias("_mode"), F.col("inverse_penalty").alias("_c"), F.col("correction_threshold").alias("selected_threshold"))
    rows = folded.join(chosen, [*keys, "anchor_pos"], "left")
    keys = list(keys)
    modes = {k: list(v) for k, v in feature_sets.items()}
    allf = list(dict.fromkeys(n for v in modes.values() for n in v))
    need = [*keys, "pos", "trade_date", "fold_known", "fold_target", "anchor_pos", "_mode", "_c", "selected_threshold", *allf]
    parts = _blocks(rows.select(*dict.fromkeys(need)), keys, window, SHORT_BLOCK)
    extra = [T.StructField("probability", T.DoubleType()), T.StructField("training_rows", T.LongType()), T.StructField("last_training_date", T.DateType()),
             T.StructField("selected_features", T.StringType()), T.StructField("selected_c", T.DoubleType()), T.StructField("selected_threshold", T.DoubleType())]
    out = T.StructType([*[f for f in folded.schema.fields if f.name in keys or f.name == "pos"], *extra])
    names = [f.name for f in out.fields]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        own, part = part[part["_own"] & part["_mode"].notna()], part[~part["_own"]]
        pos, known, y = part["pos"].to_numpy(), part["fold_known"].to_numpy(dtype=bool), part["fold_target"].to_numpy(dtype=float)
        done = []
        for (anchor, mode, c), now in own.groupby(["anchor_pos", "_mode", "_c"]):
            cols = modes[mode]
            h = np.flatnonzero(known & (pos < anchor) & (pos >= anchor - window))
            p = Logistic(part[cols].to_numpy(dtype=float)[h], y[h], np.ones(len(h)), c)(now[cols].to_numpy(dtype=float))
            done.append(now[[*keys, "pos", "selected_threshold"]].assign(probability=p, training_rows=len(h), last_training_date=part["trade_date"].iloc[h[-1]], selected_features=mode, selected_c=c))
        return pd.concat(done)[names] if done else pd.DataFrame(columns=names)

    return _groups(parts, keys).applyInPandas(run, out)
