"""Exact quantiles and leading parts of groups, by rank selection.

There is one plan for every group size.  Rows are counted by order-preserving
buckets (with partial sums), which tells the buckets that contain a wanted rank.
Those few are written, and the rows in them are picked out where they are, by a
broadcast where Spark measures the buckets small enough; only these rows are
shuffled by value and ordered.  A window then sees a group's bucket totals or one
bucket's distinct values, never the group.  The input is read twice, so callers
stage a derived one.  NaN is larger than any number, as it is in Spark's order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import before, ordered
from tidemark.sources.staging import stage

_LOG_STEPS = 256
_ZERO_OFFSET = 745 * _LOG_STEPS + 1


def _bucket(df: DataFrame, value: str) -> Column:
    """A number that grows with the value: of a string its first seven bytes, of a number its logarithm in fine steps."""
    kind = df.schema[value].dataType
    c = F.col(value)
    if isinstance(kind, T.IntegralType):
        return F.floor(c / 4096)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    size = F.abs(c)
    magnitude = F.when(size == float("inf"), F.lit(4 * _ZERO_OFFSET)).otherwise(F.floor(F.ln(F.when(size != float("inf"), size)) * _LOG_STEPS) + _ZERO_OFFSET)
    return F.when(F.isnan(c), F.lit(8 * _ZERO_OFFSET)).when(c == 0, F.lit(0)).when(c > 0, magnitude).otherwise(-magnitude).cast("bigint")


def select_ranks(df: DataFrame, keys: Sequence[str], value: str,
                 ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Value at given 0-based ascending ranks of each group.

    `ranks` maps an output name to a function of the group size; ranks outside
    [0, size) give null.  Returns keys, rank_rows and per name a struct of the
    value, the rows up to and including it (`upto`) and the rows equal to it
    (`ties`).
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    rows = rows.withColumn("_b", _bucket(df, value))
    buckets = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_bc"))
    placed = buckets.withColumn("_start", F.coalesce(F.sum("_bc").over(before(ordered(keys, "_b"))), F.lit(0))).withColumn(
        "rank_rows", F.sum("_bc").over(Window.partitionBy(*keys)))
    names = list(ranks)
    wanted = F.array(*[ranks[n](F.col("rank_rows")).cast("bigint") for n in names])
    hit = F.filter(F.array_distinct(wanted), lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_bc")))
    targets = stage(placed.withColumn("_hit", hit).where(F.size("_hit") > 0).drop("_bc"), "rank-targets")
    inside = rows.select(*keys, "_b", value).join(targets.select(*keys, "_b"), [*keys, "_b"], "left_semi")
    near = inside.groupBy(*keys, "_b", value).agg(F.count("*").alias("_c")).join(targets, [*keys, "_b"])
    run = F.sum("_c").over(ordered([*keys, "_b"], value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start")
    got = near.withColumn("_end", run).where(F.exists("_hit", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c"))))
    found = F.struct(F.col(value).alias("value"), F.col("_end").alias("upto"), F.col("_c").alias("ties"))
    picks = []
    for n in names:
        r = ranks[n](F.col("rank_rows")).cast("bigint")
        picks.append(F.max(F.when((r < F.col("_end")) & (r >= F.col("_end") - F.col("_c")), found)).alias(n))
    return got.groupBy(*keys).agg(F.max("rank_rows").alias("rank_rows"), *picks)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group by rank selection, for groups of any size."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for i, p in enumerate(probs.values()):
        ranks[f"_lo{i}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"_hi{i}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    got = select_ranks(df, keys, value, ranks)
    outs = []
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("rank_rows") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo{i}.value"), F.col(f"_hi{i}.value")
        outs.append(F.when(lo == hi, lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi).alias(name))
    return got.select(*keys, *outs)


def aggregate_with_quantiles(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], quantiles: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """groupBy(keys).agg(...) plus quantiles given as (name, expression, probability).

    All expressions and probabilities go through one rank selection, the
    expression's number being one more key.
    """
    keys = list(keys)
    texts = list(dict.fromkeys(str(x) for _, x, _ in quantiles))
    values = [next(x for _, x, _ in quantiles if str(x) == t) for t in texts]
    probs = {f"_p{i}": p for i, p in enumerate(dict.fromkeys(p for *_, p in quantiles))}
    column = {p: c for c, p in probs.items()}
    long = df.select(*keys, F.posexplode(F.array(*[v.cast("double") for v in values])).alias("_x", "_v"))
    found = exact_quantiles(long, [*keys, "_x"], "_v", probs)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_x") == texts.index(str(x)), F.col(column[p]))).alias(n) for n, x, p in quantiles])
    return df.groupBy(*keys).agg(*aggs).join(wide, keys, "left")


def flag_top(df: DataFrame, keys: Sequence[str], value: str, tie: str, count: Callable[[Column], Column], name: str = "is_top") -> DataFrame:
    """Flag the `count(size)` rows with the largest value, ties going to the smaller tie key.

    The boundary value is selected by rank.  Only where rows equal to it do not
    all fit are they settled by a second selection on the tie key, so no group
    is sorted as a whole.  A null tie key comes first; rows that repeat both
    the value and the tie key at the boundary cannot be told apart and are
    flagged together.
    """
    keys = list(keys)
    edge = stage(select_ranks(df, keys, value, {"_e": lambda n: n - count(n)}).select(
        *keys, F.col("_e.value").alias("_edge"), F.col("_e.ties").alias("_ties"),
        (count(F.col("rank_rows")) - (F.col("rank_rows") - F.col("_e.upto"))).alias("_need")), "rank-edges")
    marked = df.join(edge, keys, "left").withColumn("_free", F.col(tie).isNull())
    contested = stage(marked.where((F.col(value) == F.col("_edge")) & (F.col("_need") < F.col("_ties"))).select(*keys, tie, "_need", "_free"), "rank-ties")
    nulls = contested.groupBy(*keys, "_need").agg(F.count(F.when(F.col("_free"), 1)).alias("_nulls"))
    rest = contested.where("NOT _free").select(*keys, tie, "_need").join(nulls, [*keys, "_need"])
    last = select_ranks(rest, [*keys, "_need", "_nulls"], tie, {"_t": lambda n: F.col("_need") - F.col("_nulls") - 1}).select(*keys, F.col("_t.value").alias("_last"), F.lit(True).alias("_cut"))
    out = marked.join(stage(last, "rank-last"), keys, "left")
    fits = F.col("_cut").isNull() | F.col("_free") | (F.col(tie) <= F.col("_last"))
    flag = (F.col(value) > F.col("_edge")) | ((F.col(value) == F.col("_edge")) & fits)
    return out.withColumn(name, F.coalesce(flag, F.lit(False))).drop("_edge", "_ties", "_need", "_last", "_free", "_cut")


def tenth(n: Column) -> Column:
    """Size of the leading tenth, rounded up and at least one."""
    return F.greatest(F.ceil(n / 10), F.lit(1))
