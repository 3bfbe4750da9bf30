"""Row-frame helpers.

Spark frames never enforce a minimum number of observations and skip nulls, so
every rolling statistic here pairs the aggregate with a count test.  All windows
are partitioned by the series keys; a panel holds at most one row per key and
session, which bounds a window partition by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def prior(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one, which is excluded."""
    return w.rowsBetween(-n, -1)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(x: Column, n: int, agg: Callable[[Column], Column], w: WindowSpec) -> Column:
    """Rolling aggregate, null unless all n rows of the frame are known."""
    return at_least(x, n, n, agg, w)


def at_least(x: Column, n: int, minimum: int, agg: Callable[[Column], Column], w: WindowSpec) -> Column:
    f = trailing(w, n)
    return F.when(F.count(x).over(f) >= minimum, agg(x).over(f))


def full_prior(x: Column, n: int, minimum: int, agg: Callable[[Column], Column], w: WindowSpec) -> Column:
    f = prior(w, n)
    return F.when(F.count(x).over(f) >= minimum, agg(x).over(f))


def diff(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x - F.lag(x, n).over(w)


def growth(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def deviation(x: Column, n: int, w: WindowSpec) -> Column:
    """x relative to its own rolling mean, minus one."""
    return F.try_divide(x, full(x, n, F.avg, w)) - 1


def zscore(x: Column, n: int, minimum: int, w: WindowSpec, floor: float = 1e-12) -> Column:
    mean = at_least(x, n, minimum, F.avg, w)
    spread = at_least(x, n, minimum, F.stddev_samp, w)
    return (x - mean) / F.greatest(spread, F.lit(floor))


def drawdown(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(x, full(x, n, F.max, w)) - 1


def prior_scaled(x: Column, n: int, w: WindowSpec, clip: float = 5.0, floor: float = 1e-12) -> Column:
    """Normalise by the mean and population deviation of the n earlier rows."""
    mean = full_prior(x, n, n, F.avg, w)
    spread = full_prior(x, n, n, F.stddev_pop, w)
    z = F.when(spread > floor, (x - mean) / spread)
    return F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def prior_count(flag: Column, n: int, running: str, pos: str, w: WindowSpec) -> Column:
    """Sum of an integer flag over the n earlier rows as a running-sum difference.

    `running` names a column that already holds the inclusive running sum of the
    flag, so the cost per row does not depend on n.
    """
    r = F.col(running)
    return F.coalesce(F.lag(r, 1).over(w), F.lit(0)) - F.coalesce(F.lag(r, n + 1).over(w), F.lit(0))
