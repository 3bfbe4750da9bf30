"""Query registry.

A query declares its output once, as a short column list such as
``"code:i trade_date:d up_fraction:f"``.  The same list shapes the Spark result
and the checking SQL, so names, types and rounding cannot drift apart.
Kinds: i integer, d date, t timestamp, s string, b boolean (as 0/1),
f double rounded to 6 places, f2/f4 fewer places.  A thousandth of the last
place is added first, so that an exact half is not decided by addition order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def _spark(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "i":
        out = c.cast("bigint")
    elif kind == "d":
        out = F.date_format(c, "yyyy-MM-dd")
    elif kind == "t":
        out = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif kind == "s":
        out = c.cast("string")
    elif kind == "b":
        out = c.cast("int").cast("bigint")
    else:
        x = c.cast("double")
        n = int(kind[1:] or 6)
        y = F.when(~F.isnan(x), x) + 10.0 ** -(n + 3)
        scaled = F.round(y * 10.0**n) / 10.0**n  # as the SQL rounds: above a thousand millions decimal digits would round otherwise
        r = F.when(F.abs(scaled) == float("inf"), y).otherwise(scaled)
        out = F.when(r == 0, F.lit(0.0)).otherwise(r)
    return out.alias(name)


def _sql(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "i":
        out = f"CAST({q} AS BIGINT)"
    elif kind == "d":
        out = f"strftime(CAST({q} AS DATE), '%Y-%m-%d')"
    elif kind == "t":
        out = f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    elif kind == "s":
        out = f"CAST({q} AS VARCHAR)"
    elif kind == "b":
        out = f"CAST(CAST({q} AS INT) AS BIGINT)"
    else:
        n = int(kind[1:] or 6)
        x = f"(CAST({q} AS DOUBLE) + 1e-{n + 3})"
        out = f"CASE WHEN isnan({x}) THEN NULL WHEN round({x}, {n}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {n}) END"
    return f"{out} AS {q}"


def shape(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_spark(n, k) for n, k in parse(spec)])


def shape_sql(sql: str, spec: str) -> str:
    cols = ", ".join(_sql(n, k) for n, k in parse(spec))
    return f"SELECT {cols} FROM (\n{sql}\n) AS result"


def query(name: str, spec: str, sql: str | None = None):
    """Register a query; `sql` is left out where plain SQL cannot express it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, d: shape(fn(spark, d), spec)
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[name] = shape_sql(sql, spec)
        return fn

    return wrap
