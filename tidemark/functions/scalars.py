"""Scalar expressions shared by the operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def logit(p: Column, low: float = 0.01, high: float = 0.99) -> Column:
    q = clip(p, low, high)
    return F.ln(q / (1 - q))


def close_to(a: Column, b: Column, rtol: float = 0.0, atol: float = 0.0) -> Column:
    """Tolerant equality; two nulls match, one null does not."""
    both = a.isNull() & b.isNull()
    near = F.abs(a - b) <= (F.lit(atol) + F.lit(rtol) * F.abs(b))
    return both | F.coalesce(near, F.lit(False))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: over zero an infinity, or NaN for zero; null only where an operand is null."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


@F.arrow_udf(T.DoubleType())
def natural_log(x: pa.Array) -> pa.Array:
    """The logarithm to the last bit as the checking SQL has it, NaN and infinities included.

    F.ln differs there in one row of thirteen, which decides the sign of sums that should be zero.
    """
    return pc.ln(x)


@F.arrow_udf(T.DoubleType())
def exponential(x: pa.Array) -> pa.Array:
    """The exponential to the last bit as the checking SQL has it; the last bit of a large one shows in its sixth decimal place."""
    return pc.exp(x)


def known(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def all_known(*cols: Column) -> Column:
    test = F.lit(True)
    for c in cols:
        test = test & c.isNotNull()
    return test


def wilson_lower(correct: Column, rows: Column, z: float = 1.96) -> Column:
    n = rows.cast("double")
    p = F.try_divide(correct.cast("double"), n)
    z2 = z * z
    centre = p + F.try_divide(F.lit(z2 / 2), n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2 / 4), n * n))
    return F.when(rows > 0, F.try_divide(centre - spread, 1 + F.try_divide(F.lit(z2), n))).otherwise(F.lit(0.0))


def session_int(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def to_session(x: Column) -> Column:
    """Strict eight-digit session; anything else is null."""
    s = x.cast("string")
    return F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)
