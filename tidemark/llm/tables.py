"""Small tables that a plan joins with: written first, so that Spark knows their size and broadcasts them only below its own threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import stage


def bounded(df: DataFrame, name: str) -> DataFrame:
    """Write a table whose rows are few by construction as one file, and read it back."""
    return stage(df.repartition(1), name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of df whose `column` is not in the one column of `values`; nulls stay."""
    other = fresh(df, "_other")
    return df.join(values.toDF(other).where(f"`{other}` IS NOT NULL").distinct(), F.col(column) == F.col(other), "left_anti")
