"""Sliding computations in blocks of a series with a halo.

A series is cut into blocks of consecutive rows, each with copies of the
`window` rows before it.  A block's result needs nothing else, so a long series
is many tasks, a row is shipped a fixed number of times, and where the cuts fall
changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.frames import ordered

BLOCK_ROWS = 1024


def in_blocks(df: DataFrame, keys: Sequence[str], order: str, window: int, columns: Sequence[str], added: Sequence[T.StructField],
              compute: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]], block: int | None = None) -> DataFrame:
    """df with the columns that `compute` gives.

    compute(values, start) sees `columns` of a block as float arrays, unknown
    values as NaN, in order; rows before `start` are the halo, shorter at the
    beginning of a series.  It returns arrays for the rows from `start` on, NaN
    for unknown.
    """
    block = block or BLOCK_ROWS
    n, b = F.col("_n"), F.floor(F.col("_n") / block)
    copies = [F.struct(b.alias("_block"), F.lit(True).alias("_own"))]
    copies += [F.when(n + window >= (b + k) * block, F.struct((b + k).alias("_block"), F.lit(False).alias("_own"))) for k in range(1, -(-window // block) + 1)]
    rows = df.withColumn("_n", F.row_number().over(ordered(keys, order)) - 1)
    rows = rows.withColumn("_copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull()))).select("*", "_copy.*").drop("_copy")
    wanted, kinds = list(columns), {f.name: to_arrow_type(f.dataType) for f in added}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        start = len(table) - int(np.count_nonzero(table["_own"].to_numpy()))
        values = {c: table[c].cast(pa.float64()).to_numpy().astype(float) for c in wanted}
        made = compute(values, start)
        out = table.slice(start).drop_columns(["_n", "_block", "_own"])
        for name, kind in kinds.items():
            out = out.append_column(name, pa.array(made[name], from_pandas=True).cast(kind))
        return out

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys, "_block").groupBy(*keys, "_block").applyInArrow(run, T.StructType([*df.schema.fields, *added]))


def earlier(values: np.ndarray, start: int, window: int) -> np.ndarray:
    """For every row from `start` on, the `window` values before it; NaN where the series had not begun."""
    padded = np.concatenate([np.full(max(0, window - start), np.nan), values[max(0, start - window):]])
    return np.lib.stride_tricks.sliding_window_view(padded, window)[: len(values) - start]
