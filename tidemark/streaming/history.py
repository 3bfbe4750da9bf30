"""Stateful per-key history: momentum over unbroken runs of sessions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = T.StructType([T.StructField("session_no", T.IntegerType()), T.StructField("returns", T.ArrayType(T.DoubleType()))])


def streaming_momentum(rows: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Momentum per (code, session_no, ret) row; a skipped session resets the key.

    State per key is the last session and at most max(windows) log returns.  A
    batch may carry several sessions of a key; they are taken in session order.
    """
    wins, keep = list(windows), max(windows)
    out = T.StructType([T.StructField("code", T.LongType()), T.StructField("session_no", T.IntegerType()), *[T.StructField(f"mom_{n}", T.DoubleType()) for n in wins]])
    names = out.fieldNames()

    def added(logs: list[float]) -> float:
        """The sum in row order, as a window adds; sum() would compensate."""
        return reduce(add, logs)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, logs = state.get if state.exists else (None, [])
        logs = list(logs)
        part = pd.concat(list(batches)).sort_values("session_no")
        done = []
        for no, r in zip(part["session_no"], part["ret"]):
            if last is None or no != last + 1:
                logs = []
            logs = (logs + [float(np.log(1 + r))])[-keep:]
            last = int(no)
            done.append((key[0], last, *[float(np.exp(added(logs[-n:])) - 1) if len(logs) >= n else None for n in wins]))
        state.update((last, logs))
        yield pd.DataFrame(done, columns=names)

    return rows.groupBy("code").applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)
