"""Staged tables: a derived panel that several branches read is written once.

Without staging every branch of a plan re-derives its input, because branches
prune different columns and Spark cannot reuse their exchanges.  A staged table
is columnar parquet in the shared folder named by spark.checkpoint.dir: branches
read only their columns, the optimiser knows its size, and a lost executor
re-reads files instead of recomputing lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_job: list[dict] = []  # tables of the job that shares its readings, if one runs


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def leave_with_session(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder when it ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)  # noqa: SLF001


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder (with the writer's options) and return a scan of the written files, which last as long as the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    leave_with_session(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


@contextmanager
def one_reading() -> Iterator[None]:
    """Queries run inside derive each kept table once from an input folder and share it; the next job reads the folder again."""
    if _job:
        yield
        return
    _job.append({})
    try:
        yield
    finally:
        _job.pop()


def shares_readings() -> bool:
    return bool(_job)


def kept(name: str) -> Callable:
    """Stage what a function of (spark, root) derives, once for all queries of a job that shares its readings."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(fn)
        def table(spark: SparkSession, root: str) -> DataFrame:
            if not _job:
                return stage(fn(spark, root), name)
            at = (name, root)
            if at not in _job[0]:
                _job[0][at] = stage(fn(spark, root), name)
            return _job[0][at]

        return table

    return wrap


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again; what was computed from them must have been written."""
    for table in staged:
        target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)  # noqa: SLF001
        target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001
