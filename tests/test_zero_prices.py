"""Users whose amount of a day is zero: returns from that day are infinite, as in the checking SQL."""

import duckdb
import pytest

from tests.harness import TABLES, compare
from tidemark.catalog import load

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def zeroed(tmp_path_factory):
    """The smallest tables, a seventh of its user days without any amount."""
    root = tmp_path_factory.mktemp("zeroed")
    con = duckdb.connect()
    for t in TABLES:
        columns = "* REPLACE (CASE WHEN (user_id*31 + day(ts)) % 7 = 0 THEN 0.0 ELSE value END AS value)" if t == "events" else "*"
        con.execute(f"COPY (SELECT {columns} FROM '{ROOT}/{t}.parquet') TO '{root}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return str(root), con


@pytest.mark.parametrize("name", ["a3_state_transitions", "a13_trend_breadth", "w9_consecutive_momentum", "g11_stateful_momentum", "f2_distribution_features", "f16_trend_features", "a14_intraday_path", "e18_all_panels"])
def test_a_day_of_zero_amount_is_no_error(spark, zeroed, name):
    root, con = zeroed
    queries, sql = load()
    verdict = compare(spark, con, root, name, queries[name], sql[name])
    assert verdict.startswith("ok"), verdict


def test_quotient_of_doubles(spark):
    from tidemark.functions.scalars import quotient
    from pyspark.sql import functions as F

    rows = spark.sql("SELECT * FROM VALUES (1D, 0D), (-1D, 0D), (0D, 0D), (NULL, 0D), (1D, NULL), (3D, 2D) AS t(a, b)")
    got = [str(r[0]) for r in rows.select(quotient(F.col("a"), F.col("b"))).collect()]
    assert got == ["inf", "-inf", "nan", "None", "None", "1.5"]
