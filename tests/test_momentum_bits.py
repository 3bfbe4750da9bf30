"""Momentum to the last bit of its SQL: prices over many orders of magnitude, and events without a time."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.harness import compare
from tidemark.catalog import load, registry

SOURCE = "/root/testdata/sf0.1/events.parquet"
TABLES = {
    # one event a user and day, so that no order of addition enters
    "wide": f"SELECT * REPLACE (value * power(10, (event_id % 13)::DOUBLE) AS value) FROM '{SOURCE}' QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) = 1",
    "timeless": f"SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS ts) FROM '{SOURCE}'",
}


@pytest.mark.parametrize("kind", TABLES)
@pytest.mark.parametrize("name", ["w9_consecutive_momentum", "g11_stateful_momentum"])
def test_equals_its_sql(spark, tmp_path, name, kind):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"COPY ({TABLES[kind]}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    queries, sql = load()
    verdict = compare(spark, con, str(tmp_path), name, queries[name], sql[name])
    assert verdict.startswith("ok"), verdict


def test_sign_of_a_return_to_the_same_price(spark):
    """Whether a price that comes back counts as up follows the last bits of three logarithms."""
    from tidemark.operators.calendar import calendar_of
    from tidemark.operators.panel import consecutive_momentum
    from pyspark.sql import functions as F

    rng, rows = np.random.default_rng(3), []
    for code in range(2000):
        a, b, c = np.round(rng.exponential(50, 3) + 0.01, 2)
        rows += [(code, d, float(p)) for d, p in enumerate((a, b, c, a))]
    prices = spark.createDataFrame(rows, "code bigint, d int, px double").select("code", F.expr("date_add(DATE '2024-01-01', d)").alias("trade_date"), "px")
    before = F.expr("lag(px) OVER (PARTITION BY code ORDER BY trade_date)")
    stock = prices.select("code", "trade_date", F.lit("SH").alias("market"), F.lit(1.0).alias("vol"), F.col("px").alias("amount"), (100 * (F.col("px") / before - 1)).alias("pct_chg"))
    got = {r.code: r.mom_3 for r in consecutive_momentum(stock, calendar_of(stock), (3,)).where("mom_3 IS NOT NULL").collect()}
    con = duckdb.connect()
    con.register("p", pa.table({"code": [r[0] for r in rows], "d": [r[1] for r in rows], "px": [r[2] for r in rows]}))
    want = dict(con.sql("""WITH r AS (SELECT *, 100*(px/lag(px) OVER (PARTITION BY code ORDER BY d) - 1)/100 AS ret FROM p)
        SELECT code, exp(sum(ln(1 + ret)) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) - 1 FROM r WHERE ret IS NOT NULL QUALIFY d = 3""").fetchall())
    assert got == want and len(want) == 2000


def test_rounds_as_its_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=50_000) * 10.0 ** rng.uniform(-9, 17, 50_000)
    x = np.concatenate((x, rng.integers(-(10**6), 10**6, 5000) / 128, [0.0, -0.0, 1e308, -1e308, np.inf, -np.inf, np.nan, 1e-320, 5e-7, -5e-7]))
    pq.write_table(pa.table({"i": np.arange(len(x)), "a": x, "b": x, "c": x}), f"{tmp_path}/x.parquet")
    spec = "i:i a:f b:f2 c:f4"
    got = sorted(map(tuple, registry.shape(spark.read.parquet(f"{tmp_path}/x.parquet"), spec).collect()))
    assert got == sorted(duckdb.sql(registry.shape_sql(f"SELECT * FROM '{tmp_path}/x.parquet'", spec)).fetchall())
