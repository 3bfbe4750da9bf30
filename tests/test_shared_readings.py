"""What a job derives from its inputs, and how often."""

import duckdb
from pyspark.sql import functions as F

from tests.harness import duck
from tidemark.catalog import sqltext as S
from tidemark.sources import derive as D
from tidemark.sources import staging

ROOT = "/root/testdata/sf0.001"


def _names(monkeypatch):
    made = []
    real = staging.stage

    def stage(df, name, **options):
        made.append(name)
        return real(df, name, **options)

    monkeypatch.setattr(staging, "stage", stage)
    return made


def test_a_job_derives_a_table_once(spark, monkeypatch):
    made = _names(monkeypatch)
    with staging.one_reading():
        a = D.index_series(spark, ROOT)
        with staging.one_reading():
            assert D.index_series(spark, ROOT) is a
    assert made == ["index"] and D.index_series(spark, ROOT) is not a and made == ["index", "index"]


def test_extremes_of_quotes_sort_no_lines(spark):
    lines = D.table(spark, ROOT, "lineitem").select("*", F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("trade_date"))
    plan = D.quote_days(lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_closing_line_among_lines_of_one_order(spark, tmp_path):
    """All lines of a session in few orders: the close is still settled by line, part, supplier and price."""
    con = duck(ROOT)
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey % 2 AS l_orderkey, l_linenumber % 2 AS l_linenumber, l_partkey % 3 AS l_partkey) FROM '{ROOT}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    cols = ["asset", "trade_date", "low", "high", "close", "ticks", "ask"]
    want = sorted(con.sql(S.with_(S.EXTERNAL) + f"SELECT {', '.join(cols)} FROM ext").fetchall())
    got = sorted(tuple(r) for r in D.external_series(spark, str(tmp_path)).select(*cols).collect())
    assert got == want


def test_the_fixed_candidate_is_a_stream_of_the_portfolio(spark):
    from tidemark.catalog import learning as LQ

    keep = ["series_id", "pos", "predicted_label", "calibrated_confidence", "correction_selected"]
    one = LQ.portfolio(spark, ROOT, ["moneyflow_price"]).where("stream_id = 'moneyflow_price'").select(*keep).collect()
    all_ = LQ.portfolio(spark, ROOT).where("stream_id = 'moneyflow_price'").select(*keep).collect()
    key = lambda r: (r.series_id, r.pos)
    assert len(one) > 0 and sorted(one, key=key) == sorted(all_, key=key)


def test_the_quote_family_groups_its_orders_once(spark, monkeypatch):
    from tidemark.catalog import load

    made = _names(monkeypatch)
    assert load()[0]["e15_fx_family"](spark, ROOT).where("variant = 'control'").count() == 5
    assert made.count("external") == 1 and made.count("index") == 1


def test_core_stream_derives_its_bars_once(spark, monkeypatch):
    from tidemark.catalog import learning as LQ

    made = _names(monkeypatch)
    LQ.core_stream(spark, ROOT)
    LQ.context_stream(spark, ROOT)
    assert made.count("index") == 2


def test_closing_lines_without_an_order(spark, tmp_path):
    """Sessions all of whose lines lack an order keep their close beside sessions whose last order is known; so do tables without any order."""
    for name, lost in (("some", "day(l_shipdate) % 2 = 0"), ("all", "true")):
        root = tmp_path / name
        root.mkdir()
        duck(ROOT).execute(f"COPY (SELECT * REPLACE (CASE WHEN NOT ({lost}) THEN l_orderkey END AS l_orderkey) FROM '{ROOT}/lineitem.parquet') TO '{root}/lineitem.parquet' (FORMAT parquet)")
        days = D.table(spark, str(root), "lineitem").selectExpr("l_returnflag", "to_date(l_shipdate) AS day").distinct().count()
        got = D.external_series(spark, str(root))
        assert got.count() == days and got.where("close IS NULL OR close NOT BETWEEN low AND high").count() == 0


def test_attempts_look_up_their_series_once_a_block(spark, monkeypatch):
    """The columns of an attempt's series come from one row of the block, not from one lookup for every attempt."""
    import pandas as pd
    from pyspark.sql import types as T

    from tidemark.operators import walkforward as L

    got = {}

    class Groups:
        def applyInPandas(self, run, out):
            got["run"] = run

    class Folded:
        schema = T.StructType([T.StructField("series_id", T.StringType())])

        def select(self, *names):
            return self

    monkeypatch.setattr(L, "_blocks", lambda *a: None)
    monkeypatch.setattr(L, "_groups", lambda *a: Groups())
    L.nested_attempts(Folded(), ["series_id"], {"base": ["a"]}, thresholds=(0.4, 0.5), minimum=20, block_rows=10)
    n = 200
    part = pd.DataFrame({"series_id": "s", "pos": range(n), "trade_date": pd.date_range("1995-01-01", periods=n).date, "fold_known": True, "fold_target": [float(i % 3 == 0) for i in range(n)],
                         "anchor_pos": [float(i - i % 5) for i in range(n)], "predicted_label": 1, "real_pct_change": [-0.1 if i % 3 == 0 else 0.1 for i in range(n)], "a": [float(i * 7 % 11) for i in range(n)], "_own": False})
    part = pd.concat([part, part[part["pos"] >= 150].assign(_own=True)])
    looked = []
    real = type(part.iloc).__getitem__
    monkeypatch.setattr(type(part.iloc), "__getitem__", lambda self, key: (looked.append(key), real(self, key))[1])
    out = got["run"](part)
    assert len(out) == 10 * 3 * 3 * 2 and set(out["series_id"]) == {"s"} and len(looked) < 10
    assert out["last_validation_date"].max() == part["trade_date"].iloc[194]
