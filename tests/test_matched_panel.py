"""Stock, flow and capitalisation by one grouping of the lines."""

from pyspark.sql import functions as F

from tidemark.operators.panel import active_rows, matched_flow
from tidemark.sources import derive as D

ROOT = "/root/testdata/sf0.001"


def test_one_grouping_gives_what_the_joins_give(spark):
    keys, root = ["code", "trade_date"], "/root/testdata/sf0.01"  # its codes leave holes in flow and capitalisation
    s = D.stock_panel(spark, root)
    joined = s.join(D.flow_panel(spark, root), keys, "left").join(D.cap_panel(spark, root, s), keys, "left")
    one = D.matched_panel(spark, root)
    assert sorted(one.columns) == sorted(joined.columns)
    shown = [F.col(c).cast("string") if c in ("code", "trade_date", "market") else F.round(c, 6).alias(c) for c in joined.columns]
    want, got = joined.select(*shown), one.select(*shown)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert not one.where(F.col(D.AMOUNTS[0]).isNull()).isEmpty() and not one.where(F.col("total_mv").isNull()).isEmpty()


def test_nothing_is_joined_on_code_and_session(spark):
    plan = matched_flow(D.matched_panel(spark, ROOT))._jdf.queryExecution().optimizedPlan().toString()
    bare = active_rows(D.stock_panel(spark, ROOT))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == bare.count("Join ") == 1


def test_coverage_keeps_a_single_join(spark):
    from tidemark.catalog import load

    plan = load()[0]["j15_three_way_coverage"](spark, ROOT)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
