"""Rank selection and span-cut joins against plain computations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators.asof import asof_join, range_expand
from tidemark.operators.ranks import aggregate_with_quantiles, flag_top, tenth


@pytest.fixture(scope="module")
def skewed(spark):
    """One day holds most rows; a third of its values are equal."""
    rng = np.random.default_rng(5)
    rows = []
    for day, n in ((1, 3000), (2, 40), (3, 1)):
        v = rng.normal(size=n).round(2)
        v[: n // 3] = 0.25
        rows += [(day, int(c), float(x)) for c, x in zip(rng.permutation(n), v)]
    return spark.createDataFrame(rows, "day int, code long, v double").cache()


def test_quantiles_equal_the_aggregate(skewed):
    q = [(f"q{i}", F.col("v"), p) for i, p in enumerate((0.0, .01, .25, .5, .9, 1.0))] + [("c", F.col("code"), .5)]
    got = {r.day: r for r in aggregate_with_quantiles(skewed, ["day"], [F.count("*").alias("n")], q).collect()}
    want = {r.day: r for r in skewed.groupBy("day").agg(F.count("*").alias("n"), *[F.percentile(x, F.lit(p)).alias(n) for n, x, p in q]).collect()}
    for d in want:
        assert list(got[d]) == pytest.approx(list(want[d]), abs=1e-12)


@pytest.mark.parametrize("values", [[*range(30), float("nan")], [float("inf"), float("-inf"), 1.0, -2.0, 0.0] * 5, [None] * 4, [7.0] * 9])
def test_quantiles_of_odd_values(spark, values):
    df = spark.createDataFrame([(1, None if v is None else float(v)) for v in values], "day int, v double")
    q = [(f"q{i}", F.col("v"), p) for i, p in enumerate((0.0, .25, .5, 1.0))]
    got = aggregate_with_quantiles(df, ["day"], [F.count("*").alias("n")], q).first()
    want = df.groupBy("day").agg(F.count("*").alias("n"), *[F.percentile(x, F.lit(p)).alias(n) for n, x, p in q]).first()
    assert repr(got) == repr(want)


@pytest.mark.parametrize("odd", ["none", "nan", "string", "nulls"])
def test_leading_part_equals_row_number(skewed, odd):
    df = skewed.withColumn("v", F.when(F.col("code") == 7, float("nan")).otherwise(F.col("v"))) if odd == "nan" else skewed
    df = df.withColumn("code", F.concat(F.lit("shared-prefix-"), F.lpad("code", 6, "0"))) if odd == "string" else df
    df = df.withColumn("v", F.when(F.pmod("code", F.lit(5)) > 0, F.col("v"))) if odd == "nulls" else df
    w = Window.partitionBy("day")
    want = df.where("v IS NOT NULL").withColumn("r", F.row_number().over(w.orderBy(F.desc("v"), "code"))).withColumn("n", F.count("v").over(w)).where(F.col("r") <= tenth(F.col("n")))
    got = flag_top(df, ["day"], "v", "code", tenth).where("is_top")
    assert sorted(got.select("day", "code").collect()) == sorted(want.select("day", "code").collect())


def test_contested_tie_at_the_edge(spark):
    df = spark.createDataFrame([(1, c, 1.0) for c in range(100)], "day int, code long, v double")
    got = flag_top(df, ["day"], "v", "code", tenth).where("is_top").select("code").collect()
    assert sorted(r.code for r in got) == list(range(10))


def test_repeated_tie_keys_are_flagged_together(spark):
    df = spark.createDataFrame([(1, 5, 1.0)] * 30 + [(1, 6, 1.0)] * 30, "day int, code long, v double")
    got = flag_top(df, ["day"], "v", "code", tenth).where("is_top").select("code").collect()
    assert [r.code for r in got] == [5] * 30


def test_value_buckets_keep_order(spark):
    xs = sorted([float("-inf"), float("inf"), -1e9, -3.0, -1e-300, 0.0, 5e-324, 1e-9, .1, .1000001, 7.0, 1e300])
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    b = [r[0] for r in df.select(ranks._bucket(df, "x")).collect()]
    assert b == sorted(b) and len(set(b)) > 8


@pytest.mark.parametrize("strict", [True, False])
def test_span_cut_asof_equals_plain(spark, strict):
    rng = np.random.default_rng(9)
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(int(k), t0 + dt.timedelta(hours=int(h)), i) for i, (k, h) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 2400, 300)))], "k int, t timestamp, id int")
    right = spark.createDataFrame([(k, t0 + dt.timedelta(hours=int(h)), float(h)) for k in range(3) for h in rng.choice(2400, 40, replace=False)], "k int, rt timestamp, x double")
    got = [sorted(map(str, asof_join(left, right, ["k"], "t", "rt", ["x"], strict, span_days=s).collect())) for s in (None, 5)]
    assert got[0] == got[1]


def test_range_expand_equals_brute_force(spark):
    a = spark.createDataFrame([("s", p) for p in (0, 3, 17, 40)], "k string, anchor_pos int")
    h = spark.createDataFrame([("s", p) for p in range(45)], "k string, pos int")
    got = sorted((r.anchor_pos, r.pos) for r in range_expand(a, h, ["k"], 10).collect())
    assert got == sorted((x, p) for x in (0, 3, 17, 40) for p in range(45) if x - 10 <= p < x)
