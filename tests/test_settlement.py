"""Settlement by stream settles what settlement by batch does, however late the target session comes."""

from datetime import date

from tidemark.catalog import load

ROOT = "/root/testdata/sf0.001"


def test_stream_settles_what_batch_settles(spark):
    queries, _ = load()
    cols = ["series_id", "trade_date", "target_date"]
    batch = queries["g6_settlement"](spark, ROOT).where("stream_id = 'base'")
    want = {tuple(r[:3]): (r[3], r[4]) for r in batch.select(*cols, "actual_return", "settled_correct").collect()}
    rows = queries["g6_settlement_stream"](spark, ROOT).select(*cols, "actual_return", "correct").collect()
    got = {tuple(r[:3]): (r[3], r[4]) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert any((date.fromisoformat(str(k[2])) - date.fromisoformat(str(k[1]))).days > 14 for k in got)
    assert all(got[k] == v or abs(float(got[k][0]) - float(v[0])) < 1e-9 and got[k][1] == v[1] for k, v in want.items())


def test_late_targets_settle_and_overdue_ones_expire_once(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.streaming import windows as W
    from tidemark.streaming.settlement import ROCKSDB, settle_stream

    day = lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    forecasts = [[("a", day(0), day(1), 10.0, 1), ("a", day(1), day(60), 11.0, 0), ("a", day(2), day(3), 5.0, 1), ("b", day(2), day(3), 8.0, 1)], [("a", day(200), day(201), 4.0, 0)], [("a", day(400), day(401), 4.0, 1)], [("a", day(401), day(402), 4.0, 1)]]
    closes = [[("a", day(0), 10.0), ("a", day(1), 11.0)], [("a", day(60), 5.5), ("a", day(199), 3.0)], [("a", day(399), 3.0)], [("a", day(401), 5.0)]]
    kinds = {"forecasts": "series_id string, signal_at timestamp, target_at timestamp, base_close double, predicted_label int", "closes": "series_id string, close_at timestamp, close double"}
    for batch in range(4):
        for (name, kind), rows in zip(kinds.items(), (forecasts, closes)):
            spark.createDataFrame(rows[batch], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/{name}") for name, kind in kinds.items()]
    with W.setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        out = W.run_to_table(settle_stream(*streams), "expiry")
    got = sorted(((r.series_id, r.signal_at - day(0)).__repr__(), None if r.actual_return is None else round(r.actual_return, 6), r.correct) for r in out.collect())
    key = lambda s, k: repr((s, timedelta(days=k)))
    want = {key("a", 0): (0.1, True), key("a", 1): (-0.5, True), key("a", 2): (None, None), key("b", 2): (None, None), key("a", 200): (None, None), key("a", 400): (0.25, True)}
    assert got == sorted((k, *v) for k, v in want.items())
