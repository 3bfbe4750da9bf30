"""Publication by pointer: what a reader sees when a writer is killed, repeated or refused."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ledger import forecast_fingerprint
from tidemark.plans import publishing as PB
from tidemark.sources import scan as A
from tidemark.sources.pointer import Files, Publication

KEYS = ["series_id"]
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]


class Killed(Exception):
    pass


def bars(spark, upto, close=10.0):
    return spark.createDataFrame([("s", DAYS[k], close + k) for k in range(upto)], "series_id string, trade_date date, close double")


def calendar(spark):
    return spark.createDataFrame([(d, k) for k, d in enumerate(DAYS)], "trade_date date, session_no int")


def forecast(history, shift=0.0):
    f = history.withColumn("predicted_label", (F.dayofmonth("trade_date") % 2).cast("int")).withColumn("predicted_pct_change", F.lit(0.01 + shift))
    f = f.withColumn("predicted_close", F.col("close") * 1.01).withColumn("confidence", F.lit(0.6)).withColumn("calibrated_confidence", F.lit(0.55))
    return forecast_fingerprint(f)


def publish(spark, root, run, upto, make=forecast, **kw):
    return PB.publish_stream(spark, root, run, bars(spark, upto, **kw), calendar(spark), make, KEYS, ["close"], generated_at="2024-02-01 00:00:00")


def seen(publication):
    return sorted(map(tuple, PB.published_forecasts(publication, KEYS).select("trade_date", "run_id", "actual_return", "settled_by").collect()))


def expected(upto, runs):
    """Rows after runs that each ended before a position: who added a row, and who settled it."""
    by = lambda k: next(name for name, end in runs if k < end)
    return [(DAYS[k], by(k), pytest.approx((10.0 + k + 1) / (10.0 + k) - 1) if k + 1 < upto else None, by(k + 1) if k + 1 < upto else None) for k in range(upto)]


def test_runs_add_rows_and_settle_once(spark, tmp_path):
    root = str(tmp_path)
    assert seen(publish(spark, root, "one", 5)) == expected(5, [("one", 5)])
    two = publish(spark, root, "two", 9)
    want = expected(9, [("one", 5), ("two", 9)])
    assert seen(two) == want
    assert seen(publish(spark, root, "two", 9)) == want
    assert seen(publish(spark, root, "three", 9)) == want
    assert two.versions() == [1, 2, 3]
    assert sorted(r.trade_date for r in two.read("ledger", version=1).collect()) == DAYS[:5]


@pytest.mark.parametrize("step", ["history", "ledger", "outcomes", "pointer"])
def test_a_killed_run_shows_nothing_and_continues(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    before = seen(publish(spark, root, "one", 5))
    write, commit = Publication.write, Publication.commit

    def dies(self, batch, tables):
        write(self, batch, tables)
        if step in tables:
            raise Killed

    def dies_before_commit(self, *a, **kw):
        raise Killed

    monkeypatch.setattr(Publication, "write", dies)
    if step == "pointer":
        monkeypatch.setattr(Publication, "commit", dies_before_commit)
    with pytest.raises(Killed):
        publish(spark, root, "two", 9)
    assert seen(Publication(spark, root)) == before
    monkeypatch.setattr(Publication, "write", write)
    monkeypatch.setattr(Publication, "commit", commit)
    done = PB.Journal(spark, root, "two").done()
    assert seen(publish(spark, root, "two", 9)) == expected(9, [("one", 5), ("two", 9)])
    assert PB.Journal(spark, root, "two").done()[: len(done)] == done


def test_refusals_leave_the_last_version(spark, tmp_path):
    root = str(tmp_path)
    before = seen(publish(spark, root, "one", 5))
    with pytest.raises(PB.PublishRefused, match="history changed"):
        publish(spark, root, "revised", 7, close=11.0)
    with pytest.raises(PB.PublishRefused, match="differ from the ledger"):
        publish(spark, root, "drift", 7, make=lambda h: forecast(h, 0.5))
    gap = bars(spark, 9).where(F.col("trade_date") != DAYS[6])
    with pytest.raises(PB.PublishRefused, match="sessions missing"):
        PB.publish_stream(spark, root, "gap", gap, calendar(spark), forecast, KEYS, ["close"])
    assert seen(Publication(spark, root)) == before


def test_archive_matches_its_manifest(spark, tmp_path):
    publish(spark, str(tmp_path), "one", 5)
    folder = f"{tmp_path}/archive/one"
    assert A.manifest_differences(spark.read.parquet(f"{folder}/manifest"), A.file_manifest(spark, f"{folder}/features")).count() == 0
    assert spark.read.parquet(f"{folder}/manifest").count() >= 1 and spark.read.parquet(f"{folder}/features").where("year = 2024 AND month = 1 AND day = 5").count() == 5


def test_streams_of_a_killed_batch_stay_hidden(spark, tmp_path, monkeypatch):
    table = Publication(spark, str(tmp_path))
    rows = spark.createDataFrame([(s, k, DAYS[0]) for s in ("a", "b") for k in ("x", "y")] + [("a", "z", DAYS[0])], "stream string, series_id string, trade_date date")
    PB.publish_streams(table, "first", rows, KEYS, "stream", 2)
    show = lambda t: sorted((r.stream, r.series_id) for r in table.read(t).collect())
    assert show("streams") == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")] and show("withheld") == [("a", "z")]
    commit = Publication.commit
    monkeypatch.setattr(Publication, "commit", lambda *a, **kw: (_ for _ in ()).throw(Killed()))
    later = rows.withColumn("trade_date", F.lit(DAYS[1]))
    with pytest.raises(Killed):
        PB.publish_streams(table, "second", later, KEYS, "stream", 2)
    assert table.read("streams").count() == 4 and table.versions() == [1]
    monkeypatch.setattr(Publication, "commit", commit)
    for _ in range(2):
        PB.publish_streams(table, "second", later, KEYS, "stream", 2)
    assert table.read("streams").count() == 8 and table.versions() == [1, 2]


def test_two_writers_take_different_versions(spark, tmp_path, monkeypatch):
    a, b = Publication(spark, str(tmp_path)), Publication(spark, str(tmp_path))
    a.write("a", {"t": spark.range(1)})
    b.write("b", {"t": spark.range(2)})
    stale, pointer = a.pointer(), Publication.pointer
    assert b.commit("b", ["t"]) == 1
    answers = iter([stale])
    monkeypatch.setattr(Publication, "pointer", lambda self, version=None: next(answers, None) or pointer(self, version))
    assert a.commit("a", ["t"]) == 2
    monkeypatch.setattr(Publication, "pointer", pointer)
    assert a.read("t").count() == 3


def test_manifest_does_not_depend_on_splits(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    blob = bytes(range(256)) * 900
    contents = {"a.bin": blob, "b.bin": blob + b"\n", "none.bin": b"x" * 5000, "lines.bin": b"\n" * 700}
    for name, content in contents.items():
        (root / name).write_bytes(content)
    read = lambda: dict((r.file, (r.length, r.sha256)) for r in A.file_manifest(spark, str(root), "*.bin", leaf_bytes=4096, fan=4).collect())
    whole = read()
    former = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        assert read() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", former)
    assert {n: v[0] for n, v in whole.items()} == {n: len(c) for n, c in contents.items()}
    assert len({v[1] for v in whole.values()}) == len(contents)
    changed = bytearray(blob)
    changed[100_000] ^= 1
    (root / "a.bin").write_bytes(changed)
    swapped = b"".join([blob[256:512], blob[:256], blob[512:]])
    (root / "lines.bin").unlink()
    (root / "swapped.bin").write_bytes(swapped)
    now = read()
    assert now["a.bin"] != whole["a.bin"] and now["b.bin"] == whole["b.bin"] and "lines.bin" not in now and now["swapped.bin"][1] not in {v[1] for v in whole.values()}


def test_files_move_and_refuse_a_taken_name(spark, tmp_path):
    files = Files(spark)
    assert files.create(f"{tmp_path}/x/one.json", "1") and not files.create(f"{tmp_path}/x/one.json", "2")
    assert files.read(f"{tmp_path}/x/one.json") == "1" and [n for n in files.names(f"{tmp_path}/x") if not n.startswith(".")] == ["one.json"]
    files.move(f"{tmp_path}/x/one.json", f"{tmp_path}/y/two.json")
    assert files.names(f"{tmp_path}/nowhere") == [] and files.exists(f"{tmp_path}/y/two.json")
