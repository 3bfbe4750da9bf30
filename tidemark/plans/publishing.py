"""Publishing forecasts: one stream in ordered, restartable steps, several streams in one atomic batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.frames import ordered
from tidemark.operators import ledger as G
from tidemark.sources import scan as A
from tidemark.sources.pointer import Files, Publication


class PublishRefused(RuntimeError):
    """A check failed; nothing became visible."""


class Journal:
    """Steps of a run that are done, one small file each, in order.

    A step's result is what its file says, so a run that was killed continues
    after the last file.  A step that was killed half-way runs again and must
    overwrite what it left.
    """

    def __init__(self, spark: SparkSession, root: str, run: str):
        self.files, self.folder = Files(spark), f"{root.rstrip('/')}/journal/{run}"

    def done(self) -> list[str]:
        return [n.removesuffix(".json").split("-", 1)[1] for n in self.files.names(self.folder) if n.endswith(".json")]

    def run(self, steps: Sequence[tuple[str, Callable[[dict], dict | None]]]) -> dict:
        """Run the steps that have no file yet; each is given the facts of all before it."""
        facts: dict = {}
        for number, (name, step) in enumerate(steps):
            path = f"{self.folder}/{number:02d}-{name}.json"
            if not self.files.exists(path):
                self.files.create(path, json.dumps(step(facts) or {}, sort_keys=True))
            facts |= json.loads(self.files.read(path))
        return facts


def _refuse_any(bad: DataFrame, what: str) -> None:
    first = bad.limit(5).collect()
    if first:
        raise PublishRefused(f"{what}: {[tuple(r) for r in first]}")


def publish_stream(spark: SparkSession, root: str, run: str, provider: DataFrame, calendar: DataFrame, forecast: Callable[[DataFrame], DataFrame], keys: Sequence[str],
                   columns: Sequence[str], generated_at: str | None = None) -> Publication:
    """Publish one stream's forecasts for the sessions that `provider` adds.

    Steps, each recorded before the next: merge the provider's rows into the
    published history (which may only grow), check that every session is there,
    compare the replayed forecasts with the ledger, archive the snapshot and its
    manifest, stage the new ledger rows, settle what is pending, move the
    pointer.  Snapshot, ledger and outcomes become visible by the last step
    alone.  A refused run leaves the version before it; a run that is repeated
    after the pointer moved adds nothing.  provider: keys, trade_date and columns,
    close among them; calendar: the sessions every series must have, numbered;
    forecast(history) gives keys, trade_date, close and the forecast columns with
    a fingerprint.
    """
    publication, journal = Publication(spark, root), Journal(spark, root, run)
    date = "trade_date"
    keys, day = list(keys), [*keys, date]
    rows = provider.select(*day, *columns)
    staged = lambda name: spark.read.parquet(publication.path(run, name))

    def history() -> DataFrame:
        old = publication.read("history")
        new = staged("history")
        return new if old is None or publication.published(run) else old.unionByName(new)

    def snapshot(_):
        old = publication.read("history")
        new, bad = (rows, None) if old is None else G.append_only_merge(old, rows, day, date, columns)
        if bad is not None:
            _refuse_any(bad, "history changed")
        publication.write(run, {"history": new})
        as_of = staged("history").agg(F.max(date).cast("string")).first()[0] or publication.pointer()["facts"].get("as_of")
        return {"as_of": as_of}

    def complete(facts):
        _refuse_any(G.missed_sessions(calendar, history(), F.lit(facts["as_of"]).cast("date"), keys), "sessions missing")

    def plan(_):
        ledger = publication.read("ledger")
        made = forecast(history())
        if ledger is not None:
            made = G.insert_plan(made, ledger, day, date)
            _refuse_any(made.where("status IN ('drifted', 'gap')").select(*day, "status"), "forecasts differ from the ledger")
            made = made.where("status = 'new'").drop("status")
        at = F.lit(generated_at).cast("timestamp") if generated_at else F.current_timestamp()
        publication.write(run, {"ledger": made.withColumn("run_id", F.lit(run)).withColumn("generated_at", at)})

    def archive(facts):
        folder = f"{publication.root}/archive/{run}"
        if Files(spark).exists(folder):
            Files(spark).delete(folder)
        A.write_snapshot(staged("history").withColumn("as_of", F.lit(facts["as_of"]).cast("date")), f"{folder}/features", "as_of")
        manifest = A.file_manifest(spark, f"{folder}/features")
        manifest.write.parquet(f"{folder}/manifest")
        return {"archived_files": spark.read.parquet(f"{folder}/manifest").count()}

    def outcomes(_):
        new, old = staged("ledger"), publication.read("ledger")
        pending = new if old is None else old.unionByName(new)
        settled = publication.read("outcomes")
        if settled is not None:
            pending = pending.join(settled.select(*day), day, "left_anti")
        closes = history().select(*day, "close")
        following = closes.select(*day, F.lead(date).over(ordered(keys, date)).alias("target_date"))
        found = G.settle(pending, following, closes, keys)
        publication.write(run, {"outcomes": found.select(*day, "target_date", "actual_close", "actual_return", "settled_correct", F.lit(run).alias("settled_by"))})

    def pointer(facts):
        return {"version": publication.commit(run, ["history", "ledger", "outcomes"], {"as_of": facts["as_of"], "run": run})}

    journal.run([("snapshot", snapshot), ("calendar", complete), ("ledger", plan), ("archive", archive), ("settlement", outcomes), ("pointer", pointer)])
    return publication


def published_forecasts(publication: Publication, keys: Sequence[str]) -> DataFrame:
    """Visible forecasts with their outcomes, pending ones with nulls."""
    day = [*keys, "trade_date"]
    return publication.read("ledger").join(publication.read("outcomes"), day, "left")


def publish_streams(publication: Publication, batch: str, rows: DataFrame, keys: Sequence[str], stream: str, members: int, date: str = "trade_date") -> None:
    """Publish a batch of several streams: of each key all streams with equal dates, or none.

    Withheld rows are kept in the batch beside the published ones.  Both become
    visible with one pointer; a repeated batch id changes nothing.
    """
    if publication.published(batch):
        return
    verdict = G.atomic_dates(rows, stream, keys, date, members)
    judged = rows.join(verdict.select(*keys, "publish"), list(keys))
    publication.write(batch, {"streams": judged.where("publish").drop("publish"), "withheld": judged.where("NOT publish").drop("publish")})
    publication.commit(batch, ["streams", "withheld"])


def publish_stream_batches(incoming: DataFrame, publication: Publication, progress: str, keys: Sequence[str], stream: str, members: int) -> None:
    """Publish every micro-batch of a stream of forecasts until the input is drained.

    The batch id is the publication's name for the micro-batch: one that is
    replayed after a crash, before or after its pointer, is published once.
    """

    def publish(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            publish_streams(publication, f"micro-{number:09d}", rows, keys, stream, members)
        finally:
            rows.unpersist()

    query = incoming.writeStream.foreachBatch(publish).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
