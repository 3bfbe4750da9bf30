"""Ledger and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog import sqltext as S
from tidemark.catalog.panels import TREND_DAY
from tidemark.catalog.registry import query
from tidemark.operators import ledger as G
from tidemark.operators.calendar import calendar_of
from tidemark.operators.panel import active_rows
from tidemark.plans.publishing import publish_stream_batches
from tidemark.sources import derive as D
from tidemark.sources.pointer import Publication
from tidemark.sources.staging import shared_dir
from tidemark.sources.streams import base_stream, forecast_streams
from tidemark.streaming import windows as W
from tidemark.streaming.history import streaming_momentum
from tidemark.streaming.settlement import ROCKSDB, settle_stream

SID = ["series_id"]
KEY = ["series_id", "trade_date"]
K = "series_id:s trade_date:d "
SK = ["stream_id", "series_id", "trade_date"]
SKS = "stream_id:s series_id:s trade_date:d "
CUT = "2000-06-30"


def frozen_and_provider(spark, d):
    i = D.index_series(spark, d).select("series_id", "trade_date", "open", "close", "vol")
    day = F.dayofmonth("trade_date")
    frozen = i.where(F.col("trade_date") <= CUT).where(~((day == 12) & (F.year("trade_date") == 1999))).withColumn("vol", F.when(day == 10, F.lit(None)).otherwise(F.col("vol")))
    provider = i.where(~((day == 11) & (F.year("trade_date") == 1998))).withColumn("close", F.when((day == 13) & (F.year("trade_date") == 1997), F.col("close") * 1.001).otherwise(F.col("close") * (1 + 1e-15)))
    return frozen, provider


_IN = f"trade_date <= DATE '{CUT}'"
DRIFT = f"""
fz AS (SELECT series_id, trade_date, open, close, CASE WHEN day(trade_date) = 10 THEN NULL ELSE vol END AS vol FROM idx WHERE {_IN} AND NOT (day(trade_date) = 12 AND year(trade_date) = 1999)),
pv AS (SELECT series_id, trade_date, open, CASE WHEN day(trade_date) = 13 AND year(trade_date) = 1997 THEN close*1.001 ELSE close END AS close, vol FROM idx WHERE NOT (day(trade_date) = 11 AND year(trade_date) = 1998))"""
_V = f"""SELECT 'missing' AS rule, series_id, trade_date FROM fz ANTI JOIN pv USING (series_id, trade_date)
 UNION ALL SELECT 'inserted', series_id, trade_date FROM pv ANTI JOIN fz USING (series_id, trade_date) WHERE {_IN}
 UNION ALL SELECT 'revised_close', f.series_id, f.trade_date FROM fz f JOIN pv p USING (series_id, trade_date) WHERE abs(p.close - f.close) > 1e-9*f.close"""


@query("g1_append_only_drift", K + "rule:s", S.with_(S.INDEX, DRIFT) + _V)
def g1(spark, d):
    """Missing, inserted and revised rows of a provider table against the frozen one."""
    f, p = frozen_and_provider(spark, d)
    return G.append_only_merge(f, p, KEY, "trade_date", ["open", "close", "vol"], ["vol"])[1]


@query("g1_append_rows", K + "close:f2", S.with_(S.INDEX, DRIFT) + f"SELECT p.series_id, p.trade_date, p.close FROM pv p WHERE NOT ({_IN})")
def g1n(spark, d):
    """Rows that may be appended."""
    f, p = frozen_and_provider(spark, d)
    return G.append_only_merge(f, p, KEY, "trade_date", ["open", "close", "vol"], ["vol"])[0]


@query("g2_late_optional_fill", K + "rule:s", S.with_(S.INDEX, DRIFT) + _V + " UNION ALL SELECT 'revised_vol', f.series_id, f.trade_date FROM fz f JOIN pv p USING (series_id, trade_date) WHERE f.vol IS NULL")
def g2(spark, d):
    """Without the tolerance a late answer to a frozen null is a revision."""
    f, p = frozen_and_provider(spark, d)
    return G.append_only_merge(f, p, KEY, "trade_date", ["open", "close", "vol"])[1]


def _num(c):
    power = f"floor(log10(abs({c})))"
    digits = f"CAST(floor(abs({c}) * pow(10.0, 14 - {power}) + 0.5) AS BIGINT)"
    return f"""'"{c}":"' || CASE WHEN {c} = 0 THEN '0' ELSE (CASE WHEN {c} < 0 THEN '-' ELSE '' END) || {digits} || 'e' || CAST({power} AS BIGINT) END || '"'"""


_FP = "sha256('{' || " + " || ',' || ".join([_num("calibrated_confidence"), _num("confidence"), _num("predicted_close"), "'\"predicted_label\":\"' || predicted_label || '\"'", _num("predicted_pct_change"), "'\"signal_date\":\"' || strftime(trade_date, '%Y%m%d') || '\"'"]) + " || '}')"


@query("g3_payload_fingerprint", SKS + "fingerprint:s", S.with_(S.STREAMS) + f"SELECT *, {_FP} AS fingerprint FROM streams")
def g3(spark, d):
    """Canonical payload hash of each forecast."""
    return G.forecast_fingerprint(forecast_streams(spark, d))


def ledger_pair(spark, d):
    """A ledger that ends early with one drifted and one absent row per stream, and the fresh candidate."""
    c = G.forecast_fingerprint(forecast_streams(spark, d))
    stored = c.where(F.col("trade_date") <= CUT).where(~((F.col("stream_id") == "level") & (F.dayofmonth("trade_date") == 15)))
    stored = stored.withColumn("fingerprint", F.when((F.col("stream_id") == "momentum") & (F.dayofmonth("trade_date") == 16), "other").otherwise(F.col("fingerprint")))
    return c, stored


PLAN = f"""
plan AS (SELECT *, CASE WHEN NOT ({_IN}) THEN 'new' WHEN stream_id = 'level' AND day(trade_date) = 15 THEN 'gap' WHEN stream_id = 'momentum' AND day(trade_date) = 16 THEN 'drifted' ELSE 'matching' END AS status FROM streams)"""


@query("g4_insert_plan", SKS + "status:s", S.with_(S.STREAMS, PLAN) + "SELECT * FROM plan")
def g4(spark, d):
    """Candidate rows classified against the ledger."""
    return G.insert_plan(*ledger_pair(spark, d), SK)


@query("g5_immutable_insert", SKS + "predicted_label:i", S.with_(S.STREAMS, PLAN) + "SELECT * FROM plan WHERE status = 'new' AND stream_id IN ('base', 'volume')")
def g5(spark, d):
    """Rows appended: new ones of streams without drift or gaps."""
    return G.rows_to_insert(G.insert_plan(*ledger_pair(spark, d), SK))


def targets(spark, d):
    from tidemark.functions.frames import ordered

    i = D.index_series(spark, d)
    return i.select("series_id", "trade_date", F.lead("trade_date").over(ordered(SID, "trade_date")).alias("target_date")), i


@query("g6_settlement", "stream_id:s series_id:s trade_date:d target_date:d actual_return:f settled_correct:b",
       S.with_(S.STREAMS) + "SELECT s.stream_id, s.series_id, s.trade_date, target_date, real_pct_change AS actual_return, correct AS settled_correct FROM streams s JOIN (SELECT series_id, trade_date, lead(trade_date) OVER (PARTITION BY series_id ORDER BY trade_date) AS target_date FROM idx) USING (series_id, trade_date) WHERE target_date IS NOT NULL")
def g6(spark, d):
    """Pending forecasts resolved by the close of their target session."""
    t, i = targets(spark, d)
    return G.settle(forecast_streams(spark, d).drop("real_pct_change", "correct"), t, i)


@query("g6_settlement_stream", "series_id:s trade_date:d target_date:d actual_return:f correct:b",
       S.with_(S.STREAMS) + "SELECT s.series_id, s.trade_date, target_date, real_pct_change AS actual_return, correct FROM base s JOIN (SELECT series_id, trade_date, lead(trade_date) OVER (PARTITION BY series_id ORDER BY trade_date) AS target_date FROM idx) USING (series_id, trade_date) WHERE target_date IS NOT NULL")
def g6s(spark, d):
    """The same in a stream: forecasts wait for their target session's close, which comes in a later batch and may be late."""
    t, i = targets(spark, d)
    root = f"{shared_dir(spark)}/landed/settle-{uuid.uuid4().hex}"
    ts = lambda c: F.col(c).cast("timestamp")
    f = base_stream(spark, d).drop("real_pct_change").join(t, KEY).where("target_date IS NOT NULL").select("series_id", ts("trade_date").alias("signal_at"), ts("target_date").alias("target_at"), F.col("close").alias("base_close"), "predicted_label")
    c = i.select("series_id", ts("trade_date").alias("close_at"), "close")
    for half in ("< '1999-01-01'", ">= '1999-01-01'"):  # two batches: forecasts of the first wait for closes of the second
        f.where(f"signal_at {half}").coalesce(1).write.mode("append").parquet(f"{root}/forecasts")
        c.where(f"close_at {half}").coalesce(1).write.mode("append").parquet(f"{root}/closes")
    streams = (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}") for table, name in ((f, "forecasts"), (c, "closes")))
    with W.setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        out = W.run_to_table(settle_stream(*streams), "settlement")
    return out.select("series_id", F.to_date("signal_at").alias("trade_date"), F.to_date("target_at").alias("target_date"), "actual_return", "correct")


def stamped(spark, d):
    """Forecasts with a generation time: evening of the signal day, late on some days, two days later on others."""
    t, _ = targets(spark, d)
    day = F.dayofmonth("trade_date")
    hours = F.when(day % 10 == 0, 6).when(day % 7 == 0, 72).otherwise(11)
    at = F.timestamp_seconds(F.unix_timestamp(F.col("trade_date").cast("timestamp")) + hours * 3600)
    return base_stream(spark, d).join(t, KEY).withColumn("created_at", at)


STAMP = """
stp AS (SELECT b.*, target_date, b.trade_date + to_hours(CASE WHEN day(b.trade_date) % 10 = 0 THEN 6 WHEN day(b.trade_date) % 7 = 0 THEN 72 ELSE 11 END) AS created_at, target_date + INTERVAL 90 MINUTE AS opens
  FROM base b JOIN (SELECT series_id, trade_date, lead(trade_date) OVER (PARTITION BY series_id ORDER BY trade_date) AS target_date FROM idx) USING (series_id, trade_date))"""


@query("g7_origin", K + "origin:s", S.with_(S.STREAMS, STAMP) + "SELECT *, CASE WHEN target_date IS NULL THEN 'unknown' WHEN created_at < opens THEN 'live' ELSE 'backfill' END AS origin FROM stp")
def g7(spark, d):
    """Live, backfill or unknown by the opening of the target session."""
    return stamped(spark, d).withColumn("origin", G.origin(F.col("created_at"), F.col("target_date")))


@query("g8_admission", K + "admitted:b", S.with_(S.STREAMS, STAMP) + "SELECT *, coalesce(((created_at + INTERVAL 8 HOUR)::DATE > trade_date OR ((created_at + INTERVAL 8 HOUR)::DATE = trade_date AND hour(created_at + INTERVAL 8 HOUR) >= 18)) AND created_at < opens, false) AS admitted FROM stp")
def g8(spark, d):
    """Forecasts generated inside their window."""
    return stamped(spark, d).withColumn("admitted", G.admitted(F.col("created_at"), F.col("trade_date"), F.col("target_date")))


@query("g9_provenance", K + "generated_at:t", S.with_(S.STREAMS, STAMP) + "SELECT series_id, trade_date, CASE WHEN day(trade_date) % 3 = 0 THEN TIMESTAMP '2002-01-01 00:00:00' ELSE created_at END AS generated_at FROM stp")
def g9(spark, d):
    """Earliest time of an identical earlier forecast."""
    s = G.forecast_fingerprint(stamped(spark, d))
    old = s.where("dayofmonth(trade_date) % 3 <> 0").select(*KEY, "fingerprint", "created_at")
    again = old.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 5 DAYS"))
    return G.inherited_times(s.drop("created_at"), old.unionByName(again), KEY, F.to_timestamp(F.lit("2002-01-01 00:00:00")))


@query("g10_context_extension", "trade_date:d close:f2", S.with_(S.STOCK) + f"SELECT trade_date, sum(amount)/sum(vol) AS close FROM stock WHERE trade_date > DATE '{CUT}' GROUP BY 1")
def g10(spark, d):
    """Only the sessions the frozen context lacks."""
    p = D.stock_panel(spark, d).groupBy("trade_date").agg((F.sum("amount") / F.sum("vol")).alias("close"))
    frozen = p.where(F.col("trade_date") <= CUT)
    return G.extend_context(frozen, p, calendar_of(p), ["close"])[0]


@query("g11_stateful_momentum", "code:i session_no:i mom_3:f mom_5:f mom_10:f", S.with_(S.DENSE, TREND_DAY) + "SELECT code, session_no, m3 AS mom_3, m5 AS mom_5, m10 AS mom_10 FROM tm")
def g11(spark, d):
    """Momentum kept in streaming state over several batches; the files of a code's earlier sessions are older."""
    p = D.dense_panel(spark, d)
    rows = active_rows(p).join(calendar_of(p), "trade_date").where("ret > -1").select("code", F.col("session_no").cast("int").alias("session_no"), "ret")
    root = f"{shared_dir(spark)}/landed/momentum-{uuid.uuid4().hex}"
    rows.where("session_no <= 15").repartition(8, "code").write.parquet(root)
    rows.where("session_no > 15").repartition(8, "code").write.mode("append").parquet(root)
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(root)
    return W.run_to_table(streaming_momentum(s, (3, 5, 10)), "momentum")


@query("g12_freshness", "series_id:s published_as_of:d expected_as_of:d fresh:b", S.with_(S.INDEX) + "SELECT series_id, max(trade_date) AS published_as_of, (SELECT max(trade_date) FROM ical WHERE trade_date <= DATE '2000-12-30') AS expected_as_of, max(trade_date) >= (SELECT max(trade_date) FROM ical WHERE trade_date <= DATE '2000-12-30') AS fresh FROM idx WHERE trade_date <= DATE '2000-12-30' AND NOT (series_id = '5-LOW' AND trade_date > DATE '2000-12-01') GROUP BY 1")
def g12(spark, d):
    """Published as-of session against the expected one before the publication hour."""
    i = D.index_series(spark, d)
    late = (F.col("series_id") == "5-LOW") & (F.col("trade_date") > "2000-12-01")
    return G.freshness(i.where((F.col("trade_date") <= "2000-12-30") & ~late), calendar_of(i), F.to_timestamp(F.lit("2000-12-31 17:29:00")), 17, 30, SID)


@query("g13_idempotent_publish", SKS + "predicted_label:i", S.with_(S.STREAMS) + f"SELECT * FROM streams WHERE NOT ({_IN})")
def g13(spark, d):
    """Rows a repeated publish adds after the first one stopped early."""
    s = forecast_streams(spark, d)
    return G.publish_once(s.unionByName(s), s.where(F.col("trade_date") <= CUT), SK)


@query("g14_atomic_streams", "series_id:s dates:i incomplete_dates:i publish:b", S.with_(S.STREAMS) + "SELECT series_id, count(*) AS dates, sum((n <> 4)::INT) AS incomplete_dates, sum((n <> 4)::INT) = 0 AS publish FROM (SELECT series_id, trade_date, count(DISTINCT stream_id) AS n FROM streams WHERE NOT (series_id = '2-HIGH' AND stream_id = 'volume' AND pos % 50 = 0) GROUP BY 1, 2) GROUP BY 1")
def g14(spark, d):
    """Series whose streams all carry the same dates."""
    s = forecast_streams(spark, d)
    gone = (F.col("series_id") == "2-HIGH") & (F.col("stream_id") == "volume") & (F.col("pos") % 50 == 0)
    return G.atomic_dates(s.where(~gone), "stream_id", SID, "trade_date", 4)


@query("g14_atomic_publish", SKS + "predicted_label:i published:b", S.with_(S.STREAMS) + "SELECT stream_id, series_id, trade_date, predicted_label, series_id <> '2-HIGH' AS published FROM streams WHERE NOT (series_id = '2-HIGH' AND stream_id = 'volume' AND pos % 50 = 0)")
def g14p(spark, d):
    """Micro-batches of all streams published by pointer, each series with all its streams or not at all; a replay adds nothing."""
    s = forecast_streams(spark, d).select("stream_id", "series_id", "trade_date", "pos", "predicted_label")
    gone = (F.col("series_id") == "2-HIGH") & (F.col("stream_id") == "volume") & (F.col("pos") % 50 == 0)
    root = f"{shared_dir(spark)}/landed/atomic-{uuid.uuid4().hex}"
    s.where(~gone).repartition(4, "series_id").write.parquet(f"{root}/incoming")
    table = Publication(spark, f"{root}/published")
    for attempt in ("first", "replayed"):
        incoming = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/incoming")
        publish_stream_batches(incoming, table, f"{root}/progress-{attempt}", SID, "stream_id", 4)
    return table.read("streams").withColumn("published", F.lit(True)).unionByName(table.read("withheld").withColumn("published", F.lit(False)))


@query("g15_catch_up", K.strip(), S.with_(S.INDEX) + "SELECT b.series_id, c.trade_date FROM (SELECT series_id, min(trade_date) AS a FROM idx GROUP BY 1) b JOIN ical c ON c.trade_date >= b.a AND c.trade_date <= DATE '2000-12-31' ANTI JOIN idx i ON i.series_id = b.series_id AND i.trade_date = c.trade_date")
def g15(spark, d):
    """Open sessions the ledger lacks up to a moment."""
    i = D.index_series(spark, d).select("series_id", "trade_date")
    return G.missed_sessions(calendar_of(i), i, F.to_timestamp(F.lit("2000-12-31 20:00:00")), SID)


_WM = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"
_OHLC = "arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS vol, sum(value) AS amount"
_BS = "event_type:s bar_start:t bar_end:t open:f high:f low:f close:f vol:i amount:f4"


@query("g16_tumbling_bars", _BS, f"SELECT *, bar_start + INTERVAL 30 MINUTE AS bar_end FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS bar_start, {_OHLC} FROM events GROUP BY 1, 2) WHERE bar_start + INTERVAL 30 MINUTE <= {_WM}")
def g16(spark, d):
    """Half-hour bars of the event stream that the watermark has closed."""
    return W.run_to_table(W.tumbling_bars(W.event_stream(spark, d)), "bars")


@query("g16_sliding_bars", _BS, f"SELECT *, bar_start + INTERVAL 1 HOUR AS bar_end FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30*o) AS bar_start, {_OHLC} FROM events, (VALUES (0), (1)) s(o) GROUP BY 1, 2) WHERE bar_start + INTERVAL 1 HOUR <= {_WM}")
def g16s(spark, d):
    """Hourly bars every half hour."""
    return W.run_to_table(W.tumbling_bars(W.event_stream(spark, d), "1 hour", slide="30 minutes"), "sliding")


@query("g16_user_sessions", "user_id:i session_start:t session_end:t events:i amount:f4", f"""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, sum(value) AS amount FROM (SELECT *, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_WM}""")
def g16g(spark, d):
    """Activity sessions that the watermark has closed."""
    return W.run_to_table(W.user_sessions(W.event_stream(spark, d)), "sessions")


@query("g17_reseed_history", K + "close:f2 conflicts:i", S.with_(S.INDEX) + f"SELECT series_id, trade_date, close, (SELECT count(*) FROM idx WHERE {_IN} AND day(trade_date) = 13 AND year(trade_date) = 1997) AS conflicts FROM idx")
def g17(spark, d):
    """Pinned history joined by newer rows, with the count of changed values."""
    i = D.index_series(spark, d).select("series_id", "trade_date", "close")
    changed = (F.dayofmonth("trade_date") == 13) & (F.year("trade_date") == 1997)
    out, bad = G.reseed(i.where(F.col("trade_date") <= CUT), i.withColumn("close", F.when(changed, F.col("close") + 1).otherwise(F.col("close"))), KEY, "trade_date", ["close"])
    return out.withColumn("conflicts", bad.agg(F.count("*")).scalar())


@query("g18_replay_verification", SKS + "rule:s", S.with_(S.STREAMS, PLAN) + "SELECT *, CASE status WHEN 'drifted' THEN 'different' ELSE 'not_in_ledger' END AS rule FROM plan WHERE status <> 'matching'")
def g18(spark, d):
    """Replayed forecasts that are not identical in the ledger."""
    c, stored = ledger_pair(spark, d)
    return G.replay_differences(c, stored, SK)


@query("g19_compatible_upgrade", "stream_id:s rows:i differences:i compatible:b", S.with_(S.STREAMS, PLAN) + f"SELECT stream_id, count(*) FILTER (status IN ('matching', 'drifted')) AS rows, count(*) FILTER (status IN ('drifted', 'gap')) AS differences, count(*) FILTER (status IN ('drifted', 'gap')) = 0 AS compatible FROM plan WHERE {_IN} GROUP BY 1")
def g19(spark, d):
    """Streams whose every row equals the old ledger."""
    c, stored = ledger_pair(spark, d)
    return G.upgrade_verdict(c.where(F.col("trade_date") <= CUT), stored, SK, ["stream_id"])


@query("g20_shadow_stream", "series_id:s trade_date:d public_label:i shadow_label:i agrees:b", S.with_(S.STREAMS) + "SELECT b.series_id, b.trade_date, b.predicted_label AS public_label, m.predicted_label AS shadow_label, b.predicted_label = m.predicted_label AS agrees FROM base b JOIN streams m USING (series_id, trade_date) WHERE m.stream_id = 'momentum'")
def g20(spark, d):
    """A shadow stream kept in its own partition and read beside the public one."""
    path = f"{shared_dir(spark)}/landed/shadow-{uuid.uuid4().hex}"
    s = forecast_streams(spark, d).where(F.col("stream_id").isin("base", "momentum"))
    s.hint("rebalance", F.col("stream_id")).write.partitionBy("stream_id").parquet(path)
    t = spark.read.parquet(path)
    shadow = t.where("stream_id = 'momentum'").select(*KEY, F.col("predicted_label").alias("shadow_label"))
    public = t.where("stream_id = 'base'").select(*KEY, F.col("predicted_label").alias("public_label"))
    return public.join(shadow, KEY).withColumn("agrees", F.col("public_label") == F.col("shadow_label"))
