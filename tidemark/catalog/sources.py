"""Source, sink, normalisation and quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import sqltext as S
from tidemark.catalog.joins import LIVE
from tidemark.catalog.panels import slotted
from tidemark.catalog.registry import query
from tidemark.functions import scalars as N
from tidemark.functions.frames import ordered
from tidemark.operators import joins as J
from tidemark.operators import panel as P
from tidemark.operators import quality as V
from tidemark.operators import series as Q
from tidemark.operators.calendar import calendar_of, covered_sessions, invalid_calendar
from tidemark.plans.features import PUBLICATION
from tidemark.sources import derive as D
from tidemark.sources import scan as C
from tidemark.sources.pointer import Files
from tidemark.sources.staging import shared_dir, stage
from tidemark.sources.streams import base_stream, forecast_streams

SID = ["series_id"]
K = "series_id:s trade_date:d "
IDX = S.with_(S.INDEX)
BAR = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("trade_date", T.DateType()), *[T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close")]])


def landing(spark, name):
    """A fresh folder for files a query lands before scanning them."""
    return f"{shared_dir(spark)}/landed/{name}-{uuid.uuid4().hex}"


def bars(spark, d):
    return D.index_series(spark, d).select("series_id", "trade_date", "open", "high", "low", "close")


@query("s1_feature_scan", K + "open:f2 close:f2", IDX + "SELECT * FROM idx")
def s1(spark, d):
    """CSV scan with a declared schema returns the written floats."""
    path = landing(spark, "csv")
    C.write_csv(bars(spark, d), path)
    return C.read_table(spark, path, BAR)


@query("s2_raw_day_scan", "file_session:s rows:i", IDX + "SELECT strftime(trade_date, '%Y%m%d') AS file_session, count(*) AS rows FROM idx GROUP BY 1")
def s2(spark, d):
    """One compressed file per session, dates checked against the file paths."""
    path = landing(spark, "days")
    days = bars(spark, d).withColumn("session", F.date_format("trade_date", "yyyyMMdd"))
    days.repartition("session").write.partitionBy("session").option("header", True).option("compression", "gzip").csv(path)
    good, _ = C.read_raw_days(spark, path, BAR)
    return good.groupBy("file_session").agg(F.count("*").alias("rows"))


@query("s3_multi_file_union", "series_id:s rows:i", IDX + "SELECT series_id, count(*) AS rows FROM idx GROUP BY 1")
def s3(spark, d):
    """Several landed files scanned as one table."""
    b = bars(spark, d)
    paths = [landing(spark, n) for n in ("early", "late")]
    C.write_csv(b.where("trade_date < '1998-01-01'"), paths[0])
    C.write_csv(b.where("trade_date >= '1998-01-01'"), paths[1])
    return C.read_table(spark, paths, BAR).groupBy("series_id").agg(F.count("*").alias("rows"))


@query("s4_dataset_resolver", "dataset:s series_id:s rows:i", IDX + "SELECT 'merged' AS dataset, series_id, count(*) AS rows FROM idx GROUP BY 2")
def s4(spark, d):
    """Merged table used where no raw table was landed."""
    root = landing(spark, "saved")
    bars(spark, d).write.parquet(f"{root}/merged")
    name, df = C.resolve_dataset(spark, root, ["raw", "merged", "features"])
    return df.groupBy("series_id").agg(F.count("*").alias("rows")).withColumn("dataset", F.lit(name))


def pages(spark, d):
    b = bars(spark, d)
    return [b.where("dayofmonth(trade_date) <= 10"), b.where("dayofmonth(trade_date) BETWEEN 10 AND 31")]


@query("s5_page_assembly", K + "rule:s", IDX + """SELECT series_id, trade_date, rule FROM (SELECT series_id, trade_date, CASE WHEN day(trade_date) = 10 THEN 'duplicate' WHEN trade_date NOT BETWEEN '1995-06-01' AND '2000-12-31' THEN 'range' ELSE 'kept' END AS rule FROM idx
  UNION ALL SELECT series_id, trade_date, 'duplicate' FROM idx WHERE day(trade_date) = 10)""")
def s5(spark, d):
    """Page files joined up; duplicate and out-of-range rows set apart."""
    good, bad = C.assemble_pages(pages(spark, d), ["series_id", "trade_date"], "trade_date", "1995-06-01", "2000-12-31")
    return good.withColumn("rule", F.lit("kept")).unionByName(bad)


@query("s6_series_completeness", "series_id:s first_date:d last_date:d longest_gap:i complete:b",
       IDX + "SELECT *, first_date - DATE '1995-01-01' <= 7 AND DATE '2001-08-01' - last_date <= 7 AND longest_gap <= 7 AS complete FROM (SELECT series_id, min(trade_date) AS first_date, max(trade_date) AS last_date, max(g) AS longest_gap FROM (SELECT *, trade_date - lag(trade_date) OVER (PARTITION BY series_id ORDER BY trade_date) AS g FROM idx) GROUP BY 1)")
def s6(spark, d):
    """Whether a landed series covers its range without long gaps."""
    return V.truncated(bars(spark, d), SID, "trade_date", "1995-01-01", "2001-08-01")


@query("s7_csv_sink", "series_id:s rows:i total:f2", IDX + "SELECT series_id, count(*) AS rows, sum(close) AS total FROM idx GROUP BY 1")
def s7(spark, d):
    """CSV sink read back without loss."""
    path = landing(spark, "sink")
    C.write_csv(bars(spark, d), path)
    return C.read_table(spark, path, BAR).groupBy("series_id").agg(F.count("*").alias("rows"), F.sum("close").alias("total"))


@query("s8_snapshot_sink", "year:i month:i day:i rows:i", IDX + "SELECT year(trade_date) AS year, month(trade_date) AS month, day(trade_date) AS day, count(*) AS rows FROM idx GROUP BY 1, 2, 3")
def s8(spark, d):
    """Immutable snapshot by year, month and day."""
    path = landing(spark, "snapshot")
    C.write_snapshot(bars(spark, d), path)
    return spark.read.parquet(path).groupBy("year", "month", "day").agg(F.count("*").alias("rows"))


@query("s9_file_manifest", "folder:s rule:s files:i",
       IDX + "SELECT 'year=' || y AS folder, rule, 1 AS files FROM (SELECT min(year(trade_date)) AS a, max(year(trade_date)) AS z FROM idx), (VALUES ('changed'), ('missing'), ('unexpected')) t(rule), LATERAL (SELECT CASE rule WHEN 'changed' THEN a WHEN 'missing' THEN z ELSE 0 END AS y)")
def s9(spark, d):
    """Landed files against their manifest after one was altered, one was lost and one was added."""
    path, other = landing(spark, "hashed"), landing(spark, "altered")
    day = bars(spark, d).withColumn("year", F.year("trade_date"))
    day.repartition(1).write.partitionBy("year").parquet(path)
    stored = stage(C.file_manifest(spark, path), "manifest")
    files = Files(spark)
    years = [n for n in files.names(path) if n.startswith("year=")]
    first, last = f"{path}/{years[0]}", f"{path}/{years[-1]}"
    day.where(F.col("year") == int(years[0].removeprefix("year="))).withColumn("close", F.col("close") + 1).drop("year").coalesce(1).write.parquet(other)
    part = lambda folder: next(n for n in files.names(folder) if n.endswith(".parquet"))
    files.move(f"{other}/{part(other)}", f"{first}/{part(first)}")
    files.move(f"{last}/{part(last)}", f"{path}/year=0/added.parquet")
    return C.manifest_differences(stored, C.file_manifest(spark, path)).groupBy(F.element_at(F.split("file", "/"), 1).alias("folder"), "rule").agg(F.count("*").alias("files"))


@query("s10_reuse_landed_days", "trade_date:d", IDX + "SELECT trade_date FROM idx GROUP BY 1 HAVING day(trade_date) % 5 IN (0, 1)")
def s10(spark, d):
    """Days that were not landed or whose content changed since."""
    day = D.index_series(spark, d).groupBy("trade_date").agg(C.content_hash("series_id", "close").alias("sha256"))
    landed = day.where("dayofmonth(trade_date) % 5 <> 0").withColumn("sha256", F.when(F.dayofmonth("trade_date") % 5 == 1, "stale").otherwise(F.col("sha256")))
    return C.days_to_fetch(day, landed, ["trade_date"])


@query("s11_public_projection", "stream_id:s series_id:s signal_date:d record_type:s direction:s predicted_return:f actual_return:f",
       S.with_(S.STREAMS) + "SELECT stream_id, series_id, trade_date AS signal_date, CASE WHEN real_pct_change IS NULL THEN 'pending' ELSE 'validated' END AS record_type, CASE predicted_label WHEN 1 THEN 'up' ELSE 'down' END AS direction, predicted_pct_change AS predicted_return, real_pct_change AS actual_return FROM streams")
def s11(spark, d):
    """Public view of validated and pending forecasts."""
    return C.public_projection(forecast_streams(spark, d))


@query("s12_json_records", "stream_id:s series_id:s signal_date:d record:s",
       S.with_(S.STREAMS) + """SELECT stream_id, series_id, trade_date AS signal_date, '{"direction":"' || CASE predicted_label WHEN 1 THEN 'up' ELSE 'down' END || '","record_type":"' || CASE WHEN real_pct_change IS NULL THEN 'pending' ELSE 'validated' END || '","correct":' || coalesce(correct::VARCHAR, 'null') || '}' AS record FROM streams""")
def s12(spark, d):
    """Public rows as JSON objects with explicit nulls."""
    return C.json_records(C.public_projection(forecast_streams(spark, d)), ["direction", "record_type", "correct"])


@query("s13_calendar_coverage", "trade_date:d", IDX + "SELECT trade_date FROM ical WHERE trade_date BETWEEN '1997-01-01' AND '1997-12-31'")
def s13(spark, d):
    """Open sessions of a year whose every calendar day is known."""
    o = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("cal_date")).distinct().withColumn("is_open", F.lit(1))
    b = o.agg(F.min("cal_date").alias("a"), F.max("cal_date").alias("z"))
    days = b.select(F.explode(F.sequence("a", "z")).alias("cal_date")).join(o, "cal_date", "left").fillna(0, ["is_open"])
    return covered_sessions(days, "1997-01-01", "1997-12-31")


@query("s13_calendar_validation", "rule:s cal_date:d", IDX + "SELECT CASE WHEN day(trade_date) = 7 THEN 'flag' ELSE 'duplicate' END AS rule, trade_date AS cal_date FROM ical WHERE day(trade_date) IN (7, 8)")
def s13v(spark, d):
    """Invalid flags and repeated days of a calendar."""
    o = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("cal_date")).distinct()
    o = o.withColumn("is_open", F.when(F.dayofmonth("cal_date") == 7, 2).otherwise(1))
    return invalid_calendar(o.unionByName(o.where("dayofmonth(cal_date) = 8")))


@query("s14_lineage_check", "table:s input:s",
       "SELECT unnest(['breadth', 'distribution']) AS \"table\", input FROM (SELECT DISTINCT 'stock/' || strftime(l_shipdate, '%Y-%m') AS input FROM lineitem WHERE day(l_shipdate) = 13 AND year(l_shipdate) = 1995)")
def s14(spark, d):
    """Months of a table that changed after two tables were derived from them, by the content hashes recorded then and those in use."""
    rows = D.table(spark, d, "lineitem").select(F.concat(F.lit("stock/"), F.date_format("l_shipdate", "yyyy-MM")).alias("table"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_extendedprice")
    hashes = lambda r: r.groupBy("table").agg(C.content_hash("day", "l_orderkey", "l_linenumber", "l_extendedprice").alias("sha256"))
    revised = (F.dayofmonth("day") == 13) & (F.year("day") == 1995)
    used = hashes(rows).select(F.col("table").alias("input"), "sha256", F.explode(F.array(F.lit("breadth"), F.lit("distribution"))).alias("table"))
    return C.lineage_mismatch(used, hashes(rows.withColumn("l_extendedprice", F.when(revised, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice")))))


@query("p1_alias_resolution", "vendor:s series_id:s trade_date:d open:f2 close:f2 pre_close:f2 vol:f",
       IDX + "SELECT vendor, series_id, trade_date, open, close, pre_close, vol FROM idx, (VALUES ('terminal'), ('site'), ('plain')) v(vendor)")
def p1(spark, d):
    """Exports of three vendors under their own spellings, resolved to canonical names."""
    i = D.index_series(spark, d)
    spelled = {
        "terminal": {"trade_date": "TRADE_DT", "open": "S_DQ_OPEN", "close": "s_dq_close", "pre_close": "S_DQ_PRECLOSE", "vol": "S_DQ_VOLUME"},
        "site": {"trade_date": "日期", "open": "今开", "close": "最新价", "pre_close": "昨收", "vol": "成交量"},
        "plain": {"trade_date": "opdate", "open": "adj_open", "close": "Adj_Close", "pre_close": "previous_close", "vol": " Volume "},
    }
    parts = None
    for vendor, names in spelled.items():
        export = i.select("series_id", *[F.col(c).alias(n) for c, n in names.items()])
        one = C.resolve_aliases(export, {"series_id": ("series_id",), **C.ALIASES}).withColumn("vendor", F.lit(vendor))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("p2_majority_layout", K + "parsed:d", IDX + "SELECT series_id, trade_date, CASE WHEN day(trade_date) <= 27 THEN trade_date END AS parsed FROM idx")
def p2(spark, d):
    """Text dates parsed by the layout most rows follow."""
    i = bars(spark, d).withColumn("text", F.when(F.dayofmonth("trade_date") <= 27, F.concat(F.date_format("trade_date", "yyyyMMdd"), F.lit(".0"))).otherwise(F.date_format("trade_date", "yyyy-MM-dd")))
    return C.parse_majority(i, "text")


@query("p3_strict_session", K + "session:i parsed:d", IDX + "SELECT series_id, trade_date, strftime(trade_date, '%Y%m%d')::INT AS session, CASE WHEN month(trade_date) <> 12 THEN trade_date END AS parsed FROM idx")
def p3(spark, d):
    """Eight-digit sessions only."""
    i = bars(spark, d)
    text = F.when(F.month("trade_date") == 12, F.date_format("trade_date", "yyyy-MM-dd")).otherwise(F.date_format("trade_date", "yyyyMMdd"))
    return i.select("series_id", "trade_date", N.session_int(F.col("trade_date")).alias("session"), N.to_session(text).alias("parsed"))


@query("p4_canonical_features", "rule:s series_id:s trade_date:d", IDX + "SELECT 'low_positive' AS rule, series_id, trade_date FROM idx WHERE day(trade_date) = 13 UNION ALL SELECT 'range', series_id, trade_date FROM idx WHERE day(trade_date) = 14")
def p4(spark, d):
    """Rows that break the price rules of the canonical table."""
    i = bars(spark, d).withColumn("low", F.when(F.dayofmonth("trade_date") == 13, -F.col("low")).when(F.dayofmonth("trade_date") == 14, F.col("high") * 2).otherwise(F.col("low")))
    return C.canonical_features(i)[1]


@query("p5_last_row_per_date", K + "close:f2 arrival:i", IDX + "SELECT series_id, trade_date, CASE WHEN day(trade_date) = 5 THEN NULL ELSE close + 1 END AS close, 2 AS arrival FROM idx")
def p5(spark, d):
    """Infinities nulled, the last arrival per date kept."""
    i = bars(spark, d).select("series_id", "trade_date", "close")
    late = F.when(F.dayofmonth("trade_date") == 5, F.lit(float("inf"))).otherwise(F.col("close") + 1)
    both = i.withColumn("arrival", F.lit(1)).unionByName(i.withColumn("close", late).withColumn("arrival", F.lit(2)))
    return C.last_per_date(both, ["series_id", "trade_date"], "arrival", ["close"])


_REP = "rp AS (SELECT *, CASE WHEN day(trade_date) % 2 = 0 THEN high ELSE lag(close) OVER (PARTITION BY series_id ORDER BY trade_date) END AS pc FROM idx)"


def repaired(spark, d):
    i = D.index_series(spark, d).withColumn("pre_close", F.when(F.dayofmonth("trade_date") % 2 == 0, F.col("high")).otherwise(0.0))
    return C.repaired_prices(i, SID)


@query("p6_pre_close_repair", K + "pre_close:f2", S.with_(S.INDEX, _REP) + "SELECT series_id, trade_date, pc AS pre_close FROM rp")
def p6(spark, d):
    """Supplied previous close, else the row before."""
    return repaired(spark, d)


@query("p7_derived_changes", K + "change:f2 pct_chg:f swing:f", S.with_(S.INDEX, _REP) + "SELECT series_id, trade_date, close - pc AS change, (close/pc - 1)*100 AS pct_chg, (high - low)/pc*100 AS swing FROM rp")
def p7(spark, d):
    """Change, percent change and swing."""
    return repaired(spark, d)


@query("p8_next_session_target", K + "target_next_return:f target_next_direction:i", IDX + "SELECT *, r AS target_next_return, (r > 0)::INT AS target_next_direction FROM (SELECT *, lead(close) OVER (PARTITION BY series_id ORDER BY trade_date)/close - 1 AS r FROM idx)")
def p8(spark, d):
    """Return to the next session and its direction."""
    return Q.next_session_target(D.index_series(spark, d), SID)


_PB = ["ret1", "ret5", "vol20", "gap", "intraday", "range", "vol_chg"]


@query("p9_price_block", K + " ".join(f"x_{n}_lag1:f" for n in _PB), S.with_(S.INDEX, f"""a AS (SELECT *, {S.growth('close', 1, 'series_id', 'trade_date')} AS ret1 FROM idx),
b AS (SELECT series_id, trade_date, ret1, {S.growth('close', 5, 'series_id', 'trade_date')} AS ret5, {S.full('stddev_samp', 'ret1', 20, 'series_id', 'trade_date')} AS vol20, open/pre_close - 1 AS gap, close/open - 1 AS intraday, (high - low)/pre_close AS "range",
  ln(vol) - lag(ln(vol)) OVER (PARTITION BY series_id ORDER BY trade_date) AS vol_chg FROM a)""") + "SELECT series_id, trade_date, " + ", ".join(f'lag("{n}") OVER (PARTITION BY series_id ORDER BY trade_date) AS x_{n}_lag1' for n in _PB) + " FROM b")
def p9(spark, d):
    """Price feature block lagged and renamed."""
    return Q.price_features(D.index_series(spark, d), SID, "x_", lag=C.default_lag(True, "after_close"))


_AWAY = "('1-URGENT', '2-HIGH')"


@query("p10_default_lag_policy", K + "prediction_time:s lag:i close_known:f2", IDX + f"""SELECT series_id, trade_date, 'after_close' AS prediction_time, CASE WHEN series_id IN {_AWAY} THEN 1 ELSE 0 END AS lag,
  CASE WHEN series_id IN {_AWAY} THEN lag(close, 1) OVER w ELSE close END AS close_known FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY trade_date)
UNION ALL SELECT series_id, trade_date, 'before_open', CASE WHEN series_id IN {_AWAY} THEN 2 ELSE 1 END, CASE WHEN series_id IN {_AWAY} THEN lag(close, 2) OVER w ELSE lag(close, 1) OVER w END FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY trade_date)""")
def p10(spark, d):
    """The close that may be used on each date at each forecast time; two of the series are foreign markets."""
    i = D.index_series(spark, d)
    foreign = F.expr(f"series_id IN {_AWAY}")
    w = ordered(SID, "trade_date")

    def known(is_foreign, when):
        n = C.default_lag(is_foreign, when)
        return F.struct(F.lit(when).alias("prediction_time"), F.lit(n).alias("lag"), F.lag("close", n).over(w).alias("close_known"))

    rows = i.select(*SID, "trade_date", *[F.when(foreign, known(True, t)).otherwise(known(False, t)).alias(t) for t in ("after_close", "before_open")])
    return rows.select(*SID, "trade_date", F.explode(F.array("after_close", "before_open")).alias("x")).select(*SID, "trade_date", "x.*")


@query("p11_date_range", K + "close:f2", IDX + "SELECT * FROM idx WHERE trade_date BETWEEN '1997-03-01' AND '1998-02-28'")
def p11(spark, d):
    """Rows of a date range; the bounds reach the scan."""
    o = D.table(spark, d, "orders").where("o_orderdate >= '1997-03-01' AND o_orderdate < '1998-03-01'")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("trade_date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


@query("p12_unit_conversion", "code:i trade_date:d ret:f vol_hands:f amount_thousand:f", S.with_(S.STOCK) + "SELECT code, trade_date, pct_chg/100 AS ret, vol/100 AS vol_hands, amount/1000 AS amount_thousand FROM stock")
def p12(spark, d):
    """Percent to fraction, shares to hands, yuan to thousands."""
    return D.stock_panel(spark, d).select("code", "trade_date", (F.col("pct_chg") / 100).alias("ret"), (F.col("vol") / 100).alias("vol_hands"), (F.col("amount") / 1000).alias("amount_thousand"))


@query("p13_period_keys", "year:i month:s rows:i", IDX + "SELECT year(trade_date) AS year, strftime(trade_date, '%Y%m') AS month, count(*) AS rows FROM idx GROUP BY 1, 2")
def p13(spark, d):
    """Year and month keys of sessions."""
    return bars(spark, d).groupBy(F.year("trade_date").alias("year"), F.date_format("trade_date", "yyyyMM").alias("month")).agg(F.count("*").alias("rows"))


@query("p14_contract_code", "ts_code:s product:s month_index:i rows:i", S.with_(S.FUTURES) + "SELECT ts_code, product, (2000 + substr(ts_code, 3, 2)::INT)*12 + substr(ts_code, 5, 2)::INT AS month_index, count(*) AS rows FROM fut GROUP BY 1, 2, 3")
def p14(spark, d):
    """Product and delivery month of contract codes."""
    rx = r"^(IF|IC)(\d{2})(\d{2})\.CFX$"
    g = lambda i: F.regexp_extract("ts_code", rx, i)
    return D.futures_daily(spark, d).groupBy("ts_code").agg(F.count("*").alias("rows")).select("ts_code", "rows", g(1).alias("product"), ((2000 + g(2).cast("int")) * 12 + g(3).cast("int")).alias("month_index"))


@query("p15_local_time", "event_id:i local_time:t", "SELECT event_id, date_trunc('second', ts) + CASE WHEN event_id % 2 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END AS local_time FROM events")
def p15(spark, d):
    """Mixed stamps to Shanghai wall-clock time; naive stamps are local already."""
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return D.table(spark, d, "events").select("event_id", C.local_times(F.when(F.col("event_id") % 2 == 0, F.concat(t, F.lit("Z"))).otherwise(t)).alias("local_time"))


@query("p16_affixes", K + "x_open_lag1:f2 x_close_lag1:f2", IDX + "SELECT series_id, trade_date, open AS x_open_lag1, close AS x_close_lag1 FROM idx")
def p16(spark, d):
    """Prefix and suffix on a column set, columns dropped by prefix."""
    i = bars(spark, d).withColumnsRenamed({"high": "old_high", "low": "old_low"})
    return C.affixed(i, ["series_id", "trade_date"], "x_", "_lag1", "old_")


def broken(spark, d):
    """Index bars with declared defects on fixed days of the month."""
    day = F.dayofmonth("trade_date")
    i = D.index_series(spark, d)
    i = i.withColumn("close", F.when(day == 3, F.lit(float("nan"))).otherwise(F.col("close"))).withColumn("vol", F.when(day == 4, -F.col("vol")).otherwise(F.col("vol"))).withColumn("low", F.when(day == 6, F.col("high") + 1).otherwise(F.col("low")))
    return i.unionByName(i.where(day == 9))


@query("v1_required_columns", "series_id:s column:s rows_lacking:i rows:i", IDX + """SELECT series_id, c AS "column", CASE c WHEN 'close' THEN count_if(day(trade_date) = 3) WHEN 'open' THEN 0 ELSE count(*) END AS rows_lacking, count(*) AS rows
  FROM (SELECT * FROM idx UNION ALL SELECT * FROM idx WHERE day(trade_date) = 9), (VALUES ('open'), ('close'), ('pct_chg'), ('turnover')) t(c) GROUP BY 1, 2""")
def v1(spark, d):
    """Rows of each series that lack a declared column's value; a column that the table lacks is lacking in all."""
    i = broken(spark, d)
    declared = ["open", "close", "pct_chg", "turnover"]
    gone = V.missing_columns(i, declared)
    lacking = [F.count_if(F.lit(c in gone) if c in gone else F.col(c).isNull() | F.isnan(c)).alias(c) for c in declared]
    n = i.groupBy("series_id").agg(F.count("*").alias("rows"), *lacking)
    return n.select("series_id", "rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows_lacking")) for c in declared])).alias("x")).select("series_id", "rows", "x.*")


@query("v2_unique_key", K + "rows:i", IDX + "SELECT series_id, trade_date, 2 AS rows FROM idx WHERE day(trade_date) = 9")
def v2(spark, d):
    """Keys that occur more than once."""
    return V.duplicate_keys(broken(spark, d), ["series_id", "trade_date"])


@query("v3_expected_date", "expected:d series_id:s rows:i", IDX + "SELECT trade_date - day(trade_date)::INT + 1 AS expected, series_id, count(*) AS rows FROM idx WHERE day(trade_date) <> 1 GROUP BY 1, 2")
def v3(spark, d):
    """Rows whose date is not the one their partition declares."""
    i = bars(spark, d).withColumn("expected", F.trunc("trade_date", "month").cast("date"))
    return i.where(F.col("trade_date") != F.col("expected")).groupBy("expected", "series_id").agg(F.count("*").alias("rows"))


@query("v4_code_pattern", "ts_code:s", S.with_(S.FUTURES) + "SELECT DISTINCT replace(ts_code, '.CFX', '.XFC') AS ts_code FROM fut WHERE product = 'IC'")
def v4(spark, d):
    """Codes outside the supported pattern."""
    f = D.futures_daily(spark, d).select(F.when(F.col("ts_code").startswith("IC"), F.regexp_replace("ts_code", "CFX", "XFC")).otherwise(F.col("ts_code")).alias("ts_code")).distinct()
    return f.where(~F.col("ts_code").rlike(r"^(IF|IC)\d{4}\.CFX$"))




@query("v5_numeric_rules", "rule:s series_id:s trade_date:d", IDX + "SELECT 'close_finite' AS rule, series_id, trade_date FROM idx WHERE day(trade_date) = 3 UNION ALL SELECT 'vol_nonnegative', series_id, trade_date FROM idx WHERE day(trade_date) = 4")
def v5(spark, d):
    """Non-finite and negative values."""
    return V.flag_rows(broken(spark, d), {"close_finite": V.finite("close"), "vol_nonnegative": F.col("vol") >= 0}, ["series_id", "trade_date"])


@query("v6_bounded_fractions", "rule:s series_id:s trade_date:d", S.with_(S.STREAMS) + "SELECT 'confidence_spread' AS rule, series_id, trade_date FROM base WHERE 2*confidence - 1 > 0.3 UNION ALL SELECT 'return_bound', series_id, trade_date FROM base WHERE abs(real_pct_change) > 1 OR real_pct_change IS NULL")
def v6(spark, d):
    """Fractions and spreads outside their bounds; unknown counts as a violation."""
    return V.flag_rows(base_stream(spark, d), {"confidence_spread": (2 * F.col("confidence") - 1).between(-0.3, 0.3), "return_bound": F.col("real_pct_change").between(-1, 1)}, ["series_id", "trade_date"])


@query("v7_ohlc_consistency", "rule:s series_id:s trade_date:d", IDX + """SELECT rule, series_id, trade_date FROM idx, (VALUES ('range'), ('open_inside'), ('close_inside')) r(rule) WHERE day(trade_date) = 6""")
def v7(spark, d):
    """Open and close outside the day's range, or an inverted range."""
    i = broken(spark, d).where("dayofmonth(trade_date) <> 3 AND dayofmonth(trade_date) <> 9")
    return V.flag_rows(i, V.ohlc_rules(0.01), ["series_id", "trade_date"])


@query("v8_increasing_dates", "series_id:s trade_date:d previous:d", IDX + """, a AS (SELECT series_id, trade_date, CASE WHEN day(trade_date) = 20 THEN trade_date - 30 ELSE trade_date END AS arrival FROM idx)
SELECT series_id, trade_date, previous FROM (SELECT *, lag(trade_date) OVER (PARTITION BY series_id ORDER BY arrival, trade_date) AS previous FROM a) WHERE previous >= trade_date""")
def v8(spark, d):
    """Rows that arrived before an earlier date."""
    i = bars(spark, d).withColumn("arrival", F.struct(F.when(F.dayofmonth("trade_date") == 20, F.date_sub("trade_date", 30)).otherwise(F.col("trade_date")), F.col("trade_date")))
    return V.unordered(i, SID, "arrival", "trade_date")


@query("v9_warmup", "trade_date:d", S.with_(S.INDEX, S.STOCK) + "SELECT c.trade_date FROM cal c LEFT JOIN ical i USING (trade_date) WHERE i.session_no IS NULL OR i.session_no <= 20")
def v9(spark, d):
    """Signals off the calendar or without 20 earlier sessions."""
    cal = calendar_of(D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")))
    return V.warmup_violations(D.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct(), cal, 20)


@query("v11_max_gap", "code:i trade_date:d gap_days:i", S.with_(S.STOCK) + "SELECT * FROM (SELECT code, trade_date, trade_date - lag(trade_date) OVER (PARTITION BY code ORDER BY trade_date) AS gap_days FROM stock) WHERE gap_days > 7")
def v11(spark, d):
    """Rows more than a week after the previous one."""
    return V.gaps(D.stock_panel(spark, d), ["code"], "trade_date", 7)


_POL = ", ".join(f"('{k}', {h * 60 + m})" for k, (h, m) in PUBLICATION.items())


@query("v12_publication_gate", "source:s trade_date:d signals:i admitted:i", f"SELECT source, CAST(ts AS DATE) AS trade_date, count(*) AS signals, count_if(hour(ts) * 60 + minute(ts) >= m) AS admitted FROM events, (VALUES {_POL}) p(source, m) GROUP BY 1, 2")
def v12(spark, d):
    """Signals of each day that come late enough to use each source in the same session."""
    at = F.hour("ts") * 60 + F.minute("ts")
    days = D.table(spark, d, "events").groupBy(F.to_date("ts").alias("trade_date")).agg(F.count("*").alias("signals"), *[F.count_if(at >= h * 60 + m).alias(k) for k, (h, m) in PUBLICATION.items()])
    return days.select("trade_date", "signals", F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.col(k).alias("admitted")) for k in PUBLICATION])).alias("p")).select("trade_date", "signals", "p.*")


@query("v13_source_before_signal", "trade_date:d source_date:d", IDX + "SELECT trade_date, source_date FROM (SELECT trade_date, CASE WHEN day(trade_date) = 11 THEN trade_date ELSE lag(trade_date) OVER (ORDER BY trade_date) END AS source_date FROM ical) WHERE source_date >= trade_date")
def v13(spark, d):
    """Signals whose source is not strictly earlier."""
    cal = calendar_of(D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")))
    prev = cal.select((F.col("session_no") + 1).alias("session_no"), F.col("trade_date").alias("p"))
    s = cal.join(prev, "session_no", "left").withColumn("source_date", F.when(F.dayofmonth("trade_date") == 11, F.col("trade_date")).otherwise(F.col("p")))
    return s.where(F.col("source_date") >= F.col("trade_date"))


@query("v14_universe_equality", "trade_date:d rule:s contracts:i", S.with_(S.OPTION, LIVE) + "SELECT l.trade_date, 'unobserved' AS rule, count(*) AS contracts FROM live l LEFT JOIN opt o ON o.ts_code = l.ts_code AND o.trade_date = l.trade_date WHERE o.ts_code IS NULL GROUP BY 1")
def v14(spark, d):
    """Listed contracts that were not observed, and the reverse."""
    o = stage(D.option_daily(spark, d), "options")
    live = J.validity_expand(D.option_contracts(o), calendar_of(o), "ts_code", "list_date", "delist_date")
    return V.universe_mismatch(o, live, ["ts_code", "trade_date"]).groupBy("trade_date", "rule").agg(F.count("*").alias("contracts"))


@query("v15_cross_section_cardinality", "product:s trade_date:d contracts:i", S.with_(S.FUTURES) + "SELECT product, trade_date, count(DISTINCT mon) AS contracts FROM fut GROUP BY 1, 2 HAVING count(*) <> 4 OR count(DISTINCT mon) <> 4")
def v15(spark, d):
    """Product-days without exactly four dated contracts."""
    f = D.futures_daily(spark, d).groupBy(F.substring("ts_code", 1, 2).alias("product"), "trade_date").agg(F.count("*").alias("n"), F.count_distinct("ts_code").alias("contracts"))
    return f.where("n <> 4 OR contracts <> 4")


@query("v16_minimum_universe", "trade_date:d rows:i active:i", S.with_(S.STOCK) + "SELECT * FROM (SELECT trade_date, count(*) AS rows, count(CASE WHEN pct_chg IS NOT NULL AND market <> 'BJ' THEN 1 END) AS active FROM stock GROUP BY 1) WHERE rows < 20 OR active < 15")
def v16(spark, d):
    """Sessions with too small a universe."""
    s = D.stock_panel(spark, d)
    live = F.col("pct_chg").isNotNull() & F.col("market").isin(*P.COVERED)
    return s.groupBy("trade_date").agg(F.count("*").alias("rows"), F.count(F.when(live, 1)).alias("active")).where("rows < 20 OR active < 15")


@query("v17_bars_reconcile", "rule:s series_id:s trade_date:d", S.with_(S.BARS) + "SELECT rule, series_id, trade_date FROM (SELECT DISTINCT series_id, trade_date FROM slots), (VALUES ('close'), ('volume')) r(rule) WHERE (rule = 'close' AND day(trade_date) = 2) OR (rule = 'volume' AND day(trade_date) = 3)")
def v17(spark, d):
    """Sessions whose bars disagree with the daily bar."""
    b = D.intraday_bars(spark, d)
    day = b.groupBy("series_id", "trade_date").agg(F.max_by("close", "bar_end").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("vol").alias("vol"), F.sum("amount").alias("amount"))
    n = F.dayofmonth("trade_date")
    day = day.withColumn("close", F.when(n == 2, F.col("close") + 1).otherwise(F.col("close"))).withColumn("vol", F.when(n == 3, F.col("vol") * 1.01).otherwise(F.col("vol")))
    return V.bars_disagree(b, day, SID)


@query("v18_bar_grid", "series_id:s trade_date:d slot:i", S.with_(S.BARS) + "SELECT g.series_id, g.trade_date, g.slot FROM (SELECT DISTINCT series_id, trade_date, unnest(range(1, 9)) AS slot FROM slots) g LEFT JOIN (SELECT * FROM slots WHERE (day(trade_date) + slot) % 9 <> 0) s USING (series_id, trade_date, slot) WHERE s.close IS NULL")
def v18(spark, d):
    """Expected bars that are absent."""
    b = slotted(D.intraday_bars(spark, d))
    return V.grid_mismatch(b.where((F.dayofmonth("trade_date") + F.col("slot")) % 9 != 0), SID, 8)


@query("v19_prediction_invariants", "rule:s series_id:s trade_date:d", S.with_(S.STREAMS) + "SELECT 'sign_matches_label' AS rule, series_id, trade_date FROM base WHERE day(trade_date) = 17 UNION ALL SELECT 'correct_recomputes', series_id, trade_date FROM base WHERE day(trade_date) = 18 AND correct IS NOT NULL")
def v19(spark, d):
    """Forecast rows that contradict themselves."""
    day = F.dayofmonth("trade_date")
    s = base_stream(spark, d).withColumn("predicted_pct_change", F.when(day == 17, -F.col("predicted_pct_change")).otherwise(F.col("predicted_pct_change"))).withColumn("correct", F.when(day == 18, ~F.col("correct")).otherwise(F.col("correct")))
    return V.flag_rows(s, V.prediction_rules(), ["series_id", "trade_date"])


@query("v20_training_causality", K + "last_training_date:d", S.with_(S.STREAMS) + "SELECT series_id, trade_date, trade_date AS last_training_date FROM base WHERE pos >= 120 AND day(trade_date) = 21")
def v20(spark, d):
    """Fitted rows trained on data that is not earlier."""
    s = base_stream(spark, d).withColumn("n", F.when(F.col("pos") >= 120, F.col("pos")).otherwise(0)).withColumn("last_training_date", F.when(F.dayofmonth("trade_date") == 21, F.col("trade_date")).otherwise(F.date_sub("trade_date", 1)))
    return V.causality_violations(s, "n", "last_training_date")


@query("v21_unused_anomaly_flag", "asset:s trade_date:d unused_open_range_anomaly:b", S.with_(S.EXTERNAL) + "SELECT asset, trade_date, coalesce(p < low OR p > high, false) AS unused_open_range_anomaly FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY trade_date) AS p FROM ext)")
def v21(spark, d):
    """An opening quote outside the range is flagged and kept."""
    e = D.external_series(spark, d).withColumn("p", F.lag("close").over(ordered(["asset"], "trade_date")))
    return e.withColumn("unused_open_range_anomaly", F.coalesce((F.col("p") < F.col("low")) | (F.col("p") > F.col("high")), F.lit(False)))


@query("v22_contract_dimension", "rule:s ts_code:s", S.with_(S.OPTION) + "SELECT 'right' AS rule, ts_code FROM contracts WHERE opt_code = 'Brand#3' UNION ALL SELECT 'interval', ts_code FROM contracts WHERE opt_code = 'Brand#5'")
def v22(spark, d):
    """Contracts with an unknown right or an inverted validity."""
    c = D.option_contracts(D.option_daily(spark, d))
    c = c.withColumn("call_put", F.when(F.col("opt_code") == "Brand#3", "X").otherwise(F.col("call_put"))).withColumn("list_date", F.when(F.col("opt_code") == "Brand#5", F.date_add("delist_date", 1)).otherwise(F.col("list_date")))
    return V.flag_rows(c, V.contract_rules(), ["ts_code"])
