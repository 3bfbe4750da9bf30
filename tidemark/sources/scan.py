"""Scans, normalisation and sinks for landed market files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import ordered

# Accepted spellings per canonical price column, first match wins (fixed values).
ALIASES = {
    "trade_date": ("trade_date", "trade_dt", "date", "日期", "tradedate", "datetime", "time", "opdate"),
    "open": ("open", "今开", "开盘", "开盘价", "s_dq_open", "s_open", "adj_open"),
    "high": ("high", "最高", "最高价", "s_dq_high", "s_high", "adj_high"),
    "low": ("low", "最低", "最低价", "s_dq_low", "s_low", "adj_low"),
    "close": ("close", "latest", "最新价", "收盘", "收盘价", "s_dq_close", "s_close", "adj_close"),
    "pre_close": ("pre_close", "preclose", "prev_close", "previous_close", "昨收", "前收盘", "s_dq_preclose"),
    "change": ("change", "chg", "涨跌额"),
    "pct_chg": ("pct_chg", "pct_change", "change_pct", "pctchange", "涨跌幅", "s_dq_pctchange"),
    "vol": ("vol", "volume", "成交量", "s_dq_volume", "s_volume"),
    "amount": ("amount", "amt", "turnover", "成交额", "s_dq_amount", "s_amount"),
    "swing": ("swing", "振幅"),
}


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Scan landed files with a declared schema; floats keep their full text precision."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST")
    paths = [path] if isinstance(path, str) else list(path)
    return reader.format(fmt).load(paths)


def read_raw_days(spark: SparkSession, pattern: str, schema: T.StructType, date: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """Scan one file per session and split rows by whether their date equals the file's."""
    raw = read_table(spark, pattern, schema).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"(\d{8})(?=[^/]*/[^/]*$|[^/]*$)", 1).alias("file_session"))
    same = F.date_format(date, "yyyyMMdd") == F.col("file_session")
    return raw.where(same), raw.where(~F.coalesce(same, F.lit(False)))


def resolve_dataset(spark: SparkSession, root: str, candidates: Sequence[str]) -> tuple[str, DataFrame]:
    """First existing landed table among candidates (raw before merged before features)."""
    jvm = spark._jvm  # noqa: SLF001
    for name in candidates:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # noqa: SLF001
            return name, spark.read.parquet(f"{root}/{name}")
    raise FileNotFoundError(f"none of {list(candidates)} under {root}")


def assemble_pages(pages: Sequence[DataFrame], keys: Sequence[str], date: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Union page files; keep unique in-range rows and return the rejected ones with a rule."""
    rows = pages[0]
    for p in pages[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    marked = rows.join(counts, list(keys)).withColumn("rule", F.when(F.col("_n") > 1, "duplicate").when(~F.col(date).between(start, end), "range")).drop("_n")
    return marked.where(F.col("rule").isNull()).drop("rule"), marked.where(F.col("rule").isNotNull())


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Rename the first matching spelling of each canonical column; others are dropped."""
    have = {c.strip().lower(): c for c in df.columns}
    picked = []
    for canonical, names in aliases.items():
        hit = next((have[n.lower()] for n in names if n.lower() in have), None)
        if hit is not None:
            picked.append(F.col(f"`{hit}`").alias(canonical))
    return df.select(*picked)


LAYOUTS = ((r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))


def parse_majority(df: DataFrame, column: str, name: str = "parsed", share: float = 0.8) -> DataFrame:
    """Parse text dates by the layout most rows follow; day-first otherwise.

    The layout shares are a scalar subquery, not a driver decision.
    """
    text = F.regexp_replace(F.trim(F.col(column)), r"\.0$", "")
    d = df.withColumn("_t", text)
    rates = d.agg(F.array(*[F.avg(F.col("_t").rlike(rx).cast("double")) for rx, _ in LAYOUTS]).alias("r")).scalar()
    j = d.withColumn("_r", rates)
    out = F.coalesce(F.try_to_date("_t", "d/M/yyyy"), F.try_to_date("_t", "d-M-yyyy"))
    for i, (_, fmt) in reversed(list(enumerate(LAYOUTS))):
        out = F.when(F.col("_r")[i] > share, F.try_to_date("_t", fmt)).otherwise(out)
    return j.withColumn(name, out).drop("_t", "_r")


def canonical_features(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed, finite, consistent rows with unique dates, and the violations."""
    from tidemark.operators.quality import finite, flag_rows

    keys = [c for c in ("series_id", "trade_date") if c in df.columns]
    ok = {f"{c}_positive": finite(c) & (F.col(c) > 0) for c in ("open", "high", "low", "close")}
    ok["range"] = F.col("high") >= F.col("low")
    bad = flag_rows(df, ok, keys)
    test = F.lit(True)
    for c in ok.values():
        test = test & F.coalesce(c, F.lit(False))
    return df.where(test), bad


def last_per_date(df: DataFrame, keys: Sequence[str], arrival: str, numeric: Sequence[str]) -> DataFrame:
    """Infinities become null, rows without a date go, the last arrival per key stays."""
    clean = df.select(*[F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns])
    clean = clean.where(F.col(keys[-1]).isNotNull())
    picked = clean.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in clean.columns if c not in keys]), arrival).alias("_r"))
    return picked.select(*keys, "_r.*")


def repaired_prices(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Previous close where supplied and positive, else the row before; derived change, percent change and swing."""
    w = ordered(keys, "trade_date")
    out = df.withColumn("pre_close", F.when(F.col("pre_close") > 0, F.col("pre_close")).otherwise(F.lag("close").over(w)))
    return out.withColumn("change", F.col("close") - F.col("pre_close")).withColumn("pct_chg", (F.try_divide(F.col("close"), F.col("pre_close")) - 1) * 100).withColumn(
        "swing", F.try_divide(F.col("high") - F.col("low"), F.col("pre_close")) * 100)


def default_lag(foreign: bool, prediction_time: str) -> int:
    """Sessions to lag a feature block: one for a foreign market, one more before the open."""
    if prediction_time not in ("after_close", "before_open"):
        raise ValueError("prediction_time must be after_close or before_open")
    return int(foreign) + int(prediction_time == "before_open")


def local_times(text: Column, zone: str = "Asia/Shanghai") -> Column:
    """Wall-clock time in `zone` of mixed stamps; a stamp without an offset is already local."""
    offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(offset, F.from_utc_timestamp(F.try_to_timestamp(text), zone)).otherwise(F.try_to_timestamp(text))


def affixed(df: DataFrame, keep: Sequence[str], prefix: str = "", suffix: str = "", drop_prefix: str | None = None) -> DataFrame:
    """Add a prefix or suffix to all but the kept columns, dropping columns by prefix."""
    cols = [c for c in df.columns if drop_prefix is None or not c.startswith(drop_prefix)]
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}{suffix}") for c in cols])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and ISO dates; refuses an existing target."""
    df.write.mode("errorifexists").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_snapshot(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """Immutable snapshot partitioned by year, month and day; refuses an existing target.

    Rows are rebalanced by day first: small days share tasks and a crowded day is
    split over several, each writing its own file.
    """
    out = df.withColumn("year", F.year(date)).withColumn("month", F.month(date)).withColumn("day", F.dayofmonth(date))
    out.hint("rebalance", F.col("year"), F.col("month"), F.col("day")).write.mode("errorifexists").partitionBy("year", "month", "day").parquet(path)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*.parquet", leaf_bytes: int = 16 << 20, fan: int = 1024) -> DataFrame:
    """file (path under the folder), length and sha256 of every file: the root of a hash tree over its byte ranges.

    Files are read as records between newline bytes, whole by no task, and no
    file or range is one cell.  A record's place is the running length of the
    records before it: within its split, after the splits before that.  A leaf
    is an order-free sum over the places and bytes of the records that start in
    its `leaf_bytes`, so it does not depend on how files were split; leaves are
    hashed in order by `fan` into nodes, and nodes with the length into the
    root.  Compressed text is read uncompressed.  Spark's scans pass over files
    of no bytes, so they are not listed.
    """
    root = path.rstrip("/").split("/")[-1]
    named = lambda c: F.regexp_extract(F.url_decode(F.regexp_replace(c, "\\+", "%2B")), f"/{root}/(.*)$", 1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = found.select(named(F.col("path")).alias("file"), "length")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    records = lines.select(named(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"),
                           F.col("value").cast("binary").alias("bytes")).withColumn("size", F.octet_length("bytes") + F.lit(1).cast("bigint"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    splits = records.groupBy("file", "split").agg(F.sum("size").alias("n"))
    splits = splits.select("file", "split", F.coalesce(F.sum("n").over(earlier(["file"], "split")), F.lit(0)).alias("base"))
    hashed = records.select("file", "split", "seq", "size", F.sha2("bytes", 256).alias("h"))
    placed = hashed.withColumn("at", F.coalesce(F.sum("size").over(earlier(["file", "split"], "seq")), F.lit(0))).join(splits, ["file", "split"]).withColumn("at", F.col("at") + F.col("base"))
    leaf = F.floor(F.col("at") / leaf_bytes)
    leaves = placed.withColumn("leaf", leaf).groupBy("file", "leaf").agg(content_hash("at", "h").alias("h"))
    in_order = lambda key: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "/"), 256)
    nodes = leaves.withColumn("node", F.floor(F.col("leaf") / fan)).groupBy("file", "node").agg(in_order("leaf").alias("h"))
    roots = nodes.groupBy("file").agg(in_order("node").alias("h"))
    return files.join(roots, "file", "left").select("file", "length", F.sha2(F.concat_ws("/", F.col("length").cast("string"), F.coalesce("h", F.lit(""))), 256).alias("sha256"))


def manifest_differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed since the stored manifest."""
    j = stored.select("file", F.col("sha256").alias("s")).join(current.select("file", F.col("sha256").alias("c")), "file", "full")
    rule = F.when(F.col("c").isNull(), "missing").when(F.col("s").isNull(), "unexpected").when(F.col("s") != F.col("c"), "changed")
    return j.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("file", "rule")


def content_hash(*columns: str) -> Column:
    """Order-free hash of a group's rows: their count and the sums of four parts of each row's sha256, so partial sums suffice."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = [F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("bigint")) for i in (1, 17, 33, 49)]
    return F.sha2(F.concat_ws("/", F.count(F.lit(1)), *half), 256)


def days_to_fetch(wanted: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted keys with no landed copy of the same content hash."""
    return wanted.join(landed.select(*keys, "sha256"), [*keys, "sha256"], "left_anti")


def lineage_mismatch(derived: DataFrame, inputs: DataFrame) -> DataFrame:
    """Derived tables whose recorded input hash is not the one in use."""
    j = derived.join(inputs.select(F.col("table").alias("input"), F.col("sha256").alias("current")), "input", "left")
    return j.where(~F.col("sha256").eqNullSafe(F.col("current"))).select("table", "input", "sha256", "current")


def public_projection(df: DataFrame) -> DataFrame:
    """Validated history and pending rows under public names."""
    kind = F.when(F.col("real_pct_change").isNull(), "pending").otherwise("validated")
    side = F.create_map(F.lit(1), F.lit("up"), F.lit(0), F.lit("down"))[F.col("predicted_label")]
    return df.select("stream_id", "series_id", F.col("trade_date").alias("signal_date"), kind.alias("record_type"), side.alias("direction"),
                     F.col("predicted_pct_change").alias("predicted_return"), "predicted_close", "confidence", F.col("real_pct_change").alias("actual_return"), "correct")


def json_records(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON object per row; non-finite numbers become null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    safe = [F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c) for c in columns]
    return df.withColumn("record", F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}))
