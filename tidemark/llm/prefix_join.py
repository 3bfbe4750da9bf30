"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

An item is cut into windows of ten consecutive words (a shorter item is one
window).  A window occurs in a document only if every one of its words does, so
one necessary word is enough to find it: its prefix token, the rarest in the
documents.  The steps:

1. Count, in the documents, the words that the benchmark uses.
2. Order each window's words by that rarity; the rarest is its prefix token.
3. Join document words with prefix tokens.  Where the token stands in the window
   fixes where the window would start; starts before the text or ends beyond it
   are dropped (position and length bounds).
4. Verify the words in between: by hash within the same pass, then exactly
   against the windows' own words.

With up to BROADCAST_ROWS windows, which is counted, documents are read twice
and never shuffled: only hits are.  Beyond that the join is a shuffle on the
token, whose skew adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import bounded
from tidemark.sources.staging import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text in lower case (A-Z only); none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _key(words: Column) -> Column:
    return F.xxhash64(words)


def item_windows(items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(window, words, item): each distinct window with each item that has it."""
    w = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))))
    w = w.select("item", F.slice("w", F.col("at"), n).alias("words")).distinct()
    return w.withColumn("window", F.sha2(F.concat_ws(" ", "words"), 256))


def prefixed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, ahead, length, looks): key and place of the rarest word of each distinct window, its length and its key; ties go to the longer word, then by bytes."""
    each = windows.select("window", "words").distinct().select("window", "words", F.posexplode("words").alias("ahead", "word")).withColumn("token", _key(F.col("word")))
    each = each.join(counts, "token", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("window").orderBy("often", F.length("word").desc(), "word", "ahead"))
    return each.withColumn("_r", rank).where("_r = 1").select("token", "ahead", F.size("words").alias("length"), _key(F.col("words")).alias("looks")).distinct()


def occurrences(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW_WORDS, broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, windows).  rows: row, id, n_words once for each document, and row, id, start, length, window for each occurrence; windows: window, item.

    Up to `broadcast_rows` windows (rows of four numbers) the words meet the
    tokens where they are read.  Beyond it words and tokens are shuffled without
    the texts, and each document is read once more for its own candidates.
    """
    windows = bounded(item_windows(items, item_col, item_text_col, n), "bench-windows")
    small = windows.count() <= broadcast_rows
    wanted = bounded(windows.select(F.explode("words").alias("word")).select(_key(F.col("word")).alias("token")).distinct(), "bench-words")
    used = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).select(_key(F.col("word")).alias("token"))
    used = used.join(F.broadcast(wanted), "token") if small else used
    prefix = bounded(prefixed(windows, used.groupBy("token").agg(F.count(F.lit(1)).alias("often"))), "bench-prefix")

    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    start = F.col("pos") - F.col("ahead")
    fits = F.col("looks").isNotNull() & (start >= 0) & (start + F.col("length") <= F.col("size"))
    found = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("length"))
    if small:
        each = text.select("row", "id", "w", F.size("w").alias("size"), F.posexplode_outer("w").alias("pos", "word")).withColumn("token", _key(F.col("word")))
        each = each.join(F.broadcast(prefix), "token", "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    else:
        text = stage(text, "bench-texts")
        each = text.select("row", F.size("w").alias("size"), F.posexplode("w").alias("pos", "word")).withColumn("token", _key(F.col("word"))).join(prefix, "token").where(fits)
        held = each.groupBy("row").agg(F.collect_list(F.struct("pos", "ahead", "length", "looks")).alias("found")).withColumnRenamed("row", "_row")
        each = text.join(held, F.col("row") == F.col("_row"), "left").select("row", "id", "w", F.size("w").alias("size"), F.explode_outer(F.concat(F.array(F.expr("named_struct('pos', 0, 'ahead', 0, 'length', cast(null as int), 'looks', cast(null as bigint))")), F.coalesce("found", F.array()))).alias("f"))
        each = each.select("row", "id", "w", "size", "f.*")
    each = each.withColumn("_hit", F.coalesce(fits & (_key(found) == F.col("looks")), F.lit(False)))
    first = F.col("looks").isNull() & (F.col("pos") == 0) if not small else F.col("pos") == 0
    rows = stage(
        each.where(F.col("_hit") | first).select(
            "row", "id", F.when(first, F.col("size")).alias("n_words"), F.when(F.col("_hit"), start).alias("start"), F.when(F.col("_hit"), F.col("length")).alias("length"), F.when(F.col("_hit"), found).alias("found"),
        ),
        "bench-found",
    )
    exact = rows.where("found IS NOT NULL").select("row", "id", F.lit(None).cast("int").alias("n_words"), "start", "length", F.sha2(F.concat_ws(" ", "found"), 256).alias("window"), "found")
    exact = exact.join(windows.select("window", "words").distinct(), "window").where("found = words")
    plain = rows.where("n_words IS NOT NULL").select("row", "id", "n_words", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("length", "int"), ("window", "string"))))
    return plain.unionByName(exact.select(plain.columns)), windows.select("window", "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (sorted as strings, comma-joined), contaminated.

    A word is hit if any occurrence of any window covers it.  Null and empty
    texts have no words and are clean; items without words have no windows;
    repeated documents and null ids get a row each; repeated items all count; an
    empty benchmark leaves every document clean; other columns are not read.
    """
    rows, windows = occurrences(docs, items, id_col, text_col, item_col, item_text_col, n, broadcast_rows)
    hits = rows.where("window IS NOT NULL")
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reach, F.lit(0))))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = hits.select("row", "window").distinct().join(windows, "window").select("row", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    found = covered.join(named, "row", "left").withColumnRenamed("row", "_row")
    base = rows.where("n_words IS NOT NULL").groupBy("row", "id").agg(F.max("n_words").alias("n_words"))
    return base.join(found, F.col("row") == F.col("_row"), "left").select(
        F.col("id").alias(id_col), F.col("n_words").cast("bigint"), F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def contamination_sql(docs: str = "documents") -> str:
    """The same in DuckDB's dialect over `benchmark` and a relation with doc_id and text: CTEs ending in `contaminated_docs`."""
    words = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}')"
    n = WINDOW_WORDS
    return f"""
bench_w AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
bench_at AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {n - 1}) + 1)) AS place FROM bench_w WHERE len(w) > 0),
bench AS (SELECT DISTINCT item_id, w[place : place + {n - 1}] AS words FROM bench_at),
bench_u AS (SELECT DISTINCT words, words[1] AS token FROM bench),
bench_d AS (SELECT doc_id, coalesce({words}, []) AS w FROM {docs}),
bench_p AS (SELECT doc_id, w, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM bench_d),
bench_h AS (SELECT doc_id, pos, words FROM bench_p JOIN bench_u USING (token) WHERE w[pos : pos + len(words) - 1] = words),
bench_c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + len(words))) AS place FROM bench_h) GROUP BY doc_id),
bench_i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM bench_h JOIN bench USING (words)) GROUP BY doc_id),
contaminated_docs AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, coalesce(n_hit > 0, false) AS contaminated
  FROM bench_d LEFT JOIN bench_c USING (doc_id) LEFT JOIN bench_i USING (doc_id))"""
