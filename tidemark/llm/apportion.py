"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets.  Sources in code-point order (null last) weigh 1, 2, 3, repeating.
They share all words by weight; no target exceeds `most` times its source's
words, and what a capped source leaves is shared among the others by weight
until none is above.  With sources in order of cap over weight that is one
prefix sum.

Quotas.  Blocks of equal token length go to sources by the highest quotients
target/(2k+1), then within a source to shards by the highest size/(2k+1).  Only
the few quotients around each one's fair share are listed and ranked: a divisor
method never strays farther from it than half the number of contenders, shared
by size.

Selection.  A shard is about `shard_words` words, so a source with a third of
the corpus is many shards.  Its documents stand in an order given by a seeded
digest of their id and their words are tiled into m equal blocks; of every m/q
consecutive blocks one is taken, from a seeded offset, which takes exactly q
blocks with repeats.  How many of a document's words that takes follows from its
two end positions, so no block is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS = 1024
BLOCKS_IN_LEAST = 200
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> the same with place, weight and target."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1).cast("bigint"))
    w = w.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc())
    every = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    water = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    return w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(water, F.lit(0.0)))).drop("cap", "level")


def highest_quotients(rows: DataFrame, votes: str, seats: str, within: list[str], tie: str, out: str) -> DataFrame:
    """Add `out`: the seats that each row wins of `seats` (equal in a group) by its share of `votes`."""
    group = Window.partitionBy(*within)
    v, n, total, parties = F.col(votes).cast("double"), F.col(seats).cast("double"), F.sum(F.col(votes)).over(group).cast("double"), F.count(F.lit(1)).over(group)
    some = rows.withColumn("_total", total).withColumn("_half", parties / 2.0)
    share = lambda n: F.floor(v * n / F.col("_total") + 0.5)
    some = some.withColumn("_low", F.when(F.col("_total") > 0, F.greatest(F.lit(0), share(F.greatest(F.lit(0.0), n - F.col("_half"))) - 1)).otherwise(0))
    some = some.withColumn("_high", F.when((F.col("_total") > 0) & (v > 0), share(n + F.col("_half")) + 1).otherwise(0))
    some = some.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    listed = some.where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    rank = F.row_number().over(group.orderBy((v / (2 * F.col("_k") + 1)).desc(), F.col(tie).asc(), F.col("_k").asc()))
    won = listed.withColumn("_rank", rank).groupBy(*(F.col(c).alias(f"_of_{c}") for c in (*within, tie))).agg(F.sum(F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).alias("_won"))
    met = some.join(won, [F.col(c) == F.col(f"_of_{c}") for c in (*within, tie)], "left")
    return met.select(*rows.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("bigint").alias(out))


def mix_to_targets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
    block_words: int = BLOCK_WORDS, blocks_in_least: int = BLOCKS_IN_LEAST, shard_words: int = SHARD_WORDS, seed: str = SEED,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (0 to most * size).

    A block has `block_words` words, or fewer so that the least positive target
    has `blocks_in_least` blocks.  Null texts have size 0 and take nothing; null
    sources are one source, the last; repeated rows stand beside each other and
    each get a row; an empty table gives none; other columns are not read.
    """
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    every = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / blocks_in_least)))
    targets = targets.withColumn("block", F.coalesce(block, F.lit(1)).cast("bigint")).withColumn("all_seats", F.floor(F.sum("source_size").over(every) / F.col("block")).cast("bigint"))
    targets = highest_quotients(targets, "target", "all_seats", [], "place", "seats").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint"))
    targets = stage(targets.select("source", "place", "source_size", "target", "block", "seats", "shards"), "mix-targets")

    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("shard", F.pmod(_number(F.col("key")), F.col("shards")))
    shards = placed.groupBy("place", "shard", "seats", "block").agg(F.sum("size").alias("words"))
    shards = highest_quotients(shards, "words", "seats", ["place"], "shard", "won")
    shards = shards.withColumn("m", F.greatest(F.lit(1), F.floor(F.col("words") / F.col("block") + 0.5)).cast("bigint")).withColumn("q", F.least(F.col("won"), most * F.col("m")))
    shards = shards.withColumn("offset", F.pmod(_number(F.md5(F.concat_ws("/", F.lit(seed), "place", "shard"))), F.col("m")))
    shards = stage(shards.select("place", "shard", "words", "m", "q", "offset"), "mix-shards")

    order = Window.partitionBy("place", "shard").orderBy("key", "size")
    at = placed.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(shards, ["place", "shard"])
    return at.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.expr(f"CASE WHEN size = 0 THEN 0L ELSE {_taken_before('upto')} - {_taken_before('(upto - size)')} END").alias("taken"))


def _taken_before(x: str) -> str:
    """Words taken among the first x of a shard of `words` words, q of m blocks: whole numbers throughout."""
    b = f"({x} * m div words)"
    f = f"(({b} * q + offset) div m)"
    g = f"((({b} + 1) * q + offset) div m)"
    return f"((words * {f} + ({g} - {f}) * ({x} * m - {b} * words)) div m)"


def mixing_sql(docs: str = "documents") -> str:
    """The same in DuckDB's dialect, over a relation with doc_id, text and source: CTEs ending in `mixed`."""
    weights = f"[{', '.join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1]"

    def before(x: str) -> str:
        return _taken_before(x).replace(" div ", " // ")

    def quotients(name: str, rows: str, votes: str, seats: str, within: str, tie: str, out: str) -> str:
        part = f"PARTITION BY {within} " if within else ""
        keys = f"{within}, {tie}" if within else tie
        return f"""
{name}_a AS (SELECT *, CAST(sum({votes}) OVER ({part}) AS DOUBLE) AS _total, count(*) OVER ({part}) / 2.0::DOUBLE AS _half FROM {rows}),
{name}_b AS (SELECT *, CASE WHEN _total > 0 THEN greatest(0, floor({votes}::DOUBLE * greatest(0, {seats}::DOUBLE - _half) / _total + 0.5) - 1) ELSE 0 END::BIGINT AS _low,
  CASE WHEN _total > 0 AND {votes} > 0 THEN floor({votes}::DOUBLE * ({seats}::DOUBLE + _half) / _total + 0.5) + 1 ELSE 0 END::BIGINT AS _high FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(_low) OVER ({part}) AS _left FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(_low, _high)) AS _k FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER ({part} ORDER BY {votes}::DOUBLE / (2 * _k + 1) DESC, {tie}, _k) AS _rank FROM {name}_d),
{name}_f AS (SELECT {keys}, sum(CASE WHEN _rank <= _left THEN 1 ELSE 0 END) AS _won FROM {name}_e GROUP BY {keys}),
{name} AS (SELECT c.* EXCLUDE (_total, _half, _low, _high, _left), CAST(_low + coalesce(f._won, 0) AS BIGINT) AS {out} FROM {name}_c c LEFT JOIN {name}_f f USING ({keys}))"""

    return f"""
sized AS (SELECT doc_id AS id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {docs}),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM src),
weighed AS (SELECT *, CAST({weights} AS BIGINT) AS weight, source_size * {MOST} AS cap FROM ranked),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM weighed),
targeted AS (SELECT * EXCLUDE (cap, level), least(CAST(cap AS DOUBLE), weight * coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER (), 0.0)) AS target FROM levels),
blocked AS (SELECT *, CAST(coalesce(greatest(1, least({BLOCK_WORDS}, floor(min(CASE WHEN target > 0 THEN target END) OVER () / {BLOCKS_IN_LEAST}))), 1) AS BIGINT) AS block FROM targeted),
seated AS (SELECT *, CAST(floor(sum(source_size) OVER () / block) AS BIGINT) AS all_seats FROM blocked),{quotients("won_src", "seated", "target", "all_seats", "", "place", "seats")},
targets AS (SELECT *, CAST(greatest(1, ceil(source_size / {SHARD_WORDS})) AS BIGINT) AS shards FROM won_src),
placed AS (SELECT s.*, t.* EXCLUDE (source), ('0x' || substr(s.key, 1, 8))::BIGINT % t.shards AS shard FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
shard_words AS (SELECT place, shard, seats, block, CAST(sum(size) AS BIGINT) AS words FROM placed GROUP BY ALL),{quotients("won_shard", "shard_words", "words", "seats", "place", "shard", "won")},
tiled AS (SELECT place, shard, words, won, CAST(greatest(1, floor(words / block + 0.5)) AS BIGINT) AS m FROM won_shard),
dealt AS (SELECT place, shard, words, m, least(won, {MOST} * m) AS q, ('0x' || substr(md5('{SEED}/' || place || '/' || shard), 1, 8))::BIGINT % m AS "offset" FROM tiled),
summed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM placed),
mixed AS (SELECT id AS doc_id, source, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE {before("upto")} - {before("(upto - size)")} END AS BIGINT) AS taken
  FROM summed JOIN dealt USING (place, shard))""".replace("offset)", '"offset")')
