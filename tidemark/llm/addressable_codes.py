"""Token identifiers of a corpus in directly addressable codes.

An identifier is split into chunks of eight bits.  Level 0 holds the low chunk
of every identifier; a bitmap says which of them continue, and only those have
a chunk on the next level, and so on.  A rank directory over each bitmap gives
the place of a token on the next level, so any token is read by at most four
look-ups and nothing else is decoded.

The corpus is a folder of two tables.  `segments`: whole documents in ascending
order of id, about SEGMENT_IDS identifiers a row, with their levels.
`directory`: where each segment starts in the corpus.  Segments are numbered in
corpus order, so a reader needs no sort, and a lost task writes the same rows
again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.chunk_ids import chunk_ids, read_spec

SEGMENT_IDS = 1 << 16
RANK_BITS = 512
SEGMENT_BITS = 33
#: Readers take up to a row group of segments at once.
ROW_GROUP_BYTES = 16 << 20

LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of an array of unsigned 32-bit identifiers: chunks, continuation bitmap and rank directory of each; the last has no bitmap."""
    levels, rest = [], ids
    while True:
        on = rest > 255
        level = {"chunks": (rest & 255).astype(np.uint8).tobytes(), "more": b"", "ranks": b""}
        levels.append(level)
        if not on.any():
            return levels
        bits = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(bits) * 8 // RANK_BITS) * RANK_BITS // 8, np.uint8)
        padded[: len(bits)] = bits
        before = np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32).cumsum(dtype=np.uint32)
        level |= {"more": bits.tobytes(), "ranks": np.concatenate(([0], before[:-1])).astype("<u4").tobytes()}
        rest = rest[on] >> 8


def rank(level: dict[str, bytes], place: int) -> int:
    """Number of continuing tokens before `place` on a level."""
    block = place // RANK_BITS
    if block * 4 == len(level["ranks"]):  # just past a level that fills its last block
        block -= 1
    start = block * RANK_BITS // 8
    bits = int.from_bytes(level["more"][start : (place + 7) // 8], "little") & ((1 << (place - start * 8)) - 1)
    return int.from_bytes(level["ranks"][block * 4 : block * 4 + 4], "little") + bits.bit_count()


def token_at(levels: list[dict[str, bytes]], place: int) -> int:
    """One identifier; no other is decoded."""
    value = 0
    for k, level in enumerate(levels):
        value |= level["chunks"][place] << (8 * k)
        if not level["more"] or not level["more"][place >> 3] >> (place & 7) & 1:
            break
        place = rank(level, place)
    return value


def tokens_between(levels: list[dict[str, bytes]], start: int, end: int) -> np.ndarray:
    """Identifiers of the places start to end - 1; the rest is not decoded."""
    ids = np.zeros(end - start, np.uint32)
    where = np.arange(end - start)
    for k, level in enumerate(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8, end - start, start)
        ids[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
        if not level["more"] or end == start:
            break
        first = start >> 3
        bits = np.unpackbits(np.frombuffer(level["more"], np.uint8, (end + 7 >> 3) - first, first), bitorder="little")
        on = bits[start & 7 : (start & 7) + end - start].astype(bool)
        start = rank(level, start)
        end = start + int(on.sum())
        where = where[on]
    return ids


def write_codes(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the identifiers of every text, each followed by end_id, in ascending order of document id.

    Null ids come first; rows of one id are ordered by a hash of the text and
    then by the text.  A null text counts as empty: one end id.  An empty table
    gives a folder without segments.  Other columns are not read.  A document
    is never split between segments; texts are never cut.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def segment(part: int, number: int, rows: list) -> dict:
        ids = np.frombuffer(b"".join(b for _, b in rows), "<u4")
        return {"segment": part << SEGMENT_BITS | number, "n_ids": len(ids), "doc_ids": [i for i, _ in rows], "sizes": [len(b) // 4 for _, b in rows], "levels": pack(ids)}

    def encode(batches):
        from pyspark import TaskContext

        part, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
        ids_of, made, schema = chunk_ids(spec.value), [], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("segment", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("sizes", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))])
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                coded = ids_of(text.as_py() or "") + end
                if rows and held + len(coded) > SEGMENT_IDS * 4:
                    yield pa.RecordBatch.from_pylist([segment(part, number, rows)], schema)
                    number, rows, held = number + 1, [], 0
                rows.append((doc_id.as_py(), coded))
                held += len(coded)
        if rows:
            yield pa.RecordBatch.from_pylist([segment(part, number, rows)], schema)

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = slim.repartitionByRange("i", "h").sortWithinPartitions("i", "h", "t").select("i", "t")
    coded = ordered.mapInArrow(encode, f"segment bigint, n_ids bigint, doc_ids array<{kind}>, sizes array<bigint>, levels array<struct<chunks: binary, more: binary, ranks: binary>>")
    coded.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/segments")

    sizes = spark.read.parquet(f"{folder}/segments").select("segment", "n_ids").withColumn("part", F.shiftright("segment", SEGMENT_BITS))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    starts = sizes.withColumn("ahead", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    starts.select("segment", (F.col("base") + F.col("ahead")).alias("start"), "n_ids").write.parquet(f"{folder}/directory")


def read_documents(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, start (identifiers before it), n_tokens (with its end) and ids_crc32 of its identifiers."""
    segments = spark.read.parquet(f"{folder}/segments")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        for batch in batches:
            for start, ids, sizes, levels in zip(*(batch.column(k) for k in range(4))):
                levels, sizes = levels.as_py(), sizes.values.to_numpy()
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(tokens_between(levels, int(e - n), int(e)).astype("<u4").tobytes()) for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(start.as_py() + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    placed = segments.drop("n_ids").join(spark.read.parquet(f"{folder}/directory").select("segment", "start"), "segment")
    return placed.select("start", "doc_ids", "sizes", "levels").mapInArrow(decode, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_tokens(positions: DataFrame, folder: str, position_col: str = "position") -> DataFrame:
    """Distinct positions of the corpus with their token; a null position, or one outside the corpus, gives no row.

    Positions meet segments by equal stretches of SEGMENT_IDS places, then each
    segment is joined once, with the distinct places wanted of it.
    """
    spark = positions.sparkSession
    stretch = lambda c: F.floor(c / SEGMENT_IDS)
    directory = spark.read.parquet(f"{folder}/directory")
    spans = directory.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_ids") - 1))))
    wanted = positions.select(F.col(position_col).cast("bigint").alias("position")).where("position IS NOT NULL").distinct().withColumn("stretch", stretch(F.col("position")))
    met = wanted.join(spans, "stretch").where("position >= start AND position < start + n_ids")
    places = met.groupBy("segment").agg(F.collect_list((F.col("position") - F.col("start"))).alias("places"), F.first("start").alias("start"))
    joined = places.join(spark.read.parquet(f"{folder}/segments").select("segment", "levels"), "segment").select("start", "places", "levels")

    def look_up(batches):
        for batch in batches:
            for start, places, levels in zip(*(batch.column(k) for k in range(3))):
                levels, places, start = levels.as_py(), places.as_py(), start.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([start + p for p in places], pa.int64()), pa.array([token_at(levels, p) for p in places], pa.int64())], names=["position", "token"])

    return joined.mapInArrow(look_up, "position bigint, token bigint")
