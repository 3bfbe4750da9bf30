"""Document fingerprints: threshold-scaled sketches of word shingles.

Every five-word shingle is hashed to 64 bits and kept if the hash lies below a
fixed fraction of the range.  What is kept depends on the shingle alone, so
sketches of a union are unions of sketches, and containment and likeness can be
estimated between documents of very unequal length.

A fingerprint is the text `digest:shingles:kept`: 16 hex digits of the whole
text's digest, the number of distinct shingles, and the kept hashes in ascending
order, eight hex digits each.  The digest tells equal texts from texts that are
too short to keep a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import bounded
from tidemark.llm.text import Words, blocks, shingles

SHINGLE_WORDS = 5
FRACTION = 0.25


def sketches(texts: list[bytes], k: int, fraction: float) -> list[tuple[int, np.ndarray]]:
    """(distinct shingles, kept hashes) of each text."""
    words = Words(texts)
    value, owner = shingles(words.hashes(), words.first, k)
    value >>= np.uint64(32)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    total = np.bincount(owner, minlength=len(texts))
    low = value < np.uint64(int(fraction * (1 << 32)))
    value, owner = value[low], owner[low]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(int(total[d]), value[cut[d] : cut[d + 1]].astype(np.uint32)) for d in range(len(texts))]


def written(text: bytes, sketch: tuple[int, np.ndarray]) -> str:
    return f"{hashlib.blake2b(text, digest_size=8).hexdigest()}:{sketch[0]}:{sketch[1].astype('>u4').tobytes().hex()}"


def _kept(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.rsplit(":", 1)[1]), ">u4")


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints; 1 for equal texts, 0 if neither kept anything."""
    if a.split(":", 1)[0] == b.split(":", 1)[0]:
        return 1.0
    x, y = _kept(a), _kept(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b holds; 1 for equal texts, 0 if a kept nothing."""
    if a.split(":", 1)[0] == b.split(":", 1)[0]:
        return 1.0
    x = _kept(a)
    return len(np.intersect1d(x, _kept(b), assume_unique=True)) / len(x) if len(x) else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """One row per input row: id and fingerprint.  Null counts as empty; rows stay where they are."""

    def work(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            out = [written(t, s) for part in blocks(map(len, texts)) for t, s in zip(texts[part], sketches(texts[part], k, fraction))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, fingerprint string")


def descending_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (bucket, id, text, bridge) laid out so that each row's successor in descending id follows it in its partition.

    Ids are cut into ranges of about equal row counts; the first row of a range
    is sent a second time, marked as bridge, to the range before it (that of the
    first range to the last).  Text is shuffled once.  Equal ids are ordered by
    text; null ids come last.  The list of ranges is bounded by `buckets`, four
    times the shuffle partitions unless given.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] if n > 1 else [0.5], 100 * n)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(rows.withColumn("_x", F.col("id").cast("double")))
        rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), len(splits)).otherwise(len(splits) - F.col("_b").cast("int"))).drop("_x", "_b")
    else:
        rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), 1).otherwise(0))
    heads = [(r.bucket, r.id) for r in rows.groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()]
    kind = dict(rows.dtypes)["id"]
    bridges = bounded(spark.createDataFrame([(b, i, heads[k - 1][0]) for k, (b, i) in enumerate(heads)], f"_b int, _i {kind}, _to int"), "sketch-heads")
    again = rows.join(bridges, (F.col("bucket") == F.col("_b")) & F.col("id").eqNullSafe(F.col("_i")), "left")
    both = F.array(F.struct(F.col("bucket"), F.lit(0).alias("bridge")), F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("bridge")))
    laid = again.select("id", "text", F.explode(F.when(F.col("_to").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("at")).select("at.bucket", "id", "text", "at.bridge")
    return laid.repartition("bucket").sortWithinPartitions("bucket", "bridge", F.col("id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likeness and that to the next text.

    The next document is the one with the next smaller id (after the last, the
    first).  One row per input row; a single row is its own successor; an empty
    table gives no rows; null texts count as empty; other columns are not read.
    """

    def runs(batches) -> Iterator[list[tuple]]:
        """Lists of (id, text, next text) of about a block."""
        held, out, size = None, [], 0
        for batch in batches:
            for bucket, i, text, bridge in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == bucket and not held[3]:
                    out.append((held[1], held[2], text))
                    size += len(held[2]) + len(text)
                    if size > 1 << 19:
                        yield out
                        out, size = [], 0
                held = (bucket, i, text, bridge)
        if out:
            yield out

    def work(batches):
        for rows in runs(batches):
            changed = [edited(t, f).encode() for _, t, f in rows]
            texts = [t.encode() for _, t, _ in rows]
            after = [f.encode() for _, _, f in rows]
            parts = {}
            for name, some in (("text", texts), ("edited", changed), ("next", after)):
                if name == "next":  # a row's successor is mostly the next row, which has its fingerprint already
                    known = dict(zip(texts, parts["text"]))
                    lacking = list(dict.fromkeys(t for t in after if t not in known))
                    known |= dict(zip(lacking, (written(t, s) for t, s in zip(lacking, sketches(lacking, k, fraction))))) if lacking else {}
                    parts[name] = [known[t] for t in after]
                else:
                    parts[name] = [written(t, s) for t, s in zip(some, sketches(some, k, fraction))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa_kind), pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed]), pa.array(parts["text"]), pa.array(parts["edited"]),
                    pa.array(list(map(likeness, parts["text"], parts["edited"])), pa.float64()),
                    pa.array(list(map(likeness, parts["text"], parts["next"])), pa.float64()),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    pa_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = descending_runs(docs, id_col, text_col).mapInArrow(work, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
