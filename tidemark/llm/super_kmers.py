"""Substring dedup by super-k-mer partitioning.

A window is `n` consecutive words of a document; its minimiser is the smallest
hash of the runs of M words in it, so equal windows have equal minimisers.
Consecutive windows that share a minimiser travel as one packed string, about
three times the text instead of n times, to the bucket of the minimiser.  In a
bucket the windows are sorted by a 128-bit hash of their words, which brings
equal ones together; all but those of the smallest document id are repeats.

Skew.  A super-k-mer that several documents of a batch share travels once, for
the smallest id; the others are repeats already.  Minimisers that are frequent
in a sample of the documents are salted by document over several buckets, whose
first windows meet again in a second, hash-keyed step with partial minima.  The
sample only decides where windows travel, not what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import fresh
from tidemark.llm.text import Words, blocks, mix
from tidemark.sources.staging import stage

WINDOW_WORDS = 50
MINIMISER_WORDS = 4
BUCKETS_PER_PARTITION = 8
SAMPLE_ONE_IN = 32
LEAST_SAMPLED = 24
NO_ID = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def runs(hashes: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of every k consecutive word hashes, by doubling: one array operation for each bit of k."""
    out, have, step, step_len, step_power = None, 0, hashes, 1, np.array([base])
    while True:
        if k & step_len:
            if out is None:
                out, have = step, step_len
            else:
                n = max(0, len(hashes) - have - step_len + 1)
                out, have = out[:n] * step_power + step[have : have + n], have + step_len
        if step_len * 2 > k:
            return mix(out)
        n = len(step) - step_len
        step = step[: max(0, n)] * step_power + step[step_len:]
        step_len, step_power = step_len * 2, step_power * step_power


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if len(x) > rest else x[:0]


def super_kmers(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, minimiser) of each maximal run of windows with one minimiser."""
    m = min(MINIMISER_WORDS, n)
    low = sliding_min(runs(words.hashes(), m), n - m + 1) if len(words.starts) >= n else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + n <= words.first[1:][text])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (low[at][1:] != low[at][:-1]) | (text[at][1:] != text[at][:-1])
    start = at[fresh]
    return text[start], start, np.diff(np.append(np.flatnonzero(fresh), len(at))), low[start]


def _normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().split())


def frequent_minimisers(docs: DataFrame, n: int, buckets: int) -> dict[int, int]:
    """Salts of the minimisers that would crowd a bucket, judged on a sample of documents; at most 4 * buckets of them."""

    def work(batches):
        for batch in batches:
            texts = [_normal(t.as_py()) for t in batch.column(0)]
            found = [super_kmers(Words(texts[part]), n)[3] for part in blocks(map(len, texts))]
            value, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=["minimiser", "count"])

    some = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE_ONE_IN)) == 0).select("text").mapInArrow(work, "minimiser bigint, count bigint")
    counts = stage(some.groupBy("minimiser").agg(F.sum("count").alias("count")), "kmer-sample")
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(LEAST_SAMPLED, total // (4 * buckets))
    return {r[0]: max(2, min(buckets, 4 * r[1] // least)) for r in counts.where(F.col("count") >= least).collect()}


def _pack(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, hot: np.ndarray, strings: list[bytes]) -> bytes:
    body = b"\n".join(strings)
    return zstandard.ZstdCompressor(level=3).compress(b"".join((np.int64(len(ids)).tobytes(), ids.tobytes(), marks.tobytes(), starts.tobytes(), hot.astype(np.int8).tobytes(), body)))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, marks, starts = (np.frombuffer(raw, np.int64, k, 8 + i * 8 * k) for i in range(3))
    return ids, marks, starts, np.frombuffer(raw, np.int8, k, 8 + 24 * k), raw[8 + 25 * k :]


FOUND = "id bigint, mark bigint, start bigint, end bigint, h1 bigint, h2 bigint, bucket int, block binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
    columns = [pa.concat_arrays([pa.array(c, k) if c is not None else pa.nulls(len(r[0]), k) for r in rows for c in (r[i],)]) if rows else pa.array([], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def _deal(batches, n: int, buckets: int, salts: dict[int, int]):
    """Batches of (id, mark, text) -> blocks of super-k-mers by bucket, and ranges that the batch itself shows to be repeats."""
    often = np.array(sorted(salts), np.int64).view(np.uint64)
    for batch in batches:
        ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
        marks = np.array(batch.column(1).to_pylist(), np.int64)
        texts = [_normal(t.as_py()) for t in batch.column(2)]
        strings: list[bytes] = []
        parts = []
        for part in blocks(map(len, texts)):
            words = Words(texts[part])
            text, start, count, low = super_kmers(words, n)
            raw = words.buffer.tobytes()
            strings += [raw[a:b] for a, b in zip(words.starts[start].tolist(), words.ends[start + count + n - 2].tolist())]
            parts.append((text + part.start, start - words.first[text], count, low))
        if not strings:
            continue
        text, start, count, low = (np.concatenate(c) for c in zip(*parts))
        first: dict[bytes, int] = {}
        owner = ids[text].tolist()
        for s, i in zip(strings, owner):
            if i < first.get(s, NO_ID + 1):
                first[s] = i
        kept = np.array([first[s] == i for s, i in zip(strings, owner)])
        again = np.flatnonzero(~kept)
        rows = [(ids[text[again]], marks[text[again]], start[again], start[again] + count[again] + n - 1, None, None, None, None)] if len(again) else []
        at = np.flatnonzero(kept)
        hot = np.isin(low[at], often)
        bucket = low[at].copy()
        for j in np.flatnonzero(hot):
            salt = salts[int(bucket[j : j + 1].view(np.int64)[0])]
            bucket[j] = mix(bucket[j : j + 1] + np.uint64(int(marks[text[at[j]]]) % salt + 1))[0]
        bucket = (bucket % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        packed = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            some = at[order[a:b]]
            packed.append((int(bucket[order[a]]), _pack(ids[text[some]], marks[text[some]], start[some], hot[order[a:b]], [strings[k] for k in some])))
        rows.append((*[pa.nulls(len(packed), pa.int64())] * 6, [p[0] for p in packed], [p[1] for p in packed]))
        yield _found(rows)


def _meet(table: pa.Table, n: int) -> pa.Table:
    """Repeats in one bucket as ranges of words; of windows with a frequent minimiser, also the first of each kind."""
    got = [_unpack(b) for b in table.column("block").to_pylist()]
    ids, marks, begin, hot = (np.concatenate([g[i] for g in got]) for i in range(4))
    words = Words([s for g in got for s in g[4].split(b"\n")])
    h = words.hashes()
    h1, h2 = runs(h, n), runs(h, n, _BASE_2)
    of = np.repeat(np.arange(len(ids)), np.diff(words.first))[: len(h1)]
    at = np.flatnonzero(np.arange(len(h1)) + n <= words.first[1:][of])
    of, h1, h2, place = of[at], h1[at], h2[at], begin[of[at]] + at - words.first[of[at]]
    order = np.lexsort((h2, h1))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(ids[of[order]], heads)[np.cumsum(fresh) - 1]
    repeat = np.empty(len(order), bool)
    repeat[order] = ids[of[order]] > least
    rows = []
    bad = np.flatnonzero(repeat)
    if len(bad):
        new = np.ones(len(bad), bool)
        new[1:] = (bad[1:] != bad[:-1] + 1) | (of[bad][1:] != of[bad][:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(bad) - 1)
        rows.append((ids[of[bad[new]]], marks[of[bad[new]]], place[bad[new]], place[bad[last]] + n, None, None, None, None))
    open_ = np.flatnonzero(~repeat & (hot[of] == 1))
    if len(open_):
        rows.append((ids[of[open_]], marks[of[open_]], place[open_], place[open_] + n, h1[open_].view(np.int64), h2[open_].view(np.int64), None, None))
    return pa.Table.from_batches([_found(rows)]).select(["id", "mark", "start", "end", "h1", "h2"])


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_WORDS) -> DataFrame:
    """(id, mark, ranges): word ranges covered by windows that also start in a document with a smaller id; mark is xxhash64 of the text."""
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    salts = frequent_minimisers(rows, n, buckets)
    dealt = rows.mapInArrow(lambda b: _deal(b, n, buckets, salts), FOUND)
    keyed = dealt.withColumn("bucket", F.coalesce("bucket", (F.pmod(F.col("mark"), F.lit(buckets)) - buckets).cast("int")))

    def meet(table: pa.Table) -> pa.Table:
        if table.column("block").null_count:
            return table.select(["id", "mark", "start", "end", "h1", "h2"])
        return _meet(table, n)

    met = stage(keyed.groupBy("bucket").applyInArrow(meet, "id bigint, mark bigint, start bigint, end bigint, h1 bigint, h2 bigint"), "kmer-met")
    sure = met.where("h1 IS NULL")
    if salts:
        open_ = met.where("h1 IS NOT NULL")
        least = open_.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min("id").alias("least"))
        sure = sure.unionByName(open_.join(least, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where("id > least").drop("k1", "k2", "least"))
    return sure.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_WORDS, size_col: str = "n_words", lost_col: str = "n_removed", as_is: bool = False) -> DataFrame:
    """The input with `text_col` reduced to the words kept, joined by one space, plus size_col (words before) and lost_col (words removed).

    Every row and column stays; columns named like the added ones are replaced.
    `as_is` leaves texts that lose nothing as they are.  Windows are judged on
    the input.  A null text has no words and stays null; texts of fewer than n
    words lose nothing; repeated rows and rows with one id are the same document
    to each other, so none is a repeat of the other; a null id counts as larger
    than any; an empty table gives none.
    """
    docs = docs.drop(size_col, lost_col)
    i, mark, ranges = (fresh(docs, c) for c in ("_id", "_mark", "_ranges"))
    found = repeated_ranges(docs, id_col, text_col, n).toDF(i, mark, ranges)
    names = docs.columns
    met = docs.join(found, (F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NO_ID))) == F.col(i)) & (F.xxhash64(F.col(text_col)) == F.col(mark)), "left").drop(i, mark)

    def work(batches):
        for batch in batches:
            texts, sizes, lost = [], [], []
            for text, gaps in zip(batch.column(text_col).to_pylist(), batch.column(ranges).to_pylist()):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in gaps or ():
                    gone[r["start"]] += 1
                    gone[r["end"]] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                if text is not None and (len(keep) < len(words) or not as_is):
                    text = b" ".join([words[k] for k in keep] if len(keep) < len(words) else words).decode()
                texts.append(text)
                sizes.append(len(words))
                lost.append(len(words) - len(keep))
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())], names=[*names, size_col, lost_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{size_col}` bigint", f"`{lost_col}` bigint"])
    return met.mapInArrow(work, schema)
