"""Alignment of two tokenisations of the same bytes, with Arrow columns inside tasks.

Both tokenisations of a slice of documents are list columns.  Flattened tokens
with the indices of their parents give byte lengths, a running sum restarted
at each document gives byte ends, and a hash join on (document, end) finds the
ends that both have: they cut the tokens into groups.  Links are the pairs of
tokens within a group; Table.group_by counts them for each document.

A pair's count over the corpus is the number of documents that hold it: tasks
count pairs with Table.group_by and Spark adds the counts.  The most frequent
pairs, at most FREQUENT of them, are broadcast and answer most links where they
are; the links of all other pairs meet their counts in a shuffle, so no count
is lost and no pair is hot there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_count import byte_symbols
from tidemark.llm.chunk_ids import chunk_ids, read_spec
from tidemark.llm.text import blocks
from tidemark.sources.staging import stage

FREQUENT = 1 << 19
SLICE_BYTES = 1 << 21
SLICE_PAIRS = 1 << 20
#: Groups of more links than this count their distinct tokens before these are paired.
LARGE_GROUP = 1 << 10
#: Partial counts held by a task.
PARTIAL_PAIRS = 1 << 20
ROW_BITS = 33
ROW_GROUP_BYTES = 32 << 20


class Side:
    """A vocabulary: encoder of many texts, and the bytes of each token."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(tokens, pa.binary())
        self.sizes = pc.binary_length(self.bytes).cast(pa.int64())
        self.names = pa.array([str(i) for i in range(len(tokens))], pa.string())

    def lists(self, texts: list[str]) -> pa.ListArray:
        return self.encode(texts)

    def joined(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each text's tokens, one after the other."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.bytes.take(lists.values)), b"")


def byte_level(spec: str) -> Side:
    """Space and text by a byte-level file, special strings as plain text."""
    ids_of = chunk_ids(spec, plain_specials=True)
    number = {c: b for b, c in byte_symbols().items()}

    def encode(texts):
        coded = [ids_of(" " + t) for t in texts]
        offsets = np.cumsum([0, *(len(c) // 4 for c in coded)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))

    entries = [ids_of.library.id_to_token(i) for i in range(ids_of.library.get_vocab_size())]
    return Side(encode, [bytes(number[c] for c in e) for e in entries])


def sentence_pieces(model: bytes) -> Side:
    """Texts by a piece model, which adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=model)

    def encode(texts):
        return pa.array(library.encode(texts, num_threads=1), pa.list_(pa.int32()))

    n = library.get_piece_size()
    pieces = [library.id_to_piece(i) for i in range(n)]
    return Side(encode, [bytes([int(p[1:-1], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


def _ends(side: Side, lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(index of the document, byte end within it) of every token."""
    parents = pc.list_parent_indices(lists)
    running = pc.cumulative_sum(side.sizes.take(lists.values)).to_numpy()
    before = np.concatenate(([0], running))[lists.offsets.to_numpy()]
    return parents, running - before[parents.to_numpy()]


def _paired(group_offsets: tuple[np.ndarray, np.ndarray], sides: tuple[pa.Array, pa.Array], group_docs: np.ndarray, pairs_of_a: int, codes: int) -> pa.Table:
    """(key, times): key is document * codes + a * pairs_of_a + b, for every link of a group; large groups pair distinct tokens with their frequencies."""
    (first_a, first_b), (flat_a, flat_b) = group_offsets, sides
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    large = n_a * n_b > LARGE_GROUP
    of_a = np.repeat(np.arange(len(n_a)), n_a)
    small = np.flatnonzero(~large[of_a])
    partners = pa.ListArray.from_arrays(pa.array(first_b, pa.int32()), flat_b).take(pa.array(of_a[small]))
    at = small[pc.list_parent_indices(partners).to_numpy()]
    key = group_docs[of_a[at]] * codes + flat_a.to_numpy()[at].astype(np.int64) * pairs_of_a + partners.flatten().to_numpy()
    links = [pa.table({"key": key, "times": np.ones(len(key), np.int64)})]
    if large.any():
        counted = []
        for first, flat, name in ((first_a, flat_a, "a"), (first_b, flat_b, "b")):
            of = np.repeat(np.arange(len(large)), np.diff(first))
            here = large[of]
            counted.append(pa.table({"group": of[here], name: flat.to_numpy()[here].astype(np.int64)}).group_by(["group", name], use_threads=False).aggregate([(name, "count")]))
        met = counted[0].join(counted[1], "group", join_type="inner", use_threads=False)
        group, a, b, m, n = (met[c].to_numpy() for c in ("group", "a", "b", "a_count", "b_count"))
        links.append(pa.table({"key": group_docs[group] * codes + a * pairs_of_a + b, "times": m * n}))
    return pa.concat_tables(links)


def aligned(texts: list[str], a: Side, b: Side) -> dict[str, np.ndarray | pa.Array]:
    """Columns of a slice of texts: n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with how often each is linked."""
    lists_a, lists_b = a.lists(texts), b.lists(texts)
    whole = pa.array([(" " + t).encode() for t in texts], pa.binary())
    same = pc.and_(pc.equal(a.joined(lists_a), whole), pc.equal(b.joined(lists_b), whole)).to_numpy(zero_copy_only=False) & np.array([bool(t) for t in texts])
    good = np.flatnonzero(same)
    lists_a, lists_b = (pa.ListArray.from_arrays(pa.array(np.cumsum([0, *pc.list_value_length(x).to_numpy()]), pa.int32()), x.flatten()) for x in (lists_a.take(pa.array(good)), lists_b.take(pa.array(good))))
    n_a, n_b = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (lists_a, lists_b))

    (docs_a, ends_a), (docs_b, ends_b) = _ends(a, lists_a), _ends(b, lists_b)
    met = pa.table({"doc": docs_a, "end": ends_a, "a": np.arange(len(ends_a))}).join(pa.table({"doc": docs_b, "end": ends_b, "b": np.arange(len(ends_b))}), ["doc", "end"], join_type="inner", use_threads=False)
    first_a, first_b = (np.concatenate(([0], np.sort(met[c].to_numpy()) + 1)) for c in ("a", "b"))
    group_docs = docs_a.to_numpy()[first_a[1:] - 1].astype(np.int64)
    n_groups = np.bincount(group_docs, minlength=len(good))
    doc_groups = np.concatenate(([0], np.cumsum(n_groups)))
    links_before = np.concatenate(([0], np.cumsum(np.diff(first_a) * np.diff(first_b))))

    named = [pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), side.names.take(lists.values)), ",") for first, side, lists in ((first_a, a, lists_a), (first_b, b, lists_b))]
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(doc_groups, pa.int32()), pc.binary_join_element_wise(*named, "|")), ";")

    codes = len(a.bytes) * len(b.bytes)
    counted = _paired((first_a, first_b), (lists_a.values, lists_b.values), group_docs, len(b.bytes), codes).group_by("key", use_threads=False).aggregate([("times", "sum")])
    key, times = counted["key"].to_numpy(), counted["times_sum"].to_numpy()
    order = np.argsort(key)
    key, times = key[order], times[order]

    def spread(values, kind=np.int64):
        out = np.zeros(len(texts), kind)
        out[good] = values
        return out

    digests = np.full(len(texts), "", object)
    digests[good] = [hashlib.sha256(g.as_py().encode()).hexdigest() for g in groups]
    n_pairs = spread(np.bincount(key // codes, minlength=len(good)))
    return {
        "n_a": spread(n_a), "n_b": spread(n_b), "n_groups": spread(n_groups), "n_links": spread(np.diff(links_before[doc_groups])), "groups_sha256": pa.array(digests, pa.string()),
        "offsets": np.concatenate(([0], np.cumsum(n_pairs))), "pairs": key % codes, "times": times,
    }


_sides: list = []  # the vocabularies that this worker holds: their content, then both sides


def alignment(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The two paths name a byte-level file and a piece model; both are read on the
    driver and broadcast: their size is that of the vocabularies.  A null or
    empty text, or one whose tokens do not spell it, gives zeros and an empty
    groups_sha256.  Every row counts as a document of its own, repeated ids too;
    an empty table gives no row; other columns are not read.  Texts are never
    cut; memory in a task is that of a slice of SLICE_BYTES, or of one text.
    """
    spark = docs.sparkSession
    with open(piece_vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast((read_spec(byte_vocabulary), f.read()))
    local = (byte_level(content.value[0]), sentence_pieces(content.value[1]))
    pairs_of_a, codes = len(local[1].bytes), len(local[0].bytes) * len(local[1].bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    code, arrow_code = ("int", pa.int32()) if codes < 1 << 31 else ("bigint", pa.int64())

    def align(batches):
        from pyspark import TaskContext

        if not _sides or _sides[0] != content.value:
            _sides[:] = [content.value, byte_level(content.value[0]), sentence_pieces(content.value[1])]
        number = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for part in blocks(sizes, SLICE_BYTES):
                n = part.stop - part.start
                ids, texts = batch.column(0)[part], [t or "" for t in batch.column(1)[part].to_pylist()]
                x = aligned(texts, *_sides[1:])
                lists = [pa.ListArray.from_arrays(pa.array(x["offsets"], pa.int32()), pa.array(v, t)) for v, t in ((x["pairs"], arrow_code), (x["times"], pa.int64()))]
                plain = [pa.array(x[c]) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(n)), ids, *plain, x["groups_sha256"], *lists], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                number += n

    shape = f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{code}>, times array<bigint>"
    aligned_docs = stage(docs.select(id_col, text_col).mapInArrow(align, shape), "alignments", **{"parquet.block.size": ROW_GROUP_BYTES, "compression": "zstd"})

    def count(batches):
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for batch in batches:
            lists = batch.column(0)
            for start in range(0, len(lists), 512):
                seen = lists[start : start + 512].flatten().cast(pa.int64())
                held = pa.concat_tables([held, pa.table({"pair": seen, "n": pa.repeat(pa.scalar(1, pa.int64()), len(seen))})]).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
                if len(held) > PARTIAL_PAIRS:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        yield from held.to_batches()

    counts = stage(aligned_docs.select("pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    # One row for each token of the first vocabulary at most.
    highest = counts.groupBy(F.expr(f"pair div {pairs_of_a}").alias("a")).agg(F.max("n").alias("top"))
    judged = counts.join(F.broadcast(highest), F.expr(f"pair div {pairs_of_a}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    step = F.floor(F.log2("n") * 4)
    cut, among = None, 0
    for size, pairs in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        among += pairs
        if among > FREQUENT:
            break
        cut = size
    often = judged.where(step >= cut) if cut is not None else judged.limit(0)
    known = often.toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def resolve(batches):
        pair, n, best = known.value
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            held = pc.list_value_length(columns["pairs"]).to_numpy()
            for part in blocks(held.tolist(), SLICE_PAIRS):
                rows = columns["row"][part]
                lists, times = columns["pairs"][part], columns["times"][part].flatten().to_numpy()
                at, sought = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy().astype(np.int64)
                place = np.minimum(np.searchsorted(pair, sought), max(len(pair) - 1, 0))
                found = pair[place] == sought if len(pair) else np.zeros(len(sought), bool)
                hit = place[found]
                links = pa.table({"at": np.concatenate((at[found], np.arange(len(rows)))), "best": np.concatenate((times[found] * best[hit], np.zeros(len(rows), np.int64))), "sum": np.concatenate((times[found] * n[hit], np.zeros(len(rows), np.int64)))})
                sums = links.group_by("at", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")]).sort_by("at")
                heads = {"row": rows, "pair": pc.subtract(-1, rows), "links": pa.nulls(len(rows), pa.int64()), "n_best": sums["best_sum"].combine_chunks(), "count_sum": sums["sum_sum"].combine_chunks()}
                yield pa.RecordBatch.from_arrays([*heads.values(), *(columns[c][part] for c in base)], names=[*heads, *base])
                rest = np.flatnonzero(~found)
                tails = [rows.take(pa.array(at[rest])), pa.array(sought[rest]), pa.array(times[rest]), pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64())]
                yield pa.RecordBatch.from_arrays([*tails, *(pa.nulls(len(rest), columns[c].type) for c in base)], names=[*heads, *base])

    base = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    shape = f"row bigint, pair bigint, links bigint, n_best bigint, count_sum bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    rare = (judged.where(step < cut) if cut is not None else judged).withColumnRenamed("pair", "p")
    mixed = aligned_docs.mapInArrow(resolve, shape).join(rare, F.col("pair") == F.col("p"), "left")
    n_best = F.sum(F.coalesce("n_best", F.when(F.col("best"), F.col("links")).otherwise(0))).alias("n_best")
    count_sum = F.sum(F.coalesce("count_sum", F.col("links") * F.col("n"))).alias("count_sum")
    whole = mixed.groupBy("row").agg(*(F.max(c).alias(c) for c in base), n_best, count_sum)
    return whole.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
