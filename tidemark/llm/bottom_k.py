"""MinHash near-dedup from bottom-k sketches of one hash function.

1. A document's set is its distinct word shingles.  Documents with equal sets
   are one class, so copies never meet in pairs; its smallest id represents it.
2. A representative's sketch is its K smallest shingle hashes.  Sets with
   Jaccard similarity t share about t*K of them, hardly ever fewer than K/2, so
   two such sketches share a value among the rarest K - K/2 + 1 of each (small
   sets: the exact prefix).  Those values key the inverted lists.
3. Links are sought so that no list is paired out.  First each list's smallest
   id is compared with the rest (a star), then one picked by a hash of list and
   id with those that are still apart from it.  Those pairs pass the union-sketch
   estimate (t less five standard deviations), then exact Jaccard on full sets;
   links make components.
4. Only lists that hold several components can join any; all others are left
   behind.  Those with one smallest id form a group (the lists of one family of
   copies mostly have the same).  Its sketches meet in a task, or in tasks for two
   parts of SKETCHES_PER_SET * LIST_PART each, and leave the sets that may be
   similar to one of another component.  The full sets of those meet likewise, in
   parts of at most LIST_PART sets and PART_SHINGLES shingles, and give only as
   many links as join components.
5. All links make the final components.

Pairs that no candidate could connect anew are not compared: membership, not the
list of all links, is the result, and it is the same.  The chance that sketches
hide a link (too few shared values, or an estimate five deviations low) is below
one in a million for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.text import Words, blocks, shingles
from tidemark.sources.staging import discard, stage

K = 64
PERCENT = 80
LIST_PART = 4096
PART_SHINGLES = 1 << 22
SKETCHES_PER_SET = 8
GROUPS_ROWS = 4096
DEVIATIONS = 5
BROADCAST_ROWS = 1_000_000


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text, letters A-Z in lower case."""
    words = Words(texts, fold=True)
    value, owner = shingles(words.hashes(), words.first, k)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [value[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _each_set(batches, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column("text")]
        out: list[np.ndarray] = []
        for part in blocks(map(len, texts)):
            out += shingle_sets(texts[part], k)
        yield batch, out


def sketches(docs: DataFrame, shingle_words: int, k: int = K) -> DataFrame:
    """(id, text) -> (id, n, set, sketch): set size, a 128-bit digest of the set, and the k smallest hashes; a map over rows."""

    def work(batches):
        for batch, sets in _each_set(batches, shingle_words):
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array([r[: 8 * k] for r in raw], pa.binary())],
                names=["id", "n", "set", "sketch"],
            )

    return docs.mapInArrow(work, "id bigint, n bigint, set binary, sketch binary")


def _values(reps: DataFrame, k: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            sets = [np.frombuffer(s.as_py(), np.int64) for s in batch.column("sketch")]
            size = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("id").to_numpy(), size)), pa.array(np.repeat(batch.column("n").to_numpy(), size)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))],
                names=["id", "n", "value"],
            )

    return reps.select("id", "n", "sketch").mapInArrow(work, "id bigint, n bigint, value bigint")


def inverted_lists(reps: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(value, id, n): the rarest retained values of each set, as many as a similar set must meet, where another set has them too.

    Values of one set alone take their places among the rarest but make no list.
    """
    values = _values(reps, k)
    often = values.groupBy(F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(often, F.col("value") == F.col("_v")).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    kept = F.least(F.col("n"), F.lit(k))
    exact = F.floor(F.col("n") * (100 - percent) / 100) + 1
    prefix = F.when(F.col("n") * 100 <= k * percent, exact).otherwise(kept - k // 2 + 1)
    left = (prefix - (kept - F.size("v"))).cast("int")
    listed = shared.where(left > 0).select("id", "n", F.explode(F.slice("v", F.lit(1), left)).alias("v")).select(F.col("v.value").alias("value"), "id", "n")
    lists = stage(listed, "listed-values")
    real = lists.groupBy(F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("first")).where("entries > 1")
    return lists.join(real, F.col("value") == F.col("_v")).drop("_v")


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, int]:
    """Share of the union's k smallest values that both sketches hold, and how many those are."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    n = len(union)
    return (int(np.searchsorted(both, union[-1], side="right")) / n if n else 0.0), n


def _likely(a: np.ndarray, b: np.ndarray, k: int, percent: int) -> bool:
    estimate, n = _estimate(a, b, k)
    t = percent / 100
    return estimate >= t - DEVIATIONS * (t * (1 - t) / max(1, n)) ** 0.5


def _compare(pairs: DataFrame, table: DataFrame, column: str, test) -> DataFrame:
    """Pairs (a, b) whose rows of `table` (id, column) pass test(bytes, bytes)."""
    left, right = (table.select(F.col("id").alias(f"_{e}"), F.col(column).alias(f"_{e}s")) for e in ("a", "b"))
    met = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "_as", "_bs")

    def work(batches):
        for batch in batches:
            keep = [test(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(work, "a bigint, b bigint")


def _overlaps(sets: list[np.ndarray]):
    """A function of x that gives the number of values set x has in common with every set."""
    value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]

    def shared(x: int) -> np.ndarray:
        low = np.searchsorted(value, sets[x], side="left")
        span = np.searchsorted(value, sets[x], side="right") - low
        at = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
        return np.bincount(row[at], minlength=len(sets))

    return shared


def _touching(group: np.ndarray, sets: list[np.ndarray], size: np.ndarray, comp: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Which rows have a sketch that may be that of a set similar to one of another component of their group.

    Sketches of sizes up to m that share fewer values than the least estimate
    allows for a union of m values cannot pass it, for any larger union either.
    Two that share enough also share one of the values that are rarest in the
    group, so only those are followed to other rows.  Groups are handled
    together: a value counts in each group by itself.
    """
    kept, t = np.array([len(x) for x in sets]), percent / 100
    least = lambda m: np.maximum(1, np.ceil(m * t - DEVIATIONS * np.sqrt(m * t * (1 - t)))).astype(int)
    row = np.repeat(np.arange(len(sets)), kept)
    _, plain = np.unique(np.concatenate(sets), return_inverse=True)
    _, value, often = np.unique(group[row] * (plain.max() + 1) + plain, return_inverse=True, return_counts=True)
    starts = np.cumsum(kept) - kept
    table = np.full((len(sets), k), len(often))
    table[row, np.arange(len(row)) - starts[row]] = value
    # The rarest values of each row, and the rows that have a value among theirs.
    order = np.lexsort((value, often[value], row))
    rare = order[np.arange(len(row)) - starts[row] <= (kept - least(kept))[row]]
    rare = rare[often[value[rare]] > 1]
    rare_value, rare_row = value[rare], row[rare]
    mine = np.searchsorted(rare_row, np.arange(len(sets) + 1))
    by_value = np.argsort(rare_value, kind="stable")
    holders, first = rare_row[by_value], np.searchsorted(rare_value[by_value], np.arange(len(often) + 1))

    found, marked, met = np.zeros(len(sets), bool), np.zeros(len(often) + 1, bool), np.zeros(len(sets), bool)
    for x in range(len(sets)):
        for v in rare_value[mine[x] : mine[x + 1]]:
            met[holders[first[v] : first[v + 1]]] = True
        near = np.flatnonzero(met)
        met[near] = False
        near = near[(comp[near] != comp[x]) & (100 * np.minimum(size[near], size[x]) >= percent * np.maximum(size[near], size[x]))]
        if len(near):
            own = table[x, : kept[x]]
            marked[own] = True
            found[x] = (marked[table[near]].sum(1) >= least(np.maximum(kept[near], kept[x]))).any()
            marked[own] = False
    return found


def _close(met: DataFrame, k: int, percent: int) -> DataFrame:
    """Distinct (first, id, component) of the rows that `_touching` finds in the groups (first, p, q)."""

    def work(batches):
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            first, p, q = (rows[c].to_numpy() for c in ("first", "p", "q"))
            starts = np.concatenate(([True], (first[1:] != first[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            sets = [np.frombuffer(x, np.uint64) for x in rows["sketch"].to_pylist()]
            some = pa.array(_touching(starts.cumsum(), sets, rows["n"].to_numpy(), rows["component"].to_numpy(), k, percent))
            return rows.select(["first", "id", "component"]).filter(some).combine_chunks()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < GROUPS_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows[c][-1].as_py() for c in ("first", "p", "q")]
            whole = len(rows) - int(np.logical_and.reduce([rows[c].to_numpy() == v for c, v in zip(("first", "p", "q"), last)]).sum())
            if whole:
                yield from found(rows.slice(0, whole)).to_batches()
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield from found(pa.Table.from_batches(held)).to_batches()

    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = met.repartition(tasks, "first", "p", "q").sortWithinPartitions("first", "p", "q")
    return ordered.select("first", "p", "q", "id", "component", "n", "sketch").mapInArrow(work, "first bigint, id bigint, component bigint").distinct()


def _joining(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links, by exact Jaccard on full sets, that join components of one group; as many as it takes, not all of them."""
    group = group.drop_duplicates("id").sort_values("id", ignore_index=True)
    sets = [np.frombuffer(f, np.uint64) for f in group["full"]]
    ids, size = group["id"].to_numpy(), np.array([len(x) for x in sets])
    names, comp, count = np.unique(group["component"].to_numpy(), return_inverse=True, return_counts=True)
    shared, out = _overlaps(sets), []
    for x in np.flatnonzero(comp != np.argmax(count)):
        both = shared(x)
        for y in np.flatnonzero((100 * both >= percent * (size + size[x] - both)) & (comp != comp[x])):
            if comp[y] != comp[x]:
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                comp[comp == comp[y]] = comp[x]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = PERCENT, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked if their sets have 100 * intersection >= percent *
    union; component_id is the smallest id reachable and `kept` tells whether
    that is the document itself.  Texts without words (null, empty) have no
    shingles and are linked with nothing; texts of fewer words than a shingle
    have one, the whole sequence; repeated rows are linked by their equal sets
    and get a row each; a null id is linked with nothing, has a null component
    and is kept; an empty table gives no rows; other columns are not read.
    """
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    drawn = stage(sketches(text, shingle_words, k), "sketches")
    classes = drawn.where("n > 0 AND id IS NOT NULL").groupBy("set").agg(F.min("id").alias("rep"))
    heads = drawn.join(classes.withColumnRenamed("set", "_set"), (F.col("set") == F.col("_set")) & (F.col("id") == F.col("rep"))).select("id", "n", "set", "sketch").dropDuplicates(["id"])
    reps = stage(heads.where(F.col("n") * (100 - percent) >= percent), "representatives")  # a smaller set has no similar set but itself
    lists = stage(inverted_lists(reps, k, percent), "lists")

    def full_sets(ids: DataFrame) -> DataFrame:
        """(id, full) of the documents `_id`, from their texts; a row of the id with another set is not its."""
        listed = stage(ids.distinct().join(reps.select("id", "set"), F.col("_id") == F.col("id")).select("_id", F.col("set").alias("_set")), "listed")
        some = F.broadcast(listed) if listed.count() <= broadcast_rows else listed
        sets = stage(text.join(some, F.col("id") == F.col("_id")).select("id", "text", "_set").mapInArrow(full, "id bigint, full binary"), "full-sets")
        discard(listed)
        return sets

    def full(batches):
        for batch, sets in _each_set(batches, shingle_words):
            raw = [x.tobytes() for x in sets]
            meant = pa.array([xxhash.xxh3_128_digest(r) == w for r, w in zip(raw, batch.column("_set").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "full"]).filter(meant)

    def exact(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        return _likely(x, y, k, percent)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that pass the union-sketch estimate, then exact Jaccard; full sets are made for those of the first kind alone."""
        likely = stage(_compare(pairs, reps, "sketch", near), "likely")
        sets = full_sets(likely.select(F.explode(F.array("a", "b")).alias("_id")))
        found = stage(_compare(likely, sets, "full", exact), "verified")
        discard(likely, sets)
        return found

    def mixed(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Rows of the lists that hold several components; no other list can have a link that joins any."""
        labels = connected(links).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        at = rows.join(labels, F.col("id") == F.col("_node"), "left").withColumn("component", F.coalesce("_component", "id")).drop("_node", "_component")
        torn = at.groupBy(F.col("value").alias("_v")).agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("_v")
        return stage(at.join(torn, F.col("value") == F.col("_v")).drop("_v"), "mixed")

    sized = (F.least("n", "_n") * 100) >= (F.greatest("n", "_n") * percent)
    hubs = lists.where("id = first").select(F.col("value").alias("_v"), F.col("id").alias("_hub"), F.col("n").alias("_n")).dropDuplicates(["_v"])
    stars = lists.join(hubs, F.col("value") == F.col("_v")).where((F.col("id") != F.col("_hub")) & sized).select(F.col("_hub").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(stars)

    at = mixed(lists, links)
    discard(lists)
    picked = at.groupBy(F.col("value").alias("_v")).agg(F.min_by(F.struct("id", "n", "component"), F.xxhash64("value", "id")).alias("_h")).select("_v", F.col("_h.id").alias("_hub"), F.col("_h.n").alias("_n"), F.col("_h.component").alias("_hc"))
    stars = at.join(picked, F.col("value") == F.col("_v")).where((F.col("component") != F.col("_hc")) & sized).select(F.least("_hub", "id").alias("a"), F.greatest("_hub", "id").alias("b")).distinct()
    links = links.unionByName(verified(stars))

    still = mixed(at.drop("component"), links)
    near_by = still.select("first", "id", "component").distinct()
    torn = near_by.groupBy(F.col("first").alias("_f")).agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_rows")).where("_lo <> _hi")

    def dealt_out(rows: DataFrame, sizes: DataFrame, parts: Column) -> DataFrame:
        """Rows of each group for every two of its parts, (first, p, q)."""
        mine, other = F.pmod(F.xxhash64("id"), parts), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
        placed = rows.join(sizes, F.col("first") == F.col("_f")).select("first", "id", "component", mine.alias("mine"), other.alias("other"))
        return placed.select("first", "id", "component", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))

    met = dealt_out(near_by, torn, F.ceil(F.col("_rows") / (SKETCHES_PER_SET * LIST_PART)).cast("bigint")).join(reps.select(F.col("id").alias("_id"), "n", "sketch"), F.col("id") == F.col("_id")).drop("_id")
    close = stage(_close(met, k, percent), "close")
    sized = close.join(reps.select(F.col("id").alias("_id"), "n"), F.col("id") == F.col("_id")).groupBy(F.col("first").alias("_f")).agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_size"))
    dealt = stage(dealt_out(close, sized, F.ceil(F.greatest(F.col("_rows") / LIST_PART, F.col("_size") / PART_SHINGLES)).cast("bigint")), "dealt")
    sets = full_sets(dealt.select(F.col("id").alias("_id")))
    met = dealt.join(sets.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
    joined = met.select("first", "p", "q", "id", "component", "full").groupBy("first", "p", "q").applyInPandas(lambda g: _joining(g, percent), "a bigint, b bigint")
    links = links.unionByName(stage(joined.distinct(), "verified"))
    discard(at, still, close, dealt, sets)

    labels = connected(links).select(F.col("node").alias("_node"), "component")
    whole = classes.join(labels, F.col("rep") == F.col("_node"), "left").select(F.col("set").alias("_set"), F.coalesce("component", "rep").alias("_component"))
    out = drawn.select("id", "n", "set").join(whole, (F.col("set") == F.col("_set")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    component = F.coalesce("_component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
