"""Token counts of byte-level BPE without producing identifiers.

Each pretoken starts as one symbol a byte.  A heap holds the adjacent pairs
that have a merge rank; the lowest rank (the leftmost on ties) is popped again
and again, and a linked list over the symbols takes the merge.  The number of
tokens is the number of initial symbols less the number of merges.

Rows never move: the count is a map over partitions.  Counts of white-space
delimited chunks are memoised in each worker, at most CACHE_ENTRIES of them and
none longer than CACHE_CHARS, so memory does not depend on the input.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_ENTRIES = 1_500_000
CACHE_CHARS = 48
PAIR_BITS = 24
PLACE_BITS = 40
PLACE_MASK = (1 << PLACE_BITS) - 1

# The Unicode White_Space code points and the byte-level split pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_symbols() -> dict[int, str]:
    """Printable character of every byte: bytes that print stand for themselves, the rest are numbered from 256."""
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[int, int], list[int], list[str]]:
    """(rank of each pair of symbols, symbol that each rank makes, special strings).

    Symbols are numbered in order of appearance only to make the pairs short
    keys.  Files with settings other than plain byte-level merges are refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
        raise ValueError("a plain byte-level BPE file is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take neighbours in are not supported")
    number = {c: b for b, c in byte_symbols().items()}
    ranks, makes = {}, []
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        ranks[number[a] << PAIR_BITS | number[b]] = rank
        makes.append(number.setdefault(a + b, len(number)))
    return ranks, makes, [t["content"] for t in spec["added_tokens"]]


def merged_length(live: list[int], rank_of, makes: list[int]) -> int:
    """Number of symbols left after all merges, lowest rank first; `live` is used up.  rank_of(pair) gives a rank or None."""
    n = len(live)
    heap = [r << PLACE_BITS | i for i, (a, b) in enumerate(zip(live, live[1:])) if (r := rank_of(a << PAIR_BITS | b)) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        top = heappop(heap)
        rank, i = top >> PLACE_BITS, top & PLACE_MASK
        j = after[i]
        if live[i] < 0 or j >= n or rank_of(live[i] << PAIR_BITS | live[j]) != rank:
            continue
        new = live[i] = makes[rank]
        live[j] = -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            rank = rank_of(new << PAIR_BITS | live[k])
            if rank is not None:
                heappush(heap, rank << PLACE_BITS | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(live[h] << PAIR_BITS | new)
            if rank is not None:
                heappush(heap, rank << PLACE_BITS | h)
    return left


class Memo(dict):
    """A bounded memo of a function of a short string; long strings are computed each time."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> int:
        value = self.compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class Counter:
    def __init__(self, ranks: dict[int, int], makes: list[int], specials: list[str]):
        self.rank_of = ranks.get
        self.makes = makes
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.chunks = Memo(self._chunk)

    def _chunk(self, chunk: str) -> int:
        return sum(merged_length(list(piece.encode("utf-8")), self.rank_of, self.makes) for piece in PIECES.findall(chunk))

    def __call__(self, text: str) -> int:
        if self.specials is None or not self.specials.search(text):
            return sum(map(self.chunks.__getitem__, CHUNKS.findall(text)))
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(sum(map(self.chunks.__getitem__, CHUNKS.findall(p))) for p in parts)


_counters: list = []  # the vocabulary that this worker holds, and its counter


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `vocabulary` is the path of a byte-level BPE file, read on the driver and
    broadcast: its size is that of the vocabulary, whatever the corpus.  A null
    text counts as empty (0 bytes, 0 tokens); repeated rows and null ids give a
    row each; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches):
        if not _counters or _counters[0] is not shared.value:
            _counters[:] = [shared.value, Counter(*shared.value)]
        counter = _counters[1]
        for batch in batches:
            ids, n_bytes, n_tokens = batch.column(0), [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(counter(text))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
