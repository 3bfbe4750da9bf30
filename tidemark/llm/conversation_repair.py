"""Cheapest repair of a conversation's turn structure, decided by one integer minimum.

A row is kept, given another role, or deleted, and empty rows may be inserted
anywhere, so that the role initials read `(s?(ua)+)?`.  States say what the
output ends with: nothing, s, u or a.  A path of edits weighs one integer: its
high digits are the cost, its low digits the audit letters in order, one digit
each at fixed width, zeros after the end.  Putting a letter before a suffix
adds its cost above, moves the low digits one place down and writes the letter
on top, which keeps the order of suffixes; so the least integer over the
acyclic graph of (row, state) is the cheapest repair, and among equals the one
with the least audit in ASCII order.

A conversation may be of any length.  Rows are dealt by range over
(conversation, turn), each run of a conversation is cut into blocks of
BLOCK_ROWS, and a block yields the 4 x 4 least costs between states at its two
ends.  Folding those from the end gives the cost that lies ahead of each block;
with it the block's own integers decide its letters, whichever state it is
entered in.  Insertions belong to the row after them, so a block's letters are
never the beginning of another path's, and the first difference inside the
block decides.  What remains for one task per conversation is to chain blocks
and hash the repaired text, as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import stage

BLOCK_ROWS = 128
BLOCK_CHARS = 1 << 18
PART_BITS = 33
#: Spark hands whole row groups to a task, so row groups are kept small.
ROW_GROUP_BYTES = 16 << 20
SPACES = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # where a user or assistant row leads, the only one that fits
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NOWHERE = (None, None, None, None)
ROLE = {USER: "user", ASSISTANT: "assistant"}

CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = "\0DIKR"  # a letter's digit is its place, in ASCII order
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
DIGIT = 3  # bits
BEYOND = 1 << 60


class Weights:
    """Integers of paths with room for `width` letters; width 0 leaves costs alone."""

    def __init__(self, width: int):
        self.bits = DIGIT * width
        self.low = (1 << self.bits) - 1

    def edge(self, letter: int, cost: int) -> int:
        return (cost << self.bits) + (letter << (self.bits - DIGIT) if self.bits else 0)

    def before(self, edge: int, weight: int) -> int:
        """Weight of a path whose first letter is the edge's and whose rest has `weight`."""
        letters = weight & self.low
        return edge + weight - letters + (letters >> DIGIT)

    def cost(self, weight: int) -> int:
        return weight >> self.bits

    def audit(self, weight: int) -> str:
        out, at = [], self.bits - DIGIT
        while at >= 0 and (digit := weight >> at & 7):
            out.append(LETTERS[digit])
            at -= DIGIT
        return "".join(out)


def least_weights(initials: list[str], faults: bytes, ahead: list[int], weights: Weights) -> list[int]:
    """Least weight from each state before the first row, given the weights from each state after the last."""
    edge, before = weights.edge, weights.before
    insert, delete = edge(INSERT, INSERT_COST), edge(DELETE, DELETE_COST)
    keep = {f: edge(KEEP, f == TRUNCATED and TRUNCATED_COST or 0) for f in (CLEAN, TRUNCATED)}
    rerole = {f: edge(REROLE, REROLE_COST + (f == TRUNCATED and TRUNCATED_COST or 0)) for f in (CLEAN, TRUNCATED)}
    for initial, fault in zip(reversed(initials), reversed(faults)):
        taken = [before(delete, ahead[s]) for s in STATES]
        if fault in keep:
            fits = KEPT.get(initial, NOWHERE)
            for s in STATES:
                taken[s] = min(taken[s], before(rerole[fault], ahead[NEXT[s]]))
                if fits[s] is not None:
                    taken[s] = min(taken[s], before(keep[fault], ahead[fits[s]]))
        once = [min(taken[s], before(insert, taken[NEXT[s]])) for s in STATES]
        ahead = [min(taken[s], before(insert, once[NEXT[s]])) for s in STATES]
    return ahead


def at_end(weights: Weights) -> list[int]:
    """Weights after a conversation's last row: nothing and a may end there, u needs one inserted row, s two."""
    done = 0
    user = weights.before(weights.edge(INSERT, INSERT_COST), done)
    return [done, weights.before(weights.edge(INSERT, INSERT_COST), user), user, done]


def crossing(initials: list[str], faults: bytes) -> list[int]:
    """Least cost from each state before a block to each state after it, row by row."""
    plain = Weights(0)
    columns = [least_weights(initials, faults, [0 if s == x else BEYOND for s in STATES], plain) for x in STATES]
    return [min(columns[x][e], BEYOND) for e in STATES for x in STATES]


def walk(state: int, initials: list[str], audit: str) -> int:
    """The state after a block whose edits are `audit`."""
    row = 0
    for letter in audit:
        if letter == "K":
            state = KEPT[initials[row]][state]
        elif letter != "D":
            state = NEXT[state]
        row += letter != "I"
    return state


def decide(initials: list[str], faults: bytes, costs_ahead: list[int], last: bool) -> tuple[list[int], list[str], list[int]]:
    """(least cost, audit letters, state after) of a block for each state before it."""
    weights = Weights(3 * len(initials) + 2)
    ahead = at_end(weights) if last else [c << weights.bits for c in costs_ahead]
    least = least_weights(initials, faults, ahead, weights)
    audits = [weights.audit(w) for w in least]
    return [weights.cost(w) for w in least], audits, [walk(s, initials, a) for s, a in zip(STATES, audits)]


def edited(state: int, roles: list[str], texts: list[str], audit: str):
    """(role, text) of every row that the edits leave."""
    row = 0
    for letter in audit:
        if letter == "K":
            yield roles[row], texts[row]
            state = KEPT[roles[row][:1]][state]
        elif letter != "D":
            state = NEXT[state]
            yield ROLE[state], "" if letter == "I" else texts[row]
        row += letter != "I"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: the rows after damage by crc32 of `conv:turn` (nulls: one space) modulo 20.

    0 drops the row (it stays as a mark with `gone` true, so that its
    conversation is not forgotten), 1 empties its text, 2 takes out its full
    stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    Null roles and texts are one space.
    """
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    text = F.coalesce(F.col(text_col), F.lit(" "))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    hurt = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col), F.lit(" "))).alias("role"),
        F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return hurt.select("conv", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), copies).drop("copy")


def intact(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: the rows as they are; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.lit(False).alias("gone"))


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in order, cut into blocks numbered in order."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    told = rows.withColumn("blank", stripped == "").withColumn("open", ~F.substring(stripped, -1, 1).isin(".", "!", "?"))
    told = told.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    # Few rows say what another of their conversation says; only those learn the turn in which it was said first.
    said = told.where("NOT gone AND NOT blank").groupBy("conv", "same").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("least"))
    said = stage(said.where("n > 1").select(F.col("conv").alias("c"), F.col("same").alias("s"), F.when(~F.col("untimed"), F.col("least")).alias("first")), "repeated-turns")
    told = told.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    told = told.select("conv", "turn", "role", "text", "gone", "blank", "open", F.col("s").isNotNull().alias("again"), "first", F.xxhash64("text").alias("h"))
    ordered = told.repartitionByRange("conv", "turn", "role", "h").sortWithinPartitions("conv", "turn", "role", "h", "text")

    def cut(batches):
        from pyspark import TaskContext

        part, number, started = TaskContext.get().partitionId(), 0, False
        now, before, held, chars, out, schema = None, None, [], 0, [], None

        def flush():
            nonlocal number, held, chars
            initials = [r[:1] for r, *_ in held]
            faults = bytes(f for *_, f in held)
            turns = [t for _, _, t, _ in held if t is not None]
            out.append({
                "block": part << PART_BITS | number, "conv": now, "roles": [r for r, *_ in held], "texts": [x for _, x, *_ in held], "faults": faults,
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "costs": crossing(initials, faults),
            })
            number, held, chars = number + 1, [], 0

        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("block", pa.int64()), ("conv", batch.schema.field(0).type), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.binary()),
                    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())),
                ])
            for conv, turn, role, text, gone, blank, unfinished, again, first in zip(*(c.to_pylist() for c in batch.columns)):
                if started and (conv != now or len(held) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    flush()
                if not started or conv != now:
                    started, now, before = True, conv, None
                if gone:
                    continue
                row = (turn, role, text)
                fault = BLANK if blank else DUPLICATE if again and (turn != first or row == before) else TRUNCATED if unfinished else CLEAN
                before = row
                held.append((role, text, turn, fault))
                chars += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if started:
            flush()
            yield pa.RecordBatch.from_pylist(out, schema)

    shape = f"block bigint, conv {kind}, roles array<string>, texts array<string>, faults binary, first_turn bigint, last_turn bigint, turns bigint, costs array<bigint>"
    return ordered.drop("h").mapInArrow(cut, shape)


def _ahead(blocks: DataFrame) -> DataFrame:
    """block, ahead, last: the least cost from each state after a block to the end of its conversation, folded from the end."""

    def fold(batches):
        now, ahead = object(), None
        for batch in batches:
            found = []
            for conv, block, costs in zip(*(c.to_pylist() for c in batch.columns)):
                last = conv != now
                if last:
                    now, ahead = conv, [Weights(0).cost(w) for w in at_end(Weights(0))]
                found.append({"b": block, "ahead": ahead, "last": last})
                ahead = [min(costs[4 * e + x] + ahead[x] for x in STATES) for e in STATES]
            if found:
                yield pa.RecordBatch.from_pylist(found, pa.schema([("b", pa.int64()), ("ahead", pa.list_(pa.int64())), ("last", pa.bool_())]))

    slim = blocks.select("conv", "block", "costs").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    return slim.mapInArrow(fold, "b bigint, ahead array<bigint>, last boolean")


def repair(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of `rows` (conv, turn, role, text, gone; see `damage` and `intact`).

    Columns: the conversation's id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256.  Rows are taken by turn, nulls first, rows
    of one turn by role, then by a hash of the text and the text; equal rows
    stand side by side.  A row has one fault at most: blank (nothing but white
    space), else duplicate (role and text said earlier; compared by SHA-256),
    else truncated.  A null id is a conversation of its own; one of which all
    rows are gone has zeros, an empty audit and the hash of an empty string.
    An empty table gives no row.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    blocks = stage(_blocks(rows, kind), "conversation-blocks", **{"parquet.block.size": ROW_GROUP_BYTES})

    def edits(batches):
        for batch in batches:
            found = []
            for roles, faults, ahead, last in zip(*(batch.column(c).to_pylist() for c in ("roles", "faults", "ahead", "last"))):
                costs, audits, leads = decide([r[:1] for r in roles], faults, ahead, last)
                found.append({"cost": costs[START], "audits": audits, "leads": leads})
            made = pa.Table.from_pylist(found, pa.schema([("cost", pa.int64()), ("audits", pa.list_(pa.string())), ("leads", pa.list_(pa.int64()))])).combine_chunks().to_batches()
            if made:
                kept = [c for c in batch.schema.names if c not in ("ahead", "last")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made[0].columns], names=[*kept, "cost", "audits", "leads"])

    decided = blocks.drop("costs").join(_ahead(blocks), F.col("block") == F.col("b")).drop("b")
    shape = f"block bigint, conv {kind}, roles array<string>, texts array<string>, faults binary, first_turn bigint, last_turn bigint, turns bigint, cost bigint, audits array<string>, leads array<bigint>"
    decided = decided.mapInArrow(edits, shape)

    def chain(batches):
        one, now, schema = None, object(), None

        def result(x):
            gaps = x["max"] - x["min"] + 1 - x["turns"] if x["min"] is not None else 0
            return [now, gaps, x["faults"][BLANK], x["faults"][DUPLICATE], x["faults"][TRUNCATED], x["illegal"], x["cost"], "".join(x["audit"]), x["sha"].hexdigest()]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([(conv_col, batch.schema.field("conv").type), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            found = []
            for b in batch.to_pylist():
                if b["conv"] != now or one is None:
                    if one is not None:
                        found.append(result(one))
                    now = b["conv"]
                    one = {"state": START, "cost": b["cost"], "audit": [], "sha": hashlib.sha256(), "any": False, "min": None, "max": None, "turns": 0, "faults": [0] * 4, "illegal": 0, "initial": None}
                for r in b["roles"]:
                    one["illegal"] += one["initial"] is not None and one["initial"] + r[:1] not in ("su", "ua", "au")
                    one["initial"] = r[:1]
                for f in (BLANK, DUPLICATE, TRUNCATED):
                    one["faults"][f] += b["faults"].count(f)
                if b["turns"]:
                    one["turns"] += b["turns"] - (one["max"] == b["first_turn"])
                    one["min"] = b["first_turn"] if one["min"] is None else one["min"]
                    one["max"] = b["last_turn"]
                audit = b["audits"][one["state"]]
                for role, text in edited(one["state"], b["roles"], b["texts"], audit):
                    one["sha"].update(f"{chr(10) if one['any'] else ''}{role}:{text}".encode())
                    one["any"] = True
                one["audit"].append(audit)
                one["state"] = b["leads"][one["state"]]
            if found:
                yield batch_of(found)
        if one is not None:
            yield batch_of([result(one)])

    whole = decided.repartition("conv").sortWithinPartitions("conv", "block")
    return whole.mapInArrow(chain, f"`{conv_col}` {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def repair_sql() -> str:
    """Damage and repair in DuckDB's dialect, over `conversations`, by pairs of cost and letters instead of integers.

    Rows of one turn would be ordered by role alone, so the rows must not repeat turns.
    """
    return """
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS d FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE d <> 0),
placed AS (SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS spot FROM hurt),
rows_ AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY spot) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'clean' END AS fault,
  CASE initial WHEN 's' THEN [2, NULL, NULL, NULL] WHEN 'u' THEN [3, 3, NULL, 3] WHEN 'a' THEN [NULL, NULL, 4, NULL] ELSE [NULL, NULL, NULL, NULL]::INT[] END AS fits, lag(initial) OVER (PARTITION BY conv_id ORDER BY spot) AS before FROM placed),
ends AS (SELECT conv_id, max(spot) AS n FROM rows_ GROUP BY 1),
best(conv_id, i, v) AS (
  SELECT conv_id, n, [{'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}] FROM ends
  UNION ALL
  SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda s: list_sort([taken[s], {'c': once[[3, 3, 4, 3][s]].c + 5, 'a': 'I' || once[[3, 3, 4, 3][s]].a}])[1])
  FROM (SELECT *, list_transform([1, 2, 3, 4], lambda s: list_sort([taken[s], {'c': taken[[3, 3, 4, 3][s]].c + 5, 'a': 'I' || taken[[3, 3, 4, 3][s]].a}])[1]) AS once
  FROM (SELECT b.conv_id, b.i, list_transform([1, 2, 3, 4], lambda s: list_sort(list_filter([{'c': v[s].c + 2, 'a': 'D' || v[s].a},
    CASE WHEN r.fault IN ('clean', 'truncated') THEN {'c': v[[3, 3, 4, 3][s]].c + 1 + 5 * (r.fault = 'truncated')::INT, 'a': 'R' || v[[3, 3, 4, 3][s]].a} END,
    CASE WHEN r.fault IN ('clean', 'truncated') AND r.fits[s] IS NOT NULL THEN {'c': v[r.fits[s]].c + 5 * (r.fault = 'truncated')::INT, 'a': 'K' || v[r.fits[s]].a} END], lambda x: x IS NOT NULL))[1]) AS taken
  FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.spot = b.i))),
chosen AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM best WHERE i = 0),
walk(conv_id, audit, p, row, state, kept) AS (
  SELECT conv_id, audit, 0, 0, 1, []::VARCHAR[] FROM chosen
  UNION ALL
  SELECT conv_id, audit, p + 1, row + (letter <> 'I')::INT, after, CASE WHEN letter = 'D' THEN kept ELSE list_append(kept, CASE WHEN letter = 'K' THEN role WHEN after = 3 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.*, r.role, r.text, w.audit[w.p + 1] AS letter, CASE w.audit[w.p + 1] WHEN 'D' THEN w.state WHEN 'K' THEN r.fits[w.state] ELSE [3, 3, 4, 3][w.state] END AS after
    FROM walk w LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.spot = w.row + 1 WHERE w.p < len(w.audit))),
repaired AS (SELECT conv_id, sha256(array_to_string(kept, chr(10))) AS repaired_sha256 FROM walk WHERE p = len(audit)),
facts AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""
