"""Repair of conversations against every edit sequence of short ones, and against a plain search of long ones."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversation_repair as repair

PATTERN = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, block string, audit string, c string, h string, gone string"
sys.setrecursionlimit(10_000)
ADDED = {"u": "user", "a": "assistant"}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub("[ \t-\r]+$", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits(rows, faults, letters, added):
    """(cost, audit, rows left) of one choice of edits, None where it is not allowed."""
    cost, audit, out = 0, "", []
    for k in range(len(rows) + 1):
        for x in added[k]:
            cost, audit = cost + 5, audit + "I"
            out.append((ADDED[x], ""))
        if k == len(rows):
            return cost, audit, out
        (role, text), fault, x = rows[k], faults[k], letters[k]
        if x == "D":
            cost, audit = cost + 2, audit + "D"
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (x != "K") + 5 * (fault == "truncated")
        audit += "K" if x == "K" else "R"
        out.append((role if x == "K" else ADDED[x], text))


def every_edit(rows):
    """The cheapest, then ASCII-least of all edit sequences with at most two insertions in a gap."""
    faults = faults_of(rows)
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    for letters in itertools.product("DKua", repeat=len(rows)):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            made = edits(rows, faults, letters, added)
            if made and PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in made[2])) and (best is None or made[:2] < best[:2]):
                best = (*made[:2], "\n".join(f"{r}:{t}" for r, t in made[2]))
    return best


def search(rows):
    """The same by recursion over (row, what the output ends with), for longer conversations."""
    faults = faults_of(rows)

    @functools.cache
    def least(k, end, added):
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[end]
        found = [(0, "", ())] if k == len(rows) and end in ("", "a") else []
        if added < 2:
            x = "a" if end == "u" else "u"
            c, a, r = least(k, x, added + 1)
            found.append((c + 5, "I" + a, ((ADDED[x], ""), *r)))
        if k < len(rows):
            c, a, r = least(k + 1, end, 0)
            found.append((c + 2, "D" + a, r))
            if faults[k] in ("", "truncated"):
                role, text = rows[k]
                for x in fits:
                    extra = 5 * bool(faults[k])
                    if role[:1] == x:
                        c, a, r = least(k + 1, x, 0)
                        found.append((c + extra, "K" + a, ((role, text), *r)))
                    if x != "s":
                        c, a, r = least(k + 1, x, 0)
                        found.append((c + extra + 1, "R" + a, ((ADDED[x], text), *r)))
        return min(found, default=(10**9, "", ()))

    cost, audit, out = least(0, "", 0)
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def outcome(rows):
    """What the operator's parts give for one block, or for blocks of `size` rows."""

    def run(size):
        codes = bytes(["", "blank", "duplicate", "truncated"].index(f) for f in faults_of(rows))
        initials = [r[:1] for r, _ in rows]
        cuts = [slice(k, k + size) for k in range(0, max(1, len(rows)), size)]
        plain = repair.Weights(0)
        ahead, behind = [plain.cost(w) for w in repair.at_end(plain)], []
        for cut in reversed(cuts):
            behind.append(ahead)
            costs = repair.crossing(initials[cut], codes[cut])
            ahead = [min(costs[4 * e + x] + ahead[x] for x in range(4)) for e in range(4)]
        state, audit, out = 0, "", []
        for cut, rest in zip(cuts, reversed(behind)):
            costs, audits, leads = repair.decide(initials[cut], codes[cut], rest, cut is cuts[-1])
            total = costs[0] if cut is cuts[0] else total
            out += [f"{r}:{t}" for r, t in repair.edited(state, *zip(*rows[cut]), audits[state])] if rows[cut] else []
            audit, state = audit + audits[state], leads[state]
        return total, audit, "\n".join(out)

    return run


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "", " "]), rng.choice(["Yes.", "no", " \t", "", "Why?", f"t{rng.random()}.", f"x{rng.random()}"])) for _ in range(n)]


def test_search_equals_every_edit():
    rng = random.Random(3)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3):
        rows = random_rows(rng, n)
        assert search(rows) == every_edit(rows)


def test_blocks_of_any_size_equal_the_search():
    rng = random.Random(4)
    for k in range(300):
        rows = random_rows(rng, rng.randrange(0, 30))
        want = search(rows)
        for size in (1, 2, 5, 64):
            assert outcome(rows)(size) == want, (k, size)


def expected(table):
    """All columns of the operator for (conv, turn, role, text) rows after damage, by conversation."""
    out = []
    for conv, rows in table.items():
        pairs = [(r, t) for _, r, t in rows]
        turns = [x for x, *_ in rows if x is not None]
        faults = faults_of(pairs)
        cost, audit, text = search(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def damaged(rows, order):
    table = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        table.setdefault(conv, []).extend([(turn, role, text)] * (kind > 0) * (1 + (kind == 3)))
    for kept in table.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], order[r[2]], r[2]))
    return table


def _order(spark, texts):
    return dict(map(tuple, spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t)").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(conv, turn, role, text) for conv in range(60) for turn, (role, text) in enumerate(random_rows(rng, rng.randrange(1, 9)))]
    out += [(None, None, None, None), (None, 3, "user", "Said."), (None, 3, "user", "Said."), (None, None, "user", "Said."), (70, None, None, "x."), (71, 5, "user", "z" * 300000), (71, 9, "assistant", "End. \n")]
    out += [(80, k // 3, role, text) for k, (role, text) in enumerate(random_rows(rng, 400))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [128, 3])
def test_operator(spark, rows, block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    data = spark.createDataFrame([(*r, *"qwerty") for r in rows], SCHEMA).repartition(6)
    got = repair.repair(repair.damage(data))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    texts = {t for kept in damaged(rows, defaultdict(int)).values() for _, _, t in kept}
    want = expected(damaged(rows, _order(spark, texts)))
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0)) == want


def test_a_conversation_that_loses_every_row(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = repair.repair(repair.damage(spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")))
    assert [tuple(r) for r in got.collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_no_rows_and_no_damage(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.conv_id, r.blank, r.cost, r.audit) for r in repair.repair(repair.intact(rows)).collect()] == [(1, 1, 4, "DD")]
