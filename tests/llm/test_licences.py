"""Licence scans: notices wherever they stand, against a plain version that tries every window."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidemark.llm import licence_dice

SCHEMA = "doc_id bigint, text string, row string, w string, dice string, start string, template string, licence string, m string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, templates=licence_dice.TEMPLATES, least=0.8):
    """(licence, dice, start, windows that reach it)."""
    w = words(text)
    pairs, found = list(zip(w, w[1:])), []
    for k, (name, body) in enumerate(templates):
        b = words(body)
        bag, m = Counter(zip(b, b[1:])), len(b) - 1
        for s in range(len(pairs)):
            window = Counter(pairs[s : s + m])
            dice = 2 * sum((window & bag).values()) / (window.total() + m)
            if pairs[s] in bag and dice >= least:
                found.append((-dice, -m, s, k, name))
    best = min(found, default=None)
    return (best[4], -best[0], best[2], len(found)) if best else (None, None, None, 0)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    filler = lambda n: " ".join(rng.choice(["the", "of", "software", "license", "Lorem", "under", "and", "permission", "version", "2", "granted"]) for _ in range(n))
    texts = [None, "", "one", "license", " \n\t", "Copyright 2020 Foo Bar. Licensed under the Apache License, Version 2.0. All other rights reserved.", "Released\nunder\n the MIT\r\nLicense."]
    for _, body in licence_dice.TEMPLATES:
        plain = body.split()
        wrapped = "\n".join(" ".join(plain[i : i + 5]) for i in range(0, len(plain), 5))
        edited = " ".join("edit" if rng.random() < 0.04 else x for x in plain)
        texts += [body, filler(40) + " " + body + " " + filler(30), "// " + wrapped, edited, body[: len(body) // 2], body[: int(len(body) * 0.75)], body + " " + body]
    texts += [filler(9000) + " Released under the MIT License. " + filler(9000), "the of " * 3000, filler(300)]
    return [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, texts[5]), (None, None)]


def test_every_window(spark, rows):
    got = licence_dice.licence_scan(spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "licence", "dice", "start", "n_found"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *brute(t))) for i, t in rows)


def test_notices_inside_paragraphs_and_over_lines(spark, rows):
    found = {r.doc_id: r.licence for r in licence_dice.licence_scan(spark.createDataFrame([r for r in rows if r[0] is not None][:7], "doc_id bigint, text string")).collect()}
    assert found == {0: None, 1: None, 2: None, 3: None, 4: None, 5: "Apache-2.0", 6: "MIT"}


def test_sql_gives_the_same(spark, rows, tmp_path):
    rows = [r for r in dict(r for r in rows if r[0] is not None).items()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = licence_dice.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    relation = con.sql(licence_dice.licence_sql())
    assert sorted(relation.columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(relation.columns).collect()))) == sorted(map(repr, relation.fetchall()))


def test_other_templates_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d y")], "doc_id bigint, text string")
    templates = (("L", "a b c d"), ("M", "one"))
    assert sorted(map(tuple, licence_dice.licence_scan(docs, templates=templates, least=1.0).collect())) == [(1, "L", 1.0, 0, 1), (2, "L", 1.0, 1, 1)]
    assert licence_dice.licence_scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_every_window_that_reaches_the_least_has_a_needed_word(least):
    rng = random.Random(3)
    for _, body in licence_dice.TEMPLATES:
        w = words(body)
        needed = set(licence_dice.needed_words(body, least))
        bag, m = Counter(zip(w, w[1:])), len(w) - 1
        for _ in range(40):
            holes = [("gap" if rng.random() < 0.15 or x in needed else x) for x in w]
            window = Counter(zip(holes, holes[1:]))
            assert 2 * sum((window & bag).values()) / (2 * m) < least
