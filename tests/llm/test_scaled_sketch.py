"""Fingerprints and likenesses of documents and their edited texts, against plain integers and sets."""

import hashlib
import random

from tidemark.llm import scaled_sketch

BASE, M = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def word_hash(word):
    if len(word) >= 512:
        return mix(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
    x = len(word)
    for b in word:
        x = (x * BASE + b) & M
    return mix(x)


def sketch(text, k=5):
    """(distinct shingles, kept hashes) of a text."""
    hashes = [word_hash(w) for w in text.encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    runs = [hashes[i : i + k] for i in range(len(hashes) - k + 1)] if len(hashes) >= k else [hashes] if hashes else []
    found = set()
    for run in runs:
        x = len(run)
        for h in run:
            x = (x * BASE + h) & M
        found.add(mix(x) >> 32)
    return len(found), sorted(h for h in found if h < 1 << 30)


def fingerprint(text):
    n, kept = sketch(text)
    return f"{hashlib.blake2b(text.encode(), digest_size=8).hexdigest()}:{n}:{''.join(f'{h:08x}' for h in kept)}"


def alike(a, b):
    if a == b:
        return 1.0
    x, y = set(sketch(a)[1]), set(sketch(b)[1])
    return len(x & y) / len(x | y) if x | y else 0.0


def test_neighbours(spark):
    rng = random.Random(21)
    say = lambda n: " ".join(f"w{rng.randrange(60)}{rng.choice(['', ',', 'é'])}" for _ in range(n))
    base = say(200)
    texts = [None, "", "one", "one two", base, base + " and more words here", say(90), say(3000), "🙂é" * 400, "z" * 700 + " y", " \t\n", say(5)]
    rows = [(k * 7 - 20, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    want, down = [], sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, text), (_, after) in zip(down, down[1:] + down[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(text), fingerprint(changed), alike(text, changed), alike(text, after)))
    docs = spark.createDataFrame([(*r, *"abc") for r in rows], "doc_id bigint, text string, bucket string, bridge string, id string").repartition(3)
    assert sorted(map(tuple, scaled_sketch.neighbour_fingerprints(docs).collect())) == sorted(want)


def test_blocks_of_few_words(spark):
    """A block whose texts hold fewer words in all than a shingle has, as where a range's last row is followed by a short text."""
    for texts in ([""], ["a"], ["a b"], ["a b c"], ["a b c d"], ["a", "b c"], ["", "a b", ""], ["a b c d e"], ["a b", "c d e f"]):
        for k in range(1, 9):
            got = [(n, kept.tolist()) for n, kept in scaled_sketch.sketches([t.encode() for t in texts], k, 0.25)]
            assert got == [sketch(t, k) for t in texts], (texts, k)
    docs = spark.createDataFrame([(1, "one two"), (2, ""), (3, "three")], "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in scaled_sketch.neighbour_fingerprints(docs).collect()}
    assert got == {1: fingerprint("one two"), 2: fingerprint(""), 3: fingerprint("three")}
