"""Token alignment against a plain version that walks the tokens of every document."""

import collections
import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import token_alignment

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id bigint, text string, row string, pair string, n_a string, id string, times string"


def brute(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each (id, text) row."""
    a_lib = Tokenizer.from_file(BYTES)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    number = {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printing)}
    of_a = lambda i: bytes(number[c] for c in a_lib.id_to_token(i))
    of_b = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()

    def cut(ids, of, ends):
        groups, now, at = [], [], 0
        for i in ids:
            now, at = [*now, i], at + len(of(i))
            if at in ends:
                groups, now = [*groups, now], []
        return groups

    def ends(ids, of):
        out, at = set(), 0
        for i in ids:
            at += len(of(i))
            out.add(at)
        return out

    found = []
    for _, text in rows:
        a, b = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids, b_lib.encode(text or "")
        if not text or any(b"".join(map(of, ids)) != (" " + text).encode() for ids, of in ((a, of_a), (b, of_b))):
            found.append(None)
            continue
        both = ends(a, of_a) & ends(b, of_b)
        groups = list(zip(cut(a, of_a, both), cut(b, of_b, both), strict=True))
        found.append((a, b, groups, collections.Counter((x, y) for p, q in groups for x in p for y in q)))
    counts = collections.Counter(pair for f in found if f for pair in f[3])
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((i, len(a), len(b), len(groups), links.total(), sum(n for p, n in links.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = ["the", "Étion", "über", "Wörter", "x,", "don't", "12345", "漢字", "🙂🙃", "zzzzzzzzz", "…", "naïve", "\t", "\n", "<s>", "<0x41>", "<|endoftext|>", "http://a.b/c?d=e"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts += [None, "", " ", "  two  spaces ", "▁", "a▁b", "z" * 4001, "🙂" * 900, "q" * 7, texts[0], texts[0], "é", " x", "ﬁ", "\x00\x01"]
    texts.append(" ".join(f"{rng.choice(vocabulary)}{rng.randrange(900)}" for _ in range(12000)))
    out = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, rows, small, monkeypatch):
    if small:  # few frequent pairs, small slices, partial counts given out early, all groups of two tokens large
        for name, value in (("FREQUENT", 40), ("SLICE_BYTES", 3000), ("SLICE_PAIRS", 500), ("PARTIAL_PAIRS", 300), ("LARGE_GROUP", 1)):
            monkeypatch.setattr(token_alignment, name, value)
    docs = spark.createDataFrame([(i, t, *"vwxyz") for i, t in rows], SCHEMA).repartition(5)
    got = token_alignment.alignment(docs, BYTES, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_nothing_to_align(spark):
    assert token_alignment.alignment(spark.createDataFrame([], SCHEMA), BYTES, PIECES).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, token_alignment.alignment(empty, BYTES, PIECES).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
