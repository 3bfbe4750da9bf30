"""Directly addressable codes: the codec alone, then whole corpora against the tokenizers library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import addressable_codes as codes
from tidemark.llm.chunk_ids import ChunkIds, read_spec

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id bigint, text string, start string, n_tokens string, segment string, i string, t string, h string"


@pytest.mark.parametrize("top", [1, 256, 257, 65537, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 1024, 3000])
def test_any_token_and_any_range(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    levels = codes.pack(ids)
    assert [codes.token_at(levels, i) for i in range(n)] == ids.tolist()
    for a, b in (sorted(map(int, rng.integers(0, n + 1, 2))) for _ in range(25)):
        assert codes.tokens_between(levels, a, b).tolist() == ids[a:b].tolist()
    assert codes.tokens_between(levels, n, n).tolist() == []


def test_a_token_needs_only_its_own_bytes():
    ids = np.arange(70000, dtype=np.uint32)
    levels = codes.pack(ids)
    assert [len(level["chunks"]) for level in levels] == [70000, 70000 - 256, 70000 - 65536]
    blank = [dict(level, chunks=b"\x00" * 60000 + level["chunks"][60000:]) if k == 0 else level for k, level in enumerate(levels)]
    assert codes.token_at(blank, 69999) == 69999


@pytest.mark.parametrize("plain", [False, True])
def test_chunks_give_the_library_s_identifiers(plain):
    texts = ["", " ", "  ", "a", " a", "a  b", "a \n\n b\t\tc\x85d", "it's 12　x\r\n", "<|endoftext|>", "x <|endoftext|> <|endoftext|>y", "é́ 漢字 🙂🙂   z", "w" * 3000, "\n\n"]
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = plain
    ids = ChunkIds(read_spec(VOCABULARY), plain)
    assert [np.frombuffer(ids(t), "<u4").tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def _rows():
    long = " ".join(f"word{k % 977}" for k in range(60000))
    texts = ["one", None, "", "one", "<|endoftext|> it's", long, "漢字 🙂", "one", "tie b", "tie a"]
    ids = [5, 4, 3, 5, 2, 1, 0, None, -7, -7]
    return [(i, t, *"abcdef") for i, t in zip(ids, texts)] + [(k, f"text of {k}, number {k * k}", *"abcdef") for k in range(100, 400)]


def test_corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codes, "SEGMENT_IDS", 300)
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    folder = str(tmp_path / "codes")
    codes.write_codes(docs, folder, VOCABULARY)
    got = sorted(map(tuple, codes.read_documents(spark, folder).collect()), key=lambda r: r[1])
    by_place = docs.selectExpr("doc_id", "text", "xxhash64(text) AS k").collect()
    want, at, whole = [], 0, []
    library = Tokenizer.from_file(VOCABULARY)
    for i, text, _ in sorted(by_place, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        whole += ids
    assert got == want
    wanted = spark.createDataFrame([(p,) for p in [*range(0, at, 7), 0, at - 1, at, -1, None, None]], "position bigint")
    found = dict(map(tuple, codes.read_tokens(wanted, folder).collect()))
    assert found == {p: whole[p] for p in [*range(0, at, 7), at - 1]}


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "codes")
    codes.write_codes(spark.createDataFrame([], SCHEMA), folder, VOCABULARY)
    assert codes.read_documents(spark, folder).collect() == []
    assert codes.read_tokens(spark.range(3).toDF("position"), folder).collect() == []


def test_text_ids(spark, tmp_path):
    folder = str(tmp_path / "codes")
    codes.write_codes(spark.createDataFrame([("b", "x y"), ("a", "z")], "doc_id string, text string"), folder, VOCABULARY)
    assert [tuple(r)[:3] for r in codes.read_documents(spark, folder).orderBy("start").collect()] == [("a", 0, 2), ("b", 2, 3)]
