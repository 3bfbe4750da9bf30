"""Each operator against brute force, on rows with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

import pytest

from tests.llm import brute
from tidemark.llm import apportion, bottom_k, bpe_count, brown, licence_dice, multi_instance, page_template, prefix_join, scaled_sketch, super_kmers
from tidemark.llm.components import connected

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, value string, n_words string, _id string, row string, score string"


def _text(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}{rng.choice(['', '.', ',', 'é'])}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, base = _text(rng, 70), _text(rng, 120)
    near = [" ".join("edit" if rng.random() < 0.03 else w for w in base.split()) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One ONE", "one one", base, base, base.upper(), *near, _text(rng, 30) + " " + passage + "\n" + _text(rng, 20), passage, "x  " + passage + " y " + _text(rng, 60),
             _text(rng, 6000, 3000), "a " * 300, "a " * 260, "z" * 5000, "Licensed under the Apache License, Version 2.0.\nThe rest.", "<|endoftext|> it's  12 　 x\r\n"]
    out = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (None, base), (None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", [None, "a", "b", "c"][k % 4], 7, 1, "v", "n", "u", "r", "s") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _same(df, want):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_substring_dedup(docs, rows, none):
    got = super_kmers.remove_repeats(docs)
    assert [c for c in docs.columns if c != "n_words"] == [c for c in got.columns if c not in ("n_words", "n_removed")]
    want = [(i, n, m, None if t is None else kept) for (i, t), (n, m, kept) in zip(rows, brute.repeats(rows))]
    _same(got.select("doc_id", "n_words", "n_removed", "text"), want)
    assert super_kmers.remove_repeats(none).count() == 0


def test_substring_dedup_with_salted_minimisers(docs, rows, monkeypatch):
    monkeypatch.setattr(super_kmers, "SAMPLE_ONE_IN", 1)
    monkeypatch.setattr(super_kmers, "LEAST_SAMPLED", 2)
    got = super_kmers.remove_repeats(docs)
    _same(got.select("doc_id", "n_words", "n_removed"), [(i, n, m) for (i, _), (n, m, _) in zip(rows, brute.repeats(rows))])


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, none, k):
    got = bottom_k.similar_components(docs, shingle_words=k)
    _same(got.select("doc_id", "n_shingles", "component_id", "kept"), [(i, *r) for (i, _), r in zip(rows, brute.components(rows, k))])
    assert bottom_k.similar_components(none).count() == 0


def test_near_duplicates_in_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(bottom_k, "LIST_PART", 3)
    got = bottom_k.similar_components(docs, shingle_words=2, broadcast_rows=0)
    _same(got.select("doc_id", "n_shingles", "component_id", "kept"), [(i, *r) for (i, _), r in zip(rows, brute.components(rows))])


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, docs, rows, none, limit):
    items = [(10, rows[0][1]), (9, "w1 w2"), (8, None), (7, ""), (6, "the rest"), (5, "the rest"), (4, next(t for _, t in rows if t and t.startswith("x  ")))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = prefix_join.contamination(docs, bench, broadcast_rows=limit)
    _same(got, [(i, *r) for (i, _), r in zip(rows, brute.leaks(rows, items))])
    assert prefix_join.contamination(none, bench).count() == 0
    assert prefix_join.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    _same(bpe_count.token_counts(docs, VOCABULARY), want)
    assert bpe_count.token_counts(none, VOCABULARY).count() == 0


def test_token_counts_of_odd_text():
    from tokenizers import Tokenizer

    library, count = Tokenizer.from_file(VOCABULARY), bpe_count.Counter(*bpe_count.read_vocabulary(VOCABULARY))
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "'LL", "é", "漢", "🙂", "1", "٣", "́", "\x85", " ", "\x1c", "_", "<|endoftext|>", "the", "ing"]) for _ in range(rng.randrange(30)))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_brown(docs, rows, none):
    got = brown.score(docs, brown.train(docs.where("doc_id IS NULL OR pmod(crc32(cast(doc_id AS string)), 7) <> 2"))).collect()
    want = brute.base_scores(rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted((str(i), n, k, t, round(b, 6)) for (i, _), (n, k, t, b) in zip(rows, want))
    assert all(r.score < 0 for r in got)
    model = brown.train(none)
    assert brown.score(none, model).count() == 0
    assert {r.n_known for r in brown.score(docs, model).collect()} == {0}


def test_exchange_ends_where_no_move_helps():
    import numpy as np

    def likelihood(pairs, of, classes):
        member = np.eye(classes)[of]
        table = member.T @ pairs @ member
        return brown._xlogx(table).sum() - brown._xlogx(table.sum(0)).sum() - brown._xlogx(table.sum(1)).sum()

    rng = np.random.default_rng(0)
    for _ in range(5):
        pairs = rng.integers(0, 9, (14, 14)).astype(float)
        of = brown.exchange(pairs, classes=4, sweeps=50)
        best = likelihood(pairs, of, 4)
        assert best > likelihood(pairs, np.append(np.arange(13) % 3, 3), 4) - 1e-9 and of[13] == 3 and max(of[:13]) < 3
        for w in range(13):
            for b in range(3):
                moved = of.copy()
                moved[w] = b
                assert likelihood(pairs, moved, 4) <= best + 1e-6


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    bad, plain = ["scum", "idiotic"], [f"u{k}" for k in range(60)]
    text = lambda toxic: ". ".join(" ".join([*(rng.choice(plain) for _ in range(6)), *([rng.choice(bad)] if toxic and s == 2 else [])]) for s in range(5))
    some = [(k, text(k % 4 == 0), k % 4 == 0) for k in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in some], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in some if i < 300] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = multi_instance.train(frame, labels)
    got = {r.doc_id: r.score for r in multi_instance.scores(frame, model).collect()}
    assert all((got[i] >= 0.3) == y for i, _, y in some)
    found = multi_instance.offending(frame.where("doc_id >= 300"), model).collect()
    assert {r.doc_id for r in found} == {i for i, _, y in some if y and i >= 300} and all(any(b in r.sentence for b in bad) for r in found)
    assert multi_instance.with_scores(docs, model, "score").count() == docs.count()
    assert multi_instance.scores(none, model).count() == 0
    assert all(0 <= r.score < 0.3 for r in multi_instance.scores(docs, multi_instance.train(docs, labels.limit(0))).collect())


def test_sketches(docs, rows, none):
    def key(i, t):
        return (i is None, -(i or 0), t or "")

    order = sorted(rows, key=lambda r: key(*r))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), brute.sha(t[: len(t) - half] + after[:half])))
    got = scaled_sketch.neighbour_fingerprints(docs)
    _same(got.select("doc_id", "n_chars", "edited_sha256"), want)
    by = {}
    for r in got.collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[6] == by[7] and len(by[3]) == 1
    assert scaled_sketch.neighbour_fingerprints(none).count() == 0
    assert scaled_sketch.neighbour_fingerprints(docs.where("doc_id = 6")).first().near_next == 1.0


def test_sketch_estimates():
    rng = random.Random(3)
    a = _text(rng, 4000, 100_000).split()
    texts = [" ".join(a).encode(), " ".join(a[:1000]).encode()]
    x, y = (scaled_sketch.written(t, s) for t, s in zip(texts, scaled_sketch.sketches(texts, 5, 0.25)))
    assert scaled_sketch.containment(y, x) > 0.98 and abs(scaled_sketch.containment(x, y) - 0.25) < 0.05 and abs(scaled_sketch.likeness(x, y) - 0.25) < 0.05


def test_mix(docs, rows, none):
    got = apportion.mix_to_targets(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(brute.words(t))) for i, t in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 1 and own[0].source_size == sum(r.size for r in own)
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, apportion.mix_to_targets(docs).collect()))
    assert apportion.mix_to_targets(none).count() == 0


def test_highest_quotients(spark):
    rng = random.Random(4)
    votes = [rng.choice([0, 1, 3, 50, 700, 9000]) + rng.randrange(5) for _ in range(40)]
    for seats in (0, 1, 39, 500, 20_000):
        df = spark.createDataFrame([(k, v, seats) for k, v in enumerate(votes)], "place bigint, votes bigint, seats bigint")
        got = dict(apportion.highest_quotients(df, "votes", "seats", [], "place", "won").select("place", "won").collect())
        ranked = sorted(((v / (2 * j + 1), -k) for k, v in enumerate(votes) if v for j in range(seats)), reverse=True)[:seats] if seats <= 500 else None
        assert sum(got.values()) == seats
        if ranked is not None:
            assert all(got[k] == sum(-p == k for _, p in ranked) for k in got)


def test_licences(docs, none):
    got = {r.doc_id: r for r in licence_dice.licence_scan(docs.where("doc_id IS NOT NULL")).collect()}
    assert [i for i, r in got.items() if r.licence] == [k for k, r in got.items() if r.licence == "Apache-2.0"] and sum(r.n_found for r in got.values()) == 2
    assert licence_dice.licence_scan(none).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>"</script></head><body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav>'
    '<div class="cookie-notice">We use</div><main><article><h1>Head {k} &amp; <em>you</em></h1><p>One<br>two &nbsp; three {k}<p><b>bold<br><p>x &lt; y</p><!-- c --><ul><li>a<li>b</ul><form>f</form>'
    '<div class="ad">Buy</div><aside>Side</aside><section class="comments"><article>first!</article></section></article></main><footer>&copy; {k}</footer>'
)


def test_pages(spark):
    pages = [(k, f"http://h{k % 3}.example.org/{k}", PAGE.replace("{k}", str(k)), "x", "y") for k in range(12)]
    pages += [(50, None, None, "x", "y"), (51, "", "", "x", "y"), (52, "http://h0.example.org/odd", "<p>Only <b>this</b></p><nav>no</nav>", "x", "y"), (52, "http://h0.example.org/odd", "<p>Only <b>this</b></p><nav>no</nav>", "x", "y"), (None, "x", "just < text", "x", "y")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string, host string, main string")
    got = [tuple(r) for r in page_template.extract(frame).collect()]
    want = [(k, u, f"Head {k} & you\nOne two three {k}\nbold\nx < y\na\nb") for k, u, *_ in pages[:12]] + [(50, None, ""), (51, "", ""), (52, pages[14][1], "Only this"), (52, pages[14][1], "Only this"), (None, "x", "just < text")]
    assert sorted(map(repr, got)) == sorted(repr((*w, len(w[2]))) for w in want)
    assert page_template.extract(frame.limit(0)).count() == 0
    slots = {r.host: r for r in page_template.templates(frame).collect()}
    assert slots["h1.example.org"].main.endswith("/main/article") and slots["h1.example.org"].root_tokens > 8


@pytest.mark.parametrize("mark", ['id="post-{k}"', 'class="post-{k} entry"', 'id="{w}"'])
def test_pages_with_labels_of_their_own(spark, mark):
    body = '<html><body><div class="top">Tagline of the site</div><article {m}><h1>Head {k}</h1><p>' + "word " * 40 + "{k}</p></article><div class=\"tail\">Made with care {k}</div></body></html>"
    names = ["".join(chr(97 + int(d)) for d in str(k * k + 1)) for k in range(40)]
    pages = [(k, f"http://h.example.org/{k}", body.replace("{m}", mark).replace("{k}", str(k)).replace("{w}", names[k])) for k in range(40)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in page_template.extract(frame).collect()}
    assert got == {k: f"Head {k}\n" + "word " * 40 + str(k) for k in range(40)}
    assert page_template.recurring(page_template.occurrence_vectors(frame)).count() < 20


def test_pages_with_articles_in_a_wide_slot(spark):
    lone = "<html><body><div class='top'>Tagline</div><div class='c'>{a}</div></body></html>"
    text = "word " * 30
    pages = [(k, f"http://h.example.org/{k}", lone.replace("{a}", f"<article><p>{text}{k}</p></article><p>Aside {k}</p>" if k < 3 else f"<p>{text}{k}</p>")) for k in range(10)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in page_template.extract(frame).collect()}
    assert got == {k: f"{text}{k}" for k in range(10)}


def test_pages_by_classes(spark):
    """Text of the template goes whatever its element is called, an article's part stays whatever it is called, and the slot is told by its text."""
    base = "<html><body><article><p>Teaser {k}</p></article><div class='c'><h1>Head {k}</h1><p>Please mind the gap</p><p>{a}</p>{s}<ul>{l}</ul><div class='related'>See {k}</div><p>Send to a <b>friend</b></p></div></body></html>"
    pages = []
    for k in range(8):
        items = "".join(f"<li><p>item {k} {i}</p><p>Read more</p></li>" for i in range(k % 3 + 1))
        part = "<p class='social'>A social part</p>" if k == 3 else "<p>Maybe</p>" * (k % 3)
        pages.append((k, f"http://h.example.org/{k}", base.replace("{a}", f"word{k} " * 60).replace("{s}", part).replace("{l}", items).replace("{k}", str(k))))
    pages += [(k + 20, "http://copies.example.org/", "<html><body><article><p>Copied text</p></article></body></html>") for k in range(6)]
    got = {r.page_id: r.text for r in page_template.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for k in range(8):
        part = ["A social part"] if k == 3 else ["Maybe"] * (k % 3)
        assert got[k].split("\n") == [f"Head {k}", (f"word{k} " * 60).strip(), *part, *(f"item {k} {i}" for i in range(k % 3 + 1))], k
    assert all(got[k + 20] == "Copied text" for k in range(6))
