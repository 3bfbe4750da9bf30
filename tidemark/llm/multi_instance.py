"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence scores by a logistic function of
hashed features of its words; the document's score is the noisy-or of them,
1 - prod(1 - p).  Only documents carry labels, so the gradient of the
document's likelihood is what tells sentences apart: in a toxic document it
falls on the sentences that already look worst.  The same sentence scores then
say where the offence is.

The model is fitted on a bounded sample of labelled documents (SAMPLE of each
label, those with the smallest digests of their id), in one task whose input
that bounds.  Scoring is a map over all documents: nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import bounded
from tidemark.llm.text import Words, blocks, mix

SAMPLE = 3000
FEATURE_BITS = 18
PREFIXES = (4, 5)
STEPS = 80
RATE = 0.3
RIDGE = 1e-5
START = -5.0
SCREEN = 15.0
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Sentences:
    """Features of the sentences of some texts: `features[k]` belongs to sentence `of[k]`, which belongs to text `text[of[k]]`."""

    features: np.ndarray
    of: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def sentences(texts: list[bytes]) -> Sentences:
    """Sentences end at . ! ? or a line feed; a text without any has one empty sentence, so that it has a score.  Places are bytes in the joined texts."""
    words = Words(texts, fold=True, breaks=_BREAKS)
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    end = words.ends
    columns = [words.hashes()]
    for n in PREFIXES:
        words.ends = np.minimum(end, words.starts + n)
        columns.append(mix(words.hashes() + np.uint64(n)))
    words.ends = end
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    number = np.cumsum(_ENDS[words.buffer])[words.starts] if len(owner) else np.zeros(0, np.int64)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    of = np.cumsum(fresh) - 1
    text, starts = owner[fresh], words.starts[fresh]
    ends = words.ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(owner) - 1)] if len(owner) else starts
    bare = np.setdiff1d(np.arange(len(texts)), text)
    place = np.cumsum([0, *(len(t) + 1 for t in texts)])[bare]
    return Sentences(
        np.concatenate([(c & mask).astype(np.int32) for c in columns]), np.tile(of, len(columns)), np.concatenate((text, bare)),
        np.concatenate((starts, place)), np.concatenate((ends, place)),
    )


def noisy_or(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Document scores from sentence logits: log(1 - P) is the sum of -log(1 + e^z)."""
    return -np.expm1(-np.bincount(text, np.logaddexp(0, z), minlength=n))


def _telling(s: Sentences, toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, sentence) of the features whose share of texts differs between the labels by more than chance (likelihood ratio over SCREEN)."""
    pairs = np.unique(s.features.astype(np.int64) * n + s.text[s.of])
    bad = toxic[pairs % n]
    size = 1 << FEATURE_BITS
    a, b = (np.bincount(pairs[k] // n, minlength=size).astype(float) for k in (bad, ~bad))
    na, nb = max(1, toxic.sum()), max(1, n - toxic.sum())
    share = (a + b) / n

    def part(x, m):
        miss = m - x
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(m * share, 1e-12)), 0) + np.where(miss > 0, miss * np.log(np.maximum(miss, 1) / np.maximum(m * (1 - share), 1e-12)), 0)

    keep = 2 * (part(a, na) + part(b, nb)) > SCREEN
    used = keep[s.features]
    return s.features[used], s.of[used]


def fit(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Feature weights and bias by full-batch adaptive gradient steps on the noisy-or likelihood."""
    s = sentences(texts)
    n, rows = len(texts), len(s.text)
    features, of = _telling(s, toxic, n)
    w, bias = np.zeros(1 << FEATURE_BITS), START
    seen, seen_bias = np.full(1 << FEATURE_BITS, 1e-10), 1e-10
    weight = weight / weight.sum()
    for _ in range(STEPS):
        z = np.clip(bias + np.bincount(of, w[features], minlength=rows), -30, 30)
        p = np.clip(noisy_or(z, s.text, n), 1e-6, 1 - 1e-9)
        pull = np.where(toxic, -(1 - p) / p, 1.0) * weight
        slope = pull[s.text] / (1 + np.exp(-z))
        g = np.bincount(features, slope[of], minlength=1 << FEATURE_BITS) + RIDGE * w
        seen += g * g
        seen_bias += slope.sum() ** 2
        w -= RATE * g / np.sqrt(seen)
        bias -= RATE * slope.sum() / np.sqrt(seen_bias)
    return w.astype(np.float32), float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of the labelled documents; one without labels of both kinds never calls a document toxic.

    Null labels are dropped; of several labels of an id the highest counts.
    Each label's sample is weighted to that label's share of all.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    share = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not share.get(0) or not share.get(1):
        return np.zeros(1 << FEATURE_BITS, np.float32), -20.0
    first = [known.where(F.col("_toxic") == t).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample) for t in (0, 1)]
    ids = bounded(first[0].unionAll(first[1]), "toxic-sample")
    each = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, F.col("id") == F.col("_id")).select(F.lit(0).alias("one"), "text", "_toxic")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_toxic", "text"])
        toxic = rows["_toxic"].to_numpy() == 1
        got = np.bincount(toxic.astype(int), minlength=2)
        w, bias = fit([t.encode() for t in rows["text"]], toxic, np.where(toxic, share[1] / max(1, got[1]), share[0] / max(1, got[0])))
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [bias]})

    got = each.groupBy("one").applyInPandas(one, "weights binary, bias double").collect()
    return (np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["bias"]) if got else (np.zeros(1 << FEATURE_BITS, np.float32), -20.0)


def _logits(s: Sentences, model: tuple[np.ndarray, float]) -> np.ndarray:
    return model[1] + np.bincount(s.of, model[0][s.features], minlength=len(s.text))


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score", text_col: str = "text") -> DataFrame:
    """The input with a column `name`, which replaces one of that name; every row stays, null counts as empty, an empty table gives none.

    A text without words scores as one sentence without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    names = [*docs.columns, name]

    def work(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(text_col)]
            out = [np.zeros(0)]
            for part in blocks(map(len, texts)):
                s = sentences(texts[part])
                out.append(noisy_or(_logits(s, shared.value), s.text, len(texts[part])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())], names=names)

    return docs.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"]))


def scores(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score."""
    return with_scores(docs.select(id_col, text_col), model, "score", text_col).select(id_col, "score")


def offending(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where the offence is: (id, sentence, score) of sentences that score `least` or more by themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [(t.as_py() or "").encode() for t in batch.column(1)]
            for part in blocks(map(len, texts)):
                s = sentences(texts[part])
                p = 1 / (1 + np.exp(-_logits(s, shared.value)))
                joined = b"\n".join(texts[part])
                hit = np.flatnonzero(p >= least)
                hit = hit[np.lexsort((s.starts[hit], s.text[hit]))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[part][t] for t in s.text[hit]], batch.schema.field(0).type),
                        pa.array([joined[a:b].decode() for a, b in zip(s.starts[hit], s.ends[hit])], pa.string()), pa.array(p[hit], pa.float64()),
                    ],
                    names=[id_col, "sentence", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, sentence string, score double")
