"""Quality classifier by positive-unlabelled learning.

A linear model on text statistics and hashed words is fitted by minimising the non-negative unbiased risk: trusted positives
and unlabelled web text stand for the positives and, after the share of positives is taken off, for the negatives. The class
prior is estimated from the labels. Fitting uses bounded samples; scoring covers every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed word features; documents sampled for each side of the fit (the bound of what reaches the driver).
BUCKETS, SAMPLE = 512, 6_000
FOLDS, HELD_OUT = 3, 1
STATISTICS = ("words", "letters a word", "upper case", "symbols", "exclamations", "bars", "digits", "distinct words", "adjacent repeats", "distinct pairs", "lines", "repeated lines", "stops")
SYMBOLS = b"#*$%&<>"


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels must not be learned: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _features(text: str, buckets: int, known: dict[bytes, int]) -> np.ndarray:
    """Statistics of the whole text and its hashed words with unit length. ``known`` keeps the buckets of words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    out = np.zeros(len(STATISTICS) + buckets, np.float32)
    if not n:
        return out
    low = data.lower()
    size = len(data)
    lines = [x for x in data.split(b"\n") if x]
    letters = sum(map(len, words))
    out[:13] = (
        np.log1p(n),
        min(letters / n, 50) / 10,
        sum(map(data.count, [bytes([c]) for c in range(65, 91)])) / size,
        sum(map(data.count, [bytes([c]) for c in SYMBOLS])) / n,
        data.count(b"!") / n,
        data.count(b"|") / n,
        sum(map(data.count, [bytes([c]) for c in range(48, 58)])) / size,
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        (data.count(b".") + data.count(b",")) / n,
    )
    marks = np.empty(n, np.int64)
    for i, w in enumerate(low.split()):
        b = known.get(w)
        if b is None:
            if len(known) > 200_000:
                known.clear()
            b = known[w] = zlib.crc32(w) % buckets
        marks[i] = b
    counts = np.bincount(marks, minlength=buckets).astype(np.float32)
    out[13:] = np.sqrt(counts / n)
    return out


def features_column(text: Column, buckets: int = BUCKETS) -> Column:
    """array<float> of the features of each text; null counts as empty."""

    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        known: dict[bytes, int] = {}
        rows = [_features(x.as_py() or "", buckets, known) for x in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (len(STATISTICS) + buckets)), pa.array(flat))

    return of(text)


@dataclass(frozen=True)
class Model:
    """Standardised linear scores: sigmoid(weights . (x - mean) / scale + bias)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    buckets: int


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, buckets: int, rounds: int = 600, rate: float = 0.02, shrink: float = 20.0) -> Model:
    """Adam on the non-negative risk with the logistic loss: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

    Where the second term is negative, a step goes up its gradient instead, so that the model can't fit it below zero.
    ``shrink``, divided by the number of positives, is the weight decay: few positives can't be learned by heart.
    """
    decay = shrink / len(positives)
    both = np.concatenate([positives, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = ((x.astype(np.float64) - mean) / scale for x in (positives, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, rounds + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (p, u))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gn = su @ u / len(u) - prior * (sp @ p) / len(p)
        bn = su.mean() - prior * sp.mean()
        if negative < 0:
            g, gb = -gn, -bn
        else:
            g, gb = prior * ((sp - 1) @ p) / len(p) + gn, prior * (sp - 1).mean() + bn
        step = np.append(g + decay * w, gb)
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, float(b), prior, buckets)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, buckets: int = BUCKETS) -> Model | None:
    """A model from at most ``sample`` positives and ``sample`` unlabelled documents, chosen by hash; None without either.

    Labels of held-out rows are not read. The prior is the share of label 1 among all other labels. Unlabelled are the
    documents of the training folds, whatever their label: a sample of the web text as it comes.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = known.agg(F.avg("quality")).first()[0]
    if prior is None:
        return None
    prior = float(np.clip(prior, 0.01, 0.99))
    own = docs.where(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    picked = F.xxhash64(F.col("doc_id"))
    trusted = known.where("quality = 1").orderBy(picked, "doc_id").limit(sample)
    others = own.select(F.col("id").alias("doc_id")).orderBy(picked, "doc_id").limit(sample)

    def matrix(ids: DataFrame) -> np.ndarray:
        rows = own.join(ids.select(F.col("doc_id").alias("wanted")).distinct(), F.col("id") == F.col("wanted"))
        rows = rows.select("id", features_column(F.col("text"), buckets).alias("x")).dropDuplicates(["id"]).orderBy("id").select("x")
        flat = rows.toArrow().column(0).combine_chunks()
        flat = flat.values if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.values for c in flat.chunks])
        return flat.to_numpy().reshape(-1, len(STATISTICS) + buckets).astype(np.float32)

    p, u = matrix(trusted), matrix(others)
    return fit(p, u, prior, buckets) if len(p) and len(u) else None


def score_column(text: Column, model: Model | None) -> Column:
    """Scores from 0 to 1; without a model every text gets 0.5. A text without words has the statistics of nothing."""
    if model is None:
        return F.lit(0.5)
    weights = (model.weights / model.scale).astype(np.float64)
    bias = float(model.bias - model.mean @ weights)
    buckets = model.buckets

    @F.arrow_udf("double")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, int] = {}
        for batch in texts:
            scores = [_features(x.as_py() or "", buckets, known).astype(np.float64) @ weights + bias for x in batch]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -500, 500))))

    return of(text)


def classified(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Scores depend on the text alone. Null ids are not held out and not learned from; null and empty texts are scored like
    any other; repeated rows get equal rows.
    """
    model = train(docs, labels, text, doc_id, **options)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score_column(F.col(text), model).alias("score"))
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
