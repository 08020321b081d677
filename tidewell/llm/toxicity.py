"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams of a document's distinct lower-cased words, counted by
words.  Each is scaled by the log ratio of its smoothed frequencies in toxic and other training
documents, and logistic regression is fitted on the scaled features.

Edge cases: null and empty texts score the intercept alone; without two classes of labels every
score is the (smoothed) share of toxic labels; a very long text is scored whole; a score of one half is
toxic; repeated rows give equal scores; a null doc_id is scored, and is in the fold of the empty text; an empty table
gives an empty table; labels, lang, source and the id are never inputs of a score, nor are extra columns,
whatever their names.  Of a doc_id that is repeated one text (the greatest) is fitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._util import fold_of, slices, strings
from tidewell.llm.text_linear import BITS, FITTED_ROWS, Adam, Incidence, WordScores, labelled_sample, sigmoid
from tidewell.sources.package import in_batches

GRAMS = (3, 5)
#: Features with a smaller log ratio, or in fewer words of the training documents, are left out.
WEAK, FEW = 1.5, 5


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


@dataclass
class Model:
    theta: np.ndarray
    bias: float


def fit(rows: list[tuple[int, str]], steps: int = 80, smoothing: float = 1.0, decay: float = 1e-4) -> Model:
    y = np.array([float(label > 0) for label, _ in rows])
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = math.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), bias)
    x = Incidence((dict.fromkeys(sorted(words_of(text)), 1.0) for _, text in rows), GRAMS)
    p, q = smoothing + x.back(y), smoothing + x.back(1 - y)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # Weak ratios are noise that adds up with the length of a text.
    ratio[(np.abs(ratio) < WEAK) | (p + q < FEW + 2 * smoothing)] = 0
    v, adam, adam_b = np.zeros(1 << BITS), Adam(1 << BITS, 0.03), Adam(1, 0.05)
    for _ in range(steps):
        slope = (sigmoid(x.forward(ratio * v) + bias) - y) / len(y)
        v -= adam.step(x.back(slope) * ratio + decay * v / len(y))
        bias -= float(adam_b.step(np.array([slope.sum()]))[0])
    return Model((ratio * v).astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, rows: int = FITTED_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, label, fold_of("doc_id", folds) != 0, rows))


def _scores(texts: list[str], known: WordScores, bias: float) -> np.ndarray:
    own = [words_of(x) for x in texts]
    known.learn(own)
    # fsum: the same whatever the order of the words, so equal texts have equal scores
    return sigmoid(np.array([bias + math.fsum(map(known.__getitem__, x)) for x in own], float))


def civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole, whose text is not predicted toxic: one pass and no join."""
    sent = docs.sparkSession.sparkContext.broadcast((model.theta, model.bias))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, bias = sent.value
        known = WordScores(theta, GRAMS)
        for b in (part for whole in batches for part in slices(whole)):
            yield b.filter(pa.array(_scores(strings(b.column("text")), known, bias) < 0.5))

    return docs.transform(in_batches, select, docs.schema)


def scored(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.theta, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, bias = sent.value
        known = WordScores(theta, GRAMS)
        for b in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(strings(b.column(1)), known, bias))], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, score, "doc_id long, score double")
    return found.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
