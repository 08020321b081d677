"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - threshold_k) with one weight vector for all grades over hashed text
and ordered thresholds.  x averages the hashed character n-grams of the words of a whole text and
of a few markers of its make-up (how varied its words are, how long, how many, how often one follows itself).  The model gives
the expected grade and the probability of each tail for selection.

Edge cases: null and empty texts have the markers alone; with fewer than two grades among the
labels every document has that grade; grades are any integers, in their order; a very long text is
graded whole; a tail probability equal to the bound is selected; repeated rows give equal scores; a null doc_id is
graded, and is in the fold of the empty text; an empty table gives an empty table; extra columns are no inputs, and
``selected`` keeps them, whatever their names.  Of a doc_id that is repeated one text (the greatest) is fitted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._util import fold_of, slices, strings
from tidewell.llm.text_linear import BITS, FITTED_ROWS, Adam, Incidence, WordScores, labelled_sample, sigmoid
from tidewell.sources.package import in_batches

GRAMS = (1, 3)
#: The mean over words is multiplied by this, so that weights stay near 1.
SCALE = 8.0


def make_up(text: str) -> dict[str, float]:
    """Weights of the words of a text, which sum to SCALE, and of its markers."""
    words = text.split()
    n = max(1, len(words))
    counted = Counter(words)
    own = {w: SCALE * c / n for w, c in counted.items()}
    length = sum(map(len, words)) / n
    # Markers hold a blank, which no word does.
    for marker in (f" varied {10 * len(counted) // n}", f" commonest {10 * max(counted.values(), default=0) // n}", f" long {min(20, int(length))}", f" words {min(16, n.bit_length())}", f" repeated {10 * sum(map(eq, words, words[1:])) // n}"):
        own[marker] = 3.0
    return own


@dataclass
class Model:
    theta: np.ndarray
    grades: list[int]
    thresholds: list[float] = field(default_factory=list)


def fit(rows: list[tuple[int, str]], steps: int = 100, decay: float = 1e-3) -> Model:
    grades = sorted({g for g, _ in rows}) or [0]
    if len(grades) < 2:
        return Model(np.zeros(1 << BITS, np.float32), grades)
    at = {g: k for k, g in enumerate(grades)}
    y = np.array([at[g] for g, _ in rows])
    x = Incidence((make_up(text) for _, text in rows), GRAMS)
    # Thresholds: the first is free, the others add exp(gap) each, so they stay in order.
    share = np.clip([(y > k).mean() for k in range(len(grades) - 1)], 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    free = np.concatenate([start[:1], np.log(np.maximum(1e-2, np.diff(start)))])
    theta, adam, adam_t = np.zeros(1 << BITS), Adam(1 << BITS, 0.08), Adam(len(free), 0.05)
    n = len(y)
    for _ in range(steps):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        z = x.forward(theta)
        low, high = sigmoid(bounds[y] - z), sigmoid(bounds[y + 1] - z)
        likely = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)
        theta -= adam.step(x.back((d_high - d_low) / likely / n) + decay * theta / n)
        d_cut = np.bincount(y, weights=-d_high / likely, minlength=len(grades))[: len(cuts)] + np.bincount(y, weights=d_low / likely, minlength=len(grades))[1:]
        tail = np.cumsum(d_cut[::-1])[::-1] / n
        free -= adam_t.step(tail * np.concatenate([[1.0], np.exp(free[1:])]))
    cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    return Model(theta.astype(np.float32), grades, [float(c) for c in cuts])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, rows: int = FITTED_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, label, fold_of("doc_id", folds) != 0, rows))


def assess(own: dict[str, float], known: WordScores) -> float:
    return math.fsum(map(mul, own.values(), map(known.__getitem__, own)))


def _tails(texts: list[str], known: WordScores, thresholds: list[float]) -> np.ndarray:
    """P(grade > k) by text and threshold."""
    own = [make_up(x) for x in texts]
    known.learn(own)
    z = np.array([assess(x, known) for x in own], float)
    return sigmoid(z[:, None] - np.array(thresholds, float)[None, :])


def _tail(tails: np.ndarray, grades: list[int], cut: int) -> np.ndarray:
    """P(grade >= cut)."""
    above = sum(g < cut for g in grades)
    return np.ones(len(tails)) if above == 0 else np.zeros(len(tails)) if above == len(grades) else tails[:, above - 1]


def selected(docs: DataFrame, model: Model, cut: int | None = None, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose text has that tail probability: one pass and no join."""
    sent = docs.sparkSession.sparkContext.broadcast((model.theta, model.grades, model.thresholds))
    cut = model.grades[-1] if cut is None else cut

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, grades, thresholds = sent.value
        known = WordScores(theta, GRAMS)
        for b in (part for whole in batches for part in slices(whole)):
            yield b.filter(pa.array(_tail(_tails(strings(b.column("text")), known, thresholds), grades, cut) >= at_least))

    return docs.transform(in_batches, select, docs.schema)


def scored(docs: DataFrame, model: Model, cut: int | None = None, at_least: float = 0.5, folds: int = 5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability of a grade of ``cut`` (the highest) or more, and selected."""
    sent = docs.sparkSession.sparkContext.broadcast((model.theta, model.grades, model.thresholds))
    cut = model.grades[-1] if cut is None else cut

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, grades, thresholds = sent.value
        known = WordScores(theta, GRAMS)
        steps = np.diff(np.array(grades, float))
        for b in (part for whole in batches for part in slices(whole)):
            tails = _tails(strings(b.column(1)), known, thresholds)
            expected = grades[0] + tails @ steps if len(steps) else np.full(len(tails), float(grades[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(_tail(tails, grades, cut))], ["doc_id", "expected_grade", "tail_probability"])

    found = docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, score, "doc_id long, expected_grade double, tail_probability double")
    return found.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= at_least).alias("selected"))
