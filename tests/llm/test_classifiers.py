import random
import zlib

import numpy as np
import pytest

from tidewell.llm import quality, toxicity
from tidewell.llm.text_linear import BITS, FITTED_ROWS, Incidence, features, labelled_sample
from tidewell.llm._util import fold_of

SMALL = "/root/testdata/sf0.01"


def held_out(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def test_incidence_is_the_plain_sum():
    docs = [{"ab": 2.0, "cd": 1.0, " mark 1": 3.0}, {}, {"ab": 0.5, "é" * 50: 1.0}]
    x, theta = Incidence(docs, (1, 2)), np.random.default_rng(0).normal(size=1 << BITS)
    from tidewell.llm.text_linear import features

    own = {w: [int(x) for f, _ in features([w], 1, 2) for x in f] for d in docs for w in d}
    want = [sum(v * sum(theta[f] for f in own[w]) for w, v in d.items()) for d in docs]
    assert np.allclose(x.forward(theta), want)
    back = np.zeros(1 << BITS)
    for d, s in zip(docs, [1.0, 2.0, 3.0], strict=True):
        for w, v in d.items():
            np.add.at(back, own[w], v * s)
    assert np.allclose(x.back(np.array([1.0, 2.0, 3.0])), back)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    assert all(r["held_out"] == held_out(r["doc_id"], 5) for r in out.values())
    rows = [(r["toxic"], out[r["doc_id"]]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    assert np.mean([t == o["predicted"] for t, o in rows]) > 0.9


def rates(truth, guess, score):
    """Recall, precision and the area under the curve of the scores."""
    truth, guess, score = np.array(truth, bool), np.array(guess, bool), np.array(score)
    above = (score[truth][:, None] > score[~truth][None, :]).mean() + 0.5 * (score[truth][:, None] == score[~truth][None, :]).mean()
    return (guess & truth).sum() / truth.sum(), (guess & truth).sum() / max(1, guess.sum()), above


def test_recall_and_precision_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marks = {r["doc_id"]: r for r in labels.collect() if held_out(r["doc_id"], 5)}
    out = [r for r in toxicity.scored(docs, toxicity.train(docs, labels)).filter("held_out").collect() if r["doc_id"] in marks]
    toxic = rates([marks[r["doc_id"]]["toxic"] for r in out], [r["predicted"] for r in out], [r["score"] for r in out])
    good = [r for r in quality.scored(docs, quality.train(docs, labels)).filter("held_out").collect() if r["doc_id"] in marks]
    fine = rates([marks[r["doc_id"]]["quality"] for r in good], [r["selected"] for r in good], [r["tail_probability"] for r in good])
    bad = rates([not marks[r["doc_id"]]["quality"] for r in good], [not r["selected"] for r in good], [-r["tail_probability"] for r in good])
    print("toxic", toxic, "quality", fine, "rejected", bad)
    # A constant has a recall or a precision of 0 for one of the classes, and an area of one half.
    assert min(toxic) > 0.6 and toxic[2] > 0.9 and min(fine) > 0.8 and min(bad) > 0.7


def dense(texts, grams, of):
    """Documents by features, as one matrix: every n-gram of every word hashed on its own."""
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for k, text in enumerate(texts):
        for word, weight in of(text).items():
            for feature, _ in features([word], *grams):
                np.add.at(x[k], feature, weight)
    return x


def test_toxicity_fit_equals_a_dense_fit(monkeypatch):
    rng = random.Random(8)
    rows = [(k % 2, " ".join(rng.choices(["bad", "awful", "nasty"] if k % 2 else ["good", "fine"], k=3) + rng.choices(["the", "of", "house", "é"], k=6))) for k in range(40)]
    found = toxicity.fit(rows, steps=15)
    x, y = dense([t for _, t in rows], toxicity.GRAMS, lambda t: dict.fromkeys(toxicity.words_of(t), 1.0)), np.array([float(l) for l, _ in rows])
    p, q = 1 + x.T @ y, 1 + x.T @ (1 - y)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(np.abs(ratio) < toxicity.WEAK) | (p + q < toxicity.FEW + 2)] = 0
    v, b, m, s, mb, sb = np.zeros(1 << BITS), 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(1, 16):  # logistic loss, its gradient, Adam
        slope = 1 / (1 + np.exp(-(x @ (ratio * v) + b))) - y
        g, gb = (x.T @ slope) * ratio / len(y) + 1e-4 * v / len(y), slope.mean()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        v = v - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(found.theta, ratio * v, atol=1e-3) and found.bias == pytest.approx(b, abs=1e-4) and np.abs(found.theta).max() > 0.1


def test_quality_slopes_equal_differences():
    """The ordinal fit's loss falls, and its end is where small moves of thresholds no longer lower it."""
    rng = random.Random(9)
    rows = [(g, " ".join(rng.choices([["junk"], ["plain"], ["superb"]][g] + ["the", "of"], k=12))) for g in (0, 1, 2) * 30]
    x, y = dense([t for _, t in rows], quality.GRAMS, quality.make_up), np.array([g for g, _ in rows])

    def loss(model, move=(0.0, 0.0)):
        cuts = np.concatenate([[-np.inf], np.array(model.thresholds) + move, [np.inf]])
        z = x @ model.theta.astype(float)
        return -np.log(1 / (1 + np.exp(-(cuts[y + 1] - z))) - 1 / (1 + np.exp(-(cuts[y] - z)))).mean()

    short, long = quality.fit(rows, steps=5), quality.fit(rows, steps=600)
    assert loss(long) < loss(short) < np.log(3)
    for move in ((0.3, 0.0), (-0.3, 0.0), (0.0, 0.3), (0.0, -0.3)):
        assert loss(long, move) > loss(long) - 1e-3


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    rows = [(r["quality"], out[r["doc_id"]]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    assert np.mean([q == o["selected"] for q, o in rows]) > 0.9


def test_held_out_labels_are_never_used(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    spoiled = labels.withColumn("toxic", F.when(fold_of("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, spoiled))
    assert a.bias == b.bias and (a.theta == b.theta).all()


def test_three_grades_are_ordered():
    random.seed(0)
    words = {0: ["junk", "spam"], 1: ["plain", "text"], 2: ["superb", "essay"]}
    rows = [(g, " ".join(random.choices(words[g] + ["the", "of"], k=20))) for g in (0, 1, 2) * 60]
    m = quality.fit(rows)
    assert m.grades == [0, 1, 2] and m.thresholds[0] < m.thresholds[1]
    from tidewell.llm.text_linear import WordScores

    known = WordScores(m.theta, quality.GRAMS)
    made = [(y, quality.make_up(t)) for y, t in rows]
    known.learn(d for _, d in made)
    z = {g: np.mean([quality.assess(d, known) for y, d in made if y == g]) for g in (0, 1, 2)}
    assert z[0] < m.thresholds[0] < z[1] < m.thresholds[1] < z[2]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 50_000, 5), (4, "x" * 200_000, 5), (None, "a b", 5), (3, "word " * 50_000, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.scored(odd, toxicity.train(odd, labels)), quality.scored(odd, quality.train(odd, labels))):
        rows = out.collect()
        assert len(rows) == 6 and all(x is not None for r in rows for c, x in r.asDict().items() if c != "doc_id")
        three = [r for r in rows if r["doc_id"] == 3]
        assert three[0] == three[1] and out.filter("false").count() == 0
    empty = labels.filter("false")
    assert toxicity.scored(odd.filter("false"), toxicity.train(odd, empty)).count() == 0
    assert {r["score"] for r in toxicity.scored(odd, toxicity.train(odd, empty)).collect()} == {0.5}
    assert {r["selected"] for r in quality.scored(odd, quality.train(odd, empty)).collect()} == {True}


def test_sample_is_bounded(spark, odd):
    labels = spark.createDataFrame([(k, 1, 1) for k in (1, 2, 3, 4)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    assert len(labelled_sample(odd, labels, "toxic", F.lit(True), 2)) == 2 and FITTED_ROWS <= 10_000
