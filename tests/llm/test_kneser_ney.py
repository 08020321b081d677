import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidewell.llm import kneser_ney as kn

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        self.c, pairs = Counter(), Counter()
        for t in texts:
            own = words(t)
            self.c.update(own)
            pairs.update(zip(["<s>", *own], own))
        self.n, self.v, self.pairs = sum(self.c.values()), len(self.c), pairs
        self.past, self.kinds = Counter(), defaultdict(Counter)
        follow = Counter(w for _, w in pairs)
        self.follow = follow
        for (h, _), n in pairs.items():
            self.past[h] += n
            self.kinds[h][min(n, 3)] += 1
        self.d = (0, *kn.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
        self.low = (0, *kn.discounts([sum(n == k for n in follow.values()) for k in (1, 2, 3, 4)]))

    def p(self, h, w):
        total = len(self.pairs)
        f = self.follow[w]
        rest = sum(self.low[min(x, 3)] for x in self.follow.values()) / total if total else 1.0
        lower = (max(f - self.low[min(f, 3)], 0) / total if total else 0) + rest / (self.v + 1)
        if not self.past[h]:
            return lower
        n = self.pairs[h, w]
        share = sum(self.d[k] * x for k, x in self.kinds[h].items()) / self.past[h]
        return max(n - self.d[min(n, 3)], 0) / self.past[h] + share * lower

    def score(self, text):
        own = words(text)
        return sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *own], own))

    def base(self, text):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in words(text))


def corpus():
    random.seed(5)
    vocabulary = ["The", "cat", "sat", "é", "on", "mat", "a b", "dog"]
    return [" ".join(random.choices(vocabulary, weights=[9, 4, 3, 2, 2, 1, 1, 1], k=random.randrange(0, 30))) for _ in range(60)] + [None, "", "  \n", "THE cat\tsat\x0bon the\x1cmat"]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")


def test_scores_equal_the_plain_model(spark):
    texts = corpus()
    train, every = texts[:40], [*texts, "wholly unknown words", "the zebra sat"]
    plain, model = Plain(train), kn.train(frame(spark, train), parts=5)
    got = {r["doc_id"]: r for r in kn.scored(frame(spark, every), model).collect()}
    for k, t in enumerate(every):
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words(t)), sum(plain.c[w] > 0 for w in words(t)), plain.n)
        assert r["base_score"] == pytest.approx(plain.base(t)) and r["score"] == pytest.approx(plain.score(t))


class Recursive:
    """A model of any order in dictionaries: the textbook recursion."""

    def __init__(self, texts, order):
        self.order, grams = order, Counter()
        for t in texts:
            own = ["<s>"] * (order - 1) + words(t)
            grams.update(tuple(own[k : k + order]) for k in range(len(own) - order + 1))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d = {k: kn.discounts([sum(n == x for n in c.values()) for x in (1, 2, 3, 4)]) for k, c in self.counts.items()}
        self.follow = {k: defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.follow[k][g[:-1]].append(n)
        self.v = len(self.counts[1])

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.v + 1)
        own, n, d = self.follow[k].get(gram[:-1], []), self.counts[k][gram], self.d[k]
        if not own:
            return self.p(gram[1:])
        taken = sum(min(x, d[min(x, 3) - 1]) for x in own)
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / sum(own) + taken / sum(own) * self.p(gram[1:])

    def score(self, text):
        own = ["<s>"] * (self.order - 1) + words(text)
        return sum(math.log10(self.p(tuple(own[k : k + self.order]))) for k in range(len(own) - self.order + 1))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_any_order_equals_the_recursion(spark, order):
    texts = corpus()
    train, every = texts[:45], [*texts, "wholly unknown words", "the zebra sat on the mat"]
    plain, model = Recursive(train, order), kn.train(frame(spark, train), parts=3, order=order)
    got = {r["doc_id"]: r["score"] for r in kn.scored(frame(spark, every), model).collect()}
    for k, t in enumerate(every):
        assert got[k] == pytest.approx(plain.score(t))
    histories = {g[:-1] for g in plain.counts[order]}
    for h in [*sorted(histories, key=str)[:20], ("zebra",) * (order - 1)]:
        assert sum(plain.p((*h, w)) for w in [*(g[0] for g in plain.counts[1]), "unseen"]) == pytest.approx(1)


def test_parts_follow_the_text(spark, monkeypatch):
    texts = frame(spark, corpus())
    few = kn.train(texts, order=3)
    monkeypatch.setattr(kn, "PART", 100)
    many = kn.train(texts, order=3)
    assert len(many.words.files) > 2 * len(few.words.files)
    assert (few.tokens, few.distinct, few.levels) == (many.tokens, many.distinct, many.levels)


def test_files_that_cannot_be_mapped_are_held_within_bounds(spark, monkeypatch, tmp_path):
    keys = [np.arange(100, dtype=np.uint64) + np.uint64(k << 60) for k in range(16)]
    files = [(kn.save(str(tmp_path), f"p{k}", x, x), 100, "<u8 <u8") for k, x in enumerate(keys)]
    own = kn.Table(files, np.array([k << 60 for k in range(16)], np.uint64), 1)
    monkeypatch.setattr(kn, "load", lambda path, n, kinds: [np.fromfile(path, kinds[0])[:n], np.fromfile(path, kinds[0])[n:]])
    monkeypatch.setattr(kn, "HELD", 4000)
    asked = np.concatenate(keys)
    assert (own.find(asked)[1][0].astype(np.uint64) == asked).all() and len(own.held) <= 3


def test_null_ids_and_long_texts(spark):
    df = spark.createDataFrame([(None, "a b a b"), (1, "x y " * 60_000), (2, None)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS held_out")
    got = {r["doc_id"]: r for r in kn.held_out_scores(df, order=3).collect()}
    assert got[1]["n_tokens"] == 120_001 and got[None]["n_tokens"] == 5 and got[2]["n_tokens"] == 1
    assert all(r["score"] < 0 for r in got.values())


def test_probabilities_sum_to_one():
    plain = Plain(corpus())
    for h in ("<s>", "the", "zebra", None):
        assert sum(plain.p(h, w) for w in [*plain.c, "unseen"]) == pytest.approx(1)


def test_many_flushes_give_the_same(spark, monkeypatch):
    texts = frame(spark, corpus())
    whole = kn.train(texts, parts=3)
    monkeypatch.setattr(kn, "FLUSH", 20)
    cut = kn.train(texts, parts=3)
    assert (whole.tokens, whole.distinct, whole.discounts, whole.rest) == (cut.tokens, cut.distinct, cut.discounts, cut.rest)


def test_nothing_to_train_on(spark):
    empty = frame(spark, ["x"]).filter("false")
    rows = kn.scored(frame(spark, ["a b", None]), kn.train(empty)).collect()
    assert all(r["score"] == pytest.approx(0) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert kn.held_out_scores(empty).count() == 0


def test_packing_of_blobs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    value = rng.integers(0, 1 << 40, len(keys)).astype(np.uint64)
    a, b = kn.unpack(kn.pack(keys, value))
    assert (a == keys).all() and (b == value).all() and not kn.unpack(kn.pack(keys[:0], value[:0]))
    k, v = kn.merged([kn.pack(keys, value), kn.pack(keys[::2], value[::2])])
    assert (k == keys).all() and (v[::2] == 2 * value[::2]).all() and (v[1::2] == value[1::2]).all()
    assert (kn.unmixed(kn.mixed(keys)) == keys).all() and kn.END_HASH == xxhash.xxh3_64_intdigest(b" end")
