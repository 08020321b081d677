"""Hashed character n-grams of words, for linear models whose document score is a sum over words.

A document's score is ``sum over words of weight(document, word) * S(word)`` where S(word) sums the
model's weights over the word's n-grams.  Training keeps document-to-word and word-to-feature
incidence apart, which is far smaller than document-to-feature; scoring remembers S for each word.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 19
#: Distinct words whose scores a worker remembers before it starts anew.
REMEMBERED = 400_000
#: At most so many labelled rows, those first by a hash of their id, are used for fitting.
FITTED_ROWS = 4_000


def marker(word: str) -> bool:
    """Markers of a text's make-up open with a blank, which no word does; each is one feature."""
    return word[:1] == " "


def features(words: list[str], shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, position of its word) of all n-grams of bytes of the words, ends marked, for each n; then of the markers."""
    data = [b"\x02%b\x03" % w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, data), np.int64, len(data))
    size[[k for k, w in enumerate(words) if marker(w)]] = 0
    flat = np.frombuffer(b"".join(x for x, n in zip(data, size, strict=True) if n) + b"\0" * longest, np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    left = (np.repeat(np.cumsum(size), size) - np.arange(len(word))).astype(np.int32)
    rolled = np.zeros(len(word), np.uint32)
    for n in range(1, longest + 1):
        rolled = rolled * np.uint32(0x01000193) + flat[n - 1 : n - 1 + len(word)]
        if n >= shortest:
            inside = left >= n
            mixed = (rolled[inside] ^ np.uint32(n << 27)) * np.uint32(0x9E3779B1)
            yield ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)).astype(np.int32), word[inside]
    marked = [k for k, w in enumerate(words) if marker(w)]
    yield np.array([zlib.crc32(words[k].encode()) >> 32 - BITS for k in marked], np.int32), np.array(marked, np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int) -> list[tuple[int, str]]:
    """(label, text) of at most ``rows`` labelled documents for which ``keep`` holds, in order of a hash of the id.

    A doc_id labelled more than once takes its highest label; null labels and null ids are left out.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = one.filter(keep).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``rows`` ids are sent
    found = picked.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")).orderBy("doc_id")
    return [(r["label"], r["text"] or "") for r in found.select("label", "text").collect()]


class Incidence:
    """Documents as weighted words, words as features; in flat arrays of small numbers."""

    def __init__(self, documents: Iterable[dict[str, float]], grams: tuple[int, int]):
        words: dict[str, int] = {}
        docs, ids, weights = array("i"), array("i"), array("f")
        self.docs = 0
        for own in documents:
            for w, x in own.items():
                docs.append(self.docs)
                ids.append(words.setdefault(w, len(words)))
                weights.append(x)
            self.docs += 1
        self.words = len(words)
        self.doc, self.word, self.weight = (np.frombuffer(x, k) if x else np.zeros(0, k) for x, k in ((docs, np.int32), (ids, np.int32), (weights, np.float32)))
        self.features = list(features(list(words), *grams))

    def forward(self, theta: np.ndarray) -> np.ndarray:
        s = np.zeros(self.words)
        for feature, word in self.features:
            s += np.bincount(word, weights=theta[feature], minlength=self.words)
        return np.bincount(self.doc, weights=self.weight * s[self.word], minlength=self.docs)

    def back(self, slope: np.ndarray) -> np.ndarray:
        s, out = np.bincount(self.word, weights=self.weight * slope[self.doc], minlength=self.words), np.zeros(1 << BITS)
        for feature, word in self.features:
            out += np.bincount(feature, weights=s[word], minlength=1 << BITS)
        return out


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, slope: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (slope - self.m)
        self.v += 0.001 * (slope * slope - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class WordScores(dict):
    """Word to the sum of the weights of its features; ``learn`` the words of some texts before asking for them."""

    def __init__(self, theta: np.ndarray, grams: tuple[int, int]):
        self.theta, self.grams = theta, grams

    def learn(self, texts: Iterable[Iterable[str]]) -> None:
        texts = list(texts)
        new = {w for own in texts for w in own if w not in self}
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = {w for own in texts for w in own}
        words = list(new)
        s = np.zeros(len(words))
        for feature, word in features(words, *self.grams):
            s += np.bincount(word, weights=self.theta[feature], minlength=len(words))
        self.update(zip(words, s.tolist(), strict=True))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
