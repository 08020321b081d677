"""Best-fit packing by length patterns.

Documents become token ids, are cut at ``room`` tokens where they are longer, and the pieces
are placed in as few sequences of ``room`` tokens as can be.  Only the histogram of piece
lengths (at most ``room`` numbers, whatever the input) reaches the driver: patterns of a few
lengths that fill a sequence are enumerated, non-negative least squares fits how often each is
used to the histogram, the counts are rounded down, and the residual histogram is packed by
best fit.  The pieces of one length then take their places in the patterns by rank.

Edge cases: a null or empty text is one piece that holds the end id alone; a very long text is cut into
full pieces and a last one; rows that repeat a doc_id are separate documents with equal piece numbers, a null
doc_id is one, too; pieces of equal length take their places by doc_id, piece and checksum, and pieces equal in
these are alike; an empty table gives an empty table; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._util import batch, slices, strings, tasks, written
from tidewell.llm.token_counts import LETTER, NUMBER, SPACE, Merged, tokenizer
from tidewell.sources.package import in_batches

#: The pre-tokens of lower-cased text; white space separates and is dropped.
WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: Texts with other characters go through the library whole (U+0130 and others leave the range in lower case).
BEYOND = re.compile("[^\x00-įı-ſ]")
END = 1


def ids_of(tokens: list) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


@functools.lru_cache(maxsize=2)
def remembered(path: str) -> Merged:
    return Merged(tokenizer(path), ids_of)


class Encoder:
    def __init__(self, path: str):
        self.tok, self.ids = tokenizer(path), remembered(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        """The ids of a whole text, then the end id, as little-endian 32-bit numbers."""
        if BEYOND.search(text) or any(x in text for x in self.special):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids) + 1}I", *ids, END)
        return b"".join([*map(self.ids.__getitem__, WORD.findall(text.lower())), b"\1\0\0\0"])


def pieces(docs: DataFrame, vocabulary: str, room: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
        for b in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                ids = encode(text)
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
            yield batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def length_patterns(counts: np.ndarray, room: int, tries: int = 12) -> list[tuple[int, ...]]:
    """Patterns of one to four present lengths that fill a sequence, or nearly.

    ``tries``: so many of the commonest lengths are tried in the middle of a pattern.  Patterns are proposals: lengths
    that none covers are packed with the residual.
    """
    present = np.flatnonzero(counts)
    present = present[present > 0]
    common = present[np.argsort(-counts[present], kind="stable")]

    def below(rest: int) -> int:
        at = bisect_right(present, rest)
        return int(present[at - 1]) if at else 0

    found = set()
    for a in map(int, present[::-1]):
        if a == room:
            found.add((a,))
            continue
        if b := below(room - a):
            found.add(tuple(sorted((a, b), reverse=True)))
        middle = common[common <= room - a][:tries]
        for b in map(int, middle):
            if c := below(room - a - b):
                found.add(tuple(sorted((a, b, c), reverse=True)))
            for c in map(int, middle[: tries // 4]):
                if a + b + c <= room and (d := below(room - a - b - c)):
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(x for x in found if sum(x) >= room - max(1, room // 256))


def fitted(patterns: list[tuple[int, ...]], counts: np.ndarray, most_steps: int = 4000, near: float = 1e-4) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|: projected gradient with momentum.

    It ends when a step moves no count by more than ``near`` of the greatest, or after ``most_steps``; a fit that ends
    early leaves more to the residual, and no piece out.
    """
    if not patterns:
        return np.zeros(0)
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([v for p in patterns for v in p])
    size = len(counts)
    forward = lambda x: np.bincount(row, weights=x[column], minlength=size)
    back = lambda r: np.bincount(column, weights=r[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate = 1 / max(1e-9, float(v @ back(forward(v))) * 1.05)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(most_steps):
        step = np.maximum(0, y - rate * back(forward(y) - counts))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        moved = np.abs(step - x).max()
        if float((y - step) @ (step - x)) > 0:  # momentum that has gone too far starts anew
            t2 = 1.0
        x, y, t = step, step + (t - 1) / t2 * (step - x) if t2 > 1 else step, t2
        if moved <= near * max(1.0, float(x.max())):
            break
    return x


def plan(counts: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), using up ``counts`` exactly."""
    left, used = counts.astype(np.int64).copy(), []
    used.append(((room,), int(left[room])))
    left[room] = 0
    patterns = length_patterns(left, room)
    for p, x in sorted(zip(patterns, fitted(patterns, left.astype(float)), strict=True), key=lambda v: -v[1]):
        need: dict[int, int] = {}
        for v in p:
            need[v] = need.get(v, 0) + 1
        times = min([int(x), *(int(left[v]) // k for v, k in need.items())])
        if times > 0:
            used.append((p, times))
            for v, k in need.items():
                left[v] -= k * times
    used += best_fit(left, room)
    return [(p, n) for p, n in used if n]


def best_fit(left: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """The residual: the longest piece left opens a sequence, then the longest that fits is added."""
    used, left = [], left.copy()
    present = sorted(int(v) for v in np.flatnonzero(left))
    while present:
        pattern, need, rest = [], {}, room
        at = len(present) - 1
        while at >= 0:
            v = present[at]
            k = min(rest // v, int(left[v]))
            if k > 0:
                pattern += [v] * k
                need[v] = k
                rest -= k * v
            at = min(at, bisect_right(present, rest)) - 1
        times = min(int(left[v]) // k for v, k in need.items())
        used.append((tuple(pattern), times))
        for v, k in need.items():
            left[v] -= k * times
            if not left[v]:
                del present[bisect_right(present, v) - 1]
    return used


def slots(used: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: the first rank, first sequence and offset of each run of places."""
    found: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in used:
        offset = 0
        for v in pattern:
            first, sequence, at = found.setdefault(v, ([], [], []))
            first.append(taken.get(v, 0))
            sequence.append(base)
            at.append(offset)
            taken[v] = taken.get(v, 0) + times
            offset += v
        base += times
    return found


def ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """``cut`` with the rank of each row among those of its length, by buckets so that no length is one task's."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    sizes = sizes.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("own", own).join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")


def packed(docs: DataFrame, vocabulary: str | None = None, room: int = 4096) -> DataFrame:
    """Rows of doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary or default_vocabulary(), room), "pieces")
    counts = np.zeros(room + 1)
    for length, n in cut.groupBy("length").count().collect():  # at most ``room`` rows
        counts[length] = n
    places = spark.sparkContext.broadcast(slots(plan(counts, room)))  # grows with ``room``, not with the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: tuple(map(np.asarray, x)) for v, x in places.value.items()}
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, base, at = table[int(length[own[0]])]
                run = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = base[run] + rank[own] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(cut, tasks(spark)).transform(in_batches, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
