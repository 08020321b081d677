"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any order from 2.

Tokens are lower-cased (A-Z) words and one end for each text; a text's first words have begin marks as
history.  Spark counts in one shuffle for the words, one for the n-grams and a smaller one for each lower
level: workers count what they read in sorted arrays of hashes, cut these by the top bits of the hash
into parts, and send the pieces; one task merges a part.  The first pass gives the vocabulary, whose
sorted order numbers the words; the second counts n-grams of word numbers.  From a part's distinct
n-grams come partial sums for their histories, and the shorter n-grams that they end in: how many
distinct words precede these is the count of the next lower level.  Each level has discounts of its own.
Every part is a file of sorted hash arrays in the shared folder; scoring workers map these into memory,
or, where the store cannot be mapped, read a part at a time, and look up sorted batches.

Nothing is pruned, capped or sampled.  The number of parts follows the bytes of text, so a part's size does
not grow with the corpus, and a frequent word's n-grams are spread over all parts, for parts are cut by a
hash of the whole n-gram.  Up to 2**32 - 3 distinct words can be numbered; more raise an error.  N-grams
of three and more words are told apart by 64-bit hashes.

Edge cases: a null or empty text is the end alone; an empty training set scores every token
1 / (V + 1) with V = 0; a very long text is counted and scored whole, in one go; repeated rows are counted and
scored each; a null doc_id is scored, and is in the fold of the empty text; an empty table gives an empty
table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._util import batch, filesystem, fold_of, scratch, slices, tasks, texts, written
from tidewell.sources.package import in_batches

#: Tokens that a worker counts, or scores, at a time.
FLUSH = 2_000_000
#: Bytes of text to a part of the model's files.
PART = 8 << 20
#: Bytes of files that a worker holds where it cannot map them.
HELD = 256 << 20
REMEMBERED = 150_000
#: No word holds a blank.
END_HASH = xxhash.xxh3_64_intdigest(b" end")
UNKNOWN = (1 << 32) - 1
BLOBS = "part int, what int, blob binary"
BLOB_SCHEMA = pa.schema([("part", pa.int32()), ("what", pa.int32()), ("blob", pa.binary())])
U8 = np.uint64


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U8(32))) * U8(0x9E3779B97F4A7C15)
    return x ^ (x >> U8(29))


def unmixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U8(29)) ^ (x >> U8(58))
    x = x * U8(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    return x ^ (x >> U8(32))


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, and values, by byte planes and compressed."""
    gaps = np.diff(keys.astype(U8), prepend=U8(0))
    whole = [np.array([len(keys)], U8).tobytes()]
    for x in (gaps, *(v.astype(U8) for v in values)):
        whole.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(whole))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, U8, 1)[0])
    found = []
    for at in range(8, len(data), 8 * n) if n else []:
        planes = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(U8))
    if found:
        found[0] = np.cumsum(found[0], dtype=U8)
    return found


def merged(blobs: list[bytes]) -> list[np.ndarray]:
    """Keys in order, each once, with its values summed."""
    own = [x for x in map(unpack, blobs) if x]
    if not own:
        return []
    keys, *values = (np.concatenate(x) for x in zip(*own, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def cut(keys: np.ndarray, values: tuple[np.ndarray, ...], edges: np.ndarray, what: int) -> list[tuple[int, int, bytes]]:
    """Sorted keys, cut at the first key of each part."""
    at = np.searchsorted(keys, edges)
    ends = [*at[1:], len(keys)]
    return [(p, what, pack(keys[a:b], *(v[a:b] for v in values))) for p, (a, b) in enumerate(zip(at, ends, strict=True)) if b > a]


def hash_edges(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(parts)], U8)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The blobs of each part by kind; rows come sorted by part."""
    here, held = None, {}
    for b in batches:
        for part, what, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != here:
                if held:
                    yield here, held
                here, held = part, {}
            held.setdefault(what, []).append(blob)
    if held:
        yield here, held


def save(folder: str, name: str, *arrays: np.ndarray) -> str:
    """A file of the arrays, one after the other; its name is of this attempt alone."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
    store, where = filesystem(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    with store.open_output_stream(where, compression=None) as out:
        for x in arrays:
            out.write(np.ascontiguousarray(x).data)
    return path


def narrow(x: np.ndarray) -> np.ndarray:
    """The values in as few bytes each as hold the greatest."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else U8)


def kinds(*arrays: np.ndarray) -> str:
    return " ".join(x.dtype.str for x in arrays)


def load(path: str, n: int, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of ``n`` items each of a file: mapped where it is a local or mounted file, else read."""
    store, where = filesystem(path)
    if store.type_name == "local":
        data = np.memmap(where, np.uint8, "r")
    else:
        with store.open_input_file(where) as file:
            data = np.frombuffer(file.read(), np.uint8)
    found, at = [], 0
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        found.append(data[at : at + size].view(kind))
        at += size
    return found


@dataclass
class Table:
    """Sorted keys with values, in a file for each part: ``files`` of (path, n, kinds), parts in order of their keys."""

    files: list[tuple[str, int, str]]
    edges: np.ndarray
    values: int

    def __len__(self) -> int:
        return sum(n for _, n, _ in self.files)

    def part(self, p: int) -> list[np.ndarray] | None:
        path, n, kinds = self.files[p]
        if not n:
            return None
        held = self.__dict__.setdefault("held", OrderedDict())
        if p in held:
            held.move_to_end(p)
            return held[p]
        held[p] = load(path, n, kinds.split())
        # Maps cost no memory of their own; what was read is let go of, the oldest first.
        while len(held) > 1 and not isinstance(held[p][0].base, np.memmap) and sum(x.nbytes for own in held.values() for x in own) > HELD:
            held.popitem(last=False)
        return held[p]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions of sorted distinct keys over all parts (-1: absent) and the values there (0: absent)."""
        where = np.full(len(keys), -1, np.int64)
        values = [np.zeros(len(keys), np.int64) for _ in range(self.values)]
        at, offset = [*np.searchsorted(keys, self.edges), len(keys)], 0
        for p, (_, n, _) in enumerate(self.files):
            a, b = at[p], at[p + 1]
            if a < b and n:
                own, *stored = self.part(p)
                i = np.minimum(np.searchsorted(own, keys[a:b]), n - 1)
                hit = own[i] == keys[a:b]
                where[a:b] = np.where(hit, i + offset, -1)
                for v, x in zip(values, stored, strict=True):
                    v[a:b] = np.where(hit, x[i], 0)
            offset += n
        return where, values

    def values_of(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of keys in any order (0: absent)."""
        distinct, back = np.unique(keys, return_inverse=True)
        return [x[back] for x in self.find(distinct)[1]]


@dataclass
class Model:
    order: int
    words: Table  # hash, count; the position is a word's number
    grams: dict[int, Table]  # by length, 1 to order: key, count (of the longest) or number of distinct words before it
    histories: dict[int, Table]  # by length of the n-grams that they open, 2 to order: key, sum of these counts, n1, n2, n3+
    tokens: int
    levels: dict[int, tuple[float, float, float]]  # discounts by length
    distinct: int  # n-grams of two words
    rest: float  # weight of the uniform distribution below single words

    @property
    def discounts(self) -> tuple[float, float, float]:
        return self.levels[self.order]

    @property
    def vocabulary(self) -> int:
        return len(self.words)

    def number(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the hashes ``x``; UNKNOWN and 0 where absent."""
        keys, back = np.unique(x, return_inverse=True)
        where, (count,) = self.words.find(keys)
        return np.where(where < 0, UNKNOWN, where).astype(U8)[back], count[back]


def tokens(rows: list[bytes], hashes: Hashes) -> np.ndarray:
    """Hashes of the tokens of the texts, each closed by the end."""
    return np.concatenate([np.fromiter((*map(hashes.__getitem__, x.lower().split()), END_HASH), U8) for x in rows]) if rows else np.zeros(0, U8)


def flushes(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """The first column's pieces, and the tokens of the texts in the last column, about ``flush`` tokens or one slice at a time."""
    hashes, kept, held, size = Hashes(), [], [], 0
    for b in (part for whole in batches for part in slices(whole, 500)):
        kept.append(b.column(0))
        held.append(tokens(texts(b.column(b.num_columns - 1)), hashes))
        size += len(held[-1])
        if size >= flush:
            yield kept, np.concatenate(held)
            kept, held, size = [], [], 0
    if kept:
        yield kept, np.concatenate(held)


def grams_of(numbers: np.ndarray, end: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The columns of the n-grams that end in each token: the words before it, the farthest first, then its own.

    ``end``: where a token is an end; before a text's first word there are begin marks.
    """
    starts = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1]) if len(end) else np.zeros(0, np.int64)
    place = np.arange(len(numbers)) - np.repeat(starts, np.diff(np.append(starts, len(numbers))))
    columns = []
    for back in range(order - 1, 0, -1):
        column = np.full(len(numbers), begin, U8)
        column[back:] = np.where(place[back:] >= back, numbers[:-back], U8(begin)) if back < len(numbers) else column[back:]
        columns.append(column)
    return [*columns, numbers]


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """One key for each n-gram; up to two words it can be turned back."""
    if len(columns) == 1:
        return mixed(columns[0])
    key = mixed(columns[0] << U8(32) | columns[1])
    for x in columns[2:]:
        key = mixed(key * U8(0x9E3779B97F4A7C15) + x + U8(1))
    return key


def columns_of(keys: np.ndarray, columns: list[np.ndarray], length: int) -> list[np.ndarray]:
    plain = unmixed(keys) if length < 3 else None
    return [plain] if length == 1 else [plain >> U8(32), plain & U8(UNKNOWN)] if length == 2 else columns


def counted(columns: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, and their columns (for three and more words) and how often, or with what weight, they came."""
    keys, first, back, n = np.unique(key_of(columns), return_index=True, return_inverse=True, return_counts=True)
    if weight is not None:
        n = np.bincount(back, weights=weight, minlength=len(keys)).astype(np.int64)
    return keys, [*(c[first] for c in columns if len(columns) > 2), n]


def together(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    """As ``merged``, but the first ``columns`` values are of the key and not summed."""
    own = [x for x in map(unpack, blobs) if x]
    if not own:
        return []
    keys, *values = (np.concatenate(x) for x in zip(*own, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(v[order[first]] if k < columns else np.add.reduceat(v[order], first) for k, v in enumerate(values))]


FILES = "part int, what int, path string, n long, kinds string, numbers array<long>, sums array<struct<part: int, what: int, blob: binary>>"
BLOB = pa.struct([("part", pa.int32()), ("what", pa.int32()), ("blob", pa.binary())])
FILES_SCHEMA = pa.schema([("part", pa.int32()), ("what", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("kinds", pa.string()), ("numbers", pa.list_(pa.int64())), ("sums", pa.list_(BLOB))])
#: What a blob or a file holds: words, n-grams of a length, or histories of the n-grams of a length.
WORDS, GRAMS, HISTORIES = 0, 100, 200


def reduced(df: DataFrame, parts: int, reduce, name: str) -> DataFrame:
    """One output row for each file, from the blobs of a part in one task."""
    return written(df.repartitionById(parts, F.col("part")).sortWithinPartitions("part").transform(in_batches, reduce, FILES), name)


def counts_of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, held within [0, count]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.1), k - 0.1 * (k == 1)) for k, d in zip((1, 2, 3), raw, strict=True))


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """c less its discount, 0 for 0."""
    return np.maximum(c - np.select([c >= 3, c == 2, c == 1], [d[2], d[1], d[0]], 0.0), 0.0)


def table(rows: list, what: int, edges: np.ndarray, values: int) -> Table:
    files: list[tuple[str, int, str]] = [("", 0, "")] * len(edges)
    for r in rows:
        if r["what"] == what:
            files[r["part"]] = (r["path"], r["n"], r["kinds"])
    return Table(files, edges, values)


def train(docs: DataFrame, parts: int | None = None, order: int = 2) -> Model:
    """Count the n-grams of ``order`` words of all rows of ``docs`` (column text)."""
    if order < 2:
        raise ValueError("an order of 2 or more")
    spark = docs.sparkSession
    rows, flush = docs.select("text"), FLUSH
    parts = parts or max(8, tasks(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))
    folder, edges = scratch(spark, "model"), hash_edges(parts)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in flushes(batches, flush):
            keys, n = np.unique(x, return_counts=True)
            yield batch(cut(keys, (n,), edges, WORDS), BLOB_SCHEMA)

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in by_part(batches):
            keys, n = merged(held[WORDS])
            own = [keys, narrow(n)]
            yield batch([(part, WORDS, save(folder, f"words-{part}", *own), len(keys), kinds(*own), [int(n.sum())], [])], FILES_SCHEMA)

    words = reduced(rows.transform(in_batches, count_words, BLOBS), parts, merge_words, "words").drop("sums").collect()  # one row for each part
    vocabulary = table(words, WORDS, edges, 1)
    begin = len(vocabulary)
    if begin >= UNKNOWN - 2:
        raise ValueError("too many distinct words to number")

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(order, vocabulary, {}, {}, 0, {}, 0, 0.0)
        for _, x in flushes(batches, flush):
            numbers, _ = known.number(x)
            keys, values = counted(grams_of(numbers, x == U8(END_HASH), order, begin))
            yield batch(cut(keys, tuple(values), edges, GRAMS + order), BLOB_SCHEMA)

    def merge(length: int):
        """Of a part: the n-grams of ``length`` words, with what they add below, and the histories of those longer by one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, held in by_part(batches):
                for what, blobs in held.items():
                    below = []
                    if what == GRAMS + length:
                        keys, *columns, n = together(blobs, length if length > 2 else 0)
                        columns = columns_of(keys, columns, length)
                        if length > 1:
                            by_history, back = np.unique(key_of(columns[:-1]), return_inverse=True)
                            sums = tuple(np.bincount(back, weights=x).astype(np.int64) for x in (n, n == 1, n == 2, n >= 3))
                            ends, values = counted(columns[1:])
                            below = [*cut(by_history, sums, edges, HISTORIES + length), *cut(ends, tuple(values), edges, GRAMS + length - 1)]
                        own, numbers = [keys, narrow(n)], counts_of_counts(n)
                    else:
                        keys, *sums = merged(blobs)
                        own, numbers = [keys, *map(narrow, sums)], []
                    path = save(folder, f"model-{what}-{part}", *own)
                    yield batch([(part, what, path, len(keys), kinds(*own), numbers, [dict(zip(("part", "what", "blob"), x, strict=True)) for x in below])], FILES_SCHEMA)

        return run

    blobs, files = rows.transform(in_batches, count_grams, BLOBS), []
    for length in range(order, 0, -1):
        found = reduced(blobs, parts, merge(length), f"model-{length}")
        files += found.drop("sums").collect()  # one or two rows for each part
        blobs = found.select(F.explode("sums").alias("s")).select("s.part", "s.what", "s.blob")
    grams = {k: table(files, GRAMS + k, edges, 1) for k in range(1, order + 1)}
    histories = {k: table(files, HISTORIES + k, edges, 4) for k in range(2, order + 1)}
    n = {k: [sum(r["numbers"][i] for r in files if r["what"] == GRAMS + k) for i in range(4)] for k in grams}
    levels = {k: discounts(x) for k, x in n.items()}
    distinct, low = len(grams[2]), levels[1]
    rest = (low[0] * n[1][0] + low[1] * n[1][1] + low[2] * (begin - n[1][0] - n[1][1])) / distinct if distinct else 1.0
    return Model(order, vocabulary, grams, histories, sum(r["numbers"][0] for r in words), levels, distinct, rest)


def probabilities(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and probabilities of the tokens with hashes ``x``, texts one after the other."""
    v = model.vocabulary
    numbers, count = model.number(x)
    # Ends are told by their hash: the end has no number where nothing was counted.
    columns = grams_of(numbers, x == U8(END_HASH), model.order, v)
    (follow,) = model.grams[1].values_of(key_of(columns[-1:]))
    p = discounted(follow.astype(float), model.levels[1]) / max(1, model.distinct) + model.rest / (v + 1)
    for length in range(2, model.order + 1):
        own, d = columns[-length:], model.levels[length]
        (seen,) = model.grams[length].values_of(key_of(own))
        total, n1, n2, n3 = (a.astype(float) for a in model.histories[length].values_of(key_of(own[:-1])))
        share = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)
        p = discounted(seen.astype(float), d) / np.maximum(total, 1) + share * p
    return count, p


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row."""
    flush = FLUSH // 2  # a token scored takes about twice the memory of one counted

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = model.tokens, model.vocabulary
        for ids, x in flushes(batches, flush):
            count, p = probabilities(model, x)
            starts = np.concatenate([[0], np.flatnonzero(x == U8(END_HASH))[:-1] + 1])
            add = lambda y: pa.array(np.add.reduceat(y, starts))  # noqa: B023, E731
            length = np.diff([*starts, len(x)])
            base = np.log10((count + 1) / (n + 1 * (v + 1)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(length, pa.int64()), add((count > 0).astype(np.int64)), pa.array([n] * len(starts), pa.int64()), add(base), add(np.log10(p))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """Train on the rows outside fold ``held`` and score all."""
    out = fold_of("doc_id", folds) == held
    return scored(docs, train(docs.filter(~out), order=order)).withColumn("held_out", out)
