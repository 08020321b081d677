"""Exact Jaccard join of word-shingle sets, and the groups that its links make.

Documents with equal sets are one node.  Two other nodes can link only if their sets differ in few
shingles; so hash space is cut into a few more ranges than that (how many follows from the size
band), and linked nodes agree on the whole content of at least ``need`` ranges.  The contents'
hashes are counted in one shuffle, pre-aggregated by the readers: of equal hashes in what a task
reads, one node goes on and the others are tied to it.  Nodes with too few shared contents are
out; the ties of the rest, and of the nodes to which these are tied, give candidate groups, without
a row for each pair: through a node that is out itself, nodes of different readers still meet.

A group is searched in blocks of bounded size by T-occurrence: each block has inverted lists of
whole shingle sets; for a query the longest lists are set aside, the short ones merged by a heap,
and nodes that occur often enough are probed in the long lists by binary search (DivideSkip).
Pairs already connected are passed over.  In groups of several blocks some nodes are in every
block, which connects most of what is to be connected; the nodes left outside the group's largest
component are queries against the other blocks, but only against those that hold a possible partner:
with shingles ordered from rare to common, linked sets agree on one of their first (100 - percent) in
a hundred, at places that leave room for the overlap they need (prefix and positional filters, both
exact).  Queries stream past a block's index, a bounded number to a task.

Shingles are 64-bit hashes of words' 64-bit hashes, and nodes are 64-bit hashes of sets: equal
values for different shingles or sets are as unlikely as such hashes make them.

Edge cases: null and empty texts and texts without words have no shingles and link with nothing;
fewer words than a shingle's are one shingle, the whole sequence; rows that repeat a doc_id are
judged by their own texts; a null doc_id has a null component_id, takes part in no link, and is
never a label; a very long text is one large set, searched whole; an empty table gives an empty
table; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._util import batch, scratch, slices, spread, tasks, texts, written
from tidewell.llm.components import components
from tidewell.llm.kneser_ney import BLOB_SCHEMA, BLOBS, U8, Hashes, Table, by_part, cut, hash_edges, kinds, merged, mixed, narrow, pack, save, unpack
from tidewell.sources.package import in_batches

#: Nodes of a group that are searched together; larger groups have blocks of three quarters of this.
BLOCK = 512
#: Nodes that every block of a large group holds, about.
SHARED = 16
#: Queries that stream past a copy of a block's index in one task.
ASKED = 4096
#: Content hashes that a task sorts at a time.
FLUSH = 750_000
#: Microseconds to merge an entry of a short list, and to probe the long lists for a node.
MERGE, PROBE = 0.4, 12.0
TIE = np.dtype([("node", "<i8"), ("center", "<i8"), ("need", "<i4"), ("up", "<i4"), ("hits", "<i4")])


def shingles(text: bytes, width: int, hashes: Hashes) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U8)
    h = np.fromiter(map(hashes.__getitem__, words), U8, n)
    span = min(width, n)
    acc = h[: n - span + 1].copy()
    for k in range(1, span):
        acc = acc * U8(0x9E3779B97F4A7C15) + h[k : n - span + 1 + k]
    return np.unique(mixed(acc + U8(span if span < width else 0)))


def node_of(own: np.ndarray) -> int:
    """The node of a non-empty set, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), len(own)) - (1 << 63)


@functools.lru_cache
def band_of(n: int) -> tuple[int, int, int]:
    """Number, least and greatest size of the band that holds size ``n``; each is half as wide again as its start."""
    low, number = 1, 0
    while n > low + low // 2:
        low, number = low + low // 2 + 1, number + 1
    return number, low, low + low // 2


@functools.lru_cache(maxsize=None)
def ranges(parts: int) -> np.ndarray:
    return hash_edges(parts)


def contents(own: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(up, need, content hashes) for the set's own band and, as far as a partner can be there, the next ones.

    ``need``: so many of the hashes a linked node of that band shares, at least.
    """
    n = len(own)
    most = 100 * n // percent
    number, _, high = band_of(n)
    sums = np.concatenate([[U8(0)], np.cumsum(mixed(own ^ U8(0x5851F42D4C957F2D)), dtype=U8)])
    highs = [high]
    while most > highs[-1]:
        highs.append(band_of(highs[-1] + 1)[2])
    for up, high in enumerate(highs):  # at most 3, for ``percent`` is at least 50
        differ = (n + min(most, high)) * (100 - percent) // (100 + percent)
        if not differ:
            continue  # only an equal set can link
        parts = 2 * high * (100 - percent) // (100 + percent) + 2
        at = np.append(np.searchsorted(own, ranges(parts)), n)
        full = np.diff(at) > 0
        need = parts - differ - int((~full).sum())
        if need < 1:  # empty ranges could be all that it shares
            full[:], need = True, 1
        tag = U8((number + up) << 40) + np.arange(parts, dtype=U8)
        yield up, need, mixed(sums[at[1:]] - sums[at[:-1]] + mixed(tag + U8(1)))[full]


def _ties(node: np.ndarray, center: np.ndarray, info: np.ndarray, hits: np.ndarray) -> bytes:
    """Distinct (node, up, center) with their hits summed."""
    order = np.lexsort((info & 3, center, node))
    node, center, info, hits = node[order], center[order], info[order], hits[order]
    new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (center[1:] != center[:-1]) | ((info[1:] ^ info[:-1]) & 3 > 0)]))
    out = np.zeros(len(new), TIE)
    out["node"], out["center"], out["need"], out["up"] = node[new], center[new], info[new] >> 2, info[new] & 3
    out["hits"] = np.add.reduceat(hits, new)
    return out.tobytes()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted keys start, and how long they are."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return new, np.diff(np.append(new, len(keys)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def ties(docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """node, center, need, up, hits: nodes that share contents with another, each tied to the least node that does."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, edges = Hashes(), hash_edges(parts)
        held: list[tuple] = []
        seen: set[int] = set()
        size = 0

        def flush() -> list[tuple]:
            key = np.concatenate([k for k, _, _ in held])
            count = [len(k) for k, _, _ in held]
            node = np.repeat(np.array([x for _, x, _ in held], np.int64), count)
            info = np.repeat(np.array([x for _, _, x in held], np.int64), count)
            order = np.lexsort((node, key))
            key, node, info = key[order], node[order], info[order]
            new, length = _runs(key)
            shared = np.repeat(length > 1, length)
            rows = []
            if shared.any():
                center = np.repeat(node[new], length)[shared]
                rows.append((int(seen.__len__()) % parts, 1, _ties(node[shared], center, info[shared], np.ones(len(center), np.int64))))
            key, node, info = key[new], node[new], info[new] << 1 | (length > 1)
            at = [*np.searchsorted(key, edges), len(key)]
            rows += [(p, 0, pack(key[a:b], node[a:b].view(U8), info[a:b].view(U8))) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            return rows

        for b in (part for whole in batches for part in slices(whole)):
            for text in texts(b.column(0)):
                own = shingles(text, width, hashes)
                if not len(own) or (node := node_of(own)) in seen:
                    continue
                seen.add(node)
                for up, need, keys in contents(own, percent):
                    held.append((keys, node, need << 2 | up))
                    size += len(keys)
                if size >= FLUSH:
                    yield batch(flush(), BLOB_SCHEMA)
                    held, seen, size = [], set(), 0
        if held:
            yield batch(flush(), BLOB_SCHEMA)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_part(batches):
            found = [np.frombuffer(x, TIE) for x in blobs.get(1, [])]
            if 0 in blobs:
                key, node, info = (np.concatenate(x) for x in zip(*map(unpack, blobs[0]), strict=True))
                node, info = node.view(np.int64), info.view(np.int64)
                order = np.lexsort((node, key))
                key, node, info = key[order], node[order], info[order]
                # A node that several readers met counts once; it is shared if any of them saw another.
                same = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
                first = np.flatnonzero(same)
                already = np.maximum.reduceat(info & 1, first)
                key, node, info = key[first], node[first], info[first] >> 1
                new, length = _runs(key)
                shared = np.repeat(length > 1, length)
                if shared.any():
                    center = np.repeat(node[new], length)[shared]
                    found.append(np.frombuffer(_ties(node[shared], center, info[shared], 1 - already[shared]), TIE))
            for x in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in TIE.names], names=list(TIE.names))

    rows = docs.select("text").transform(in_batches, read, BLOBS)
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part").transform(in_batches, meet, "node long, center long, need int, up int, hits int")


class Lists:
    """Inverted lists of sets of nearly one size, and T-occurrence search in them."""

    def __init__(self, numbers: list[int], sets: list[np.ndarray]):
        self.numbers, self.sets = numbers, sets
        self.low, self.high = len(sets[0]), len(sets[-1])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.start, self.length = _runs(flat)
        self.key = flat[self.start]
        # All lists one after the other, each in order of its owners: a binary search in here probes one list.
        self.posting = np.repeat(np.arange(len(self.key)), self.length) * len(sets) + self.owner

    def search(self, query: np.ndarray, percent: int, skip) -> Iterator[int]:
        n = len(query)
        # A link's overlap is at least this, whichever of the sets it is with.
        least = max(-(-percent * (n + self.low) // (100 + percent)), -(-percent * n // 100))
        at = np.minimum(np.searchsorted(self.key, query), len(self.key) - 1)
        lists = at[self.key[at] == query]
        if len(lists) < least:
            return
        lists = lists[np.argsort(-self.length[lists], kind="stable")]
        # The longest lists are set aside, as many as make merging the others and probing these cheapest.
        size = self.length[lists].astype(float)
        left = (size.sum() - np.concatenate([[0.0], np.cumsum(size)]))[:least]
        aside = int(np.argmin(MERGE * left + PROBE * np.minimum(len(self.sets), left / (least - np.arange(least)))))
        long, short = lists[:aside] * len(self.sets), lists[aside:]
        merged = heapq.merge(*(self.owner[self.start[i] : self.start[i] + self.length[i]].tolist() for i in short.tolist()))
        for y, run in groupby(merged):
            overlap = sum(1 for _ in run)
            m = len(self.sets[y])
            if overlap < least - aside or percent * m > 100 * n or percent * n > 100 * m or skip(self.numbers[y]):
                continue
            probe = long + y
            overlap += int((self.posting[np.minimum(np.searchsorted(self.posting, probe), len(self.posting) - 1)] == probe).sum())
            if 100 * overlap >= percent * (n + m - overlap):
                yield self.numbers[y]


class Block:
    """Sets by size, in runs of nearly one size that are searched on their own."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.runs, at = percent, [], 0
        order = sorted(range(len(sets)), key=lambda x: len(sets[x]))
        for k in range(1, len(order) + 1):
            if k == len(order) or len(sets[order[k]]) > len(sets[order[at]]) * (1 + (100 - percent) / 250):
                self.runs.append(Lists(order[at:k], [sets[x] for x in order[at:k]]))
                at = k

    def search(self, query: np.ndarray, skip) -> Iterator[int]:
        """Positions of the sets, but those that ``skip`` names, that link with ``query``."""
        for run in self.runs:
            if self.percent * len(query) <= 100 * run.high and self.percent * run.low <= 100 * len(query):
                yield from run.search(query, self.percent, skip)


def spanning(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links within a block, as many as connect what is connected."""
    parent, found = list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    block = Block(sets, percent)
    for x in sorted(range(len(sets)), key=lambda x: len(sets[x])):
        if len(found) == len(sets) - 1:
            break
        for y in block.search(sets[x], lambda y, x=x: root(y) == root(x)):
            parent[root(y)] = root(x)
            found.append((x, y))
    return found


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch(rows, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, few of them Python objects at a time; ``bag`` as a set of hashes."""
    for b in (part for whole in batches for part in slices(whole)):
        columns = [(np.frombuffer(x, U8) for x in b.column(c).to_pylist()) if c == "bag" else b.column(c).to_pylist() for c in names]
        yield from zip(*columns, strict=True)


def inside(percent: int):
    """Links of each (grp, block) of rows sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches, "grp", "block", "node", "bag"), lambda r: r[:2]):
            block = {node: own for _, _, node, own in rows}
            nodes = list(block)
            yield _edges([(nodes[x], nodes[y]) for x, y in spanning(list(block.values()), percent)])

    return run


def across(percent: int):
    """Links between components: of rows sorted by (grp, block, chunk, asks, node) those that ask stream past the index of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches, "grp", "block", "chunk", "asks", "node", "component", "bag"), lambda r: r[:3]):
            stay, sets, index, edges, known = [], [], None, [], {}

            def root(c: int, known=known) -> int:
                while known.get(c, c) != c:
                    c = known[c]
                return c

            for *_, asks, node, component, own in rows:
                if not asks:
                    if not stay or stay[-1][0] != node:
                        stay.append((node, component))
                        sets.append(own)
                    continue
                if not stay:
                    break
                index = index or Block(sets, percent)
                for y in index.search(own, lambda y, c=component, stay=stay, root=root: root(stay[y][1]) == root(c)):
                    known[root(stay[y][1])] = root(component)
                    edges.append((node, stay[y][0]))
            if edges:
                yield _edges(edges)

    return run


def commonness(bags: DataFrame) -> Table:
    """The shingles that more than one set of ``bags`` holds, and how many do: sorted arrays in files of the shared folder."""
    spark, flush = bags.sparkSession, FLUSH
    parts = max(tasks(spark), -(-bags.count() // 20_000))
    folder, edges = scratch(spark, "shingles"), hash_edges(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (own,) in _rows(batches, "bag"):
            held.append(own)
            size += len(own)
            if size >= flush:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                yield batch(cut(keys, (n,), edges, 0), BLOB_SCHEMA)
                held, size = [], 0
        if held:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield batch(cut(keys, (n,), edges, 0), BLOB_SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in by_part(batches):
            keys, n = merged(held[0])
            own = [keys[n > 1], narrow(n[n > 1])]
            yield batch([(part, save(folder, f"part-{part}", *own), len(own[0]), kinds(*own))], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("kinds", pa.string())]))

    counted = bags.select("bag").transform(in_batches, count, BLOBS).repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    files = [("", 0, "")] * parts
    for r in counted.transform(in_batches, merge, "part int, path string, n long, kinds string").collect():  # one row for each part
        files[r["part"]] = (r["path"], r["n"], r["kinds"])
    return Table(files, edges, 1)


def meetings(busy: DataFrame, percent: int) -> DataFrame:
    """grp, block, node: the outside nodes and the home blocks, in their group, of possible partners in other components.

    ``busy``: grp, node, component, outside, home, bag.
    """
    common = commonness(busy)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 500)):
            sets = [own for (own,) in _rows([b], "bag")]
            levels = np.split(common.values_of(np.concatenate(sets))[0], np.cumsum([len(x) for x in sets])[:-1])
            counts, keys, rests = [], [], []
            for own, level in zip(sets, levels, strict=True):
                n = len(own)
                order = np.lexsort((own, level))[: n - -(-percent * n // 100) + 1]
                order, place = order[level[order] > 0], np.arange(len(order))[level[order] > 0]  # what one set alone holds meets nothing
                keys.append(own[order].view(np.int64))
                rests.append(n - place)
                counts.append(len(order))
            at = pa.array(np.repeat(np.arange(b.num_rows), counts))
            kept = [b.column(c).take(at) for c in ("grp", "node", "component", "outside", "home")]
            sizes = np.repeat([len(x) for x in sets], counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(keys)), pa.array(sizes), pa.array(np.concatenate(rests))], ["grp", "node", "component", "outside", "home", "shingle", "n", "rest"])

    lists = written(busy.transform(in_batches, first, "grp long, node long, component long, outside boolean, home long, shingle long, n long, rest long"), "lists")
    asks = lists.filter("outside").select("grp", "shingle", F.col("node").alias("asker"), F.col("n").alias("size"), F.col("rest").alias("left"), F.col("component").alias("own"))
    # What the filters see of a block in a list: its smallest set, its best placed one, and whether it is all of one component.
    placed = F.max(F.col("rest") * (100 + percent) - F.col("n") * percent)
    blocks = lists.groupBy("grp", "shingle", "home").agg(F.min("n").alias("least"), placed.alias("best"), F.min("component").alias("low"), F.max("component").alias("high"))
    # One row for each list, written, so that adaptive execution can split a hot list's askers.
    blocks = written(blocks.groupBy("grp", "shingle").agg(F.collect_list(F.struct("home", "least", "best", "low", "high")).alias("blocks")), "blocks")
    possible = f"left * {100 + percent} >= {percent} * (size + b.least) AND b.best >= {percent} * size AND (b.low <> own OR b.high <> own)"
    met = asks.join(blocks.hint("merge"), ["grp", "shingle"]).select("grp", "asker", F.expr(f"transform(filter(blocks, b -> {possible}), b -> b.home)").alias("homes")).filter("size(homes) > 0")
    met = met.groupBy("grp", "asker").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"))
    return written(met.select("grp", F.explode("homes").alias("block"), F.col("asker").alias("node")), "meetings")


def links(docs: DataFrame, meta: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges a, b between nodes, all of them links, that connect every two nodes whom links connect."""
    spark = docs.sparkSession
    n = tasks(spark)
    parts = max(n, -(-meta.count() // 20_000))  # about 2 to 4 million hashes a part
    found = written(ties(docs, width, percent, parts), "ties")
    alive = found.groupBy("node", "up").agg(F.sum("hits").alias("hits"), F.max("need").alias("need")).filter("hits >= need").select("node").distinct()
    alive = written(alive, "alive")
    tied = found.select("node", "center").distinct()
    # What grows with the corpus meets by a shuffle at every size: a broadcast would go through the driver, and files
    # and aggregates of hashes are several times larger there than the planner takes them to be.
    # A reader sends on only its run's center; what is tied to it meets other readers' nodes through the center's own ties.
    carried = alive.unionByName(tied.join(alive.hint("merge"), "node").select(F.col("center").alias("node"))).distinct()
    kept = tied.join(carried.hint("merge"), "node").filter("node <> center")
    grouped = components(kept.select(F.col("node").alias("a"), F.col("center").alias("b"))).withColumnRenamed("root", "grp").join(alive.hint("merge"), "node")
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = spread(grouped, sizes, ["grp"]).withColumn("blocks", F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(4 * F.col("n") / (3 * BLOCK))).cast("long"))
    first = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    shared = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(11)), F.col("n")) < SHARED)
    representative = meta.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    members = written(own.select("grp", "node", "blocks", first.alias("home"), shared.alias("shared")).join(representative.hint("merge"), "node"), "members")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in (part for whole in batches for part in slices(whole)):
            sets = [shingles(x, width, hashes) for x in texts(b.column("text"))]
            # Rows that repeat a doc_id can have other sets than its node.
            keep = pa.array([len(x) > 0 and node_of(x) == node for x, node in zip(sets, b.column("node").to_pylist(), strict=True)])
            bag = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "node", "blocks", "home", "shared")), bag], ["grp", "node", "blocks", "home", "shared", "bag"]).filter(keep)

    # Candidates grow with the corpus, so texts and they meet by a shuffle at every size.
    met = docs.select("doc_id", "text").join(members.hint("merge"), "doc_id").select("grp", "node", "blocks", "home", "shared", "text")
    # Written first: a sort of texts and Python workers in one stage would share an executor's memory.
    met = written(met, "texts")
    candidates = written(met.transform(in_batches, bags, "grp long, node long, blocks long, home long, shared boolean, bag binary"), "candidates")
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    placed = candidates.select("grp", "node", "bag", F.explode(F.when(F.col("shared"), everywhere).otherwise(F.array("home"))).alias("block"))
    dealt = placed.repartition(n, "grp", "block").sortWithinPartitions("grp", "block")
    edges = written(dealt.transform(in_batches, inside(percent), "a long, b long"), "links")
    large = candidates.filter("blocks > 1").select("grp", "node", "home", "bag")
    if large.isEmpty():
        return edges
    # Components of the large groups so far; the nodes outside each group's largest one ask the other blocks.
    roots = components(edges).withColumnRenamed("root", "component")
    labelled = members.filter("blocks > 1").select("grp", "node").join(roots.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = labelled.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp", "main.component", F.lit(True).alias("is_main"))
    open_groups = main.select("grp")
    labelled = spread(spread(labelled, open_groups, ["grp"]), main, ["grp", "component"], "left").select("node", "component", F.col("is_main").isNull().alias("outside"))
    busy = written(large.dropDuplicates(["node"]).join(labelled.hint("merge"), "node"), "busy")
    if busy.isEmpty():
        return edges
    met = meetings(busy, percent)
    load = met.groupBy("grp", "block").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("chunks"))
    asked = spread(met, load, ["grp", "block"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(13)), "chunks").cast("int"))
    asked = asked.select("grp", "block", "chunk", "node", F.lit(True).alias("asks")).join(busy.select("node", "component", "bag").hint("merge"), "node")
    stay = busy.withColumnRenamed("home", "block").join(load.hint("merge"), ["grp", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = asked.unionByName(stay.select("node", "grp", "block", "chunk", F.lit(False).alias("asks"), "component", "bag"))
    dealt = rows.repartition(n, "grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk", "asks", "node")
    return edges.unionByName(written(dealt.transform(in_batches, across(percent), "a long, b long"), "links"))


def groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for every row."""
    return labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """As ``groups``, with text_hash and root, a number of the row's component (null without words).

    Two documents link when 100 * |common shingles| >= ``percent`` * |shingles of either|.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent from 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in (part for whole in batches for part in slices(whole)):
            sets = [shingles(x, width, hashes) for x in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([node_of(x) if len(x) else None for x in sets], pa.int64()), b.column(2)], ["doc_id", "n_shingles", "node", "text_hash"])

    meta = written(docs.transform(in_batches, measure, "doc_id long, n_shingles long, node long, text_hash long"), "sets")
    nodes = meta.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(links(docs.filter("doc_id is not null"), meta.filter("doc_id is not null"), width, percent))
    # What is alone needs no label; the rest is small beside the table, and copies of hot rows and components can be spread.
    found = nodes.join(roots.hint("merge"), "node", "left").filter("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "least")
    found = written(found, "roots")
    label = found.groupBy("root").agg(F.min("least").alias("label"))
    by_node = spread(found, label, ["root"]).select("node", "root", "label")
    rows = spread(meta, by_node, ["node"], "left")
    return rows.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
