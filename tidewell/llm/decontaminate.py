"""Benchmark decontamination, with DataFrame and SQL functions alone.

Texts and items become lower-cased words of letters and digits and their five-word shingles.  A
shingle is one long: a hash whose low eight bits give way to its weight, which grows with the
letters of its words.  Windows of an item's size slide over every start of a text.  Starts at which
an exact bound proves that no item of the size can reach the similarity (what the window shares with
all items of that size together weighs too little) are passed over; all others are fingerprinted by
SimHash.  The fingerprints meet the items' of the same size through a multi-index: fingerprints are
cut into ``BLOCKS`` blocks, the windows' blocks are looked up as they are and the items' are stored
with up to ``FLIPS`` bits turned.  Fingerprints within ``RADIUS`` bits differ by no more than that in
one block at least, so they always meet, and each pair counts at its first such block alone.  The pairs within the
radius are verified by the exact weighted Jaccard similarity of their shingle sets.

Edge cases: null and empty texts match nothing; so do items of fewer than five words, which are
too short to be evidence; a text shorter than an item is one window; very long texts are slid over
whole; rows that repeat a doc_id are all searched and give one row per (doc_id, item_id); a null
doc_id is reported as null; of windows that tie the first (smallest start) is reported, windows that
are aligned with a shared shingle before others; an empty table on either side gives an empty result;
other columns of the input are ignored by ``leaks`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._util import without, written

WORDS = 5
#: Least similarity of a leak, in hundredths.
LEAST = 80
#: Blocks of a 64-bit fingerprint, and bits that may be turned in one.
BLOCKS, FLIPS = 6, 2
#: Weighted Jaccard 0.8 is about 10 differing bits with a deviation of 2.9.
RADIUS = (FLIPS + 1) * BLOCKS - 1
#: Item shingles up to this number (16 bytes each) are sent to every executor; more are joined by shuffle.
SENT_SHINGLES = 2_000_000


def shingled(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with n_words and ``shingles`` (none below five words) instead of the text."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    keep = [c for c in rows.columns if c != text]
    out = rows.select(*keep, words.alias("_w")).select(*keep, F.size("_w").alias("n_words"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), F.transform("_w", lambda w: F.length(w)).alias("_l"))
    hashed = ", ".join(f"get(_h, i + {k})" for k in range(1, WORDS))
    letters = " + ".join(f"get(_l, i + {k})" for k in range(WORDS))
    made = F.expr(f"transform(slice(_h, 1, greatest(0, n_words - {WORDS - 1})), (x, i) -> (xxhash64(x, {hashed}) & -256L) | least(255, 10 + {letters}))")
    return out.select(*keep, "n_words", made.alias("shingles"))


def simhash(shingles: str) -> str:
    """SQL for the weighted SimHash of an array column: bit b is set where shingles with it outweigh the others."""
    vote = f"aggregate({shingles}, 0L, (t, s) -> t + (s & 255L) * (2L * (shiftrightunsigned(xxhash64(s), b) & 1L) - 1L))"
    return f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if({vote} > 0, shiftleft(1L, b), 0L))"


def weight(shingles: str) -> str:
    return f"aggregate({shingles}, 0L, (t, s) -> t + (s & 255L))"


def _cuts() -> list[tuple[int, int]]:
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _bits(fingerprint: str, a: int, b: int) -> str:
    return f"(shiftrightunsigned({fingerprint}, {a}) & {(1 << b - a) - 1}L)"


def blocks(fingerprint: str) -> str:
    """SQL for an array of ``BLOCKS`` longs: number and bits of each block."""
    return f"array({', '.join(f'{k << 32}L | {_bits(fingerprint, a, b)}' for k, (a, b) in enumerate(_cuts()))})"


def near_blocks(fingerprint: str) -> str:
    """SQL for an array of all blocks that differ from the fingerprint's own by up to ``FLIPS`` bits."""
    made = []
    for k, (a, b) in enumerate(_cuts()):
        turned = [sum(1 << x for x in some) for n in range(FLIPS + 1) for some in combinations(range(b - a), n)]
        made.append(f"transform(array({', '.join(f'{x}L' for x in turned)}), x -> {k << 32}L | ({_bits(fingerprint, a, b)} ^ x))")
    return f"concat({', '.join(made)})"


def first_block(differ: str) -> str:
    """SQL for the number of the first block in which at most ``FLIPS`` of the bits ``differ`` are set."""
    return "CASE " + " ".join(f"WHEN bit_count({_bits(differ, a, b)}) <= {FLIPS} THEN {k}" for k, (a, b) in enumerate(_cuts())) + " END"


#: SQL for the starts of the windows that hold enough of the sorted ``places``; each is tried at its first place only,
#: and no more places than a window has shingles can be in it.
STARTS = f"""
flatten(transform(places, (p, i) -> filter(
  if(greatest(shiftright(p, 8) - size + {WORDS}, if(i = 0, 0L, shiftright(get(places, i - 1), 8) + 1), 0L) <= least(shiftright(p, 8), greatest(0, n_words - size)),
    transform(sequence(greatest(shiftright(p, 8) - size + {WORDS}, if(i = 0, 0L, shiftright(get(places, i - 1), 8) + 1), 0L), least(shiftright(p, 8), greatest(0, n_words - size))), t -> cast(t AS int)),
    array()),
  t -> 100 * aggregate(slice(places, i + 1, size), 0L, (sum, q) -> sum + if(shiftright(q, 8) <= t + size - {WORDS}, q & 255L, 0L)) >= least)))
"""


def leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, aligned, similarity, start and n_words of every window that leaks."""
    spark = docs.sparkSession
    items = shingled(benchmark.select(F.col("item_id").cast("long"), "text")).distinct()
    items = items.withColumn("bag", F.array_distinct("shingles")).withColumns({"fingerprint": F.expr(simhash("bag")), "weight": F.expr(weight("bag"))})
    items = written(items, "items")
    placed = items.select("item_id", F.col("n_words").alias("size"), F.posexplode("shingles").alias("item_at", "shingle"))
    # One row for each shingle and place; the alignment needs no more of the item than its size.
    placed = placed.select("shingle", "size", "item_at").distinct()
    # A leak's window has so much weight in common with an item, at least.
    least = items.filter("n_words >= 5").groupBy(F.col("n_words").alias("size")).agg((LEAST * F.min("weight")).alias("least"))
    placed = written(placed.join(least, "size").select("shingle", "size", "item_at", "least"), "placed")
    if placed.count() <= SENT_SHINGLES:
        placed = F.broadcast(placed)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    marked = rows.withColumn("text_hash", F.xxhash64("text"))
    # The outer form: of the plain one the optimizer infers a filter that computes every shingle anew.
    seen = shingled(marked).select("doc_id", "text_hash", "n_words", F.posexplode_outer("shingles").alias("at", "shingle"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("item_at"), F.col("n_words") - F.col("size")))
    # A place and its weight are one long.
    place = F.col("at").cast("long") * 256 + F.col("shingle").bitwiseAND(F.lit(255))
    windows = seen.join(placed, "shingle").select("doc_id", "text_hash", "n_words", "size", "least", start.cast("int").alias("start"), place.alias("place"))
    aligned, places = F.collect_set("start").alias("aligned"), F.array_sort(F.collect_set("place")).alias("places")
    windows = windows.groupBy("doc_id", "text_hash", "n_words", "size", "least").agg(aligned, places)
    windows = windows.filter(f"100 * {weight('places')} >= least").withColumn("starts", F.expr(STARTS)).filter("size(starts) > 0")
    window = F.struct("size", F.expr("transform(starts, s -> struct(s AS start, array_contains(aligned, s) AS aligned))").alias("starts"))
    windows = windows.groupBy("doc_id", "text_hash").agg(F.collect_list(window).alias("windows"))
    windows = windows.withColumn("windows", F.expr("flatten(transform(windows, x -> transform(x.starts, s -> struct(x.size AS size, s.start AS start, s.aligned AS aligned))))"))
    windows = windows.select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash"), "windows")
    hit = marked.join(windows, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash")))
    cut = shingled(hit.select("doc_id", "text_hash", "windows", "text")).select("doc_id", "text_hash", "shingles", F.explode("windows").alias("window"))
    bag = F.array_distinct(F.expr(f"slice(shingles, window.start + 1, window.size - {WORDS - 1})"))
    cut = cut.select("doc_id", "text_hash", "window.size", "window.start", "window.aligned", bag.alias("bag"))
    cut = cut.withColumns({"fingerprint": F.expr(simhash("bag")), "weight": F.expr(weight("bag"))})
    cut = written(cut, "windows")
    # Fingerprints that many windows share are searched once.
    mine = cut.select("size", "fingerprint").distinct().withColumn("block", F.explode(F.expr(blocks("fingerprint"))))
    theirs = items.filter("n_words >= 5").select(F.col("n_words").alias("size"), F.col("fingerprint").alias("item_fingerprint")).distinct()
    theirs = theirs.withColumn("block", F.explode(F.expr(near_blocks("item_fingerprint"))))
    near = mine.join(theirs, ["size", "block"]).withColumn("differ", F.expr("fingerprint ^ item_fingerprint"))
    near = near.filter(f"bit_count(differ) <= {RADIUS} AND shiftright(block, 32) = {first_block('differ')}").select("size", "fingerprint", "item_fingerprint")
    sides = items.select("item_id", F.col("n_words").alias("size"), F.col("fingerprint").alias("item_fingerprint"), F.col("bag").alias("item_bag"), F.col("weight").alias("item_weight"))
    pairs = cut.join(near.join(sides, ["size", "item_fingerprint"]), ["size", "fingerprint"])
    pairs = pairs.withColumn("common", F.expr(weight("array_intersect(bag, item_bag)")))
    either = F.col("weight") + F.col("item_weight") - F.col("common")
    return pairs.filter(100 * F.col("common") >= LEAST * either).select("doc_id", "text_hash", "item_id", "aligned", (F.col("common") / either).alias("similarity"), "start", F.col("size").alias("n_words"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start (in words) and n_words of the best window, for every leak.

    A window aligned with a shared shingle goes before all others that leak, even more similar ones.
    """
    found = leaking(docs, benchmark)
    best = F.max(F.struct("aligned", "similarity", (-F.col("start")).alias("start"), "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"), "best.n_words")


def clean(docs: DataFrame, benchmark: DataFrame, by_text: bool = False) -> DataFrame:
    """The rows of ``docs`` whose document has no leak.

    Rows that repeat a doc_id are one document, unless ``by_text``: then every row goes by its own text.  Each
    row with a null doc_id is a document of its own in both cases, and goes by its text.
    """
    found = leaking(docs, benchmark)
    judged = F.lit(True) if by_text else F.col("doc_id").isNull()
    bad = found.select(F.col("doc_id").alias("id"), F.when(judged, F.col("text_hash")).alias("text")).distinct()
    own = {"id": F.col("doc_id").cast("long"), "text": F.when(judged, F.xxhash64("text"))}
    return without(docs, own, bad)
