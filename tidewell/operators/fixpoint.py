"""Recursive set queries: the least fixpoint, by semi-naive rounds, and closures by doubling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import settled


#: Rounds after which the known rows' tables are written as one, so that plans stay short.
COMPACT = 8


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that ``base`` and repeated ``step`` give, as a set.

    Each round steps only from the rows that the last one added, drops what is known by an anti
    join, and is written to the shared folder, so cycles end and lineage stays short.  There is no
    bound on rounds: a step that makes new values for ever does not end.
    """
    columns = base.columns
    fresh = settled(base.distinct(), "round")
    known, tables = fresh, 1
    while not fresh.isEmpty():
        made = step(fresh).select(*columns).distinct()
        fresh = settled(made.alias("made").join(known.alias("known"), _same("made", "known", columns), "left_anti"), "round")
        known, tables = known.unionByName(fresh), tables + 1
        if tables >= COMPACT:
            known, tables = settled(known, "known"), 1
    return known


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in columns))


def reachable(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Pairs of nodes that a path of one or more edges connects.

    Paths double: each round joins all pairs known with themselves, so a longest shortest path of n hops
    takes about log2(n) rounds.  Nulls are no nodes.
    """
    pairs = settled(edges.select(F.col(source).alias("_a"), F.col(target).alias("_b")).filter("_a is not null and _b is not null").distinct(), "pairs")
    n = pairs.count()
    while True:
        ahead = pairs.select(F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        pairs = settled(pairs.unionByName(pairs.join(ahead, "_b").select("_a", F.col("_c").alias("_b"))).distinct(), "pairs")
        n, before = pairs.count(), n
        if n == before:
            return pairs.select(F.col("_a").alias(source), F.col("_b").alias(target))
