"""Bag unions, feeds, and collections chosen by a condition."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FeedError(ValueError):
    """A feed that is used against its rules."""


def union(*arms: DataFrame) -> DataFrame:
    """The multiset sum: every arm's rows with their multiplicities."""
    return reduce(lambda a, b: a.unionByName(b), arms)


def tagged_union(**arms: DataFrame) -> DataFrame:
    """The sum with the arm's name beside each row, so that the arms stay apart."""
    return union(*(v.withColumn("arm", F.lit(k)) for k, v in arms.items()))


def disjoint_union(key: str, *arms: DataFrame) -> DataFrame:
    """The sum of arms over one domain; a key in two arms is a fault when the query runs."""
    every = union(*arms)
    once = every.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("_repeated"))
    ok = F.when(F.col("_repeated") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("keys in two arms: "), F.col("_repeated").cast("string"))).cast("boolean"))
    return every.crossJoin(F.broadcast(once.select(ok.alias("_ok")))).filter("_ok").drop("_ok")


def choose(condition: bool | Column, then: DataFrame, otherwise: DataFrame) -> DataFrame:
    """One collection or the other.  A condition known now picks one; a column gates each arm's rows.

    A null condition is not true, so the row is the other arm's.
    """
    if isinstance(condition, bool):
        return then if condition else otherwise
    if then.schema.fieldNames() != otherwise.schema.fieldNames():
        raise ValueError("both arms must have the same fields")
    holds = F.coalesce(condition, F.lit(False))
    return then.filter(holds).unionByName(otherwise.filter(~holds))


class Feed:
    """An append-only channel: every contribution is a collection; reading gives their union.

    ``define`` ties it to one collection instead, once; a feed that is both fed and defined, defined
    twice, read without any contribution, or fed from itself is an error when the query is built.
    """

    def __init__(self, name: str = "feed"):
        self.name, self.arms, self.defined, self.reading = name, [], None, False

    def put(self, rows: DataFrame | Callable[[], DataFrame]) -> Feed:
        if self.defined is not None:
            raise FeedError(f"{self.name} is defined and cannot be fed")
        self.arms.append(rows)
        return self

    __lshift__ = put

    def put_if(self, df: DataFrame, *arms: tuple[Column | None, Callable[[DataFrame], DataFrame]]) -> Feed:
        """First match: each row of ``df`` goes to the first arm whose condition holds (None: else)."""
        taken = F.lit(False)
        for condition, make in arms:
            own = ~taken if condition is None else ~taken & F.coalesce(condition, F.lit(False))
            self.put(make(df.filter(own)))
            taken = F.lit(True) if condition is None else taken | F.coalesce(condition, F.lit(False))
        return self

    def define(self, rows: DataFrame | Callable[[], DataFrame]) -> Feed:
        if self.defined is not None:
            raise FeedError(f"{self.name} is defined twice")
        if self.arms:
            raise FeedError(f"{self.name} is fed and cannot be defined")
        self.defined = rows
        return self

    def read(self) -> DataFrame:
        if self.reading:
            raise FeedError(f"{self.name} feeds itself")
        arms = [self.defined] if self.defined is not None else self.arms
        if not arms:
            raise FeedError(f"nothing was put into {self.name}")
        self.reading = True
        try:
            return union(*(x() if callable(x) else x for x in arms))
        finally:
            self.reading = False
