"""Aggregates that are defined on no rows, grouping, and lookup of one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import IDENTITY


def total(x: Column | str) -> Column:
    """Sum of integers; 0 of none."""
    return F.coalesce(F.sum(_col(x)).cast("long"), F.lit(0).cast("long"))


def largest(x: Column | str, kind: str = "bigint") -> Column:
    """Maximum of integers or strings; of none the least value of the type.  Other types are an error."""
    if kind not in IDENTITY:
        raise TypeError(f"largest is for integers and strings, not {kind}")
    return F.coalesce(F.max(_col(x)), F.lit(IDENTITY[kind]).cast(kind))


def least(x: Column | str) -> Column:
    """Minimum; null of none."""
    return F.min(_col(x))


def size() -> Column:
    return F.count(F.lit(1))


def mean(x: Column | str) -> Column:
    """Average; null of none."""
    return F.avg(_col(x))


class Groups:
    """A collection grouped by a key: aggregate it, iterate its groups, or look one up."""

    def __init__(self, df: DataFrame, **key: Column):
        if not key:
            raise ValueError("a grouping needs a key")
        self.names = list(key)
        self.df = df.withColumns(key)

    def agg(self, **aggregates: Column) -> DataFrame:
        """One row for each group that has rows; several aggregates share one pass."""
        return self.df.groupBy(*self.names).agg(*(v.alias(k) for k, v in aggregates.items()))

    def lookup(self, *key) -> DataFrame:
        """The rows of one group; none where the key is missing."""
        out = self.df
        for name, value in zip(self.names, key, strict=True):
            out = out.filter(F.col(name) == value)
        return out

    def lookup_agg(self, *key, **aggregates: Column) -> DataFrame:
        """Aggregates of one group, with their values for no rows where the key is missing."""
        return self.lookup(*key).agg(*(v.alias(k) for k, v in aggregates.items()))

    def entries(self, value: Column, name: str = "group") -> DataFrame:
        """key and the array of its values, sorted; for groups that are small by their nature."""
        return self.df.groupBy(*self.names).agg(F.array_sort(F.collect_list(value)).alias(name))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
