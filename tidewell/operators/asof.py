"""As-of reads: the latest committed snapshot at a trigger's moment, and aggregates pinned to it.

At equal times writes come before reads, so a reply after a commit sees it.  All values of a read
come from one row, hence from one snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _together(reads: DataFrame, writes: DataFrame, time: str, write_time: str, by: list[str], values: list[str], write_order: list[str]) -> DataFrame:
    read = reads.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_n"), F.struct(*reads.columns).alias("_read"))
    order = F.row_number().over(Window.partitionBy(*by, write_time).orderBy(*write_order)).cast("bigint") if write_order else F.lit(0).cast("bigint")
    write = writes.select(*by, F.col(write_time).alias("_t"), F.lit(0).alias("_side"), order.alias("_n"), F.struct(*values).alias("_value"))
    return read.unionByName(write, allowMissingColumns=True)


def asof_join(reads: DataFrame, writes: DataFrame, time: str, values: list[str], by: list[str], write_time: str | None = None, write_order: list[str] | None = None, buckets: str | None = None) -> DataFrame:
    """Every read with ``values`` of the latest write of its key at or before its time (null: none).

    ``buckets`` (SQL over ``_t``, monotone) splits a key's time line for keys that hold much of the
    rows: the last value of each bucket is aggregated first and carried to the next ones, and the
    rows of a bucket are ordered on their own.
    """
    both = _together(reads, writes, time, write_time or time, by, values, write_order or [])
    part = [*by, "_bucket"] if buckets else by
    both = both.withColumn("_bucket", F.expr(buckets)) if buckets else both
    window = Window.partitionBy(*part).orderBy("_t", "_side", "_n").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(window)).filter("_side = 1")
    if buckets:
        ends = both.filter("_side = 0").groupBy(*part).agg(F.max_by("_value", F.struct("_t", "_n")).alias("_end"))
        every = both.select(*part).distinct().join(ends, part, "left")
        earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = every.select(*part, F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
        found = found.join(before, part, "left").withColumn("_seen", F.coalesce("_seen", "_before"))
    return found.select("_read.*", *(F.col(f"_seen.{v}").alias(v) for v in values))


def pinned(reads: DataFrame, changes: DataFrame, time: str, by: list[str], change_time: str | None = None, inclusive: bool = True, **aggregates: Column) -> DataFrame:
    """Every read with aggregates over its key's changes up to its time (or strictly before it).

    An aggregate is over columns of ``changes``, such as ``F.sum("amount")``.
    """
    read = reads.select(*by, F.col(time).alias("_t"), F.lit(1 if inclusive else 0).alias("_side"), F.struct(*reads.columns).alias("_read"))
    write = changes.withColumns({"_t": F.col(change_time or time), "_side": F.lit(0 if inclusive else 1)})
    both = read.unionByName(write, allowMissingColumns=True)
    window = Window.partitionBy(*by).orderBy("_t", "_side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select("*", *(v.over(window).alias(f"_{k}") for k, v in aggregates.items())).filter("_read is not null").select("_read.*", *(F.col(f"_{k}").alias(k) for k in aggregates))
