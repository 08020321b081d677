"""Ordered folds: loop-carried state, with or without output at every step.

Choose the cheapest that fits: ``running`` for associative updates (windows), ``fold`` for any update
written as columns when only the end matters, ``scan`` for any update with output at every step.
Without a key an order over all rows is sequential by its nature; with one, keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.sources.package import in_batches


def running(df: DataFrame, order: list[str], by: list[str] | None = None, **outputs: Column) -> DataFrame:
    """``df`` with aggregates over the rows so far; ``outputs`` are aggregates such as ``F.sum("x")``."""
    window = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *(v.over(window).alias(k) for k, v in outputs.items()))


def running_if(condition: Column, x: Column) -> Column:
    """The term of a conditional ``acc += x``: nothing where the condition fails."""
    return F.sum(F.when(condition, x).otherwise(0))


def fold(df: DataFrame, order: list[str], init: dict[str, Column], step: Callable, by: list[str] | None = None) -> DataFrame:
    """The state after the last row, one row for each key; without a key, ``init`` where there are no rows.

    ``step(acc, row)`` takes structs and returns the new value of each state variable, as columns; a
    variable that it leaves out keeps its value.  Later variables see earlier ones' new values through
    plain Python names.  The rows of a key are gathered in one array: for keys of bounded size.
    """
    by = by or []
    values = [c for c in df.columns if c not in by and c not in order]
    first = F.struct(*(v.alias(k) for k, v in init.items()))

    def merge(acc: Column, row: Column) -> Column:
        new = step(acc, row)
        if unknown := set(new) - set(init):
            raise ValueError(f"the step writes {sorted(unknown)}, which the fold does not carry")
        return F.struct(*(new.get(k, acc[k]).alias(k) for k in init))

    ordered = F.array_sort(F.collect_list(F.struct(*order, *values)))
    state = df.groupBy(*by).agg(ordered.alias("_rows")).select(*by, F.aggregate("_rows", first, merge).alias("_state"))
    return state.select(*by, "_state.*")


def scan(df: DataFrame, order: list[str], init: dict, step: Callable, output: str, by: list[str] | None = None) -> DataFrame:
    """Output at every step of any update: ``step(state, row)`` changes the dict ``state`` and returns a
    tuple for ``output`` (a schema), or None for no output.

    Rows are dealt by key and sorted, and stream through a task in Arrow batches; a key's rows are
    never held together, so its size is not bounded by memory.
    """
    by = by or []
    schema = T._parse_datatype_string(output)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = object(), {}
        for b in batches:
            rows = []
            for row in b.to_pylist():
                key = tuple(row[c] for c in by)
                if key != here:
                    here, state = key, dict(init)
                made = step(state, row)
                if made is not None:
                    rows.append((*key, *made))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in full]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, full, strict=True)], schema=full)

    keys = T.StructType([df.schema[c] for c in by])
    full = pa.schema([*to_arrow_schema(keys), *arrow]) if by else arrow
    dealt = df.repartition(*by) if by else df.repartition(1)
    return dealt.sortWithinPartitions(*by, *order).transform(in_batches, run, T.StructType([*keys.fields, *schema.fields]))


def last_or(df: DataFrame, value: str, order: str, default, by: list[str] | None = None) -> DataFrame:
    """The value at the greatest position, or a default where there are no rows."""
    kind = df.schema[value].dataType
    return df.groupBy(*(by or [])).agg(F.coalesce(F.max_by(value, order), F.lit(default).cast(kind)).alias(value))


def previous(x: str, order: list[str], default, by: list[str] | None = None) -> Column:
    """The value one position before, or a default at the first."""
    return F.lag(x, 1, default).over(Window.partitionBy(*(by or [])).orderBy(*order))


def carried(x: str, order: list[str], by: list[str] | None = None, default=None) -> Column:
    """The latest value so far that is not null: a changelog made dense."""
    window = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(x, ignorenulls=True).over(window), F.lit(default))
