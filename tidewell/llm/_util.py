"""What the operators of this subpackage share: shared-folder tables and Arrow batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.shared import settled, shared_path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return shared_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder; this cuts its lineage."""
    return settled(df, name)


def without(rows: DataFrame, own: dict[str, Column], gone: DataFrame) -> DataFrame:
    """``rows`` but those whose expressions ``own`` equal, null to null, a row of ``gone`` (columns of the same names).

    What goes may grow with the corpus, so both sides meet by a shuffle at every size.  The rows travel as one
    struct: none of their columns can clash with the keys.
    """
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), *(v.alias(f"_own_{k}") for k, v in own.items()))
    gone = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in own)).hint("merge")
    same = reduce(lambda a, b: a & b, (F.col(f"_own_{k}").eqNullSafe(F.col(f"_gone_{k}")) for k in own))
    return keyed.join(gone, same, "left_anti").select("_row.*")


def spread(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``small``, which holds each key once; a hot key's rows are dealt over ``salts`` tasks.

    Both sides meet by a shuffle at every size: the planner does not count the copies, so by its estimate it would
    broadcast, through the driver, ``salts`` times what it is allowed to, and more as the corpus grows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it for a URI, such as s3://, hdfs:// or file:, or a plain path."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:/*", "/", uri))
    return pafs.FileSystem.from_uri(uri)


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(b: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most ``rows``, so that few of its texts are Python objects at a time."""
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def parts(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows, closed at about ``limit`` bytes of binary and string values or 20,000 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= limit or len(held) >= 20_000:
            yield batch(held, schema)
            held, size = [], 0
    if held:
        yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
