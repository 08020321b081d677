"""Collections: literal lists, ranges, constants, and values of one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = "pos"


def literal(spark: SparkSession, items: Sequence, schema: str | T.DataType = "long", value: str = "value") -> DataFrame:
    """A list of the program's text: a position from 0 and the value, or a record's fields."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if isinstance(kind, T.StructType) and not (isinstance(schema, str) and len(kind) == 1 and schema.strip() == kind[0].dataType.simpleString()):
        rows = [(k, *x) for k, x in enumerate(items)]
        return spark.createDataFrame(rows, T.StructType([T.StructField(POSITION, T.LongType(), False), *kind.fields]))
    rows = [(k, x) for k, x in enumerate(items)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(POSITION, T.LongType(), False), T.StructField(value, kind)]))


def extent(spark: SparkSession, n: int) -> DataFrame:
    """The index domain [0, n)."""
    return spark.range(n).withColumnRenamed("id", POSITION)


def product(*domains: DataFrame) -> DataFrame:
    """The domain of a record of domains; columns must differ in name."""
    out = domains[0]
    for more in domains[1:]:
        out = out.crossJoin(more)
    return out


def positioned(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with dense positions in the order of a key.  All rows meet in one task: for small tables.

    A large source should carry a sequence column of its own instead.
    """
    return df.withColumn(POSITION, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def zipped(left: DataFrame, right: DataFrame, on: str | Sequence[str] = POSITION) -> DataFrame:
    """Two collections over one domain: the positions that both have."""
    return left.join(right, on, "inner")


def lookup(keys: DataFrame, key: Column, table: DataFrame, table_key: str, value: str, name: str) -> DataFrame:
    """A collection applied as a function to each key; keys that it lacks are dropped."""
    found = table.select(F.col(table_key).alias("_key"), F.col(value).alias(name))
    return keys.join(found, key == F.col("_key"), "inner").drop("_key")


def element(df: DataFrame, index: int, order: str = POSITION) -> DataFrame:
    """The row at a position of a positioned collection."""
    return df.filter(F.col(order) == index)


def scalar(df: DataFrame, column: str):
    """The value of a collection of one row."""
    rows = df.select(column).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} rows where one was meant")
    return rows[0][0]


def with_scalar(df: DataFrame, one: DataFrame, **names: str) -> DataFrame:
    """``df`` with values of a one-row collection beside each row; names: new=column.

    Any other number of rows is a fault when the query runs.
    """
    counted = one.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*(F.col(v).alias(k) for k, v in names.items()))).alias("_one"))
    wrong = F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(" rows where one was meant")))
    checked = counted.select(F.when(F.col("_n") == 1, F.col("_one")).otherwise(wrong.cast(counted.schema["_one"].dataType)).alias("_one"))
    return df.crossJoin(F.broadcast(checked)).select(*(df[c] for c in df.columns), *(F.col(f"_one.`{k}`").alias(k) for k in names))


def inverted(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values to the sorted keys that have them: the index of a collection taken as a function."""
    return df.groupBy(value).agg(F.array_sort(F.collect_list(key)).alias(key))


def flattened(df: DataFrame, inner: str, *outer: str, position: str = POSITION) -> DataFrame:
    """A collection of collections as one, over (outer, position)."""
    return df.select(*outer, F.posexplode(inner).alias(position, inner))
