"""Sources by name: files of any format that Spark reads, registered tables, and lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json", "text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Files of a format; give the schema for csv and json, as inferring reads them twice."""
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {FORMATS}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


class Sources:
    """The host's named sources, static or streaming, with declared schemas."""

    def __init__(self):
        self._known: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame, schema: str | T.StructType | None = None) -> DataFrame:
        if name in self._known:
            raise ValueError(f"source {name!r} is registered already")
        if schema is not None:
            kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
            df = df.select(*(df[f.name].cast(f.dataType) for f in kind.fields))
        self._known[name] = df
        return df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"no source {name!r}; there are {sorted(self._known)}")
        return self._known[name]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the text files that arrive in a folder, without their line feeds, as a stream."""
    return spark.readStream.format("text").load(folder)


def arriving(spark: SparkSession, folder: str, schema: str | T.StructType, kind: str = "parquet", files_at_once: int | None = None) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(folder)
