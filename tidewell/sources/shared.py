"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, with its scheme.

    Where the session names none, a temporary folder stands in on one machine (a local master); on a
    cluster that is an error.  A path without a scheme is in the session's default store, and is given
    with its scheme, for workers open files without Spark.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/tidewell-shared"
    if "://" not in found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below it."""
    return f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written there and read again, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder with all below it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
