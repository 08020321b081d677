"""This package on the executors, whose Python workers may not find it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def shipped(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tidewell-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(str(path))
    context._tidewell_shipped = True


def in_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with this package on the workers."""
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)
