"""Rows that the driver takes in one by one, as a stream: small files in the folder that all share.

What stdin or a socket says arrives in one process; the files make it a source that can be read again
after a failure.  Each file appears whole or not at all.
"""

from __future__ import annotations

import json
import sys
import threading
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.shared import shared_path


class Spool:
    """An append-only folder of rows; what came within ``every`` seconds makes one file."""

    def __init__(self, spark: SparkSession, schema: str, name: str = "spool", every: float = 0.05):
        self.path, self._spark, self._schema = shared_path(spark, name), spark, schema
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._store = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._store.mkdirs(self._folder)
        self._rows: list[dict] = []
        self._lock, self._closed, self._written, self._every = threading.Lock(), threading.Event(), 0, every
        self._writer = threading.Thread(target=self._run, daemon=True)
        self._writer.start()

    def put(self, row: dict) -> None:
        with self._lock:
            if self._closed.is_set():
                raise ValueError("the spool is closed")
            self._rows.append(row)

    def _run(self) -> None:
        while not self._closed.wait(self._every):
            self._write()
        self._write()

    def _write(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if not rows:
            return
        made = self._spark._jvm.org.apache.hadoop.fs.Path
        # Files whose names begin with a dot are not read.
        begun, done = made(self._folder, f".{self._written:012d}"), made(self._folder, f"{self._written:012d}.json")
        out = self._store.create(begun, True)
        out.write(bytearray("".join(json.dumps(row) + "\n" for row in rows).encode()))
        out.close()
        self._store.rename(begun, done)
        self._written += 1

    def stream(self, clean: bool = False) -> DataFrame:
        """The rows so far and all that come; ``clean`` deletes files that the one query of the stream has done with."""
        reader = self._spark.readStream.schema(self._schema)
        return (reader.option("cleanSource", "delete") if clean else reader).json(self.path)

    def close(self) -> None:
        """No more rows; what came is in files when this returns."""
        with self._lock:
            self._closed.set()
        self._writer.join()


class Stdin:
    """Lines of standard input, or of another open text, numbered from 0, without their line feeds.

    A thread reads them as they come.  ``wait`` returns at the end of the text, when all lines are in the stream.
    """

    def __init__(self, spark: SparkSession, text: TextIO | None = None):
        self._spool = Spool(spark, "position long, value string", "stdin")
        self._text = sys.stdin if text is None else text
        self._reader = threading.Thread(target=self._read, daemon=True)
        self._reader.start()

    def _read(self) -> None:
        try:
            for position, line in enumerate(self._text):
                self._spool.put({"position": position, "value": line.removesuffix("\n")})
        finally:
            self._spool.close()

    def stream(self) -> DataFrame:
        return self._spool.stream()

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the end has come, within so many seconds if given."""
        self._reader.join(seconds)
        return not self._reader.is_alive()
