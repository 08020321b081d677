"""Streams: element-wise queries, incremental joins, terminal aggregates, running state, and replies.

The builders of ``operators`` work on streaming DataFrames as they are; what differs is here: how a
stream is drained, when an aggregate is published, and where running state lives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.sources.package import shipped
from tidewell.sources.shared import shared_path


def drained(stream: DataFrame, name: str = "stream") -> DataFrame:
    """All that the source holds now, taken through the query in micro-batches and read back.

    Exactly once: the file sink's log names the files of committed batches.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def terminal(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], name: str = "terminal") -> DataFrame:
    """An aggregate that exists only when its input is complete: computed over the drained stream."""
    return aggregate(drained(stream, name))


def bounded_join(left: DataFrame, right: DataFrame, condition: Column, left_time: str | None = None, right_time: str | None = None, lateness: str | None = None) -> DataFrame:
    """Incremental inner join: matches appear as rows of either side arrive, and none is taken back.

    Without times and lateness the state of both sides is kept for good, as the semantics ask; with
    them it is dropped when the watermarks pass.
    """
    if lateness:
        left, right = left.withWatermark(left_time, lateness), right.withWatermark(right_time, lateness)
    return left.join(right, condition, "inner")


def stateful(stream: DataFrame, by: list[str], order: list[str], init: dict, step: Callable, state: str, output: str, position: str | None = None, time: str | None = None, lateness: str | None = None) -> DataFrame:
    """Running output of a fold over a stream, by key: ``step(state, row)`` as in ``operators.fold.scan``.

    Rows may arrive out of order.  What has to wait, waits in the state store, beside the state (a schema):

    * ``position`` names a column that numbers a key's rows 0, 1, 2, ...: a row waits until all before it
      have come, so the output is that of the ordered fold, whatever the batches.  A number that comes
      again is taken as a repeat and left out.
    * ``time`` and ``lateness``: a row waits until the watermark has passed its event time, then goes in
      ``order``; rows later than that are left out.
    * with neither, rows of a micro-batch go in ``order``, batch after batch: for sources that deliver in order.
    """
    if position and time:
        raise ValueError("order by position or by time, not both")
    fields = T._parse_datatype_string(state).fieldNames()
    keys = T.StructType([stream.schema[c] for c in by])
    made = T._parse_datatype_string(output)
    columns = [*by, *made.fieldNames()]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *own, reached, waiting = held.get if held.exists else (*(init[f] for f in fields), 0, b"")
        own, rows = dict(zip(fields, own, strict=True)), pickle.loads(waiting) if waiting else []
        if not held.hasTimedOut:
            rows += [row for frame in frames for row in frame.to_dict("records")]
        if position:
            rows.sort(key=lambda r: r[position])
            ready, later = [], []
            for row in rows:
                if row[position] == reached:
                    ready.append(row)
                    reached += 1
                elif row[position] > reached:
                    later.append(row)
        elif time:
            passed = pd.Timestamp(held.getCurrentWatermarkMs(), unit="ms")
            ready, later = [r for r in rows if r[time] <= passed], [r for r in rows if r[time] > passed]
            ready.sort(key=lambda r: [r[c] for c in order])
        else:
            ready, later = sorted(rows, key=lambda r: [r[c] for c in order]), []
        out = []
        for row in ready:
            said = step(own, row)
            if said is not None:
                out.append((*key, *said))
        held.update((*(own[f] for f in fields), reached, pickle.dumps(later) if later else b""))
        if time and later:
            held.setTimeoutTimestamp(int(min(r[time] for r in later).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=columns)

    shipped(stream.sparkSession)
    timed = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    rows = stream.withWatermark(time, lateness) if time else stream
    return rows.groupBy(*by).applyInPandasWithState(run, T.StructType([*keys.fields, *made.fields]), f"{state}, _reached long, _waiting binary", "append", timed)


def replying(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], name: str = "replies") -> None:
    """Answer requests (request_id, ...) batch by batch: ``answer`` gives (request_id, body), ``sink`` delivers them.

    A batch that is run again after a failure has the same requests; a sink should take a second reply
    to a request_id as the first.
    """

    def deliver(batch: DataFrame, _: int) -> None:
        said = answer(batch)
        sink(batch.select("request_id").join(said, "request_id", "inner"))

    state = shared_path(requests.sparkSession, f"{name}-state")
    requests.writeStream.foreachBatch(deliver).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def delivered(stream: DataFrame, sink: Callable[[DataFrame], None], name: str = "delivered") -> StreamingQuery:
    """``sink`` takes the micro-batches of a stream as they come, until the query that is returned is stopped.

    With ``stateful`` before it this is a fold over requests with a reply to each.  A batch that is run
    again after a failure is the same; a sink should take a second reply to a request_id as the first.
    """
    state = shared_path(stream.sparkSession, f"{name}-state")
    return stream.writeStream.foreachBatch(lambda batch, _: sink(batch)).option("checkpointLocation", state).start()


def windowed(stream: DataFrame, time: str, width: str, lateness: str, by: list[str] | None = None, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of tumbling or sliding windows of event time; late rows beyond the watermark are left out."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = stream.withWatermark(time, lateness).groupBy(span.alias("window"), *(by or []))
    return grouped.agg(*(v.alias(k) for k, v in aggregates.items())).select("window.start", "window.end", *(by or []), *aggregates)
