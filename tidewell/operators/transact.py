"""Serializable multi-writer transactions over store variables.

Writers propose one transaction for each of their rows.  All proposals that touch a store are
replayed in one order, (arrival, writer, position), which is what a serializable engine must be
equal to; where a writer names no position, equal arrivals of its own go by a hash of the whole row, so
that the order is the same in every run.  A variable starts from a constant or from what a finished
program gave: a one-row table, or one with a row for each key.  A transaction that writes or replies takes the next tick, from 1; one that does neither
takes none.  Variables that no block relates lie in separate stores, and with a key each key has a
store of its own; stores are replayed in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewell.operators.collection import with_scalar
from tidewell.sources.package import in_batches
from tidewell.sources.shared import settled


class TransactionError(ValueError):
    """A transaction program that breaks a rule; raised when it is built."""


class Deny(Exception):
    """Raised by a body to leave a transaction without effect."""


class Block:
    """What a body sees: its reads give what it has written so far."""

    def __init__(self, state: dict, allowed: frozenset[str], feeds: frozenset[str], writable: bool = True):
        self._state, self._allowed, self._feeds, self._writable = state, allowed, feeds, writable
        self.writes: dict = {}
        self.replies: dict = {}

    def __getitem__(self, name: str):
        self._check(name)
        return self.writes.get(name, self._state[name])

    def __setitem__(self, name: str, value) -> None:
        self._check(name)
        if not self._writable:
            raise TransactionError("a write in a read-only block")
        self.writes[name] = value

    def reply(self, feed: str, value) -> None:
        if feed not in self._feeds:
            raise TransactionError(f"no feed {feed!r}")
        self.replies[feed] = value

    def deny(self) -> None:
        raise Deny

    def _check(self, name: str) -> None:
        if name not in self._allowed:
            raise TransactionError(f"{name!r} is not in this block's footprint {sorted(self._allowed)}")


@dataclass
class Writer:
    rows: DataFrame
    order: str
    touches: frozenset[str]
    body: Callable
    read_only: bool
    position: str | None


class Transactions:
    """``Transactions({"pool": ("long", 100)})``; feeds: name to type.  ``by`` names a key column that every writer has.

    An initial value may be a DataFrame: one row with the variable's column or, with ``by``, a row for each
    key (a key without one starts from null).  So a later phase is seeded from what an earlier one ended with.
    """

    def __init__(self, variables: dict[str, tuple[str, object]], feeds: dict[str, str] | None = None, by: str | None = None):
        if not variables:
            raise TransactionError("a store needs a variable")
        self.kinds = {k: T._parse_datatype_string(v[0]) for k, v in variables.items()}
        self.init = {k: v[1] for k, v in variables.items()}
        for name, seed in self.seeds().items():
            if needed := {name, *([by] if by else [])} - set(seed.columns):
                raise TransactionError(f"the seed of {name!r} lacks {sorted(needed)}")
        self.feeds = {k: T._parse_datatype_string(v) for k, v in (feeds or {}).items()}
        if clash := set(self.kinds) & set(self.feeds):
            raise TransactionError(f"{sorted(clash)} are both variables and feeds")
        self.by, self.writers, self.awaited = by, [], set()

    def seeds(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.init.items() if isinstance(v, DataFrame)}

    def writer(self, rows: DataFrame, order: str, touches: list[str], body: Callable[[Block, dict], None], read_only: bool = False, position: str | None = None) -> Transactions:
        """A loop whose every row runs ``body(block, row)`` as one transaction over the variables it touches.

        ``order`` is the arrival; ``position`` orders the rows that arrive at once.
        """
        if unknown := set(touches) - set(self.kinds):
            raise TransactionError(f"unknown variables {sorted(unknown)}")
        if not touches:
            raise TransactionError("a block must touch a variable")
        if gone := set(touches) & self.awaited:
            raise TransactionError(f"{sorted(gone)} were awaited and cannot be touched again")
        if missing := {order, *filter(None, (self.by, position))} - set(rows.columns):
            raise TransactionError(f"rows need {sorted(missing)}")
        self.writers.append(Writer(rows, order, frozenset(touches), body, read_only, position))
        return self

    def stores(self) -> list[frozenset[str]]:
        """Variables that blocks relate, together."""
        parent = {k: k for k in self.kinds}

        def root(x: str) -> str:
            while parent[x] != x:
                x = parent[x]
            return x

        for w in self.writers:
            first, *others = sorted(w.touches)
            for x in others:
                parent[root(x)] = root(first)
        found: dict[str, set[str]] = {}
        for k in self.kinds:
            found.setdefault(root(k), set()).add(k)
        return [frozenset(v) for _, v in sorted(found.items())]

    def log(self) -> DataFrame:
        """One row for each commit: key, store, tick, arrival, writer; all variables of the store as they are then; the replies and whether each was made."""
        if not self.writers:
            raise TransactionError("no writer")
        stores = self.stores()
        home = {k: n for n, s in enumerate(stores) for k in s}
        dealt = None
        for number, w in enumerate(self.writers):
            own = w.rows.select(F.lit(home[min(w.touches)]).alias("_store"), (F.col(self.by) if self.by else F.lit(0)).alias("_key"), F.col(w.order).cast("long").alias("_arrival"), F.lit(number).alias("_writer"), self._position(w).alias("_position"), F.struct(*w.rows.columns).alias(f"_row{number}"))
            dealt = own if dealt is None else dealt.unionByName(own, allowMissingColumns=True)
        key = dealt.schema["_key"].dataType
        seeds = sorted(self.seeds())
        for name in seeds:
            dealt = self._seeded(dealt, name)
        names, feeds = sorted(self.kinds), sorted(self.feeds)
        schema = T.StructType([T.StructField("key", key), T.StructField("store", T.IntegerType()), T.StructField("tick", T.LongType()), T.StructField("arrival", T.LongType()), T.StructField("writer", T.IntegerType()), *(T.StructField(k, self.kinds[k]) for k in names), *(T.StructField(k, self.feeds[k]) for k in feeds), *(T.StructField(f"has_{k}", T.BooleanType()) for k in feeds)])
        arrow, writers, init = to_arrow_schema(schema), [(w.body, w.touches, w.read_only) for w in self.writers], {k: v for k, v in self.init.items() if k not in seeds}

        def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, state, tick = None, {}, 0
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if (r["_store"], r["_key"]) != here:
                        here, tick = (r["_store"], r["_key"]), 0
                        state = {k: init[k] if k in init else r[f"_seed_{k}"] for k in stores[r["_store"]]}
                    body, touches, read_only = writers[r["_writer"]]
                    block = Block(state, touches, frozenset(feeds), not read_only)
                    try:
                        body(block, r[f"_row{r['_writer']}"])
                    except Deny:
                        continue
                    if not block.writes and not block.replies:
                        continue
                    tick += 1
                    state |= block.writes
                    rows.append((r["_key"], r["_store"], tick, r["_arrival"], r["_writer"], *(state.get(k) for k in names), *(block.replies.get(k) for k in feeds), *(k in block.replies for k in feeds)))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        return dealt.repartition("_store", "_key").sortWithinPartitions("_store", "_key", "_arrival", "_writer", "_position").transform(in_batches, replay, schema)

    def _position(self, w: Writer) -> Column:
        if w.position:
            return F.col(w.position).cast("long")
        return F.xxhash64(*(c for c in w.rows.columns if not isinstance(w.rows.schema[c].dataType, T.MapType)))

    def _seeded(self, dealt: DataFrame, name: str) -> DataFrame:
        """``dealt`` with the variable's initial value beside each row."""
        value = F.col(name).cast(self.kinds[name]).alias(f"_seed_{name}")
        if not self.by:
            return with_scalar(dealt, self.init[name].select(value), **{f"_seed_{name}": f"_seed_{name}"})
        seed = self.init[name].select(F.col(self.by).alias("_seeded"), value)
        return dealt.join(seed, F.col("_key").eqNullSafe(F.col("_seeded")), "left").drop("_seeded")

    def committed(self) -> DataFrame:
        """The log, replayed once and written to the shared folder, for several readers."""
        return settled(self.log(), "log")

    def changes(self, variable: str, log: DataFrame | None = None) -> DataFrame:
        """tick, arrival and value of the variable after each commit of its store."""
        log = self.log() if log is None else log
        return log.filter(F.col("store") == self._home(variable)).select("key", "tick", "arrival", F.col(variable).alias("value"))

    def replies(self, feed: str, log: DataFrame | None = None) -> DataFrame:
        """key, tick, arrival, writer and value of the replies made, in one feed."""
        if feed not in self.feeds:
            raise TransactionError(f"no feed {feed!r}")
        log = self.log() if log is None else log
        return log.filter(f"has_{feed}").select("key", "tick", "arrival", "writer", F.col(feed).alias("value"))

    def await_final(self, variable: str, log: DataFrame | None = None) -> DataFrame:
        """The last committed value, or the initial one; afterwards no block may touch the variable.

        With ``by``, one row for each key that a writer of the variable's store has.
        """
        if variable in self.awaited:
            raise TransactionError(f"{variable!r} was awaited already")
        changes = self.changes(variable, log)
        self.awaited.add(variable)
        # A struct, for a committed null is not a missing commit.
        last = changes.groupBy("key").agg(F.max_by(F.struct("value"), "tick").alias("_last"))
        if not self.by:
            one = last.agg(F.max("_last").alias("_last"))
            if variable in self.seeds():
                one = with_scalar(one, self.init[variable], _first=variable)
            initial = F.col("_first") if variable in self.seeds() else F.lit(self.init[variable])
            return one.select(F.when(F.col("_last").isNotNull(), F.col("_last.value")).otherwise(initial.cast(self.kinds[variable])).alias(variable))
        home = self._home(variable)
        own = [w.rows.select(F.col(self.by).alias("_key")) for w in self.writers if self._home(min(w.touches)) == home]
        keys = reduce(lambda a, b: a.unionByName(b), own).distinct() if own else changes.select(F.col("key").alias("_key"))
        if variable in self.seeds():
            keys, initial = self._seeded(keys, variable), F.col(f"_seed_{variable}")
        else:
            initial = F.lit(self.init[variable]).cast(self.kinds[variable])
        found = keys.join(last, F.col("_key").eqNullSafe(F.col("key")), "left")
        return found.select(F.col("_key").alias(self.by), F.when(F.col("_last").isNotNull(), F.col("_last.value")).otherwise(initial).alias(variable))

    def _home(self, variable: str) -> int:
        if variable not in self.kinds:
            raise TransactionError(f"unknown variable {variable!r}")
        return next(n for n, s in enumerate(self.stores()) if variable in s)


def serial(init: dict, proposals: list[tuple[Callable, dict]], touches: frozenset[str], feeds: frozenset[str] = frozenset()) -> tuple[dict, list[dict]]:
    """A plain replay on the driver, for tests: final state, and the replies of each commit."""
    state, said = dict(init), []
    for body, row in proposals:
        block = Block(state, touches, feeds)
        try:
            body(block, row)
        except Deny:
            continue
        if block.writes or block.replies:
            state |= block.writes
            said.append(block.replies)
    return state, said
