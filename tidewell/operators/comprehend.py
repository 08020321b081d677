"""Comprehensions: generators, guards and an element, as one declarative DataFrame plan.

``Comprehension(x=xs, y=ys).where(lambda r: r.x.k == r.y.k).select(s=lambda r: r.x.a + r.y.b)``
names each generator's rows; guards may stand anywhere and are all conjuncts.  The equalities
among them become the join's keys and the rest its residual condition; a product without a linking
guard is a cross join.  Which join runs, in what order, is Catalyst's choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Row:
    """Columns of a generator's row by name: ``r.x.field``."""

    def __init__(self, alias: str, columns: list[str]):
        self._alias, self._columns = alias, columns

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._columns:
            raise AttributeError(f"{self._alias} has no field {name!r}; it has {self._columns}")
        return F.col(f"`{self._alias}`.`{name}`")


class Rows:
    def __init__(self, rows: dict[str, Row]):
        self.__dict__.update(rows)


class Comprehension:
    def __init__(self, **generators: DataFrame):
        if not generators:
            raise ValueError("a comprehension needs a generator")
        self.generators = generators
        self.guards: list[Callable] = []

    def where(self, *guards: Callable) -> Comprehension:
        """With more guards; each takes the rows by name and returns a Boolean column."""
        out = Comprehension(**self.generators)
        out.guards = [*self.guards, *guards]
        return out

    def _joined(self) -> tuple[DataFrame, Rows]:
        rows = Rows({k: Row(k, v.columns) for k, v in self.generators.items()})
        frames = [v.alias(k) for k, v in self.generators.items()]
        out = frames[0]
        for more in frames[1:]:
            out = out.crossJoin(more)
        # Filters over the product: Catalyst turns those that link two sides into join conditions,
        # pushes one-sided ones into the scans, and joins in the order that the equalities give.
        for guard in self.guards:
            out = out.filter(guard(rows))
        return out, rows

    def select(self, *whole: str, **elements: Callable) -> DataFrame:
        """The element: computed columns by name, and whole generators' columns by the generator's name."""
        out, rows = self._joined()
        columns = [F.col(f"`{name}`.`{c}`") for name in whole for c in self.generators[name].columns]
        return out.select(*columns, *(_column(f(rows)).alias(k) for k, f in elements.items()))

    def flat(self, **elements: Callable) -> DataFrame:
        """Several elements for each row: arrays, whose items become rows; null arrays give none."""
        out, rows = self._joined()
        (name, f), *others = elements.items()
        return out.select(F.explode(f(rows)).alias(name), *(_column(g(rows)).alias(k) for k, g in others))


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def generator(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Generator functions, composed from left to right."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
