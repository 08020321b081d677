"""Refinements: a base type with a predicate that values must satisfy, and function contracts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RefinementError(TypeError):
    """A value that is known not to satisfy its refinement."""


@dataclass(frozen=True)
class Refinement:
    """``says`` names the predicate; ``holds`` works on Python values and on columns alike."""

    says: str
    holds: Callable

    def literal(self, value) -> Column:
        """A literal, checked when the query is built."""
        if not self.holds(value):
            raise RefinementError(f"{value!r} does not satisfy {self.says}")
        return F.lit(value)

    def checked(self, value: Column) -> Column:
        """``value``, checked in every row as the query runs."""
        return F.when(self.holds(value), value).otherwise(F.raise_error(F.lit(f"a value does not satisfy {self.says}")))

    def acquire(self, df: DataFrame, column: str) -> DataFrame:
        """The rows whose value satisfies the refinement; afterwards it holds by construction."""
        return df.filter(self.holds(F.col(column)))


NON_ZERO = Refinement("x != 0", lambda x: x != 0)
NON_NEGATIVE = Refinement("x >= 0", lambda x: x >= 0)
POSITIVE = Refinement("x > 0", lambda x: x > 0)


def contract(requires: dict[str, Refinement] | None = None, ensures: Callable | None = None, says: str = "its postcondition"):
    """Decorate a function over columns: refined parameters are checked (literals at once), and its result against ``ensures(result, **args)``."""
    requires = requires or {}

    def wrap(f: Callable) -> Callable:
        def call(**args):
            ready = {}
            for name, value in args.items():
                rule = requires.get(name)
                if isinstance(value, Column):
                    ready[name] = rule.checked(value) if rule else value
                else:
                    ready[name] = rule.literal(value) if rule else F.lit(value)
            result = f(**ready)
            if ensures is None:
                return result
            return F.when(ensures(result, **ready), result).otherwise(F.raise_error(F.lit(f"{f.__name__} does not satisfy {says}")))

        call.__name__ = f.__name__
        return call

    return wrap
