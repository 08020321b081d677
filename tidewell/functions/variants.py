"""Tagged unions: a struct of the tag and one nullable field for each arm, and exhaustive matching.

A tag without a payload (unit) has a boolean field that is true where the tag is set.  Absence is
the tag ``none``, never a bare null, so options nest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "tag"


class VariantError(ValueError):
    """A tag or a match that does not fit the variant's type."""


@dataclass(frozen=True)
class Variant:
    """The type: arm name to the payload's type, None for a unit."""

    arms: tuple[tuple[str, T.DataType | None], ...]

    @classmethod
    def of(cls, **arms: T.DataType | str | None) -> Variant:
        if TAG in arms:
            raise VariantError(f"an arm cannot be called {TAG!r}")
        return cls(tuple((k, T._parse_datatype_string(v) if isinstance(v, str) else v) for k, v in sorted(arms.items())))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(TAG, T.StringType()), *(T.StructField(k, v or T.BooleanType()) for k, v in self.arms)])

    def payload_type(self, tag: str) -> T.DataType | None:
        for k, v in self.arms:
            if k == tag:
                return v
        raise VariantError(f"unknown tag {tag!r}; the variant has {[k for k, _ in self.arms]}")

    def make(self, tag: str, payload: Column | None = None) -> Column:
        """The value ``tag(payload)``."""
        kind = self.payload_type(tag)
        if (kind is None) != (payload is None):
            raise VariantError(f"tag {tag!r} {'takes no' if kind is None else 'needs a'} payload")
        fields = []
        for k, v in self.arms:
            own = (F.lit(True) if v is None else payload.cast(v)) if k == tag else F.lit(None).cast(v or T.BooleanType())
            fields.append(own.alias(k))
        return F.struct(F.lit(tag).alias(TAG), *fields)

    def widened(self, other: Variant) -> Variant:
        """The variant with the arms of both; an arm of two types is an error."""
        mine = dict(self.arms)
        for k, v in other.arms:
            if k in mine and mine[k] != v:
                raise VariantError(f"arm {k!r} has two types")
            mine[k] = v
        return Variant(tuple(sorted(mine.items())))

    def upcast(self, value: Column, to: Variant) -> Column:
        """``value`` as the wider variant ``to``: the arms it lacks are null."""
        for k, v in self.arms:
            if to.payload_type(k) != v:
                raise VariantError(f"arm {k!r} has another type")
        mine = dict(self.arms)
        return F.struct(value[TAG].alias(TAG), *((value[k] if k in mine else F.lit(None).cast(v or T.BooleanType())).alias(k) for k, v in to.arms))

    def match(self, value: Column, default: Callable[[], Column] | None = None, **arms: Callable[..., Column]) -> Column:
        """One arm for each tag, called with its payload (units: with nothing); without ``default`` all must be there."""
        for tag in arms:
            self.payload_type(tag)
        missing = [k for k, _ in self.arms if k not in arms]
        if missing and default is None:
            raise VariantError(f"the match lacks {missing}")
        made = None
        for tag, arm in arms.items():
            result = arm() if self.payload_type(tag) is None else arm(value[tag])
            made = F.when(value[TAG] == tag, result) if made is None else made.when(value[TAG] == tag, result)
        if made is None:
            return default()
        return made.otherwise(default()) if missing else made


def option(kind: T.DataType | str) -> Variant:
    """``some(kind)`` or ``none``."""
    return Variant.of(some=kind, none=None)


def some(value: Column, kind: T.DataType | str) -> Column:
    return option(kind).make("some", value)


def none(kind: T.DataType | str) -> Column:
    return option(kind).make("none")
