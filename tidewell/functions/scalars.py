"""Scalar functions over columns; all stay in Catalyst expressions."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN = -(1 << 63)
#: What ``largest`` of no rows is, by type name.
IDENTITY = {"bigint": INT_MIN, "int": INT_MIN, "string": ""}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", _column(a), _column(b))


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient, rounded down."""
    a, b = _column(a), _column(b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), int_div(a, b) - 1).otherwise(int_div(a, b))


def nand(a: Column, b: Column) -> Column:
    return ~(a & b)


def nor(a: Column, b: Column) -> Column:
    return ~(a | b)


def xor(a: Column, b: Column) -> Column:
    return a != b


def xnor(a: Column, b: Column) -> Column:
    return a == b


def chain(first: Column, *rest) -> Column:
    """``chain(a, "<", b, "<=", c)``: the conjunction of adjacent comparisons."""
    terms, left = [], _column(first)
    for op, right in zip(rest[::2], rest[1::2], strict=True):
        right = _column(right)
        terms.append(COMPARE[op](left, right))
        left = right
    return reduce(operator.and_, terms)


def both(a: Column, b: Column) -> Column:
    """``a and b``; ``b`` is not evaluated where ``a`` is false, so it may fault there."""
    return F.when(a, b).otherwise(F.lit(False))


def either(a: Column, b: Column) -> Column:
    """``a or b``; ``b`` is not evaluated where ``a`` is true."""
    return F.when(a, F.lit(True)).otherwise(b)


def choose(condition: Column, then: Column, otherwise: Column) -> Column:
    """The branch that is not taken is not evaluated."""
    return F.when(condition, then).otherwise(otherwise)


def cases(*arms: tuple[Column, Column], otherwise: Column) -> Column:
    """``if``/``elif``/``else`` as a value: the first condition that holds picks its arm."""
    if not arms:
        raise ValueError("at least one arm")
    made = F.when(*arms[0])
    for condition, value in arms[1:]:
        made = made.when(condition, value)
    return made.otherwise(otherwise)


def at(items: Column, index) -> Column:
    """The element at a position from 0; out of range is a fault."""
    return F.element_at(items, _column(index) + 1)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
