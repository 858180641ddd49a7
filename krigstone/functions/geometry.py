"""Column expressions on coordinates and on node numbers of the tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def square_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of squares in the order of the dimensions, as products, so that engines agree to the bit."""
    return reduce(lambda s, t: s + t, ((p - q) * (p - q) for p, q in zip(a, b, strict=True)))


def level_of(node: Column) -> Column:
    """floor(log2(node + 1)) in integer arithmetic: the number of binary digits less one."""
    return F.length(F.bin(node + 1)) - 1


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def left_child(node: Column, level: Column) -> Column:
    return node + _power(level)


def right_child(node: Column, level: Column) -> Column:
    return node + 2 * _power(level)


def parent(node: Column) -> Column:
    """The parent of a node; null for the root."""
    return F.when(node > 0, ancestor(node, level_of(node) - 1))


def ancestor(node: Column, level: Column) -> Column:
    """The node of that level above this node, or itself.

    The places within a level count modulo the width of each level above it.
    """
    width = _power(level)
    place = node + 1 - _power(level_of(node))
    return F.pmod(place, width) + width - 1
