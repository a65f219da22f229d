"""Binary search in a fixed sorted table, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_table(values: Sequence[float] | Sequence[int], kind: str = "double") -> Column:
    """An array of fixed numbers. It is spelt as one text, which the optimizer turns into one literal, however many numbers there are."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def prefix_length(n: int, holds: Callable[[Column], Column]) -> Column:
    """How many of the places 0 to n - 1 pass ``holds``, which must hold for a prefix of them: found by halving, in about log2(n) steps."""
    widths = [1 << b for b in reversed(range(n.bit_length()))]

    def widen(done: Column, width: Column) -> Column:
        return F.when((done + width <= n) & holds(done + width - 1), done + width).otherwise(done)

    return F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), widen)


def nearest(x: Column, values: Sequence[float], ranks: Sequence[int]) -> Column:
    """The least rank among the entries of ``values`` (ascending) that are nearest to x; null for a null x.

    Distances are compared as doubles are: entries whose rounded distances are
    equal are equally near, however many they are. Three searches give the
    place of x and both ends of the range of nearest entries.
    """
    table, rank, n = constant_table(values), constant_table(ranks, "int"), len(values)

    def error(at: Column) -> Column:
        return F.abs(x - F.get(table, at))

    place = prefix_length(n, lambda at: F.get(table, at) < x)
    found = F.struct(place.alias("place"), F.least(error(place - 1), error(place)).alias("least"))

    def ends(s: Column) -> Column:
        first = prefix_length(n, lambda at: (at < s["place"]) & (error(at) > s["least"]))
        end = prefix_length(n, lambda at: (at < s["place"]) | (error(at) <= s["least"]))
        return F.array_min(F.slice(rank, first + 1, end - first))

    # an array of one, so that what the first search finds is worked out once
    return F.when(x.isNotNull(), F.get(F.transform(F.array(found), ends), 0))
