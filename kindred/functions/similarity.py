"""Set and string similarities of two columns; empty evidence gives 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def shared_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    both = shared_count(a, b)
    return ratio(both, F.size(a) + F.size(b) - both)


def dice(a: Column, b: Column) -> Column:
    return ratio(2 * shared_count(a, b), F.size(a) + F.size(b))


def length_ratio(a: Column, b: Column) -> Column:
    return ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def exact(a: Column, b: Column) -> Column:
    return (a != "") & (a == b)


def _mass(left: Column, right: Column, weight) -> Column:
    shared = F.array_sort(F.array_intersect(F.map_keys(left), F.map_keys(right)))
    return F.aggregate(shared, F.lit(0.0), lambda total, t: total + weight(t))


def weighted_overlap(left: Column, right: Column, left_total: Column, right_total: Column) -> tuple[Column, Column]:
    """Weighted Dice and containment of two token-weight maps, by the left side's weights."""
    mass = _mass(left, right, lambda t: left[t])
    return ratio(2 * mass, left_total + right_total), ratio(mass, F.least(left_total, right_total))


def rare_token_dice(left: Column, right: Column, left_total: Column, right_total: Column) -> Column:
    """Weighted Dice by the smaller of both weights, symmetric where the weights differ."""
    return ratio(2 * _mass(left, right, lambda t: F.least(left[t], right[t])), left_total + right_total)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table as the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    state = every = (1 << len(a)) - 1
    for c in b:
        hit = state & places.get(c, 0)
        state = (state + hit | state - hit) & every
    return len(a) - state.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * _common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_set(a: str, b: str) -> float:
    """The best indel ratio among shared words, and shared words followed by either side's others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return max(indel(left, right), indel(both, left), indel(both, right))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b)], dtype="float64")
