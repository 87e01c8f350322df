"""Array expressions: window means, tails, products (inventory 2.6, 2.7 and 2.11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def best_window_mean(a: Column, w: int) -> Column:
    """The largest mean of w neighbours, by a running sum; at most w values: their mean."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        out = F.when(acc["i"] >= w, F.get(a, acc["i"] - w)).otherwise(0.0)
        s = acc["s"] + x - out
        best = F.when(acc["i"] + 1 >= w, F.greatest(acc["best"], s / w)).otherwise(acc["best"])
        return F.struct(s.alias("s"), best.alias("best"), (acc["i"] + 1).alias("i"))

    return F.when(F.size(a) <= w, mean(a)).otherwise(F.aggregate(a, zero, step, lambda acc: acc["best"]))


def tail_mean(a: Column, percent: int, top: bool = False) -> Column:
    """T4/T5: mean of the lowest (highest) max(1, ceil(n * percent / 100)) values."""
    k = F.greatest(F.lit(1), F.ceil(F.size(a) * percent / 100.0)).cast("int")
    ordered = F.array_sort(a)
    return mean(F.slice(ordered, F.size(a) - k + 1, k) if top else F.slice(ordered, F.lit(1), k))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def interpolated(a: Column, points: int) -> Column:
    """Values at `points` even places from the first element to the last, linear between elements."""
    last = F.size(a) - 1

    def value(i: Column) -> Column:
        at = i * last / float(points - 1)
        k = F.floor(at).cast("int")
        x, y = F.get(a, k), F.get(a, F.least(k + 1, last))
        return x + (at - F.floor(at)) * (y - x)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), value)


def sorted_quantile(ordered: Column, q: float) -> Column:
    """Interpolated quantile of values in ascending order."""
    at = F.lit(q) * (F.size(ordered) - 1)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (at - F.floor(at)) * (high - low)


def slope(a: Column) -> Column:
    """Least-squares slope over depth, which runs from 0 to 1; null for less than two elements."""
    n = F.size(a)
    x = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / (n - 1).cast("double") - 0.5)
    return F.when(n > 1, dot(a, x) / dot(x, x))  # the x are centred, so the values needn't be
