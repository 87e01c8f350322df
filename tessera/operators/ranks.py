"""Ranks and percentiles (inventory 2.6).  The variants differ in ties, ends and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by(*group: Column | str):  # noqa: ANN201
    return W.partitionBy(*group)


def average_rank(v: Column, *group: Column | str) -> Column:
    """Mean of the places that equal values share, from 1."""
    return F.rank().over(by(*group).orderBy(v)) + (F.count("*").over(by(*group, v)) - 1) / 2.0


def size(*group: Column | str) -> Column:
    return F.count("*").over(by(*group))


def unit_rank(v: Column, *group: Column | str, direction: int = 1) -> Column:
    """(average rank - 1) / (n - 1); alone: 0.5."""
    n = size(*group)
    return F.when(n == 1, 0.5).otherwise((average_rank(v * direction, *group) - 1.0) / F.nullif(n - 1, F.lit(0)))


def pct_rank(v: Column, *group: Column | str) -> Column:
    """Average rank / n."""
    return average_rank(v, *group) / size(*group)


def mid_rank(v: Column, *group: Column | str) -> Column:
    """(average rank - 0.5) / n."""
    return (average_rank(v, *group) - 0.5) / size(*group)


def ordinal(v: Column, tie: Column, *group: Column | str) -> Column:
    """Place without ties."""
    return F.row_number().over(by(*group).orderBy(v, tie))


def known_rank(v: Column, *group: Column | str) -> Column:
    """Unit rank among the non-null values of a group; null stays null."""
    return F.when(v.isNotNull(), unit_rank(v, *group, v.isNull()))


def loo_rank(v: Column, *group: Column | str) -> Column:
    """Mid-tie share of the other rows below a value; needs three rows."""
    n, ties = size(*group), F.count("*").over(by(*group, v))
    below = F.rank().over(by(*group).orderBy(v)) - 1
    return F.when(n >= 3, (below + 0.5 * (ties - 1)) / (n - 1))


RANGE = 1_000_000  # distinct values of a group that one task sorts, on average at most


def running(hist: DataFrame, value: str, sums: list[str], *group: str, ranges: int | None = None) -> DataFrame:
    """hist with, for each of `sums`, below_<c> (its sum over the group's smaller values) and all_<c> (over the group).

    hist has one row for each distinct value of a group.  Up to RANGE of them a group is one window; a
    larger one is dealt into as many ranges of its values as keep to it, whose totals are its offsets.
    So no task holds more than about RANGE values of a group, however large it is.  ranges: instead of these.
    """
    from tessera.operators.joins import small
    from tessera.operators.text import written

    def looked_up(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """a with the other columns of b, a table with one row for each combination of keys."""
        other = b.select(*[F.col(k).alias(f"_{k}_") for k in keys], *[c for c in b.columns if c not in keys])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys], F.lit(True))
        return a.join(small(other), on).drop(*[f"_{k}_" for k in keys])

    whole = by(*group) if group else W.partitionBy(F.lit(0))
    if ranges is None:
        hist = written(hist)
        largest = hist.groupBy(*group).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
        ranges = -(-largest // RANGE)
    if ranges <= 1:
        upto = whole.orderBy(value)
        return hist.select("*", *[e for c in sums for e in ((F.sum(c).over(upto) - F.col(c)).alias(f"below_{c}"), F.sum(c).over(whole).alias(f"all_{c}"))])
    cuts = hist.groupBy(*group).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("_cuts"))
    h = looked_up(hist, cuts, group)
    h = h.withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    total = h.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])  # `ranges` rows a group
    upto = whole.orderBy("_range")
    before = [(F.sum(f"_t_{c}").over(upto) - F.col(f"_t_{c}")).alias(f"_before_{c}") for c in sums]
    total = total.select(*group, "_range", *before, *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums])
    inner = by(*group, "_range").orderBy(value)
    h = h.select("*", *[(F.sum(c).over(inner) - F.col(c)).alias(f"_inner_{c}") for c in sums])
    out = looked_up(h, total, (*group, "_range"))
    below = [(F.col(f"_inner_{c}") + F.col(f"_before_{c}")).alias(f"below_{c}") for c in sums]
    return out.select(*hist.columns, *[e for c, b in zip(sums, below, strict=True) for e in (b, F.col(f"all_{c}"))])


def places(df: DataFrame, value: str, *group: str, ranges: int | None = None) -> DataFrame:
    """group, value, below, ties, n: for each distinct value of a group, how many rows lie below it and at it.

    Rows are counted by value first, so a value that many rows share is one row; see running() for
    large groups.  Nulls have no place; null groups are groups.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("ties"))
    out = running(hist, value, ["ties"], *group, ranges=ranges)
    return out.select(*group, value, F.col("below_ties").alias("below"), "ties", F.col("all_ties").alias("n"))


def with_places(df: DataFrame, value: str, out: str, rank, *group: str, ranges: int | None = None) -> DataFrame:  # noqa: ANN001
    """df with rank(average rank from 1, n) of a value in its group as a column; null values have a null."""
    p = places(df, value, *group, ranges=ranges)
    names = {c: f"_{c}_" for c in p.columns}
    p = p.select(*[F.col(c).alias(n) for c, n in names.items()])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(names[c])) for c in group], F.col(value) == F.col(names[value]))
    mean = F.col("_below_") + (F.col("_ties_") + 1) / 2.0
    return df.join(p, on, "left").withColumn(out, rank(mean, F.col("_n_"))).drop(*names.values())


def unit_of(rank: Column, n: Column) -> Column:
    """W1 from an average rank and a size."""
    return F.when(n == 1, 0.5).otherwise((rank - 1.0) / F.nullif(n - 1, F.lit(0)))


def reference_ecdf(df: DataFrame, value: str, is_reference: str, *group: str) -> DataFrame:
    """Adds ecdf_mid and ecdf_right, shares of the reference rows below (and at) each value, and references, their number.

    Reference rows are counted by value and summed up in ranges (see running()); null values have nulls.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(F.col(is_reference).cast("int")).alias("_refs"))
    r = running(hist, value, ["_refs"], *group)
    names = {c: f"_{c}_" for c in (*group, value)}
    n = F.nullif(F.col("all__refs"), F.lit(0))
    share = lambda c: (c / n)
    r = r.select(
        *[F.col(c).alias(k) for c, k in names.items()],
        share(F.col("below__refs") + 0.5 * F.col("_refs")).alias("ecdf_mid"),
        share(F.col("below__refs") + F.col("_refs")).alias("ecdf_right"),
        F.col("all__refs").alias("references"),
    )
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(names[c])) for c in group], F.col(value) == F.col(names[value]))
    return df.join(r, on, "left").drop(*names.values())


def qcut(df: DataFrame, value: str, q: int, out: str, *group: str) -> DataFrame:
    """Quantile bucket; edges are interpolated quantiles, right-closed, equal ones dropped."""
    at = F.array(*[F.lit(i / q) for i in range(q + 1)])
    edges = F.array_distinct(F.percentile(F.col(value), at))
    if group:
        e = df.groupBy(*group).agg(edges.alias("_edges"))
        df = df.join(e, list(group))
    else:
        df = df.crossJoin(F.broadcast(df.agg(edges.alias("_edges"))))  # one row
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    return df.withColumn(out, F.size(F.filter(inner, lambda e: F.col(value) > e))).drop("_edges")


def robust_scale(df: DataFrame, value: str, out: str, *group: str) -> DataFrame:
    """(x - median) / IQR inside a group; null and a range up to 1e-12 give 0."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")
    df = df.join(df.groupBy(*group).agg(q), list(group))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    z = F.when(iqr > 1e-12, (F.col(value) - F.col("_q")[1]) / iqr).otherwise(0.0)
    return df.withColumn(out, F.coalesce(z, F.lit(0.0))).drop("_q")
