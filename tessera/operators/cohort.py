"""Sampling, splits and weights (inventory 2.12).  All orders come from h60, so reruns agree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.hashing import h60
from tessera.operators.contracts import require
from tessera.operators.joins import small


def fixed_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """G1: the first n of each stratum in hash order.  Tasks keep n rows each before the shuffle."""
    order = W.partitionBy(*strata).orderBy(h60(seed, F.col(key)), key)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def allocation(capacity: DataFrame, strata: list[str], n: int) -> DataFrame:
    """N shared over strata in proportion to capacity: the floor, and one more for the largest remainders.

    A share never exceeds its capacity, and at least as many strata have a remainder as units are
    left, so one round settles it.  The windows run over one row per stratum.
    """
    every = W.partitionBy()
    share = F.lit(n) * F.col("capacity") / F.sum("capacity").over(every)
    a = capacity.where("capacity > 0").withColumn("share", share).withColumn("base", F.floor("share"))
    order = W.orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), *strata)
    left = F.lit(n) - F.sum("base").over(every)
    a = a.withColumn("extra", (F.row_number().over(order) <= left).cast("long"))
    return a.select(*strata, "capacity", (F.col("base") + F.col("extra")).alias("allocated"))


def take_allocated(df: DataFrame, alloc: DataFrame, strata: list[str], order: list[Column]) -> DataFrame:
    """The first `allocated` rows of each stratum."""
    place = F.row_number().over(W.partitionBy(*strata).orderBy(*order))
    return df.withColumn("place", place).join(alloc.select(*strata, "allocated"), strata).where(F.col("place") <= F.col("allocated")).drop("allocated")


def hash_fold(key: Column, k: int, seed: str) -> Column:
    """G7."""
    return F.pmod(h60(seed, key), F.lit(k)).cast("int")


def stratified_fold(strata: list[str], key: str, k: int, seed: str) -> Column:
    """Dealt in hash order inside each stratum, so folds differ by one row at most in each."""
    return F.pmod(F.row_number().over(W.partitionBy(*strata).orderBy(h60(seed, F.col(key)), key)) - 1, F.lit(k)).cast("int")


def balanced_folds(sizes: DataFrame, group: str, size: str, k: int) -> DataFrame:
    """Groups, largest first, into the fold that is smallest so far; ties: the first fold, the first name.

    Sequential by definition, so it runs on the table of group sizes: one row per group.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, group], ascending=[False, True])
        total, fold = [0] * k, []
        for n in pdf[size]:
            fold.append(total.index(min(total)))
            total[fold[-1]] += int(n)
        return pdf.assign(fold=fold)[[group, size, "fold"]]

    schema = f"{group} {dict(sizes.dtypes)[group]}, {size} bigint, fold int"
    return sizes.select(group, F.col(size).cast("bigint").alias(size)).groupBy(F.lit("all")).applyInPandas(deal, schema)


def greedy_assignment(counts: DataFrame, cluster: str, stratum: str, n: str, share: float, seed: str) -> DataFrame:
    """Clusters in hash order go to class 1 if that brings the touched strata nearer to their target.

    A stratum's target is `share` of its rows; equal costs: the parity of another hash.  Sequential
    by definition, so it runs on the cluster-by-stratum counts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        target = (pdf.groupby("stratum")["n"].sum() * share).to_dict()
        now = dict.fromkeys(target, 0)
        out = []
        for (_, name, odd), rows in pdf.groupby(["order", "cluster", "odd"], sort=True):
            cells = list(zip(rows["stratum"], rows["n"], strict=True))
            inside = sum(abs(now[s] + k - target[s]) for s, k in cells)
            outside = sum(abs(now[s] - target[s]) for s, _ in cells)
            one = int(inside < outside or (inside == outside and not odd))
            for s, k in cells:
                now[s] += one * k
            out.append((name, one))
        return pd.DataFrame(out, columns=["cluster", "assigned"])

    c = F.col(cluster).cast("string")
    t = counts.select(c.alias("cluster"), F.col(stratum).cast("string").alias("stratum"), F.col(n).cast("long").alias("n"))
    t = t.withColumn("order", h60(seed, F.col("cluster"))).withColumn("odd", h60(seed, "tie", F.col("cluster")) % 2)
    return t.groupBy(F.lit("all")).applyInPandas(run, "cluster string, assigned int")


def purged_leave_one_out(df: DataFrame, group: str, subject: str) -> DataFrame:
    """For each held group the rows that validate, that train, and that are purged.

    A row of another group is purged if its subject has a row in the held group.  Counts per (subject,
    group) are made first; a subject meets the few groups it occurs in, not every group.
    """
    c = df.groupBy(subject, group).agg(F.count("*").alias("n"))
    held = c.select(subject, F.col(group).alias("held"), F.col("n").alias("mine"))
    whole = c.groupBy(subject).agg(F.sum("n").alias("all"))
    total = df.agg(F.count("*").alias("n")).scalar()
    per = held.join(whole, subject).groupBy("held").agg(
        F.sum("mine").alias("validation"), F.sum(F.col("all") - F.col("mine")).alias("purged"), F.count_if(F.col("all") > F.col("mine")).alias("purged_subjects")
    )
    return per.select("held", "validation", (total - F.col("validation") - F.col("purged")).alias("train"), "purged", "purged_subjects")


def hierarchical_weights(df: DataFrame, levels: list[str]) -> DataFrame:
    """Equal mass for each value of the first level, inside it for each of the second, and so on; mean 1."""
    out, mass = df, F.lit(1.0)
    for i, level in enumerate(levels):
        above = levels[:i]
        kinds = df.select(*levels[: i + 1]).distinct().groupBy(*above).agg(F.count("*").alias(f"_k{i}"))
        out = out.join(small(kinds), above) if above else out.withColumn("_k0", kinds.select("_k0").scalar())
        mass = mass / F.col(f"_k{i}")
    rows = df.groupBy(*levels).agg(F.count("*").alias("_rows"))
    n = df.agg(F.count("*").alias("n")).scalar()
    out = out.join(small(rows), levels).withColumn("weight", mass / F.col("_rows") * n)  # the masses sum to 1
    return out.select(*df.columns, "weight")


def equal_weights(df: DataFrame, group: str) -> DataFrame:
    """1 / rows of the group, scaled to mean 1."""
    rows = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_rows"))
    scale = rows.agg((F.sum("_rows") / F.count("_group")).alias("s")).scalar()  # nulls are a group without a share of their own
    return df.join(small(rows), F.col(group).eqNullSafe(F.col("_group"))).withColumn("weight", scale / F.col("_rows")).drop("_group", "_rows")


def similarity_weights(distances: DataFrame, name: str, distance: str) -> DataFrame:
    """Softmax of -(d - least) / median positive d, half shrunk to uniform.  One row per source."""
    every = W.partitionBy()
    d = F.col(distance)
    scale = distances.agg(F.percentile(F.when(d > 1e-12, d), F.lit(0.5)).alias("s")).select(F.coalesce("s", F.lit(1.0)).alias("s")).scalar()
    raw = F.exp(F.greatest(F.lit(-50.0), -(d - F.min(d).over(every)) / scale))
    t = distances.withColumn("_raw", raw)
    return t.select(name, (0.5 / F.count("*").over(every) + 0.5 * F.col("_raw") / F.sum("_raw").over(every)).alias("weight"))


def bounded_mean_one(relative: dict[str, float], counts: dict[str, int], low: float, high: float) -> dict[str, float]:
    """One factor for all relative weights, then clipped, so that the row-weighted mean is 1."""
    require(set(relative) == set(counts) and all(v > 0 for v in relative.values()), "weights", "positive weights of the same names")
    total = sum(counts.values())

    def clipped(factor: float) -> dict[str, float]:
        return {k: min(high, max(low, factor * v)) for k, v in relative.items()}

    def mean(factor: float) -> float:
        return sum(v * counts[k] for k, v in clipped(factor).items()) / total

    a, b = 1e-8, 1e8
    require(mean(a) <= 1 <= mean(b), "weights", "no factor gives mean 1")
    for _ in range(200):
        m = math.sqrt(a * b)
        a, b = (m, b) if mean(m) < 1 else (a, m)
    return clipped(math.sqrt(a * b))


def shuffled_within(df: DataFrame, group: str, key: str, value: str, seed: str) -> DataFrame:
    """The values of a group dealt anew to its keys, in hash order."""
    a = df.select(group, key, F.row_number().over(W.partitionBy(group).orderBy(key)).alias("_k"))
    b = df.select(group, F.col(value).alias("shuffled"), F.row_number().over(W.partitionBy(group).orderBy(h60(seed, F.col(key)), key)).alias("_k"))
    return a.join(b, [group, "_k"]).drop("_k")


def batches(lengths: Iterator[int], budget: int) -> Iterator[int]:
    """Q9: batch numbers of ascending lengths; a batch's longest length times its size stays in the budget."""
    batch, inside = 0, 0
    for n in lengths:
        if inside and n * (inside + 1) > budget:
            batch, inside = batch + 1, 0
        inside += 1
        yield batch
