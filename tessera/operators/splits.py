"""Stratified splits whose strata may hold any share of the rows (inventory G8 and G9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import h60
from tessera.operators.joins import small
from tessera.operators.positions import numbered

GREEDY = 10_000  # kinds of groups whose leftovers are placed one by one


def nested_split(df: DataFrame, strata: list[str], key: str, fold: str, folds: int, seed: str) -> DataFrame:
    """df's rows once for each outer fold that they are not held by, with outer and role.

    Of an outer fold's fitting rows each stratum gives in hash order a fifth to `select`, the next fifth to
    `early` and the rest to `train`; the fold's own rows are `hold`.
    """
    d = df.withColumn("outer", F.explode(F.array(*[F.lit(i) for i in range(folds)])))
    fit = d.where(F.col("outer") != F.col(fold))
    fit = numbered(fit, [h60(seed, F.col("outer"), F.col(key)), key], "outer", *strata, out="_place")
    size = fit.groupBy("outer", *strata).agg(F.count("*").alias("_n"))
    names = {c: f"_{c}_" for c in ("outer", *strata)}
    size = size.select("_n", *[F.col(c).alias(n) for c, n in names.items()])
    on = F.lit(True)
    for c, n in names.items():
        on &= F.col(c).eqNullSafe(F.col(n))
    place = F.col("_place") * 5
    role = F.when(place < F.col("_n"), "select").when(place < 2 * F.col("_n"), "early").otherwise("train")
    fit = fit.join(small(size), on).withColumn("role", role).drop("_n", "_place", *names.values())
    return fit.unionByName(d.where(F.col("outer") == F.col(fold)).withColumn("role", F.lit("hold")))


def place_greedily(kinds: list[np.ndarray], folds: int, start: np.ndarray, total: np.ndarray) -> list[int]:
    """Folds for vectors of counts, in the given order: each where the strata's shares then differ least over folds.

    start: counts [folds, strata] so far; ties go to the fold with fewest rows, then to the first.
    """
    now, out = start.astype(float).copy(), []
    for v in kinds:
        tried = np.repeat(now[None], folds, axis=0)
        tried[np.arange(folds), np.arange(folds)] += v
        spread = (tried / total).std(axis=1).mean(axis=1).round(12)
        best = min(range(folds), key=lambda f: (spread[f], now[f].sum(), f))
        now[best] += v
        out.append(best)
    return out


def stratified_group_folds(df: DataFrame, group: str, strata: list[str], folds: int, seed: str, most: int = GREEDY) -> DataFrame:
    """Group, rows, fold: whole groups in folds, so that every stratum's share is alike in all of them.

    Groups with equal counts of all strata are one kind, and a kind is dealt by its hash order, as many
    to each fold as go without a rest; nearly all groups are of a few kinds.  What is left of a kind
    (less than `folds` groups) is placed one by one, the most uneven first, where the strata's shares then
    differ least.  Kinds beyond the `most` most uneven ones are dealt in turn.
    """
    stratum = F.concat_ws("\x1f", *[F.coalesce(F.col(s).cast("string"), F.lit("\x1e")) for s in strata])
    cell = df.groupBy(F.col(group).alias("_g"), stratum.alias("_s")).agg(F.count("*").alias("_n"))
    g = cell.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_s", "_n"))).alias("v"), F.sum("_n").alias("rows"))
    g = numbered(g.withColumn("kind", F.to_json("v")), ["kind", h60(seed, F.col("_g")), "_g"], "kind", out="place")
    kinds = g.groupBy("kind").agg(F.count("*").alias("m"), F.first("v").alias("v"))
    uneven = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["_n"] * x["_n"])
    kinds = numbered(kinds.withColumn("uneven", uneven), [-F.col("uneven"), "kind"], out="order")
    kinds = kinds.withColumn("rest", (F.col("m") % folds).cast("int"))

    # `most` kinds at most, and one row for each stratum
    totals = {r["_s"]: r["n"] for r in cell.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}
    name = {s: i for i, s in enumerate(sorted(totals))}
    head = kinds.where((F.col("order") < most) & (F.col("rest") > 0)).orderBy("order").select("kind", "v", "rest").collect()
    vectors, owners = [], []
    for r in head:
        v = np.zeros(len(name))
        for x in r["v"]:
            v[name[x["_s"]]] = x["_n"]
        vectors += [v] * r["rest"]
        owners += [(r["kind"], j) for j in range(r["rest"])]
    total = np.array([totals[s] for s in sorted(totals)], dtype=float)
    dealt = place_greedily(vectors, folds, np.zeros((folds, len(name))), total) if vectors else []
    placed = pd.DataFrame([(k, j, f) for (k, j), f in zip(owners, dealt, strict=True)], columns=["_kind", "_j", "_fold"])
    placed = df.sparkSession.createDataFrame(placed, "_kind string, _j long, _fold int")
    k = kinds.select(F.col("kind").alias("_k"), "m", "rest", "order")
    g = g.join(small(k), F.col("kind") == F.col("_k")).withColumn("j", F.col("place") - (F.col("m") - F.col("rest")))
    g = g.join(small(placed), (F.col("kind") == F.col("_kind")) & (F.col("j") == F.col("_j")), "left")
    turn = F.when(F.col("j") < 0, F.pmod(F.col("place"), F.lit(folds))).otherwise(F.pmod(F.col("order") + F.col("j"), F.lit(folds)))
    return g.select(F.col("_g").alias(group), "rows", F.coalesce(F.col("_fold"), turn.cast("int")).alias("fold"))
