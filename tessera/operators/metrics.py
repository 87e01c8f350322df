"""Evaluation metrics (inventory 2.11).

Metrics of scores work on the histogram of distinct scores of each group (a small table next to the
rows): counts are combined before the shuffle and no window runs over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranks import with_places


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r; null where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """M1/M2: rho, n and a status per group: insufficient_n below 3, constant_target, constant_prediction, ok."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.select(*group, F.col(x).alias("_vx"), F.col(y).alias("_vy"))
    for value, rank in (("_vx", "_x"), ("_vy", "_y")):  # in ranges of the values, however large a group
        d = with_places(d, value, rank, lambda mean, n: mean, *group)
    g = d.groupBy(*group).agg(
        F.count("*").alias("n"), correlation("_x", "_y").alias("_r"), (F.min("_x") == F.max("_x")).alias("_cx"), (F.min("_y") == F.max("_y")).alias("_cy")
    )
    status = F.when(F.col("n") < 3, "insufficient_n").when(F.col("_cx"), "constant_target").when(F.col("_cy"), "constant_prediction").otherwise("ok")
    return g.select(*group, "n", status.alias("status"), F.when(status == "ok", F.col("_r")).alias("rho"))


def histogram(df: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """Positives and negatives of each distinct score, with what stands at it or above in its group.

    Scores are counted first and summed up in ranges (see ranks.running), so continuous scores of a large
    group are no one task's work either.
    """
    from tessera.operators.ranks import running

    h = df.groupBy(*group, F.col(score).alias("score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    r = running(h, "score", ["pos", "neg"], *group)
    above = lambda c: F.col(f"all_{c}") - F.col(f"below_{c}")
    return r.select(*group, "score", "pos", "neg", above("pos").alias("tp"), above("neg").alias("fp"), F.col("all_pos").alias("P"), F.col("all_neg").alias("N"))


def auc(df: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """M8: area under the ROC curve, ties half; null with one class only."""
    h = histogram(df, score, label, *group)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    return h.groupBy(*group).agg((area / F.nullif(F.max("P") * F.max("N"), F.lit(0))).alias("auc"), F.max("P").alias("positives"), F.max("N").alias("negatives"))


def roc(df: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """Points (fpr, tpr) of the curve by falling score, each with the point before it, from (0, 0)."""
    h = histogram(df, score, label, *group)
    return h.select(
        *group,
        "score",
        (F.col("tp") / F.nullif(F.col("P"), F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif(F.col("N"), F.lit(0))).alias("fpr"),
        ((F.col("tp") - F.col("pos")) / F.nullif(F.col("P"), F.lit(0))).alias("tpr0"),
        ((F.col("fp") - F.col("neg")) / F.nullif(F.col("N"), F.lit(0))).alias("fpr0"),
    )


def partial_auc(df: DataFrame, score: str, label: str, most: float, *group: str) -> DataFrame:
    """M9: area up to a false-positive rate, the last segment interpolated, on McClish's scale."""
    r = roc(df, score, label, *group).where(F.col("fpr0") < most)
    end = F.least(F.col("fpr"), F.lit(most))
    slope = F.when(F.col("fpr") > F.col("fpr0"), (F.col("tpr") - F.col("tpr0")) / F.nullif(F.col("fpr") - F.col("fpr0"), F.lit(0.0))).otherwise(0.0)
    height = F.col("tpr0") + slope * (end - F.col("fpr0"))
    area = F.sum((end - F.col("fpr0")) * (F.col("tpr0") + height) / 2)
    low, high = most * most / 2, most
    return r.groupBy(*group).agg((0.5 * (1 + (area - low) / (high - low))).alias("partial_auc"))


def tpr_at(df: DataFrame, score: str, label: str, rate: float, *group: str) -> DataFrame:
    """The highest true-positive rate with a false-positive rate of at most `rate`."""
    r = roc(df, score, label, *group)
    return r.groupBy(*group).agg(F.coalesce(F.max(F.when(F.col("fpr") <= rate, F.col("tpr"))), F.lit(0.0)).alias("tpr"))


def tie_block_boundary(df: DataFrame, score: str, label: str, rate: float, *group: str) -> DataFrame:
    """Whole tie blocks from the top as long as they fit floor(rate * N + 1e-12) negatives.

    cutoff is the first block that doesn't fit (minus infinity if all do); true positives score above it.
    """
    h = histogram(df, score, label, *group).where(F.col("neg") > 0)
    allowed = F.floor(F.col("N") * rate + 1e-12)
    g = h.groupBy(*group).agg(
        F.max(allowed).alias("allowed"), F.coalesce(F.max(F.when(F.col("fp") > allowed, F.col("score"))), F.lit(float("-inf"))).alias("cutoff")
    )
    return detections(df, g, score, label, *group)


def order_statistic_threshold(df: DataFrame, score: str, label: str, rate: float, *group: str) -> DataFrame:
    """The max(1, floor(rate * N))-th largest negative; strictly higher scores are detections."""
    h = histogram(df, score, label, *group).where(F.col("neg") > 0)
    allowed = F.greatest(F.lit(1), F.floor(F.col("N") * rate))
    g = h.groupBy(*group).agg(F.max(allowed).alias("allowed"), F.max(F.when(F.col("fp") >= allowed, F.col("score"))).alias("cutoff"))
    return detections(df, g, score, label, *group)


def detections(df: DataFrame, cutoffs: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """Counts of positives and negatives above each group's cutoff."""
    if not group:
        df, cutoffs = df.withColumn("_g", F.lit(1)), cutoffs.withColumn("_g", F.lit(1))
    keys = list(group) or ["_g"]
    above = F.col(score) > F.col("cutoff")
    out = df.join(cutoffs, keys).groupBy(*keys, "allowed", "cutoff").agg(
        F.sum((above & (F.col(label) == 1)).cast("int")).alias("tp"), F.sum((above & (F.col(label) == 0)).cast("int")).alias("fp")
    )
    return out.select(*group, "allowed", "cutoff", "tp", "fp")


def interpolated_tpr(df: DataFrame, score: str, label: str, rate: float, *group: str) -> DataFrame:
    """The highest TPR of each FPR, linear between FPRs."""
    top = roc(df, score, label, *group).groupBy(*group, "fpr").agg(F.max("tpr").alias("tpr"))
    w = W.partitionBy(*group).orderBy("fpr")
    r = top.withColumn("nf", F.lead("fpr").over(w)).withColumn("nt", F.lead("tpr").over(w)).withColumn("pf", F.lag("fpr").over(w))
    here = F.when((F.col("fpr") <= rate) & (F.col("nf").isNull() | (F.col("nf") > rate)), F.when(F.col("nf").isNull(), F.col("tpr")).otherwise(
        F.col("tpr") + (F.col("nt") - F.col("tpr")) * (F.lit(rate) - F.col("fpr")) / (F.col("nf") - F.col("fpr"))))
    first = F.when(F.col("pf").isNull() & (F.col("fpr") > rate), F.col("tpr") * rate / F.col("fpr"))
    return r.groupBy(*group).agg(F.max(F.coalesce(here, first)).alias("tpr"))


def rmse(a: Column, b: Column) -> Column:
    """M7."""
    return F.sqrt(F.avg((a - b) * (a - b)))


def effective_size(w: Column) -> Column:
    """(sum w)^2 / sum w^2."""
    return F.sum(w) * F.sum(w) / F.nullif(F.sum(w * w), F.lit(0.0))


def total_variation(a: DataFrame, b: DataFrame, level: str) -> DataFrame:
    """Half the sum of differences of two distributions over levels, null being one."""
    share = lambda df, name: df.groupBy(F.coalesce(F.col(level).cast("string"), F.lit("<missing>")).alias("level")).agg(F.count("*").alias("k")).select("level", (F.col("k") / F.sum("k").over(W.partitionBy())).alias(name))  # noqa: E731  # one row a level
    both = share(a, "pa").join(share(b, "pb"), "level", "full_outer")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))))).alias("distance"))


def rank_agreement(df: DataFrame, models: list[str], *group: str) -> DataFrame:
    """Group, rows, pairs, rho_min, rho_median, rho_max, and for each model but the first its movement against it.

    Every model's scores are ranked once in each group (unit ranks, ties average); then one aggregation
    holds the rank correlations of all pairs of models.  A pair with a constant model has none and isn't
    counted.  moved_<m>, shift_mean_<m>, shift_max_<m>: rows whose rank differs from the first model's, and by how much.
    """
    from itertools import combinations

    from tessera.operators import ranks as R

    r = df.select(*group, *models)
    for m in models:
        r = R.with_places(r, m, f"r_{m}", R.unit_of, *group)
    pairs = F.array(*[correlation(f"r_{a}", f"r_{b}") for a, b in combinations(models, 2)])
    shift = lambda m: F.abs(F.col(f"r_{m}") - F.col(f"r_{models[0]}"))
    moves = [
        e
        for m in models[1:]
        for e in (F.count_if(shift(m) > 1e-12).alias(f"moved_{m}"), F.avg(shift(m)).alias(f"shift_mean_{m}"), F.max(shift(m)).alias(f"shift_max_{m}"))
    ]
    g = r.groupBy(*group).agg(F.count("*").alias("rows"), F.array_sort(F.filter(pairs, lambda x: x.isNotNull())).alias("_rho"), *moves)
    n = F.size("_rho")
    at = lambda i: F.get("_rho", i.cast("int"))
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    out = [n.cast("long").alias("pairs"), at(F.lit(0)).alias("rho_min"), median.alias("rho_median"), at(n - 1).alias("rho_max")]
    return g.select(*group, "rows", *out, *[c for c in g.columns if c not in (*group, "rows", "_rho")])
