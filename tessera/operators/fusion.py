"""Fusion, calibration and closed-form fits (inventory 2.16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import sigmoid


def rank_fusion(*parts: tuple[Column, float]) -> Column:
    """Weighted mean of ranks."""
    total = sum(w for _, w in parts)
    out = F.lit(0.0)
    for c, w in parts:
        out = out + c * w
    return out / total


def with_fallback(base: Column, view: Column, weight: float) -> Column:
    """The blend of two scores, or the base where the view is missing."""
    return F.coalesce((1 - weight) * base + weight * view, base)


def frozen_logistic(features: list[tuple[Column, float, float, float]], bias: float, most: float = 50.0) -> Column:
    """Sigmoid of the clipped sum of standardised features (column, mean, scale, weight)."""
    z = F.lit(bias)
    for c, mean, scale, w in features:
        z = z + (c - mean) / scale * w
    return sigmoid(F.greatest(F.lit(-most), F.least(F.lit(most), z)))


def weighted_line(df: DataFrame, x: str, y: str, w: str | None, least: float, *group: str, positive_intercept: bool = False) -> DataFrame:
    """E5: weighted least squares y = a + b x with b >= least (and a >= 0): columns a, b.

    With two parameters the constrained optimum is the free one, or lies on one of the two borders, or
    in their corner; the feasible candidate with the least error is taken.  All come from six sums.
    """
    weight = F.col(w) if w else F.lit(1.0)
    X, Y = F.col(x), F.col(y)
    s = df.groupBy(*group).agg(
        F.sum(weight).alias("_n"), F.sum(weight * X).alias("_x"), F.sum(weight * Y).alias("_y"),
        F.sum(weight * X * X).alias("_xx"), F.sum(weight * X * Y).alias("_xy"), F.sum(weight * Y * Y).alias("_yy"),
    )
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("_n", "_x", "_y", "_xx", "_xy", "_yy"))
    det = n * sxx - sx * sx
    free_b = F.when(F.abs(det) > 1e-12, (n * sxy - sx * sy) / det)
    low = F.lit(float(least))
    zero = F.lit(0.0)

    def candidate(a: Column, b: Column) -> Column:
        error = syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx
        ok = (b >= low - 1e-12) & ((a >= -1e-12) if positive_intercept else F.lit(True))
        return F.when(ok, F.struct(error.alias("e"), a.alias("a"), b.alias("b")))

    options = [candidate((sy - free_b * sx) / n, free_b), candidate((sy - low * sx) / n, low)]
    if positive_intercept:
        options += [candidate(zero, sxy / F.nullif(sxx, zero)), candidate(zero, low)]
    best = F.array_min(F.array_compact(F.array(*options)))
    return s.withColumn("_best", best).select(*group, F.col("_best.a").alias("a"), F.col("_best.b").alias("b"))


def through_origin(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """c = max(0, sum xy / sum xx)."""
    X, Y = F.col(x), F.col(y)
    c = F.greatest(F.lit(0.0), F.coalesce(F.sum(X * Y) / F.nullif(F.sum(X * X), F.lit(0.0)), F.lit(0.0)))
    return df.groupBy(*group).agg(c.alias("c"))


def residual_ridge(df: DataFrame, x: str, y: str, age: str, alpha: float, *group: str) -> DataFrame:
    """Ridge of ln(y / x) on standardised age: mean, scale, b0, b1 and a state.

    A value that is not positive, a missing or a constant age give a state and no fit; nothing is imputed.
    """
    ok = (F.col(x) > 0) & (F.col(y) > 0) & F.col(age).isNotNull()
    r = F.when(ok, F.ln(F.col(y) / F.col(x)))
    a = F.col(age).cast("double")
    s = df.groupBy(*group).agg(
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("_bad"), F.count("*").alias("_n"), F.avg(a).alias("mean"), F.stddev_pop(a).alias("scale"), F.avg(r).alias("b0"), F.covar_pop(a, r).alias("_c")
    )
    state = F.when(F.col("_bad") > 0, "data_limited_nonpositive_or_missing_age").when(F.coalesce(F.col("scale"), F.lit(0.0)) <= 0, "data_limited_constant_age").otherwise("evaluated")
    fit = state == "evaluated"
    slope = F.col("_n") * F.col("_c") / F.col("scale") / (F.col("_n") + alpha)
    return s.select(*group, state.alias("state"), *[F.when(fit, c).alias(k) for k, c in (("mean", F.col("mean")), ("scale", F.col("scale")), ("b0", F.col("b0")), ("b1", slope))])
