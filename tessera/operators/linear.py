"""Least squares from summed cross-products (inventory E12, E13, E16, E22 and B7).

A model's rows are read once, in one aggregation: the sums of products of all pairs of columns, by group.
Training sets are unions of groups, so every fit (a held study, a fold, a seed, a set of columns) is
arithmetic on those small matrices; rows meet their coefficients again in a join.  Columns are shifted by
their means first, so that sums of products keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ranks as R
from tessera.operators.joins import small


class Moments:
    """Cross-products of (1, columns) by group; columns are shifted by `shift`."""

    def __init__(self, columns: list[str], shift: np.ndarray, of: dict[tuple, np.ndarray]):
        self.columns, self.shift, self.of = columns, shift, of

    def total(self, keep: Callable[[tuple], bool] = lambda g: True) -> np.ndarray:
        """Sum over the groups that keep() accepts."""
        size = len(self.columns) + 1
        return sum((m for g, m in sorted(self.of.items(), key=lambda x: str(x[0])) if keep(g)), np.zeros((size, size)))

    def at(self, names: Iterable[str]) -> np.ndarray:
        """Places of columns; the first place is the constant."""
        return np.array([self.columns.index(c) + 1 for c in names], dtype=int)


def moments(df: DataFrame, columns: list[str], by: list[str], weight: str | None = None) -> Moments:
    """One aggregation over df; a row with a null in any of the columns is left out.

    The driver gets one row for each group, of (columns + 1)^2 / 2 sums: groups are studies, folds and the like.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    rows = df.where(whole)
    means = rows.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()
    shift = np.array([m or 0.0 for m in means])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(float(s)) for c, s in zip(columns, shift, strict=True)]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"_{i}_{j}") for i, j in pairs]
    of = {}
    for r in rows.groupBy(*by).agg(*sums).collect():
        m = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, r[len(by) :], strict=True):
            m[i, j] = m[j, i] = v
        of[tuple(tuple(v) if isinstance(v, list) else v for v in r[: len(by)])] = m
    return Moments(columns, shift, of)


def ridge(m: np.ndarray, x: np.ndarray, y: int, alpha: float, standardise: bool = True) -> np.ndarray:
    """Intercept and coefficients of the shifted columns at places x for the column at place y.

    Squared errors and alpha times the squared coefficients, the intercept free; with standardise the
    penalty is on coefficients of columns of deviation 1 (a constant column gets none).  alpha 0: the
    least of all solutions, as least squares gives it.
    """
    n, mean = m[0, 0], m[0, :] / m[0, 0]
    centred = m - np.outer(mean, mean) * n
    a, b = centred[np.ix_(x, x)], centred[x, y]
    scale = np.sqrt(np.maximum(np.diag(a) / n, 0)) if standardise else np.ones(len(x))
    # what is left of a constant column is the rounding of its sums
    dead = np.diag(a) <= 1e-12 * np.maximum(np.diag(m)[x], 1e-300)
    inverse = np.where(dead | (scale == 0), 0.0, 1.0 / np.where(scale == 0, 1.0, scale))
    a, b = a * np.outer(inverse, inverse), b * inverse
    beta = inverse * (np.linalg.solve(a + alpha * np.eye(len(x)), b) if alpha > 0 else np.linalg.lstsq(a, b, rcond=1e-12)[0])
    return np.concatenate([[mean[y] - mean[x] @ beta], beta])


def raw(beta: np.ndarray, shift: np.ndarray, x: np.ndarray, y: int) -> np.ndarray:
    """The same model for the columns as they are."""
    return np.concatenate([[beta[0] - beta[1:] @ shift[x - 1] + shift[y - 1]], beta[1:]])


def predicted(features: list[str], b: Column) -> Column:
    """Intercept and coefficients (an array column) applied to a row."""
    return reduce(lambda s, i: s + F.get(b, i[0] + 1) * F.col(i[1]).cast("double"), enumerate(features), F.get(b, 0))


def group_residual(df: DataFrame, y: str, features: list[str], group: str, out: str) -> DataFrame:
    """Y less its least-squares fit on the features and one indicator for each level of the group.

    Cross-products by level hold the whole normal equations; indicators are never columns.  Eliminated,
    they leave the pooled cross-products about the levels' means.  A row with a null has a null.
    """
    m = moments(df, [*features, y], [group])
    x, at = m.at(features), len(features) + 1
    size = len(features) + 2
    pooled = sum((v - np.outer(v[0], v[0]) / v[0, 0] for v in m.of.values()), np.zeros((size, size)))
    beta = np.linalg.lstsq(pooled[np.ix_(x, x)], pooled[x, at], rcond=1e-12)[0]
    level = [(g[0], float(v[0, at] / v[0, 0] + m.shift[at - 1] - (v[0, x] / v[0, 0] + m.shift[x - 1]) @ beta)) for g, v in m.of.items()]
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(level, f"_level {kind}, _intercept double")
    fit = reduce(lambda s, i: s + F.lit(float(beta[i[0]])) * F.col(i[1]), enumerate(features), F.col("_intercept"))
    return df.join(small(table), F.col(group).eqNullSafe(F.col("_level")), "left").withColumn(out, F.col(y) - fit).drop("_level", "_intercept")


def signed_studies(df: DataFrame, study: str, subject: str) -> DataFrame:
    """df with _signature: the sorted studies in which the row's subject has rows.

    Studies are combined by subject before the shuffle; a null subject is one of its own in each row.
    """
    sig = df.where(F.col(subject).isNotNull()).groupBy(F.col(subject).alias("_subject")).agg(F.array_sort(F.collect_set(study)).alias("_signature"))
    out = df.join(sig, F.col(subject) == F.col("_subject"), "left").drop("_subject")
    return out.withColumn("_signature", F.coalesce("_signature", F.array(study)))


def rank_residuals(df: DataFrame, study: str, subject: str, y: str, features: list[str], alpha: float) -> DataFrame:
    """df's rows once for each held study that they may train, with _held, base_rank, target_rank and residual.

    For a held study, each other study is held inside in turn: a base model is fitted on the rest, without
    the subjects of both, and scores that study's rows; residual is the target's unit rank there less the
    base score's.  All these fits are sums of one table of cross-products by study and by the studies of a
    row's subject.  A pair without a training row gives its rows no base.
    """
    rows = signed_studies(df, study, subject)
    m = moments(rows, [*features, y], [study, "_signature"])
    x, at = m.at(features), len(features) + 1
    studies = sorted({g[0] for g in m.of}, key=str)
    fits = []
    for held in studies:
        for inner in studies:
            if inner != held:
                train = m.total(lambda g, out=(held, inner): not set(out) & {g[0], *g[1]})
                if train[0, 0] > 0:
                    fits.append((held, inner, [float(v) for v in raw(ridge(train, x, at, alpha), m.shift, x, at)]))
    kind = df.schema[study].dataType.simpleString()
    fitted = df.sparkSession.createDataFrame(fits, f"_held {kind}, _inner {kind}, _b array<double>")
    pairs = rows.join(small(fitted), F.col(study) == F.col("_inner")).where(~F.array_contains("_signature", F.col("_held")))
    pairs = pairs.withColumn("_base", predicted(features, F.col("_b"))).drop("_b", "_inner", "_signature")
    pairs = R.with_places(pairs, "_base", "base_rank", R.unit_of, "_held", study)
    pairs = R.with_places(pairs, y, "target_rank", R.unit_of, "_held", study)
    return pairs.withColumn("residual", F.col("target_rank") - F.col("base_rank")).drop("_base")


def applied(df: DataFrame, fits: list[tuple], key: list[tuple[str, str]], features: list[str], out: str) -> DataFrame:
    """df with the prediction of the model that its key columns name; fits: (*key, coefficients); key: (column, type)."""
    schema = ", ".join(f"_{c}_ {t}" for c, t in key) + ", _b array<double>"
    table = df.sparkSession.createDataFrame([(*f[:-1], [float(v) for v in f[-1]]) for f in fits], schema)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c, _ in key])
    return df.join(small(table), on, "left").withColumn(out, predicted(features, F.col("_b"))).drop("_b", *[f"_{c}_" for c, _ in key])


def held_out_ridge(train: DataFrame, held: str, y: str, features: list[str], alpha: float, rows: DataFrame, study: str, out: str, weight: str | None = None, clip: float | None = None) -> DataFrame:
    """Rows with the prediction of the (weighted) ridge fitted on the training rows of their held study.

    train has the column `held`; a row of `rows` belongs to the held study in its column `study`.
    """
    m = moments(train, [*features, y], [held], weight)
    x, at = m.at(features), len(features) + 1
    fits = [(g[0], raw(ridge(v, x, at, alpha), m.shift, x, at)) for g, v in m.of.items()]
    p = applied(rows, fits, [(study, rows.schema[study].dataType.simpleString())], features, out)
    return p if clip is None else p.withColumn(out, F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(out))))


def shared_part(parts: list[np.ndarray], x: np.ndarray, y: int, alpha: float, scale: float) -> np.ndarray:
    """Intercept and coefficients that studies share, each study deviating from them by `scale` times a shrunken part.

    parts: cross-products of each study.  Every study's own intercept and coefficients are eliminated from
    the normal equations by themselves, so the system stays as large as the shared part, however many
    studies.  Columns are standardised over all of them; the shared intercept is free.
    """
    whole = sum(parts)
    n, mean = whole[0, 0], whole[0] / whole[0, 0]
    dev = np.sqrt(np.maximum(np.diag(whole)[x] / n - mean[x] ** 2, 0))
    dead = dev <= 1e-9 * np.sqrt(np.maximum(np.diag(whole)[x] / n, 1e-300))
    inverse = np.where(dead, 0.0, 1.0 / np.where(dead, 1.0, dev))
    size = len(x) + 1
    change = np.zeros((size, size))  # (1, raw) to (1, standardised)
    change[0, 0] = 1.0
    change[1:, 0] = -mean[x] * inverse
    change[1:, 1:] = np.diag(inverse)
    at = np.concatenate([[0], x])
    a, b = alpha * np.diag([0.0, *[1.0] * len(x)]), np.zeros(size)
    for part in parts:
        m, r = change @ part[np.ix_(at, at)] @ change.T, change @ part[at, y]
        gain = np.eye(size) - scale**2 * m @ np.linalg.inv(scale**2 * m + alpha * np.eye(size))
        a, b = a + gain @ m, b + gain @ r
    return change.T @ np.linalg.solve(a, b)


def shared_and_deviations(df: DataFrame, study: str, y: str, features: list[str], alpha: float, scale: float, out: str) -> DataFrame:
    """Each row scored by what the other studies share; fits of all held studies from one aggregation."""
    m = moments(df, [*features, y], [study])
    x, at = m.at(features), len(features) + 1
    fits = []
    for (held,) in m.of:
        others = [v for g, v in sorted(m.of.items(), key=lambda i: str(i[0])) if g != (held,)]
        if others:
            fits.append((held, raw(shared_part(others, x, at, alpha, scale), m.shift, x, at)))
    return applied(df, fits, [(study, df.schema[study].dataType.simpleString())], features, out)


def repeated_cv(df: DataFrame, key: str, y: str, variants: dict[str, list[str]], seeds: int, folds: int, alpha: float, salt: str) -> DataFrame:
    """df's key and y with variant, seed, fold and score: every row scored once in each repetition.

    A repetition deals rows into folds by another hash.  One aggregation by (seed, fold) holds all fits of
    all variants: a fold's training set is its seed's total less the fold.
    """
    from tessera.operators.cohort import hash_fold

    every = sorted({c for v in variants.values() for c in v})
    seed = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), hash_fold(F.col(key), folds, f"{salt}{s}").alias("fold")) for s in range(seeds)]))
    rows = df.select(key, y, *every, seed.alias("_s")).select(key, y, *every, "_s.seed", "_s.fold")
    m = moments(rows, [*every, y], ["seed", "fold"])
    at = len(every) + 1
    fits = []
    for name, features in variants.items():
        x = m.at(features)
        for s, f in sorted(m.of):
            train = m.total(lambda g, s=s, f=f: g[0] == s and g[1] != f)
            b = np.zeros(len(every) + 1)
            b[np.concatenate([[0], x])] = raw(ridge(train, x, at, alpha), m.shift, x, at)
            fits.append((name, s, f, b))
    scored = rows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    scored = applied(scored, fits, [("variant", "string"), ("seed", "int"), ("fold", "int")], every, "score")
    return scored.select(key, y, "variant", "seed", "fold", "score")
