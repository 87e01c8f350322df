"""Fits from summed cross-products against plain NumPy loops over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear as L


def rows_of(n=240, studies=4, seed=3):
    rng = np.random.default_rng(seed)
    study = rng.integers(0, studies, n)
    x = rng.normal(100.0, 5.0, (n, 3)) * np.array([1.0, 0.01, 30.0]) + study[:, None]
    y = x @ np.array([0.2, 5.0, -0.01]) + 3 * (study == 1) + rng.normal(0, 1, n)
    subject = rng.integers(0, n // 2, n)
    return study, subject, x, y


@pytest.fixture(scope="module")
def data():
    return rows_of()


@pytest.fixture(scope="module")
def df(spark, data):
    study, subject, x, y = data
    rows = [(i, f"s{study[i]}", int(subject[i]), *map(float, x[i]), float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id int, study string, subject int, a double, b double, c double, y double")


def plain_ridge(x, y, alpha, new, w=None, standardise=True):
    w = np.ones(len(y)) if w is None else w
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    sd = np.sqrt(np.average((x - mx) ** 2, axis=0, weights=w)) if standardise else np.ones(x.shape[1])
    z = (x - mx) / sd
    beta = np.linalg.solve((z * w[:, None]).T @ z + alpha * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - my))
    return my + (new - mx) / sd @ beta


def unit_rank(v):
    v = np.asarray(v)
    avg = np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    return np.full(1, 0.5) if len(v) == 1 else (avg - 1) / (len(v) - 1)


def test_group_residual_is_least_squares(spark, df, data):
    study, _, x, y = data
    design = np.column_stack([x[:, :2], *[(study == s).astype(float) for s in range(4)]])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = {r["id"]: r["e"] for r in L.group_residual(df, "y", ["a", "b"], "study", "e").collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-8)
    alone = L.group_residual(df.withColumn("a", F.lit(1.0)), "y", ["a"], "study", "e").collect()
    mean = {s: y[study == s].mean() for s in range(4)}
    assert all(abs(r["e"] - (y[r["id"]] - mean[study[r["id"]]])) < 1e-8 for r in alone)
    gaps = df.withColumn("a", F.when(F.col("id") != 5, F.col("a")))
    assert [r["id"] for r in L.group_residual(gaps, "y", ["a"], "study", "e").where("e is null").collect()] == [5]


def test_rank_residuals_equal_a_nested_loop(df, data):
    study, subject, x, y = data
    want = {}
    for held in range(4):
        mine = set(subject[study == held])
        train = np.array([s != held and u not in mine for s, u in zip(study, subject)])
        for inner in {s for s in range(4) if s != held}:
            rows = np.flatnonzero(train & (study == inner))
            base = train & (study != inner) & ~np.isin(subject, subject[study == inner])
            if not len(rows):
                continue
            score = plain_ridge(x[base][:, :2], y[base], 10.0, x[rows][:, :2])
            for i, v in zip(rows, unit_rank(y[rows]) - unit_rank(score)):
                want[held, i] = v
    got = {(int(r["_held"][1:]), r["id"]): r["residual"] for r in L.rank_residuals(df, "study", "subject", "y", ["a", "b"], 10.0).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_weighted_ridge_of_held_studies(df, data):
    study, _, x, y = data
    both = [df.where(F.col("study") != f"s{h}").withColumn("held", F.lit(f"s{h}")) for h in range(4)]
    train = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3]).withColumn("w", 1 + F.col("id") % 3)
    out = L.held_out_ridge(train, "held", "y", ["a", "b", "c"], 2.5, df, "study", "p", weight="w", clip=25.0).collect()
    w = 1.0 + np.arange(len(y)) % 3
    for r in out:
        t = study != int(r["study"][1:])
        want = plain_ridge(x[t], y[t], 2.5, x[[r["id"]]], w[t])[0]
        assert abs(r["p"] - np.clip(want, -25, 25)) < 1e-8


def test_shared_part_equals_dense_normal_equations(df, data):
    study, _, x, y = data
    got = {r["id"]: r["p"] for r in L.shared_and_deviations(df, "study", "y", ["a", "b", "c"], 10.0, 0.25, "p").collect()}
    for held in range(4):
        t = study != held
        mx, sd = x[t].mean(0), x[t].std(0)
        z, new = (x[t] - mx) / sd, (x[~t] - mx) / sd
        blocks = [z]
        for s in sorted(set(study[t])):
            one = (study[t] == s).astype(float)[:, None]
            blocks += [0.25 * one, 0.25 * one * z]
        wide = np.column_stack(blocks)
        mean = wide.mean(0)
        c = wide - mean
        beta = np.linalg.solve(c.T @ c + 10.0 * np.eye(c.shape[1]), c.T @ (y[t] - y[t].mean()))
        want = y[t].mean() + (np.column_stack([new, np.zeros((len(new), wide.shape[1] - 3))]) - mean) @ beta
        assert np.allclose([got[i] for i in np.flatnonzero(~t)], want, atol=1e-8)


def test_repeated_cv_equals_separate_fits(df, data):
    _, _, x, y = data
    out = L.repeated_cv(df, "id", "y", {"one": ["b"], "two": ["a", "c"]}, 3, 4, 1.0, "s").collect()
    assert len(out) == 2 * 3 * len(y)
    cols = {"one": [1], "two": [0, 2]}
    fold = {(r["seed"], r["id"]): r["fold"] for r in out}
    assert {f for f in fold.values()} == {0, 1, 2, 3} and any(fold[0, i] != fold[1, i] for i in range(len(y)))
    for r in out[::17]:
        t = np.array([fold[r["seed"], i] != r["fold"] for i in range(len(y))])
        c = cols[r["variant"]]
        assert abs(r["score"] - plain_ridge(x[t][:, c], y[t], 1.0, x[[r["id"]]][:, c])[0]) < 1e-8
