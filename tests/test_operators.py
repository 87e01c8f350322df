"""Hand-computed cases, contracts that must raise, and brute force for what SQL can't express."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical as C
from tessera.operators import arrays as A
from tessera.operators import cohort as G
from tessera.operators import contracts as K
from tessera.operators import fusion as E
from tessera.operators import joins as J
from tessera.operators import metrics as M
from tessera.operators import panel as P
from tessera.operators import ranks as R
from tessera.operators import text as D
from tessera import plans  # noqa: F401  (registers the queries)
from tessera.registry import QUERIES


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "scores, allowed, cutoff, tp", [([0.9, 0.8, 0.7, 0.6, 0.95, 0.85, 0.4, 0.3], 1, 0.8, 2), ([0.9, 0.9, 0.2, 0.1, 0.95, 0.85, 0.3, 0.0], 1, 0.9, 1)]
)
def test_tie_block_boundary(spark, scores, allowed, cutoff, tp):
    df = frame(spark, list(zip(scores, [0] * 4 + [1] * 4)), "s double, y int")
    row = M.tie_block_boundary(df, "s", "y", 0.25).first()
    assert (row["allowed"], row["cutoff"], row["tp"]) == (allowed, cutoff, tp)


def test_ranks_of_ties_and_singletons(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", 7.0)], "g string, v double")
    got = sorted((r[0], r[1]) for r in df.select("v", R.unit_rank(F.col("v"), "g")).collect())
    assert got == [(1.0, 0.0), (2.0, 0.5), (2.0, 0.5), (5.0, 1.0), (7.0, 0.5)]


def test_places_in_ranges_equal_plain_ranks(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, None, float(rng.randint(0, 90))])) for _ in range(500)] + [("alone", 3.0)]
    df = frame(spark, rows, "g string, v double")
    for ranges in (1, 8):
        got = R.with_places(df, "v", "r", lambda rank, n: F.struct(rank.alias("rank"), n.alias("n"), R.unit_of(rank, n).alias("u")), "g", ranges=ranges).collect()
        assert len(got) == len(rows)
        for r in got:
            mine = [v for g, v in rows if g == r["g"] and v is not None]
            if r["v"] is None:
                assert r["r"]["rank"] is None
                continue
            want = sum(v < r["v"] for v in mine) + (sum(v == r["v"] for v in mine) + 1) / 2
            assert (r["r"]["rank"], r["r"]["n"]) == (want, len(mine))
            assert r["r"]["u"] == pytest.approx(0.5 if len(mine) == 1 else (want - 1) / (len(mine) - 1))
    assert {(r["below"], r["n"]) for r in R.places(df.where("g = 'alone'"), "v").collect()} == {(0, 1)}


def test_geometric_mean_of_values_that_are_not_positive(spark):
    rows = [("a", 2.0), ("a", 8.0), ("a", None), ("b", 3.0), ("b", 0.0), ("c", -1.0), ("d", None)]
    df = frame(spark, rows, "g string, v double")
    got = {r["g"]: (r["some"], r["every"]) for r in df.groupBy("g").agg(P.geometric_mean(F.col("v")).alias("some"), P.geometric_mean(F.col("v"), nulls=False).alias("every")).collect()}
    assert got == {"a": (pytest.approx(4.0), None), "b": (None, None), "c": (None, None), "d": (None, None)}
    with pytest.raises(K.ContractError, match="2 values"):
        P.require_positive(df, "v")
    assert P.require_positive(df.where("g = 'a'"), "v").count() == 3


def test_within_group_pairs_take_every_customer(spark, tmp_path):
    rows = [(k, k % 2, f"s{k % 3}", 400.0 * k) for k in range(1, 13)]
    frame(spark, rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in QUERIES["J9_within_group_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(a[1], a[0], b[0], a[3] - b[3]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and abs(a[3] - b[3]) > 500}


def test_pairwise_ranker_scores_every_customer(spark, tmp_path):
    rows = [(k, k % 2, f"s{k % 3}", 400.0 * k) for k in range(1, 41)] + [(41, 9, "s", 0.0)]
    frame(spark, rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["win_chance"] for r in QUERIES["E11_E20_pairwise_ranker"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 42)) and {k for k, v in got.items() if v is None} == {41}


def test_sequence_distance_takes_every_part(spark, tmp_path):
    rows = [(k, f"part {k * k}", "t") for k in range(395, 406)]
    frame(spark, rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["distance"] for r in QUERIES["D13_sequence_distance"](spark, str(tmp_path)).collect()}
    names = {k: f"{a} {b}".upper() for k, a, b in rows}
    sets = {k: {s[i : i + 3] for i in range(len(s) - 2)} for k, s in names.items()}
    assert got == {k: pytest.approx(1 - len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1])) for k in range(395, 405)}


def test_auc_equals_pair_counting(spark):
    rows = [(i % 7 * 1.0, int(i * i % 5 < 2)) for i in range(60)]
    pairs = [(a, b) for a, x in rows if x for b, y in rows if not y]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert math.isclose(M.auc(frame(spark, rows, "s double, y int"), "s", "y").first()["auc"], want)


def test_result_does_not_depend_on_row_order(spark):
    df = frame(spark, [(i, f"g{i % 3}", float(i * 7 % 11)) for i in range(50)], "doc_id long, g string, v double")
    a = sorted(map(tuple, G.fixed_sample(df, ["g"], "doc_id", 4, "x").collect()))
    b = sorted(map(tuple, G.fixed_sample(df.repartition(7).orderBy(F.desc("v")), ["g"], "doc_id", 4, "x").collect()))
    assert a == b


def test_contracts_raise(spark):
    df = frame(spark, [(1, "2"), (1, "x"), (2, None)], "k int, v string")
    for call, code in (
        (lambda: K.require_unique(df, "k"), "not_unique"),
        (lambda: K.numeric(df, "v", allow_missing=True), "not_numeric"),
        (lambda: K.numeric(df.where("v = '2' or v is null"), "v"), "missing"),
        (lambda: K.require_columns(df, ["k", "z"]), "columns_missing"),
        (lambda: K.require_columns(df, ["k"], forbidden=("v",)), "columns_forbidden"),
        (lambda: K.require_balance(df, 1, "k"), "not_balanced"),
        (lambda: K.require_same_keys(df, df.limit(1), "k"), "keys_differ"),
        (lambda: K.audit(df, rows=4), "audit"),
        (lambda: K.aggregate_only(df.schema, ("v",)), "row_level_field"),
        (lambda: K.within({"a": 0.2}, {"a": 0.1}), "tolerance"),
        (lambda: K.feature_families(["zzz_1"]), "feature_family"),
        (lambda: J.coverage_exact(df.where("k = 2"), df.where("k = 1").limit(1), ["k"]), "coverage"),
    ):
        with pytest.raises(K.ContractError) as e:
            call()
        assert e.value.code == code
    assert K.closest_feature(["w8_m", "w12_m", "w16_m"], "w", "_m", 14) == "w12_m"


def test_unknown_label_raises(spark):
    df = frame(spark, [("maybe",)], "s string")
    with pytest.raises(Exception, match="unknown label"):
        df.select(C.label(F.col("s"))).collect()


@pytest.mark.parametrize("width, most, shape", [(60, 6, None), (60, 6, (7, 1)), (60, 6, (8, 2)), (64, 6, (9, 3)), (32, 6, None), (32, 0, None), (9, 2, (4, 2))])
def test_hamming_blocks_find_every_pair_once(spark, width, most, shape):
    import random

    rng = random.Random(1)
    xs = [rng.getrandbits(width) for _ in range(40)]
    xs += [x ^ sum(1 << b for b in rng.sample(range(width), min(k, width))) for k, x in enumerate(xs[:10])]
    xs = sorted(set(xs))
    signed = [x - (1 << 64) if x >> 63 else x for x in xs]
    got = sorted(map(tuple, J.hamming_pairs(frame(spark, list(enumerate(signed)), "k int, x long"), "k", "x", most, width, shape).collect()))
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(xs) for j, b in enumerate(xs) if i < j and (a ^ b).bit_count() <= most)
    assert got == want


def test_keys_of_more_blocks_where_values_are_many():
    assert J.blocking(500, 64, 6) == (7, 1) and J.blocking(10**6, 64, 6)[1] > J.blocking(10**4, 64, 6)[1] > 1


@pytest.mark.parametrize("tile", [1, 3, 100])
def test_bucket_pairs_come_once(spark, tile):
    rows = [("hot", i) for i in range(20)] + [("b", 1), ("b", 5), ("one", 7), (None, 1), (None, 2)]
    got = sorted((r["a"]["g"], r["a"]["k"], r["b"]["k"]) for r in J.bucket_pairs(frame(spark, rows, "g string, k int"), ["g"], "k", tile).collect())
    assert got == sorted([("hot", i, j) for i in range(20) for j in range(i + 1, 20)] + [("b", 1, 5)])


def test_prefix_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    sets = [sorted(rng.sample(range(30), rng.randint(1, 9))) for _ in range(60)]
    sets += [s[:-1] + [99] for s in sets[:20]] + sets[:5]
    df = frame(spark, list(enumerate(sets)), "k int, s array<int>")
    got = {(a, b) for a, b, _ in D.prefix_pairs(df, "k", "s", 0.5).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5}
    assert got == want


def test_minhash_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = [rng.sample(range(10**6), rng.randint(5, 60)) for _ in range(80)]
    for k in range(240):
        s = list(sets[k % 80])
        for i in rng.sample(range(len(s)), rng.randint(0, max(1, len(s) // 6))):
            s[i] = rng.randrange(10**6)
        sets.append(sorted(set(s)))
    sets += sets[:30] + [[], []]
    df = frame(spark, list(enumerate(sets)), "k long, s array<long>")
    found = D.minhash_pairs(df, "k", "s", 0.6)
    share = lambda a, b: len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
    got = {(a, b): v for a, b, v in found.collect()}
    assert all(share(sets[a], sets[b]) == pytest.approx(v) and v >= 0.6 for (a, b), v in got.items() if sets[a])
    root = {r["node"]: r["group"] for r in D.groups(df, "k", found).collect()}
    want = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (share(a, b) >= 0.6 or (not a and not b))]
    joined = sum(root[i] == root[j] for i, j in want)
    assert len(want) > 300 and joined >= 0.97 * len(want)
    assert all(root[i] == root[j] for i, j in want if sorted(sets[i]) == sorted(sets[j]))


def test_simhash_bits_are_majorities(spark):
    import random

    rng = random.Random(5)
    sets = [[rng.getrandbits(63) - (1 << 62) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    got = {r["k"]: r["b"] for r in frame(spark, list(enumerate(sets)), "k int, s array<long>").select("k", D.simhash(F.col("s")).alias("b")).collect()}
    assert got == {k: sum(1 << i for i in range(63) if s and 2 * sum(x >> i & 1 for x in s) >= len(s)) for k, s in enumerate(sets)}


def test_simhash_groups_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    xs = [rng.getrandbits(62) for _ in range(50)]
    xs += [x ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 8))) for x in xs for _ in range(2)]
    df = frame(spark, list(enumerate(xs)), "k long, b long")
    got = {r["node"]: r["group"] for r in D.groups(df, "k", D.simhash_pairs(df, "k", "b", 6)).collect()}
    group = list(range(len(xs)))
    while (low := [min(group[j] for j, b in enumerate(xs) if (a ^ b).bit_count() <= 6) for a in xs]) != group:
        group = low
    assert got == dict(enumerate(group))


def test_bottom_k_groups_against_all_pairs(spark, tmp_path):
    import random

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.randint(40, 120))) for _ in range(40)]
    texts += [t.rsplit(" ", 1)[0] for t in texts[:20]] + texts[:10] + ["", ""]
    frame(spark, list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["group"] for r in QUERIES["D8_bottom_k_groups"](spark, str(tmp_path)).collect()}
    near = sum(got[40 + i] == got[i] for i in range(20))  # a lost shingle in the first band shifts all bands
    assert near >= 16 and all(got[60 + i] == got[i] for i in range(10)) and got[71] == got[70]
    assert len(set(got.values())) == 41 + 20 - near


def test_padded_batches_fill_their_budget(spark, tmp_path):
    rows = [(i, f"s{i % 3}" if i % 4 else None, "w " * (i * 37 % 900)) for i in range(400)]
    frame(spark, rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["Q9_padded_batches"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(400))
    shards = {}
    for r in out:
        shards.setdefault((r["source"], r["shard"]), []).append((r["n"], r["doc_id"], r["batch"]))
    for shard in shards.values():
        batch, inside = 0, 0
        for n, _, b in sorted(shard):
            if inside and n * (inside + 1) > 16384:
                batch, inside = batch + 1, 0
            inside += 1
            assert b == batch


def test_ridge_equals_its_normal_equations(spark):
    import numpy as np
    from tessera.operators import models as L

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 2)) * [1.0, 5.0]
    y = x @ [0.5, -0.2] + 0.1 * rng.standard_normal(60) + 2
    df = frame(spark, [(i, float(a), float(b), float(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y))], "doc_id long, a double, b double, y double, fold int")
    got = {r["doc_id"]: r["oof"] for r in L.cross_fitted(df, ["a", "b"], "y", "fold", 3, L.ridge("y", 1.0)).collect()}
    plain = {}
    for k in range(3):
        train = np.arange(60) % 3 != k
        design = np.column_stack([np.ones(train.sum()), x[train]])
        w = np.linalg.lstsq(design, y[train], rcond=None)[0]
        plain |= {i: w[0] + x[i] @ w[1:] for i in np.flatnonzero(~train)}
    got_, want = np.array([got[i] for i in range(60)]), np.array([plain[i] for i in range(60)])
    assert np.corrcoef(got_, want)[0, 1] > 0.99 and np.abs(got_ - y).mean() < np.abs(y - y.mean()).mean()


def test_sealed_tensors_raise_on_any_difference(spark, tmp_path):
    import hashlib
    import io

    import numpy as np
    from tessera.sources import readers as S

    def shard(a):
        buffer = io.BytesIO()
        np.savez(buffer, values=a)
        return buffer.getvalue()

    raw = [shard(np.ones((3, 2), np.float32)), shard(np.zeros((2, 2), np.float32)), shard(np.zeros((2, 2)))]
    for k, content in enumerate(raw):
        S.atomic_bytes(spark, f"file://{tmp_path}/{k // 2}/s{k % 2}.npz", content)
    with pytest.raises(K.ContractError, match="exists"):
        S.atomic_bytes(spark, f"file://{tmp_path}/0/s0.npz", b"")
    seal = lambda rows: frame(spark, rows, "shard string, start long, stop long, sha256 string")
    sha = [hashlib.sha256(r).hexdigest() for r in raw]
    good = [("s0.npz", 0, 3, sha[0]), ("s1.npz", 3, 5, sha[1])]
    assert S.sealed_tensors(spark, f"{tmp_path}/0", "values", seal(good), 2).count() == 5
    for bad, code in (([good[0]], "seal"), ([good[0], ("s1.npz", 4, 6, sha[1])], "ranges"), ([good[0], ("s1.npz", 3, 5, sha[0])], "seal")):
        with pytest.raises(K.ContractError) as e:
            S.sealed_tensors(spark, f"{tmp_path}/0", "values", seal(bad), 2)
        assert e.value.code == code
    with pytest.raises(Exception, match="float64"):
        S.sealed_tensors(spark, f"{tmp_path}/1", "values", seal([("s0.npz", 0, 2, sha[2])]), 2).collect()


def test_groups_are_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 8), (8, 9), (9, 3)]
    nodes = frame(spark, [(i,) for i in range(1, 11)], "id long")
    got = {r["node"]: r["group"] for r in D.groups(nodes, "id", frame(spark, links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 1, 8: 1, 9: 1, 10: 10}


def test_greedy_assignment_equals_a_plain_loop(spark):
    import hashlib

    cells = [(f"c{i}", f"s{(i * j) % 5}", 1 + (i + j) % 4) for i in range(20) for j in range(1, 3)]
    total = {}
    for c, s, n in cells:
        total[(c, s)] = total.get((c, s), 0) + n
    h = lambda *p: int(hashlib.md5("|".join(p).encode()).hexdigest()[:15], 16)
    target, now, want = {}, {}, {}
    for (_, s), n in total.items():
        target[s] = target.get(s, 0) + n / 2
    for c in sorted({c for c, _ in total}, key=lambda c: h("z", c)):
        mine = {s: n for (k, s), n in total.items() if k == c}
        a = sum(abs(now.get(s, 0) + n - target[s]) for s, n in mine.items())
        b = sum(abs(now.get(s, 0) - target[s]) for s in mine)
        want[c] = 1 if a < b else 0 if a > b else int(h("z", "tie", c) % 2 == 0)
        for s, n in mine.items():
            now[s] = now.get(s, 0) + n * want[c]
    df = frame(spark, [(c, s, n) for (c, s), n in total.items()], "c string, s string, n int")
    got = {r["cluster"]: r["assigned"] for r in G.greedy_assignment(df, "c", "s", "n", 0.5, "z").collect()}
    assert got == want


def test_balanced_folds_and_bounded_weights(spark):
    df = frame(spark, [("a", 9), ("b", 5), ("c", 4), ("d", 1)], "g string, n long")
    assert {r["g"]: r["fold"] for r in G.balanced_folds(df, "g", "n", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    w = G.bounded_mean_one({"a": 1.0, "b": 10.0}, {"a": 3, "b": 1}, 0.5, 2.0)
    assert math.isclose((3 * w["a"] + w["b"]) / 4, 1.0, rel_tol=1e-9) and 0.5 <= min(w.values()) and max(w.values()) <= 2


def test_weighted_line_respects_its_bounds(spark):
    df = frame(spark, [(float(i), 10.0 - i) for i in range(5)], "x double, y double")
    row = E.weighted_line(df, "x", "y", None, 0.0).first()
    assert (round(row["a"], 9), row["b"]) == (8.0, 0.0)


def test_window_mean_and_tails(spark):
    df = frame(spark, [([1.0, 5.0, 2.0, 8.0],)], "a array<double>")
    row = df.select(A.best_window_mean(F.col("a"), 2), A.best_window_mean(F.col("a"), 9), A.tail_mean(F.col("a"), 50), A.tail_mean(F.col("a"), 1, top=True)).first()
    assert tuple(row) == (5.0, 4.0, 1.5, 8.0)
