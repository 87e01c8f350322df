"""Cases on which registered queries once failed, against their SQL or brute force."""

import datetime

import duckdb
import pytest

from tessera import plans  # noqa: F401  (registers the queries)
from tessera.registry import ORACLES, QUERIES
from tests import oracle


def against_sql(spark, name, folder, **tables):
    """Differences of a query from its SQL on tables given as (rows, schema)."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return oracle.differences(QUERIES[name](spark, str(folder)), ORACLES[name], con)


def events(days):
    """Pairs of values, at the two days, one participant each: nothing, zeros and negative ones among them."""
    some = [(0.0, 2.0), (2.0, 0.0), (0.0, 0.0), (-1.0, 2.0), (2.0, -1.0), (-2.0, -1.0), (-1.0, 0.0), (0.0, -1.0), (1.0, 8.0), (3.0, 8.0), (None, 1.0)]
    at = [datetime.datetime(2024, 1, d) for d in days]
    rows = [(2 * i + k, at[k], i, "f", v, '{"k": 1}') for i, pair in enumerate(some) for k, v in enumerate(pair)]
    return rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_two_timepoints_of_zeros(spark, tmp_path):
    assert against_sql(spark, "J14_J15_two_timepoints", tmp_path, events=events((2, 28))) == ""


def test_fold_changes_of_zeros(spark, tmp_path):
    assert against_sql(spark, "baseline_fold_change_rank", tmp_path, events=events((1, 10))) == ""


def test_rounding_intervals_of_halves(spark, tmp_path):
    rows = [(i, f"c{i}", 1, 50.0 * k, "s") for i, k in enumerate(range(-20, 200))] + [(1000, "n", 1, None, "s")]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    assert against_sql(spark, "M28_rounding_interval", tmp_path, customer=(rows, schema)) == ""


def test_byte_counts_of_many_texts_keep_to_small_batches(spark, monkeypatch):
    from tessera.operators import ngrams as N

    texts = ["the cat sat", "", None, "a cat", "zz", "żółć " * 3] * 100
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "id long, t string, lang string").coalesce(1)
    whole = {tuple(r) for r in N.language_counts(N.task_counts(df, "lang", "t")).collect()}
    assert whole == {tuple(r) for r in N.language_counts(N.local_counts(df, "id", "lang", "t")).collect()}
    once = N.task_counts(df, "lang", "t").count()
    monkeypatch.setattr(N, "HELD", 1000)
    cut = N.task_counts(df, "lang", "t")
    assert cut.count() > 4 * once  # what a task holds is told in several parts
    assert {tuple(r) for r in N.language_counts(cut).collect()} == whole


def test_leave_one_out_scores_by_lookup_and_by_join(spark):
    from tessera.operators import ngrams as N

    texts = ["the cat sat on the mat", "", None, "a cat", "z", "the mat, a hat"] * 20
    df = spark.createDataFrame([(i, t, "ab"[i // 6 % 2]) for i, t in enumerate(texts)], "id long, t string, lang string")
    a, b = ({r["id"]: (r["bytes"], r["logp"]) for r in N.loo_scores(df, "id", "lang", "t", most=n).collect()} for n in (0, N.MODEL))
    assert a.keys() == b.keys() and len(a) == 80
    assert all(a[i][0] == b[i][0] and a[i][1] == pytest.approx(b[i][1], abs=1e-9) for i in a)


@pytest.mark.parametrize("shape, tile", [(None, 2048), ((7, 1), 3), ((8, 2), 2), ((9, 3), 2048)])
def test_hamming_pairs_of_copies_and_hot_cells(spark, shape, tile):
    import random

    from tessera.operators import joins as J

    rng = random.Random(3)
    xs = [rng.getrandbits(12) for _ in range(40)] * 2 + [0] * 5 + [rng.getrandbits(52) for _ in range(20)] + [None]
    df = spark.createDataFrame(list(enumerate(xs)), "k long, x long")
    got = sorted(tuple(r) for r in J.hamming_pairs(df, "k", "x", 6, 52, shape, tile).collect())
    known = [(k, x) for k, x in enumerate(xs) if x is not None]
    assert got == sorted((i, j, (a ^ b).bit_count()) for i, a in known for j, b in known if i < j and (a ^ b).bit_count() <= 6)


def test_sketches_of_sets_equal_their_definitions(spark):
    import random

    from pyspark.sql import functions as F

    from tessera.operators import text as D

    rng = random.Random(4)
    sets = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (0, 1, 2, 3, 7, 64, 9000)] + [None, [-1, -(2**63), 2**63 - 1, 0]]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, s array<long>").repartition(2)
    seeded = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.array_min(F.transform("s", lambda x: F.xxhash64(x, p))))
    rows = df.select("k", "s", D.minhash(F.col("s"), 16).alias("m"), F.when(F.col("s").isNotNull(), seeded).alias("want"), D.simhash(F.col("s")).alias("b63"), D.simhash_bits(F.col("s")).alias("b64"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "getbit" not in plan  # counted in arrays, not bit by bit
    for r in rows.collect():
        assert r["m"] == r["want"]
        s = r["s"] or []
        b = sum(1 << i for i in range(64) if s and 2 * sum(x >> i & 1 for x in s) >= len(s))
        assert r["b64"] % 2**64 == b and r["b63"] == b % 2**63


def test_nearest_in_family_makes_no_pair_of_query_and_item(spark, tmp_path):
    import random

    rng = random.Random(5)
    money = lambda: round(rng.uniform(-50, 50), rng.choice((0, 2)))
    rows = [(i, f"c{rng.randrange(10**6)}", i % 3, money(), "s") for i in range(300)]
    rows += [(900, "far", 4, 9999.0, "s"), (901, "a", 5, 10.0, "s"), (902, "b", 5, 10.0 + 3e-7, "s"), (903, "A", 5, 30.0 - 3e-7, "s"), (904, "n", 0, None, "s"), (905, "n", 6, None, "s")]
    ask = [(i, i % 3, money()) for i in range(100)] + [(200, 4, -999.0), (201, 5, 20.0), (202, 7, 1.0), (203, 0, 10.0**7), (204, 0, -(10.0**7)), (205, 1, None), (206, 6, 1.0)]
    customer = (rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    assert against_sql(spark, "J12_nearest_in_family", tmp_path, customer=customer, supplier=(ask, "s_suppkey long, s_nationkey int, s_acctbal double")) == ""


def test_resampled_rows_go_to_the_draws(spark):
    from tessera.plans.cohorts import resampled

    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3 % 2, float(i), "long text") for i in range(30)], "doc_id long, lang string, y int, s4 double, text string")
    r = resampled(df, ["lang", "y"], "t", ["y", "s4"], reps=20)
    assert r.columns == ["rep", "y", "s4"]
    assert "ResolvedHint (strategy=broadcast)" in r._jdf.queryExecution().analyzed().toString() or "BroadcastHashJoin" in r._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in r.groupBy("rep").count().collect()} == {(i, 30) for i in range(20)}


def test_pairs_of_a_group_are_counted_by_their_differences(spark):
    import random
    from collections import Counter

    from tessera.operators.gaps import gap_histogram, mean_over_pairs

    rng = random.Random(8)
    rows = [(i, i % 3, float(rng.randrange(4)), float(rng.randrange(2)), round(rng.uniform(0, 9), 1)) for i in range(150)]
    rows += [(900, 7, 1.0, 1.0, 5.0), (901, 0, 1.0, 1.0, None), (902, 0, 1.0, 1.0, float("nan")), (903, None, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, g int, u double, v double, y double")
    known = [r for r in rows if r[1] is not None and r[4] is not None and r[4] == r[4]]
    pairs = [(a, b) for a in known for b in known if a[1] == b[1] and abs(a[4] - b[4]) > 0.7]  # many gaps are 0.7 but for rounding
    want = Counter((a[2] - b[2], a[3] - b[3], int(a[4] > b[4])) for a, b in pairs)
    for left, right in ((4096, 65536), (7, 11)):
        got = gap_histogram(df, "g", "k", ["u", "v"], "y", 0.7, left, right)
        assert {(r["d0"], r["d1"], r["won"]): r["pairs"] for r in got.collect()} == want
        worth = {(d, e): 0.1 * d + e for d in map(float, range(-3, 4)) for e in (-1.0, 0.0, 1.0)}
        mean = {r["k"]: (r["pairs"], r["mean"]) for r in mean_over_pairs(df, "g", "k", ["u", "v"], "y", 0.7, worth, left, right).collect()}
        assert sorted(mean) == sorted({a[0] for a, _ in pairs})
        for k, (n, m) in mean.items():
            of = [worth[a[2] - b[2], a[3] - b[3]] for a, b in pairs if a[0] == k]
            assert n == len(of) and m == pytest.approx(sum(of) / len(of))


def test_pairwise_ranker_makes_no_pair(spark, tmp_path):
    rows = [(k, k % 2, f"s{k % 3}", 400.0 * k) for k in range(1, 41)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    plan = QUERIES["E11_E20_pairwise_ranker"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sign" not in plan


def test_pairs_of_one_group_are_many_tasks(spark):
    from pyspark.sql import functions as F

    from tessera.operators import joins as J

    df = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("g"), F.col("id").cast("double").alias("y"))
    p = J.within_group_pairs(df, "g", "k", "k", "y", 10.0).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(p) > 2 and sum(r["count"] for r in p) == 2 * sum(3000 - d for d in range(11, 3000))


def test_weights_of_groups_need_no_window_of_rows(spark):
    from tessera.operators import cohort as G

    df = spark.createDataFrame([(i, "aab"[i % 3] if i % 7 else None) for i in range(42)], "k long, g string")
    w = G.equal_weights(df, "g")
    assert "Window" not in w._jdf.queryExecution().optimizedPlan().toString()
    rows = w.collect()
    size = {g: sum(r["g"] == g for r in rows) for g in ("a", "b", None)}
    assert len(rows) == 42 and all(r["weight"] == pytest.approx(42 / 2 / size[r["g"]]) for r in rows)


def test_tokens_in_arrays_equal_the_pattern(spark):
    import random
    import re

    import numpy as np

    from tessera.operators import spans as S

    rng = random.Random(9)
    pattern, name = re.compile(r"[A-Za-z_]\w*|\d+|\s+|[^\w\s]"), re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
    texts = ["".join(rng.choice("aZ_9 \t\n.,é٣ßñ中\"'#/*x²½\U0001f600 ") for _ in range(rng.randrange(50))) for _ in range(3000)]
    for t in texts:
        found = list(pattern.finditer(t))
        start, end, plain = S.tokens(t)
        assert list(zip(start.tolist(), end.tolist(), strict=True)) == [m.span() for m in found]
        assert plain.tolist() == [name.fullmatch(m[0]) is not None for m in found]
        w = np.array([rng.choice((0.5, 1.0, 3.0)) for _ in t])
        want = [x if x > 1 else 1.0 if name.fullmatch(m[0]) and len(m[0]) > 3 else 0.1 for m in found if (x := w[slice(*m.span())].max()) is not None]
        assert S.token_weights(t, w).tolist() == want
    odd = ["a ToDo", "FIXME", "fİxme", "note to ſelf", "HACK", "hac", "to do"]
    assert [S.remarkable(t) or not S.REMARK.search(t) for t in odd] == [True] * 7 and not S.remarkable("hac to do")


def test_feature_hashing_holds_a_piece_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    from tessera.operators import hashed as H

    monkeypatch.setattr(H, "PIECE", 10)
    b = pa.RecordBatch.from_pydict({"key": list(range(7)), "t": ["", "aaaa", "bbbb", "c" * 30, "dd", "", "é" * 5]})
    cut = [p.column("key").to_pylist() for p in H.pieces([b])]
    assert cut == [[0, 1, 2], [3], [4, 5], [6]]
    assert list(H.pieces([b.slice(0, 0)])) == []


def test_sequence_distances_in_arrays(spark):
    from pyspark.sql import functions as F

    from tessera.operators import text as D

    pairs = [("ACGTACGTACGT", "acgtacgtaaaa"), ("ACGT", "ACGT"), ("part one", "part two"), ("ACGT", "other"), ("", ""), ("ab", "abc"), (None, "a"), ("zz", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", D.sequence_distance(F.col("a"), F.col("b")).alias("d"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().optimizedPlan().toString()

    def sets(s, k):
        return {s.upper()[j : j + k] for j in range(max(len(s) - k + 1, 1))}

    got = [r["d"] for r in df.orderBy("i").collect()]
    want = [1 - len(sets(a, k) & sets(b, k)) / len(sets(a, k) | sets(b, k)) for (a, b), k in zip((pairs[j] for j in (0, 1, 2, 5)), (9, 9, 3, 3), strict=True)]
    assert [got[j] for j in (0, 1, 2, 5)] == pytest.approx(want) and got[4] == 0 and got[3] is None and got[6] is None and got[7] is None


def test_verified_pairs_carry_no_sets(spark):
    import random

    from tessera.operators import text as D

    rng = random.Random(11)
    sets = [rng.sample(range(12), rng.randrange(13)) for _ in range(40)] + [[], []]
    s = spark.createDataFrame(list(enumerate(sets)), "k long, s array<long>")
    pairs = [(i, j) for i in range(42) for j in range(i + 1, 42)]
    df = spark.createDataFrame(pairs, "a long, b long")
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
    want = {(i, j): like(sets[i], sets[j]) for i, j in pairs if like(sets[i], sets[j]) >= 0.6}
    for some in ({}, {"members": 5}, {"elements": 20}):
        assert {(r["a"], r["b"]): r["similarity"] for r in D.verified(df, s, 0.6, **some).collect()} == want
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(sets) if x], "k long, s array<long>")
    got = {(r["a"], r["b"]): r["similarity"] for r in D.prefix_pairs(texts, "k", "s", 0.6).collect()}
    assert got == {p: v for p, v in want.items() if sets[p[0]]}


def test_links_connect_what_pairs_connect(spark):
    import random

    import numpy as np

    from tessera.operators import text as D

    rng = random.Random(12)
    base = rng.sample(range(10**6), 60)
    sets = [sorted({*rng.sample(base, 58), rng.randrange(10**6)}) for _ in range(40)]  # near copies: 780 pairs
    short = [rng.sample(range(40), rng.randint(0, 28)) for _ in range(60)]
    sets += short + [[*s, 99] for s in short[:30]] + [rng.sample(range(10**6), 20 + i) for i in range(20)] + sets[:3] + [None, None]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, s array<long>")
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0

    def joined(near):  # noqa: ANN001, ANN202
        group = list(range(len(sets)))
        while (low := [min([group[i], *(group[j] for j in near[i])]) for i in range(len(sets))]) != group:
            group = low
        return dict(enumerate(group))

    for keys, least in ((D.low_keys(8, 4, 0.85), 0.85), (D.minhash_keys(), 0.6)):
        bands = [set(keys(np.sort(np.array(s, np.int64)))) if s is not None else set() for s in sets]
        if least == 0.85:  # the sets too small for the last band are one bucket, by definition
            bands = [b | ({"small"} if s and len(s) <= 28 else set()) for b, s in zip(bands, sets, strict=True)]
        near = [[j for j, y in enumerate(sets) if x is not None and y is not None and (bands[i] & bands[j] or sorted(x) == sorted(y)) and like(x, y) >= least] for i, x in enumerate(sets)]
        for hubs in (0, 2):
            found = D.links(D.signatures(df, "k", "s", keys), lambda ids: df.join(ids, "k", "left_semi"), least, hubs)
            assert {r["node"]: r["group"] for r in D.groups(df, "k", found).collect()} == joined(near)
        assert found.count() < 250


def test_pairs_of_a_group_in_few_parts(spark):
    from tessera.operators.joins import bucket_pairs

    df = spark.range(100).selectExpr("id k", "id % 2 g")
    pairs = bucket_pairs(df, ["g"], "k", 4, 1000)
    assert sorted((r["a"]["k"], r["b"]["k"]) for r in pairs.collect()) == [(i, j) for i in range(100) for j in range(i + 2, 100, 2)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "least(" in plan  # 4 parts, not 13


def test_prefix_pairs_carry_only_shared_elements(spark, monkeypatch):
    from tessera.operators import text as D

    sets = [[f"{i}/{j}" for j in range(50)] + (["shared"] if i % 2 else []) for i in range(20)]  # alone, and one element that unlike sets share
    sets += [[*s[:48], "other"] for s in sets[:3]] + sets[:2]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, s array<string>")
    rows, kept = [], D.written

    def counted(t):  # noqa: ANN001, ANN202
        out = kept(t)
        rows.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(D, "written", counted)
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(i, j): like(x, y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and like(x, y) >= 0.8}
    assert {(r["a"], r["b"]): r["similarity"] for r in D.prefix_pairs(df, "k", "s", 0.8).collect()} == want
    assert [n for c, n in rows if "x" in c][0] < 100  # elements of prefixes, of over a thousand
