"""Operators that SQL can't express, or only at length, against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hashed as HF
from tessera.operators import metrics as M
from tessera.operators import ngrams as N
from tessera.operators import panel as P
from tessera.operators import positions as O
from tessera.operators import probes as B
from tessera.operators import ranks as R
from tessera.operators import spans as SP
from tessera.operators import splits as S

WORDS = "alpha beta gamma delta the of and naïve straße épsilon x1 _y".split()


def sentences(n, seed=1, most=30):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def plain_scores(texts, langs, least=4, alpha=0.5, widest=4):
    """Every byte by the counts of the language's other texts, width by width from the longest context."""
    local = []
    for t in texts:
        ctx, joint, b = Counter(), Counter(), t.encode()
        for i in range(len(b)):
            for w in range(min(widest, i) + 1):
                ctx[b[i - w : i], w] += 1
                joint[b[i - w : i], w, b[i]] += 1
        local.append((ctx, joint))
    whole = defaultdict(lambda: (Counter(), Counter()))
    for (c, j), lang in zip(local, langs):
        whole[lang][0].update(c)
        whole[lang][1].update(j)
    out = []
    for t, lang, (c, j) in zip(texts, langs, local):
        b, total = t.encode(), 0.0
        for i in range(len(b)):
            for w in range(min(widest, i), -1, -1):
                context = b[i - w : i]
                n = whole[lang][0][context, w] - c[context, w]
                if w and n < least:
                    continue
                total += math.log((whole[lang][1][context, w, b[i]] - j[context, w, b[i]] + alpha) / (n + alpha * 256))
                break
        out.append((len(b), total))
    return out


def test_loo_scores_equal_a_loop_over_bytes(spark):
    texts = [*sentences(30), "", "q", "zz zz zz", *sentences(30)[:2]]
    langs = [("a", "b")[i % 2] for i in range(len(texts))]
    langs[-1] = "alone"
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))] + [(99, None, "a")], "id int, t string, lang string")
    got = {r["id"]: (r["bytes"], r["logp"]) for r in N.loo_scores(df, "id", "lang", "t").collect()}
    want = plain_scores(texts, langs)
    assert all(i not in got for i, (n, _) in enumerate(want) if n == 0) and 99 not in got
    for i, (n, total) in enumerate(want):
        if n:
            assert got[i][0] == n and abs(got[i][1] - total) < 1e-8
    assert N.loo_scores(df.where("id < 0"), "id", "lang", "t").count() == 0


def test_byte_counts_of_all_widths(spark):
    texts = sentences(8, seed=2)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, lang string")
    got = {r["gram"]: (r["joint"], r["context"]) for r in N.language_counts(N.local_counts(df, "id", "lang", "t")).collect()}
    joint, ctx = Counter(), Counter()
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for w in range(min(4, i) + 1):
                joint[w, b[i - w : i + 1]] += 1
                ctx[w, b[i - w : i]] += 1
    assert got == {(w << N.ROOM) | int.from_bytes(g, "big"): (n, ctx[w, g[:-1]]) for (w, g), n in joint.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered_rows(spark, parts):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {r["id"]: r["position"] for r in O.numbered(df, ["v", "id"], "g", parts=parts).collect()}
    seen = Counter()
    for i, g, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == seen[g]
        seen[g] += 1
    whole = {r["id"]: r["position"] for r in O.numbered(df, [-F.col("v")], parts=parts).collect()}
    assert [i for i, _ in sorted(whole.items(), key=lambda x: x[1])] == [i for i, _, _ in sorted(rows, key=lambda r: -r[2])]


def test_aligned_raises_where_rows_differ(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(50)], "k int, x int")
    b = spark.createDataFrame([(i, i * 3) for i in range(50)], "j int, y int")
    out = O.aligned(a, b.repartition(3), ["k"], ["j"], F.col("k") == F.col("j")).collect()
    assert sorted((r["position"], r["k"], r["y"]) for r in out) == [(i, i, 3 * i) for i in range(50)]
    with pytest.raises(ValueError, match="one side"):
        O.aligned(a, b.where("j < 49"), ["k"], ["j"], F.col("k") == F.col("j"))
    with pytest.raises(ValueError, match="identity"):
        O.aligned(a, b.withColumn("j", F.when(F.col("j") == 7, 500).otherwise(F.col("j"))), ["k"], ["j"], F.col("k") == F.col("j"))


def test_group_folds_are_whole_and_even(spark):
    rng = random.Random(8)
    rows = [(i, f"g{i}" if rng.random() < 0.7 else f"big{rng.randint(0, 25)}", rng.choice(["en", "en", "de", None]), int(rng.random() < 0.3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, g string, lang string, y int")
    fold = {r["g"]: r["fold"] for r in S.stratified_group_folds(df, "g", ["lang", "y"], 5, "s").collect()}
    assert set(fold) == {r[1] for r in rows} and set(fold.values()) == set(range(5))
    strata = sorted({(r[2] or "", r[3]) for r in rows})

    def spread(of):
        n = np.zeros((5, len(strata)))
        for _, g, lang, y in rows:
            n[of[g], strata.index((lang or "", y))] += 1
        return np.abs(n / n.sum(0) - 0.2).max()

    counts = defaultdict(lambda: np.zeros(len(strata)))
    for _, g, lang, y in rows:
        counts[g][strata.index((lang or "", y))] += 1
    order = sorted(counts, key=lambda g: (-(counts[g] ** 2).sum(), g))
    plain = dict(zip(order, S.place_greedily([counts[g] for g in order], 5, np.zeros((5, len(strata))), sum(counts.values()))))
    assert spread(fold) <= spread(plain) + 0.02
    again = {r["g"]: r["fold"] for r in S.stratified_group_folds(df.repartition(7), "g", ["lang", "y"], 5, "s").collect()}
    assert again == fold
    few = {r["g"]: r["fold"] for r in S.stratified_group_folds(df, "g", ["lang", "y"], 5, "s", most=3).collect()}
    assert set(few) == set(fold) and spread(few) < 0.1


def test_nested_split_sizes(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 5) for i in range(500)], "id int, s string, fold int")
    out = S.nested_split(df, ["s"], "id", "fold", 5, "n").groupBy("outer", "s", "role").count().collect()
    assert {(r["role"], r["count"]) for r in out} == {("hold", 50), ("select", 40), ("early", 40), ("train", 120)}


def test_compatibility_needs_one_signature_each(spark):
    rows = [("r1", "ref", "a", "x"), ("r2", "ref", "a", "y"), ("t1", "tgt", "a", "x"), ("t1", "tgt", "a", "x"), ("t2", "tgt", "a", "y"), ("t2", "tgt", "b", "x"), ("t3", "tgt", "b", "x"), ("o", "other", "a", "x")]
    df = spark.createDataFrame(rows, "subject string, study string, p string, q string")
    levels = {"both": F.concat("p", "q"), "p": F.col("p"), "none": F.lit(None).cast("string")}
    got = {r["level"]: (r["reference_defined"], r["compatible"], r["meets_minimum"]) for r in P.compatibility(df, levels, "subject", "study", "ref", "tgt", 1).collect()}
    assert got == {"both": (False, 0, False), "p": (True, 1, True), "none": (False, 0, False)}


def test_rank_agreement_by_hand(spark):
    rows = [("g", 1.0, 10.0, 4.0, 1.0), ("g", 2.0, 20.0, 3.0, 1.0), ("g", 3.0, 30.0, 2.0, 1.0), ("g", 4.0, 40.0, 1.0, 1.0)]
    r = M.rank_agreement(spark.createDataFrame(rows, "g string, a double, b double, c double, d double"), ["a", "b", "c", "d"], "g").first()
    assert (r["pairs"], r["rho_min"], r["rho_max"], r["moved_b"], r["moved_c"]) == (3, pytest.approx(-1), pytest.approx(1), 0, 4)
    assert r["rho_median"] == pytest.approx(-1) and r["shift_max_c"] == pytest.approx(1)


@pytest.mark.parametrize("ranges", [None, 1, 5])
def test_running_sums_in_ranges(spark, ranges):
    rng = random.Random(6)
    rows = [(g, float(v), rng.randint(0, 9)) for g in ("a", "b", None) for v in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for r in R.running(df, "v", ["n"], "g", ranges=ranges).collect():
        mine = [(v, n) for g, v, n in rows if g == r["g"]]
        assert r["below_n"] == sum(n for v, n in mine if v < r["v"]) and r["all_n"] == sum(n for _, n in mine)


def test_hashed_features_equal_a_loop(spark):
    texts = ["", None, "ab", "naïve  café\t\tnaïve x", "Wort wort Wort", "日本 🙂 日本", *sentences(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    mask, k = (1 << 64) - 1, 0x100000001B3

    def mix(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    def vector(hashes, columns):
        v = Counter()
        for h in hashes:
            v[h % columns] += 1 - 2 * (h // columns % 2)
        v = {c: x for c, x in v.items() if x}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {c: x / n for c, x in v.items()}

    for columns in (1 << 16, 32):
        for r in HF.hashed_features(df, "id", "t", columns).collect():
            t = texts[r["id"]] or ""
            squeezed, grams = re.sub(r"\s\s+", " ", t), []
            for n in (3, 4, 5):
                for i in range(len(squeezed) - n + 1):
                    h = n
                    for c in squeezed[i : i + n]:
                        h = mix((h * k + ord(c)) & mask)
                    grams.append(h)
            one = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in re.findall(r"\b\w+\b", t)]
            two = [mix((a * k + b) & mask) for a, b in zip(one, one[1:])]
            for part, hashes in (("char", grams), ("word", one + two)):
                want, got = vector(hashes, columns), dict(zip(r[f"{part}_at"], r[f"{part}_value"]))
                assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)
                assert r[f"{part}_at"] == sorted(r[f"{part}_at"])


CODE = '''def compute_total(x):  # TODO: sum   it  up
    very_long_identifier_name = "a string of more than fifteen" + 'short'
\tmixed = 1
 \t odd = x   +  1
    // not   python
    y = very_long_identifier_name /* block
    over lines */ + FIXME
'''


def test_span_weights_equal_character_loops(spark):
    texts = [CODE, "", None, "plain words only here", "a  b", "#  x  y", "x  # y  z\r\nu  v", "it's a 'quoted thing that is long' here"]

    def plain(t):
        kinds = [("standard", 1.0)] * len(t)
        w = [1.0] * len(t)
        for m in re.finditer(r"//[^\n]*|#[^\n]*|/\*.*?\*/", t, re.S):
            for i in range(*m.span()):
                w[i] = 10.0
        for m in re.finditer(r"\".*?\"|'.*?'", t, re.S):
            if len(m[0]) > 15:
                for i in range(*m.span()):
                    w[i] = 5.0
        for m in re.finditer(r"\b[A-Za-z_][A-Za-z0-9_]{3,}\b", t):
            if len(m[0]) > 10:
                for i in range(*m.span()):
                    w[i] = 3.0 if w[i] == 1.0 else w[i]
        for m in re.finditer("TODO|FIXME|HACK|Note to self", t, re.I):
            for i in range(*m.span()):
                w[i] = 10.0
        at, spots = 0, []
        for line in t.splitlines(keepends=True):
            bare = line.rstrip("\r\n")
            if re.match(r"\t+ +| +\t+", bare):
                spots.append(at)
            for m in re.finditer(r"[^ ]  +[^ ]", bare):
                if "//" not in bare[: m.start()] and "#" not in bare[: m.start()]:
                    spots.append(at + m.start() + 1)
            at += len(line)
        for s in spots:
            for i in range(max(0, s - 2), min(len(t), s + 3)):
                w[i] = max(w[i], 5.0)
        tokens = []
        for m in re.finditer(r"[A-Za-z_]\w*|\d+|\s+|[^\w\s]", t):
            most, word = max(w[m.start() : m.end()]), m[0].strip()
            tokens.append(most if most > 1 else 1.0 if len(word) > 2 and re.match(r"\b[A-Za-z_][A-Za-z0-9_]{3,}\b", word) else 0.1)
        return w, len(spots), tokens

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in SP.span_weights(df, "id", "t").collect():
        w, lints, tokens = plain(texts[r["id"]] or "")
        assert abs(r["weight"] - sum(w)) < 1e-9 and r["lints"] == lints and r["tokens"] == len(tokens)
        assert abs(r["token_weight"] - sum(tokens)) < 1e-9
        assert (r["boilerplate"], r["heavy"]) == (sum(x == 0.1 for x in tokens), sum(x > 1 for x in tokens))


def test_probe_ensemble_finds_the_layers_that_hold_the_label(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 16))
    y = (x[:, 2] + x[:, 9] * x[:, 8] > 0).astype(int)
    x[:, 4:6] += 1.5 * y[:, None]
    rows = [(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))] + [(2000, None, 1)]
    df = B.split_roles(spark.createDataFrame(rows, "id int, v array<double>, y int"), "id", "s")
    scores, layers = B.probe_ensemble(df, "id", "v", "y", "role", 8, top=3)
    place = {r["layer"]: (r["place"], r["auc"], r["epoch"]) for r in layers.collect()}
    assert len(place) == 8 and place[2][0] == 1 and place[1][0] == 2 and all(0 <= e <= 60 for _, _, e in place.values())
    got = {r["id"]: r["score"] for r in scores.collect()}
    assert len(got) == 901 and got[2000] is None
    held = {r["id"] for r in df.where("role = 'hold' and v is not null").collect()}
    one, zero = ([got[i] for i in held if y[i] == c] for c in (1, 0))
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in zero] for a in one]) > 0.85
    again = {r["id"]: r["score"] for r in B.probe_ensemble(df.repartition(5), "id", "v", "y", "role", 8, top=3)[0].collect()}
    assert all(abs(again[i] - got[i]) < 1e-12 for i in range(900))


def test_probe_gradient_is_the_loss_slope():
    """One full batch of plain descent direction: the first Adam step moves each weight against its numeric slope."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (40, 3)), (rng.random(40) > 0.5).astype(float)
    p0, _ = B.train(x, y, x, y, 4, 7, 0, 1, 0.01, 40)
    p1, _ = B.train(x, y, x, y, 4, 7, 1, 1, 1e-4, 40)
    for k in ("w1", "w2", "b1", "b2"):
        for i in np.ndindex(p0[k].shape):
            up = {n: v.copy() for n, v in p0.items()}
            up[k][i] += 1e-6
            slope = (B.loss(up, x, y) - B.loss(p0, x, y)) / 1e-6
            if abs(slope) > 1e-4:
                assert np.sign(p1[k][i] - p0[k][i]) == -np.sign(slope)


def test_eligible_records_by_type(spark):
    base = {"content": '"abc"', "path": '"p"', "autogenerated": "false", "copies": "1"}
    cases = [({}, True), ({"copies": '"1"'}, True), ({"copies": "true"}, False), ({"copies": "2"}, False), ({"copies": '"2"'}, False), ({"autogenerated": '"false"'}, False)]
    cases += [({"autogenerated": "true"}, False), ({"autogenerated": "0"}, False), ({"content": '" "'}, False), ({"content": "12"}, False), ({"path": "null"}, False), ({"content": '"abcd"'}, False)]
    rows = [("{" + ", ".join(f'"{k}": {v}' for k, v in (base | c).items()) + "}", want) for c, want in cases] + [("no json", False), (None, False), ("{}", False)]
    from tessera.operators import audits as U

    got = spark.createDataFrame(rows, "r string, want boolean").select("r", "want", U.eligible(F.col("r"), 1, 3).alias("ok")).collect()
    assert [r["r"] for r in got if r["ok"] != r["want"]] == []


def test_view_of_another_study_raises(spark):
    from tessera.operators import audits as U

    base = spark.createDataFrame([(1, "s"), (2, "t"), (3, None)], "k int, study string")
    ok = U.attach_view(base, spark.createDataFrame([(1, "s", 5), (3, None, 6)], "k int, study string, v int"), ["k"], "study").collect()
    assert sorted((r["k"], r["v"], r["has_view"]) for r in ok) == [(1, 5, True), (2, None, False), (3, 6, True)]
    for study in ("t", None):
        with pytest.raises(ValueError, match="differs"):
            U.attach_view(base, spark.createDataFrame([(1, study, 5)], "k int, study string, v int"), ["k"], "study")


def test_shift_audit_of_gaps_and_constants(spark):
    from tessera.operators import audits as U

    rows = [("s", 1.0, 5.0, None, "a"), ("s", 2.0, 5.0, None, "b"), ("s", 3.0, 5.0, None, "a"), ("h", 4.0, 6.0, 1.0, "c"), ("h", float("nan"), 6.0, 1.0, "a")]
    df = spark.createDataFrame(rows, "d string, x double, k double, gone double, c string")
    r = U.shift_audit(df, F.col("d") == "s", ["x", "k", "gone"], ["c"], 0.5).first()
    assert (r["features"], r["usable"], r["unavailable"], r["zero_iqr"]) == (3, 2, 1, 1)
    assert r["mean_shift"] == pytest.approx((2.0 / 1.0 + 1.0 / 0.5) / 2) and r["mean_missing_delta"] == pytest.approx((0.5 + 0 + 1) / 3)
    assert (r["unseen_levels"], r["unseen_fraction"]) == (1, 0.5) and r["max_tv"] == pytest.approx(0.5 * (abs(2 / 3 - 0.5) + 1 / 3 + 0.5))


def test_identifier_words_and_context_plans(spark):
    from tessera.operators import sequences as Q

    names = ["camelCaseName", "snake_case__x2", "XMLNode", "_", "42_a", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(Q.identifier_words(F.col("n"))).collect()]
    assert got == [["camel", "Case", "Name"], ["snake", "case", "x2"], ["X", "M", "L", "Node"], [], ["42", "a"], []]
    for region, start in (("prefix", 0), ("middle", 3), ("suffix", 6)):
        cols = Q.context_plan(F.sequence(F.lit(10), F.lit(19)), region, 4, True, 8)
        r = spark.range(1).select(*cols).first()
        body = list(range(10, 20))[start : start + 4]
        assert r["input_ids"] == [1, *body, 2, 0, 0] and r["mask"] == [1] * 6 + [0] * 2 and r["positions"] == [0, 1, 2, 3] and r["scored"] == 4
    r = spark.range(1).select(*Q.context_plan(F.array(F.lit(9), F.lit(8)), "suffix", 4, False, 4)).first()
    assert (r["input_ids"], r["positions"], r["selected"], r["scored"]) == ([9, 8, 0, 0], [0], 2, 1)


def test_sampled_simhash_equals_a_loop(spark):
    import xxhash

    from tessera.operators import text as D

    words = [[], ["a"], list("abcdefgh"), [f"w{i % 50}" for i in range(700)]]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w array<string>")
    got = {r["id"]: r["b"] for r in df.select("id", D.spaced_shingle_hashes(F.col("w"), 5, 256).alias("s")).select("id", D.simhash_bits(F.col("s")).alias("b")).collect()}
    for i, w in enumerate(words):
        total = len(w) - 4
        if total < 1:
            runs = [" ".join(w)]
        else:
            at = range(total) if total <= 256 else [math.floor(j * (total - 1) / 255.0) for j in range(256)]
            runs = [" ".join(w[j : j + 5]) for j in at]
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) >= len(h))
        assert got[i] % (1 << 64) == want


def test_overlap_splits_purge_subjects(spark):
    from tessera.operators import audits as U

    rows = [("a", 1, "p"), ("a", 2, "x"), ("b", 1, "p"), ("c", 3, "p"), ("d", 4, "x"), ("e", 5, "q")]
    df = spark.createDataFrame(rows, "study string, subject int, member string")
    got = {r["held"]: (r["validation_members"], r["training_studies"], r["skipped"]) for r in U.overlap_splits(df, "study", "subject", "member", ["p", "q"], 3).collect()}
    # b's only panel subject is in a as well, so it is purged where a is held, and the other way round
    assert got == {"a": (1, 2, "too_few_training_studies"), "b": (1, 2, "too_few_training_studies"), "c": (1, 3, None), "d": (0, 4, "zero_panel_overlap"), "e": (1, 3, None)}
