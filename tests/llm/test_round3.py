"""Filter audit, winnowing and phrase mining against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, filter_audit, winnow
from tessera.llm.common import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
CLASH = ", n int, h string, mask long, words string, first int, lang string, rank int, f int, id int, length int, fp int, x string, _d int, _h string"


def frame(spark, rows, head):
    """Rows with further columns named like those that the operators use inside."""
    names = [c for c in CLASH.split(", ")[1:] if c.split(" ")[0] not in {h.split(" ")[0] for h in head.split(", ")}]
    df = spark.createDataFrame(rows, head)
    for c in names:
        df = df.withColumn(c.split(" ")[0], F.lit(None).cast(c.split(" ")[1]))
    return df


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    masks = []
    for d, text, source in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if d is not None and d > least[t]:
            fails.add("E")
        masks.append((source or "", fails, d in good, d in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for p in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(p):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                total[f] += len(gone)
                earlier = [m for m in mine if f in m[1] and m[1] & set(p[:k])]
                out[part, "".join(p), k + 1] = [len(left), len(gone), len(earlier), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]] if isinstance(v[-1], str) else v[-1]
    return out


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for i in range(120):
        n = rng.choice([3, 150, 230, 400])
        words = [rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.8 else "") for _ in range(n)]
        text = " ".join(w.upper() if rng.random() < 0.02 else w for w in words) + rng.choice(["", "", " #", "\x0b|\t"])
        docs.append((i, text, rng.choice(["a", "b", None, ""])))
    docs += [(200 + i, docs[i][1], "copies") for i in range(40)] + [docs[3], docs[3], (None, docs[5][1], "a"), (None, docs[5][1], "a"), (300, None, "b"), (301, "", "b"), (302, " \t ", None), (303, "Word " * 30_000, "a")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 260, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (9999, 1, 1)]
    d = frame(spark, docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(d, lab).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit(d.where("doc_id < 0"), lab).count() == 0
    bare = filter_audit.audit(d.limit(5), lab.where("doc_id < 0"))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def plain_report(docs, items, span):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    window = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1) if w else ():
            window.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in window}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in window:
                    hit.update(range(s, s + n))
                    found |= window[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [None, 0])
def test_winnowing_equals_brute_force(spark, monkeypatch, limit):
    """Also with the items' windows shuffled instead of broadcast."""
    if limit is not None:
        monkeypatch.setattr(winnow, "checked_broadcast", lambda df, most=0: df)
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS[:6]) for _ in range(n))
    items = [(i, say(rng.randint(8, 30))) for i in range(25)]
    items += [(30, "alpha"), (31, "Kappa; iota!"), (32, "a b c d"), (33, "a b c d e f g"), (34, ""), (35, None), (None, "null id words here"), (36, "aa " * 40), (5, say(12)), (37, "x é y ü z ß w ñ v ö u"), (38, "0 1 2 3 4 5 6 7 8 9 0 1")]
    docs = [(i, say(rng.randint(0, 80))) for i in range(40)]
    for i in range(30):
        a = items[rng.randrange(25)][1].split()
        k = rng.randint(0, max(0, len(a) - 10))
        docs.append((100 + i, f"{say(rng.randint(0, 9))} {' '.join(a[k : k + rng.randint(6, 14)]).upper()}, {say(rng.randint(0, 9))}"))
    docs += [(200, None), (201, ""), (202, "!!"), (203, "aa " * 3000), (204, "a b c d e f g"), (205, "x É y ü z ß w ñ v ö u x é y ü z ß w ñ v ö u"), (206, "0 1 2 3 4 5 6 7 8 9 0 1"), (None, docs[45][1]), (None, docs[45][1]), docs[50], docs[50], (docs[50][0], "other text")]
    df, bench = frame(spark, docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit(1))
    report = winnow.report(df, bench)
    got = sorted((tuple(r)[:6] for r in report.collect()), key=str)
    want = plain_report(docs, items, 10)
    assert got == want and 0 < sum(r[5] for r in want) < len(want)
    for r in report.collect():
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"] and len(r["items"]) == r["n_items"]
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))
    clean = winnow.decontaminated(df.withColumn("_bad_id", F.lit(1)), bench)
    assert "_bad_id" in clean.columns and clean.count() == sum(not r[5] for r in want)


def test_winnowing_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:6] for r in winnow.report(docs, items.where("item_id < 0")).collect()] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert winnow.report(docs.where("doc_id < 0"), items).count() == 0
    assert [r["n_hit"] for r in winnow.report(docs, items).collect()] == [2]


def test_every_shared_window_has_a_shared_fingerprint(spark):
    rng = random.Random(3)
    w = [rng.choice("abc") for _ in range(200)]
    df = spark.createDataFrame([(w,)], "w array<string>").select(winnow.grams(F.col("w"), 5).alias("g")).select("g", winnow.minima(F.col("g"), 6).alias("m")).first()
    assert df["m"] == [min(df["g"][i : i + 6]) for i in range(len(w) - 9)]


def plain_phrases(docs, least, longest, top):
    out = []
    by = {}
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            by.setdefault("und" if lang is None else lang, []).append([x for x in re.split(r"[\x20\x09]+", piece) if x])
    for lang, pieces in by.items():
        f, n = {}, sum(map(len, pieces))
        for p in pieces:
            for m in range(1, longest + 1):
                for i in range(len(p) - m + 1):
                    k = tuple(p[i : i + m])
                    f[k] = f.get(k, 0) + 1
        cand = {k: a for k, a in f.items() if len(k) > 1 and a >= least}
        rows = []
        for k, a in cand.items():
            inside = any(len(b) > len(k) and 100 * c >= 100 * a and any(b[i : i + len(k)] == k for i in range(len(b) - len(k) + 1)) for b, c in cand.items())
            if not inside:
                score, _, left, right = min((1000 * a * n // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
                rows.append((-score, -a, " ".join(k).encode(), a, left, right, n, score))
        for rank, r in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, r[2].decode(), *r[3:]))
    return sorted(out)


def phrase_docs():
    rng = random.Random(6)
    docs = []
    for i in range(300):
        words = [rng.choice(WORDS[:4] if rng.random() < 0.6 else [*WORDS, f"rare{rng.randint(0, 900)}", "é\x01x", "a#b"]) + rng.choice(["", "", "", ",", ".", "\n", ";x", "\x0b"]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "  ", "\t"]).join(words).replace("alpha", rng.choice(["alpha", "ALPHA"]))))
    docs += [("en", None), ("en", ""), ("fr", "un deux trois " * 200), ("en", "New York City " * 50), docs[7], docs[7], ("", "alpha beta " * 30), (None, ".,;:!?")]
    return docs


@pytest.mark.parametrize("how", [{}, {"most_words": 4}, {"per": 50}, {"top": 3, "per": 7}])
def test_collocations_equal_brute_force(spark, how, monkeypatch):
    """Also with a join for all but four words, and with many small ranges, over whose ends phrases go on."""
    monkeypatch.setattr(collocations, "TEXT_BYTES", 300)
    docs = phrase_docs()
    df = frame(spark, [(i, t, x) for i, (x, t) in enumerate(docs)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, collocations.collocations(df, least=12, **how).collect()))
    want = plain_phrases(docs, 12, 5, how.get("top", 2000))
    assert got == want and len(want) >= 6


def test_collocations_without_frequent_words(spark):
    df = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.where("lang = 'x'")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    top = 4_000_000_000_000
    row = spark.createDataFrame([(top, top + 7, 3, 5)], "f long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * wide("f")).cast("decimal(23,0)") * wide("n").cast("decimal(15,0)")
    got = row.select(above.alias("above"), (wide("l") * wide("r")).alias("below")).selectExpr("cast(above as string) s", "above div cast(below * 100000000000 as decimal(38,0)) d").first()
    assert int(got["s"]) == 1000 * top * (top + 7) and got["d"] == 1000 * top * (top + 7) // (15 * 100_000_000_000)


def test_packed_keys_sort_like_tuples():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 70_000, 4000).astype(np.int32)
    ids[rng.random(4000) < 0.2] = 0
    for width in (3, 4):
        keys = collocations.packed(ids, 5, width)
        want = []
        for i in np.flatnonzero(ids):
            part = []
            for x in ids[i : i + 5]:
                if not x:
                    break
                part.append(int(x))
            want.append(tuple(part + [0] * (5 - len(part))))
        flat = [int.from_bytes(collocations.to_bytes(k)[: 5 * width], "big") for k in keys]
        assert flat == [sum(x << (8 * width * (4 - j)) for j, x in enumerate(t)) for t in want]
        assert [want[i] for i in collocations.radix_order(keys)] == sorted(want)
        again = collocations.unsqueezed(collocations.squeezed(keys.astype(">u2")), len(keys), ">u2", keys.shape[1])
        assert (again == keys).all()


def test_ids_are_numbered_over_partitions(spark):
    words = spark.createDataFrame([("en", f"w{i}", i % 7) for i in range(100)], "lang string, word string, f long").repartition(5)
    got = collocations.numbered(words, Scratch(spark, "test")).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 101)) and [r["f"] for r in got] == sorted((r["f"] for r in got), reverse=True)
