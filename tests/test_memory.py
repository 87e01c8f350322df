"""What operators hold in memory."""

import random
import tracemalloc

import numpy as np


def test_counting_byte_ngrams_holds_few_places_that_are_not_counted():
    from tessera.operators import ngrams as N

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(400)]
    texts = [(" ".join(rng.choices(words, k=4000)).encode(), "ab"[i % 2]) for i in range(50)]
    assert sum(len(N.grams(t)) for t, _ in texts) > N.HELD
    tracemalloc.start()
    seen = {}
    for of, g, k in N.tallied(iter(texts)):
        assert (np.diff(g) > 0).all()
        for x, n in zip(g.tolist(), k.tolist(), strict=True):
            seen[of, x] = seen.get((of, x), 0) + n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for of in "ab":
        g, k = np.unique(np.concatenate([N.grams(t) for t, x in texts if x == of]), return_counts=True)
        assert {(of, x): n for x, n in zip(g.tolist(), k.tolist(), strict=True)} == {key: n for key, n in seen.items() if key[0] == of}
    assert peak < 50_000_000  # four million places alone have 32 MB, and twice as many while they are joined


def test_bootstrap_sends_a_row_a_stratum(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.plans import cohorts as C

    rows = [(i, "ab"[i % 2], i % 3, None if i == 5 else i / 7) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, y int, s double")
    sent, whole = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda x: sent.append(x.count()) or whole(x))
    key = lambda r: (r["rep"], r["y"], -1.0 if r["s"] is None else r["s"])
    got = sorted(map(key, C.resampled(df, ["lang", "y"], "t", ["y", "s"], 7).collect()))
    assert sent == [6]
    monkeypatch.setattr(C, "DRAWN", 10)  # more rows are joined
    assert sorted(map(key, C.resampled(df, ["lang", "y"], "t", ["y", "s"], 7).collect())) == got and len(got) == 7 * 300
    assert sent == [6]
