"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, html_extract, imatch, langid, license_scan, mixing, packing, queries, similar, simhash, toxicity, url_filter

from tessera.llm.common import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, fp string, _k int"


def make(spark, texts, first=0):
    rng = random.Random(3)
    rows = [
        (i + first, t, rng.choice(["en", "de"]), rng.choice(["a", "b", None]), None if t is None else len(t), 0.5, 1, "x", 2) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [sentence(rng, rng.randint(1, 60)) for _ in range(40)]
    near = sentence(rng, 300).split(" ")
    out += [" ".join(near), " ".join([*near[:-1], "omega"]), out[3], out[3], out[3].upper(), "", None, "   ", "12 34 !!", "x", "word " * 5000]
    return out


def test_simhash_equals_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(make(spark, texts)).collect()}
    fps = [simhash.simhash64((t or "").encode(), 3) for t in texts]
    assert all(got[i]["fingerprint"] == f"{v:016x}" for i, v in enumerate(fps))
    group = list(range(len(fps)))
    while True:
        low = [min(group[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2) for a in fps]
        if low == group:
            break
        group = low
    assert [got[i]["component_id"] for i in range(len(fps))] == group
    assert got[45]["fingerprint"] == "0" * 16 and got[46]["component_id"] == 45


def test_simhash_bits_are_majorities():
    import xxhash

    words = "A b C d e".lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash64(b"A b C\td\n e", 3) == want
    assert simhash.simhash64(b"only two", 3) == xxhash.xxh64_intdigest(b"only two", 42)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 9, (40, 30)).astype(np.uint8)
    left, right = simhash.forest(d, 1, False)
    assert all(d[i, j] <= 1 for i, j in zip(left, right)) and len(left) < 70
    label = list(range(70))
    for i, j in zip(left, right):
        a, b = label[i], label[40 + j]
        assert a != b
        label = [b if x == a else x for x in label]
    assert all(label[i] == label[40 + j] for i in range(40) for j in range(30) if d[i, j] <= 1)


def jaccard_groups(texts, least=0.8):
    """Smallest index reachable through five-word shingle similarities, by all pairs."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    n = range(len(texts))
    near = [[j for j in n if (len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) if sets[i] | sets[j] else True)] for i in n]
    group = list(n)
    while (low := [min(group[j] for j in near[i]) for i in n]) != group:
        group = low
    return group


SIZES = [{}, {"tile": 8, "part": 4}]


@pytest.mark.parametrize("size", SIZES)
def test_one_of_each_keeps_the_smallest_id(spark, texts, size):
    docs = make(spark, texts)
    out = similar.one_of_each(docs, **size)
    assert out.columns == docs.columns
    group = jaccard_groups(texts)
    assert {r["doc_id"] for r in out.collect()} == {i for i, g in enumerate(group) if g == i}


@pytest.mark.parametrize("size", SIZES)
def test_one_of_each_equals_brute_force(spark, size):
    """Copies with other edits are often nearer to each other, and fail, than to the original, and pass."""
    texts = edited_copies()
    group = jaccard_groups(texts)
    kept = {r["doc_id"] for r in similar.one_of_each(make(spark, texts), **size).select("doc_id").collect()}
    assert kept == {i for i, g in enumerate(group) if g == i} and 3 < len(kept) < 120


def test_one_of_each_in_bands(spark):
    """With bands a few pairs at the least similarity are missed, as documented; nothing else is joined."""
    texts = edited_copies()
    want = {i for i, g in enumerate(jaccard_groups(texts)) if g == i}
    kept = {r["doc_id"] for r in similar.one_of_each(make(spark, texts), cell=16, tile=8, part=4).select("doc_id").collect()}
    assert want <= kept and len(kept - want) <= 0.01 * len(texts)


def test_one_of_each_does_not_depend_on_bands(spark, monkeypatch):
    """Whatever the fingerprints miss is found: bands that miss nine in ten and a radius that misses most pairs change nothing."""
    texts = edited_copies()
    line = " ".join(f"l{i}" for i in range(40)) + " "  # 40 more texts share it
    texts += [line + " ".join(f"p{k}x{i}" for i in range(160)) for k in range(40)]
    texts += [f"{texts[-1 - k]} q{k}" for k in range(40)] + ["a b c d e f g h i", "a b c d e f g h", "one two", "one"]
    group = jaccard_groups(texts)
    want = {i for i, g in enumerate(group) if g == i}
    seen = []
    links = similar.links
    monkeypatch.setattr(similar, "links", lambda *a: (seen.append(out := links(*a)), out)[1])
    for missed, radius, dense, size in ((0.005, 45, 64, {}), (0.9, 3, 10, {"cell": 2, "tile": 8, "part": 4}), (0.9, 0, 64, {"cell": 1, "tile": 100})):
        monkeypatch.setattr(similar, "DENSE", dense, raising=False)
        monkeypatch.setattr(similar, "MISSED", missed)
        monkeypatch.setattr(similar, "radius", lambda least, r=radius: r)
        kept = {r["doc_id"] for r in similar.one_of_each(make(spark, texts), **size).select("doc_id").collect()}
        assert kept == want
    ends = [{r[c] for r in out.collect() for c in "ab"} for out in seen]
    assert len(ends[0]) > 2 * len(ends[-1])


def test_filters_of_prefixes_leave_no_similar_pair_out():
    """Prefixes share a shingle whose places, and parities that differ in few enough bits, allow what the sets have."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 50, 300, 1000):
        for _ in range(60):
            h = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
            own = rng.integers(0, n // 8 + 1)
            x, y = np.unique(h[:n]), np.unique(h[own : n + rng.integers(0, n // 8 + 1)])
            both = len(np.intersect1d(x, y))
            if both < 0.8 * (len(x) + len(y) - both):
                continue
            common = rng.permutation(h)[: rng.integers(0, n)]
            px, py = (similar.prefix(s, common, 0.8).tolist() for s in (x, y))
            i = next(k for k, v in enumerate(px) if v in py)
            side = [{"n": np.array([[len(s)]]), "at": np.array([[k]]), "label": np.array([[k2]])} for s, k, k2 in ((x, i, 0), (y, py.index(px[i]), 1))]
            assert similar.filtered(*side, 0.8, False).all()
            bits = [similar.parity(s) for s in (x, y)]
            bx, by = (similar.parities([b], min(map(len, bits))) for b in bits)
            assert np.bitwise_count(bx ^ by).sum() <= len(x) + len(y) - 2 * both <= 0.2 / 1.8 * (len(x) + len(y)) + 1e-6


def edited_copies():
    rng = np.random.default_rng(5)
    texts = []
    for o in range(3):
        words = [f"w{o}x{i}" for i in range(300)]
        texts.append(" ".join(words))
        for c in range(60):
            edited = list(words)
            for i in rng.choice(np.arange(5, 295, 6), 6 if c % 4 else 9, replace=False):
                edited[i] = f"e{c}x{i}"
            texts.append(" ".join(edited))
    chain = [f"c{i}" for i in range(200)]
    for step in range(25):
        texts.append(" ".join(chain[step * 3 :] + [f"d{step}x{i}" for i in range(3 * step)]))
    return [texts[i] for i in rng.permutation(len(texts))]


def test_one_of_each_counts_a_shingle_once(spark):
    """A line that is repeated 200 times neither makes unlike texts equal nor sets like ones apart."""
    line = " ".join(f"l{i}" for i in range(15)) + " "
    one, other = (" ".join(f"{c}{i}" for i in range(500)) for c in "ab")
    kept = {r["doc_id"] for r in similar.one_of_each(make(spark, [line * 200 + one, line * 200 + other, line * 2 + one])).select("doc_id").collect()}
    assert kept == {0, 1}


def test_one_of_each_decides_by_row(spark):
    """Repeated and null ids: only rows of one group are removed, repeated rows come once, other columns pass."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a, "u", 1), (7, b, "v", 2), (7, b, "v", 2), (None, a, "w", 3), (None, c, "x", 4), (None, c, "x", 4), (9, c + " end", "y", 5), (3, None, "z", 6), (4, "", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n int")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["key"]) for r in similar.one_of_each(df).collect())
    assert got == sorted([(7, a, "u"), (7, b, "v"), (9, c + " end", "y"), (3, "", "z")])
    assert similar.one_of_each(df.where("false")).count() == 0


def test_bands_find_the_share_they_promise():
    """Recall of the candidates at exactly the least similarity, and that a cell's bands grow slowly."""
    width, count = similar.bands(1_000_000, 0.8)
    assert (width, count) == (6, 12) and similar.bands(1000, 0.8) == (0, 1) and similar.bands(10**10, 0.8)[1] < 200
    rng, hit, limit = np.random.default_rng(1), 0, similar.radius(0.8)
    for _ in range(1000):
        h = rng.integers(0, 1 << 63, 1100, dtype=np.uint64)  # 800 of 1000 shared, 100 own each: 0.8
        x, y = similar.majority(h[:900], 2), similar.majority(np.concatenate([h[100:900], h[900:1000]]), 2)
        cut = lambda b: b[: width * count].reshape(count, width)
        hit += (cut(x) == cut(y)).all(1).any() and (x != y).sum() <= limit
    assert hit >= 980


def test_intersections_equal_python_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(30)]
    got = similar.common(sets[:13], sets[13:], width=7)
    assert (got == [[len(set(a) & set(b)) for b in sets[13:]] for a in sets[:13]]).all()


@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16])
def test_cells_of_any_fineness_find_the_same_links(spark, parts):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for f in fps]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    pairs = {frozenset((a % (1 << 64), b % (1 << 64))) for a, b in simhash.links(df, 2, tile=4, parts=parts).collect()}
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert pairs <= want and parts_of(fps, pairs) == parts_of(fps, want)


def parts_of(nodes, pairs):
    """Components of a graph, as sets."""
    group = {f: {f} for f in nodes}
    for p in pairs:
        a, b = tuple(p)
        whole = group[a] | group[b]
        for f in whole:
            group[f] = whole
    return {frozenset(g) for g in group.values()}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base, base[:10] + 0.05 * rng.standard_normal((10, 16)), base[:3], 2 * base[3:5]]).astype("float32")
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0] * 15 + [None]]
    rows += [(len(x) + i, v, 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    v = x.astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(len(v))] == near.sum(1).tolist()
    label = np.arange(len(v))
    for _ in v:
        label = np.array([min(label[i], label[near[i]].min(initial=99)) for i in range(len(v))])
    assert [got[i]["component_id"] for i in range(len(v))] == label.tolist()
    assert all(got[i]["kept"] == (label[i] == i) for i in range(len(v)))
    assert all(got[len(v) + i]["n_links"] == 0 and got[len(v) + i]["kept"] for i in range(len(bad)))
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_urls_of_lists_beyond_every_bound(spark, monkeypatch):
    """More forms of keys than one projection looks up, and more keys than a level holds, judged like any other."""
    monkeypatch.setattr(url_filter, "SHAPES", 5)
    rng = random.Random(8)
    hosts = [".".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    keys = sorted({f"{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(120)})
    block, allow, listed = keys[0::3], keys[1::3], keys[2::3]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/y'])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    lists = [spark.createDataFrame([(k,) for k in x], "key string") for x in (block, allow, listed)]
    assert len(url_filter.shapes(lists[0])) > 5
    for r in url_filter.judge(df, *lists, largest=128).collect():
        host, _, path = urls[r["page_id"]].removeprefix("http://").partition("/")
        path = "/" + path

        def fits(k):
            h, _, p = k.partition("/")
            return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

        rules = [k for k in (*block, *allow) if fits(k)]
        rule = max(rules, key=lambda k: (len(k), k), default=None)
        want = ("block" if rule in block else "allow") if rule else "block" if any(map(fits, listed)) else "allow"
        assert (r["rule"], r["verdict"]) == (rule, want)


def test_null_ids_keep_their_links(spark):
    vec = [(3, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [-1.0, -1.0]), (None, [-1.0, -1.01]), (7, [5.0, -5.0])]
    out = embeddings.near_duplicates(spark.createDataFrame(vec, "vec_id long, embedding array<double>"))
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out.collect())
    assert got == [(0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (0, 1, 3, False), (3, 1, 3, True), (7, 0, 7, True)]
    docs = [(5, "one two three"), (None, "one two three"), (None, "nothing like it at all"), (8, "one two three")]
    out = simhash.simhash_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0), (0, 5), (5, 5), (8, 5)]
    fps = [simhash.simhash64(t.encode(), 3) for t in ("a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3", "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 4")]
    near = (fps[0] ^ fps[1]).bit_count()
    alone = spark.createDataFrame([(5, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3"), (None, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 4")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.components(alone, radius=near).collect()] == [5, 5]


def test_html_is_linear_in_a_page(spark):
    import time

    def seconds(unit, n):
        page, t = unit * n, time.process_time()
        html_extract.main_text(page)
        return time.process_time() - t

    for unit in ("<b>x<a href=1>y</a>", "<div class=ad>x</i>", "<p><b><i>t</u>", "<div class=ad><h1>"):
        seconds(unit, 1000)
        assert seconds(unit, 60_000) < 3 * seconds(unit, 30_000) + 0.2, unit


def test_hinted_parts_give_way_like_a_plain_loop():
    """The heap of hinted elements against a rescan of all blocks for each of them."""
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randint(1, 12)
        hints = html_extract.Hints([0], [False])
        for h in range(1, n):
            hints.add(rng.randrange(h))
            if rng.random() < 0.5:
                hints.hold(h)
        blocks = [html_extract.Block("x" * rng.randint(1, 9), 0, rng.random() < 0.2, rng.randrange(n), False, False) for _ in range(6)]
        like = [rng.random() < 0.6 for _ in blocks]

        def chain(h):
            return [] if not h else [*chain(hints.outer[h]), h]

        left = set()
        while not any(t and not b.never and left.issuperset(chain(b.hint)) for b, t in zip(blocks, like)):
            held = {}
            for b, t in zip(blocks, like):
                outer = next((h for h in chain(b.hint) if h not in left), None)
                if t and not b.never and outer and hints.holds[outer]:
                    held[outer] = held.get(outer, 0) + len(b.text)
            if not held:
                break
            left.add(max(held, key=lambda h: (held[h], -h)))
        free = html_extract.free_of_hints(blocks, like, hints)
        assert free == [left.issuperset(chain(h)) for h in range(n)]


def test_tiles_of_one_bucket_count_each_link_once(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(8) + 0.01 * rng.standard_normal((50, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    out = embeddings.near_duplicates(df, tile=7)
    assert {r["n_links"] for r in out.collect()} == {49} and out.where("kept").count() == 1


def test_embeddings_recall_and_extremes(spark, monkeypatch):
    """Recall over many small buckets, mixed lengths, huge and tiny components, repeated ids."""
    monkeypatch.setattr(embeddings, "BUCKET", 8)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24))
    x = np.concatenate([base, *[base + rng.uniform(0.05, 0.6) * rng.standard_normal(base.shape) for _ in range(3)]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, [1e200] * 16), (n + 1, [2e200] * 16), (n + 2, [1e-200] * 16), (n + 3, [1.0] * 5), (n + 4, [1.0] * 5), (n + 4, [2.0] * 5)]
    got = {}
    for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert embeddings.tables_for(n, 0.9)[0] > 10 and all(got[i][0]["n_links"] <= near[i].sum() for i in range(n))
    assert sum(got[i][0]["n_links"] for i in range(n)) >= 0.98 * near.sum()
    assert [got[n + i][0]["n_links"] for i in range(4)] == [2, 2, 2, 2] and {r["n_links"] for r in got[n + 4]} == {2}
    assert {got[n + i][0]["component_id"] for i in range(3)} == {n} and {r["component_id"] for i in (3, 4) for r in got[n + i]} == {n + 3}


@pytest.mark.parametrize("step", [mixing.GOLDEN, 0.1234567])
def test_mix_equals_a_plain_loop(spark, step):
    """Slots fall by their points, take the blocks of a source's shuffled documents in turn, and count the words."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, 40), f"s{i}") for i in range(6)]
    rows += [(10 + i, sentence(rng, rng.randint(0, 90)), rng.choice(["big", "mid", "mid2", None])) for i in range(200)]
    rows += [(10, rows[6][1], rows[6][2]), (None, sentence(rng, 30), "alone"), (900, " ", "only-blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=16, step=step).collect()
    order = sorted({s for _, _, s in rows if s}) + [None]
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in order}
    target = {r["source_size"]: r["target"] for r in got}
    length = {s: max(1, min(16, n // 1024)) for s, n in size.items()}
    blocks = {s: -(-n // length[s]) for s, n in size.items()}
    need = {s: target[n] / max(n, 1) * blocks[s] for s, n in size.items()}
    total, taken, edge = sum(need.values()), {s: 0 for s in order}, []
    for s in order:
        edge.append((edge[-1] if edge else 0.0) + need[s])
    uses = {}
    for i in range(round(total)):
        u = i * step % 1
        s = next((s for s, e in zip(order, edge) if u < e / total and need[s]), None)
        if taken[s] < 3 * blocks[s]:
            uses[s, taken[s] % blocks[s]] = uses.get((s, taken[s] % blocks[s]), 0) + 1
            taken[s] += 1
    want = []
    for s in order:
        mine = [(d is None, hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d, len(t.split())) for d, t, x in rows if x == s and t.split()]
        at = 0
        for _, _, d, n in sorted(mine, key=lambda m: m[:2]):
            want.append((str(d), sum(uses.get((s, w // length[s]), 0) for w in range(at, at + n))))
            at += n
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got if r["size"]) == sorted(want)
    by_source = {}
    for r in got:
        by_source[r["source_size"], r["target"]] = by_source.get((r["source_size"], r["target"]), 0) + r["taken"]
    if step == mixing.GOLDEN:
        assert all(abs(by_source[size[s], target[size[s]]] - target[size[s]]) <= 4 * length[s] for s in ("big", "mid", "mid2", None))


def test_another_sequence_gives_another_mix(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, 60), rng.choice("abbcccc")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df, step=s).collect()) for s in (mixing.GOLDEN, 0.1234567))
    assert a != b


def test_mixed_documents_hold_the_words_taken(spark):
    rng = random.Random(10)
    rows = [(i % 37 or None, sentence(rng, rng.randint(0, 50)), rng.choice(["a", "b", None]), i, "k") for i in range(90)]
    df = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string, source string, size int, h string")
    taken = mixing.mix_rows(df, 16).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect()
    out = mixing.mixed_documents(df, 16)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[(r["doc_id"], r["source"])] = words.get((r["doc_id"], r["source"]), 0) + len(r["text"].split())
    assert words == {(r["doc_id"], r["source"]): r["n"] for r in taken if r["n"]}


def test_mix_hits_targets_and_limits(spark):
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randint(0, 400)), s) for i, s in enumerate(["a"] * 150 + ["b"] * 100 + [None] * 20 + ["c"] * 2)] + [(900, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    out = mixing.mix(df, block=16).collect()
    again = mixing.mix(df.repartition(5), block=16).collect()
    assert sorted(out) == sorted(again) and len(out) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sizes, total = {}, 0
    for r in out:
        text = dict((x[0], x[1]) for x in rows)[r["doc_id"]]
        assert r["size"] == len((text or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[source[r["doc_id"]]] = sizes.get(source[r["doc_id"]], 0) + r["size"]
        total += r["size"]
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight, free, target = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
    for s in order:
        mine = [r for r in out if source[r["doc_id"]] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 16 * 4
    docs = mixing.mixed_documents(df.drop("size"), block=16)
    assert docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in out)
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tok = Tokenizer.from_file(path)
    odd = ["naïve café don't  stop\n\n\tx", "日本語 🙂👍🏽 \u00a0\u2003\x85 1234567890", "a" * 3000, "…—’s ’t 'll'LL\r\n", "x <|endoftext|> y"]
    df = make(spark, [*texts, *odd])
    out = packing.pack(df, path, window=64, keep_ids=True).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate([*texts, *odd]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist() == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 for r in mine)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for rows in sequences.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(df.where("doc_id < 0"), path).count() == 0


def test_fill_is_an_exact_subset_sum():
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(1, 60)
        used = packing.fill(counts, room)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert sum(n * c for n, c in used) == max(s for s in sums if s <= room) and all(c <= counts[n] for n, c in used)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><a href="/">Home</a> <a href="/x">More of the site</a></nav><div class="cookie-notice">We use cookies and you have to accept that.</div>
<article><h1>The title</h1><p>It is one of the   first &amp; best <b>par</b>agraphs of the text, and it is long enough to be decided.<p>Short &#233;nd.
<div class="ad">Buy this now, it is the best of all that there is.</div><aside>See also the rest of that.</aside><form><p>Name <input></p></form></article>
<section id="comments"><p>I think that this is the best of all texts that I have read for a long time, thank you for it.</p></section>
<footer>&copy; Us</footer></body>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The title\nIt is one of the first & best paragraphs of the text, and it is long enough to be decided.\nShort énd."
    assert [html_extract.main_text(x) for x in (None, "", "<nav><a>x</a></nav>", "<p", "plain words")] == ["", "", "", "", "plain words"]
    menu = "<div>" + "".join(f'<a href="/{i}">Item number {i} of the list</a> ' for i in range(9)) + "</div>"
    text = "<p>" + "It is the kind of text that has a lot of the words of the language in it. " * 4 + "</p>"
    assert html_extract.main_text(menu + text + "<p>And so on.</p>" + text).count("\n") == 2


def test_main_text_of_odd_pages():
    long = "It is the kind of text that has a lot of the words of the language in it, and so on."
    # a link that is never closed ends with its block
    page = f"<p>See <a href='/x'>this<p>{long}</p><div><p>{long} <a>More</p><p>{long}</p></div>"
    assert html_extract.main_text(page).count(long) == 3
    # hints on the article's wrapper; those inside it hold
    for wrapper in ('class="market-share"', 'id="search"', 'class="content widget"'):
        page = f"<body><div {wrapper}><h1>Head</h1><p>{long}</p><div class=comments><p>{long} I think.</p></div></div><div class='ad'>{long}</div></body>"
        assert html_extract.main_text(page) == f"Head\n{long}"
    # a hinted part with neither article nor heading stays out, even if there is nothing else
    assert html_extract.main_text(f"<div class=cookie-notice><p>{long}</p></div>") == ""
    # languages without known stop words go by length and links
    russian = "Это длинный абзац русского текста, в котором нет ни одного известного служебного слова, " * 2
    menu = "<ul>" + "<li><a>Новости раздела</a>" * 20 + "</ul>"
    assert html_extract.main_text(f"{menu}<div><p>{russian}</p></div>") == russian.strip()
    # very long pages, deep nesting
    assert len(html_extract.main_text(f"<article>{'<p>' + long + '</p>'}" * 20_000)) == 20_000 * (len(long) + 1) - 1
    assert html_extract.main_text("<div>" * 3000 + f"<p>{long}</p>") == long


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "z"), (1, "u", PAGE, "z"), (2, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_extract.main_texts(df).orderBy("page_id").collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2]["text"] == "" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert html_extract.main_texts(df.where("page_id > 9")).count() == 0


def test_urls_equal_a_plain_loop(spark):
    urls = ["HTTP://Www.Example.COM/en/712?x", "http://a.example.net/de/81", "https://x.net/de/1", "http://com/en/", "http://example.com/en", "no scheme", None, ""]
    urls += ["ftp://m.free-bets.example.com/fr/1#a", "http://notcom/en/1", "x://org/es/?", "a://b://c/d", "http://spam-farm.example.org", "http://example.com:80/en/7"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge(df).collect():
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = lambda k: (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])  # noqa: B023, E731
        rules = [k for k in (*url_filter.BLOCK, *url_filter.ALLOW) if fits(k)]
        rule = max(rules, key=len, default=None)
        verdict = ("block" if rule in url_filter.BLOCK else "allow") if rule else "block" if any(map(fits, url_filter.LISTED)) else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    assert url_filter.judge(df.where("page_id < 0")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    from tessera.llm.common import Scratch

    listed = tuple(f"h{i}.example/" for i in range(0, 300, 7))
    scratch = Scratch(spark, "test")
    universe = scratch.write(spark.createDataFrame([(f"h{i}.example/",) for i in range(3000)], "key string"))
    table = spark.createDataFrame([(k,) for k in (*listed, *listed, "h9999.example/")], "key string")
    c = url_filter.Cascade(scratch.write(universe.join(table, "key", "left_semi")), universe.join(table, "key", "left_anti"), scratch)
    got = {r["key"] for r in universe.where(c.holds(F.col("key"))).collect()}
    assert got == set(listed) and len(c.levels) >= 2


def test_hashes_of_a_level_never_overflow(spark):
    at = [url_filter.place(F.col("id").cast("string"), 1, i, url_filter.LARGEST).alias(f"p{i}") for i in range(url_filter.HASHES)]
    low, high = spark.range(200_000).select(F.least(*[F.min(c) for c in at]), F.greatest(*[F.max(c) for c in at])).first()
    assert 0 <= low and high < url_filter.LARGEST
    assert url_filter.bits_for(0) == 64 and url_filter.bits_for(url_filter.LARGEST // 10) == url_filter.LARGEST


def test_urls_of_a_listed_table_and_long_urls(spark):
    listed = spark.createDataFrame([(f"h{i}.example/x/{i % 3}",) for i in range(50)] * 2, "key string")
    urls = ["http://h7.example/x/1", "http://a.h7.example/x/1" + "y" * 100_000, "http://h7.example/x/2", "http://" + "a." * 5000 + "h8.example/x/2?q", "http://h7.example/x/1"]
    df = spark.createDataFrame([(1, u) for u in urls] + [(1, urls[0])], "page_id long, url string")
    got = sorted((r["path"][:5], r["verdict"]) for r in url_filter.judge(df, (), (), listed).collect())
    assert got == [("/x/1", "block")] * 3 + [("/x/1y", "block"), ("/x/2", "allow"), ("/x/2", "block")]


def test_licences_that_repeat_without_a_word_between(spark):
    texts = ["all rights reserved " * n for n in range(1, 9)]
    notice = license_scan.TEMPLATES[0][1]
    texts += [f"{notice} " * 5, f"x {notice} y z {notice}", "lorem ipsum " * 50_000 + "all rights reserved " * 20_000]
    rows = {r["doc_id"]: r for r in license_scan.scan(make(spark, texts)).collect()}
    assert all(rows[i]["labels"] == "all-rights-reserved" and rows[i]["score"] == 1.0 for i in (*range(8), 10))
    assert rows[8]["labels"] == rows[9]["labels"] == "mit"
    found = [tuple(r) for r in license_scan.spans(make(spark, texts)).where("doc_id = 9 and template = 0").select("first_word", "last_word", "coverage").collect()]
    assert sorted(found) == [(1, 5, 1.0), (8, 12, 1.0)]
    # three words inserted into a notice, at two places
    words = license_scan.TEMPLATES[1][1].split()
    text = " ".join([*words[:8], "kindly", *words[8:14], "oh", "so", *words[14:]])
    assert license_scan.scan(make(spark, [text])).first()["labels"] == "mit"


def test_licenses(spark):
    texts = ["Released under the MIT License. mit license", "x the GNU General Public\nLicense", "All Rights reserved!", None, "", "Licensed under -- CC BY-NC 4.0.", "mit licensed"]
    texts += ["Permission is hereby granted, FREE of charge, to any lucky person obtaining a copy of this software and associated documentation files"]
    rows = {r["doc_id"]: r for r in license_scan.scan(make(spark, texts)).collect()}
    assert [rows[i]["base_labels"] for i in range(8)] == ["mit", "gpl", "", "", "", "", "", ""]
    assert [rows[i]["labels"] for i in range(8)] == ["mit", "gpl", "all-rights-reserved", "", "", "cc-by-nc", "", "mit"]
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["n_words"]) == (2, 3, 5, 7)
    assert rows[3]["n_words"] == 0 and rows[3]["first_word"] is None and 0.75 <= rows[7]["score"] < 1
    assert license_scan.scan(make(spark, texts).where("doc_id < 0")).count() == 0
    twice = make(spark, texts[:2])
    assert license_scan.scan(twice.union(twice)).count() == 4


def test_edited_fingerprints(spark, texts):
    df = make(spark, texts)
    rows = {r["doc_id"]: r for r in imatch.edited_fingerprints(df.repartition(3)).collect()}
    t = [x or "" for x in texts]
    for i, x in enumerate(t):
        k = len(x) // 4
        edited = x[: len(x) - k] + t[(i + 1) % len(t)][:k]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(x)
        if edited == x:
            assert rows[i]["fingerprint"] == rows[i]["edited_fingerprint"] and rows[i]["near_edited"] == 1
    assert rows[3]["fingerprint"] == rows[42]["fingerprint"] and rows[42]["near_next"] == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows.values())
    assert imatch.edited_fingerprints(df.where("doc_id < 0")).count() == 0
    one = imatch.edited_fingerprints(df.where("doc_id = 3")).first()
    x, k = t[3], len(t[3]) // 4
    assert one["edited_sha256"] == hashlib.sha256((x[: len(x) - k] + x[:k]).encode()).hexdigest() and one["near_next"] == 1


def test_next_row_across_stretches(spark):
    ids = random.Random(4).sample(range(10**6), 90)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    rows = imatch.in_order(df, rows_each=7)
    from pyspark.sql import Window as W

    nxt = F.lead("text").over(W.partitionBy("_bucket").orderBy("_extra", F.col("doc_id").asc_nulls_last(), "_h"))
    got = {r["doc_id"]: r["n"] for r in rows.withColumn("n", nxt).where("_extra = 0").collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]])}

    # A third of the ids null and a third one id: each text is followed by the next in (id, hash) order.
    many = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    rows = imatch.in_order(df, rows_each=10).withColumn("n", nxt)
    got = {r["text"]: r["n"] for r in rows.where("_extra = 0").collect()}
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, _, t in sorted((d is None, (d or 0, hashes[t]), t) for d, t in many)]
    assert got == dict(zip(order, [*order[1:], order[0]]))
    assert rows.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 40


def test_fingerprints_equal_brute_force(spark):
    """Lexicon, subsets and likeness, computed anew with the xxhash library."""
    import struct

    import xxhash

    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([20, 400])]) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    texts += [texts[0] + " v1", texts[1].upper(), "v1", "", None]
    df = make(spark, texts)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = lambda h, seed: xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
    terms = [sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in (t or "").lower().split()}) for t in texts]
    df_of = {}
    for t in terms:
        for h in t:
            df_of[h] = df_of.get(h, 0) + 1
    lexicon = {h for h, n in df_of.items() if len(texts) * 0.02 <= n <= len(texts) * 0.25}

    def folded(hs):
        seed = 42
        for h in hs:
            seed = one(h, seed)
        return seed

    def fingerprint(t):
        own = [h for h in t if h in lexicon] or t
        # xxhash64(h, k) folds the int k (4 bytes) into the hash of h
        other = {h: signed(xxhash.xxh64_intdigest(struct.pack("<i", 1), one(h, 42))) for h in own}
        subsets = []
        for rate in imatch.RATES:
            row = []
            for m in range(imatch.SEEDS):
                value = lambda h: (h if m < 6 else other[h]) % (1 << 64) >> (m % 6 * imatch.FIELD)  # noqa: E731, B023
                some = [h for h in own if value(h) % (1 << rate) == 0]
                row.append(f"{folded(some) & 65535:04x}" if some else imatch.EMPTY)
            subsets.append(row)
        return f"{folded(own):016x}" if own else "", subsets

    def likeness(a, b):
        if a[0] == b[0]:
            return 1.0
        if not a[0] or not b[0]:
            return 0.0
        agree = [sum(p == q != imatch.EMPTY for p, q in zip(x, y)) for x, y in zip(a[1], b[1])]
        some = [sum(p != imatch.EMPTY or q != imatch.EMPTY for p, q in zip(x, y)) for x, y in zip(a[1], b[1])]
        k = max((k for k, n in enumerate(some) if 2 * n >= imatch.SEEDS), default=0)
        return sum(agree[k:]) / max(1, sum(some[k:]))

    want = [fingerprint(t) for t in terms]
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(df, 0.25, 0.02).collect()}
    for i, fp in enumerate(want):
        assert got[i]["fingerprint"] == "|".join([fp[0], *("".join(row) for row in fp[1])])
        assert got[i]["near_next"] == pytest.approx(likeness(fp, want[(i + 1) % len(want)]))
    assert got[1]["fingerprint"] == got[41]["fingerprint"]


def test_fingerprints_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None if i % 2 else i // 4, f"text {i % 7} of {i % 5}") for i in range(3000)], "doc_id long, text string")
    assert imatch.edited_fingerprints(df).count() == 3000


def test_languages(spark):
    rng = random.Random(6)
    de, en = "der die und nicht straße schön über ich zwei".split(), "the and with that this from which were have".split()
    rows = [(i, " ".join(rng.choice(de if i % 2 else en) for _ in range(40)), "de" if i % 2 else "en") for i in range(160)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 !?", None), (903, "the and that" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("_h", F.lit(1))
    out = {r["doc_id"]: r for r in langid.identify(df, steps=60).collect()}
    right = [out[i]["lang_pred"] == lang for i, _, lang in rows[:160] if out[i]["held_out"]]
    assert sum(right) >= 0.9 * len(right) > 0
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[903]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.where("doc_id < 0")).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(WORDS) for _ in range(rng.randint(30, 150))]
        if i % 3 == 0:
            for j in range(10, len(w), 25):
                w[j] = rng.choice(["nasty", "awful"]) + rng.choice(["", "ish", "er"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0), 9))
    rows += [(900, None), (901, ""), (902, "!!"), (903, "alpha " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(5))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(df, lab, steps=120).collect()}
    held = [i for i in range(300) if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == int(i % 3 == 0) for i in held) >= 0.9 * len(held) > 0
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert [out[i]["score"] for i in (900, 901, 902)] == [0, 0, 0] and out[903]["predicted"] == 0
    assert toxicity.toxicity(df.where("doc_id < 0"), lab).count() == 0
    assert toxicity.toxicity(df, lab.where("toxic > 1")).count() == len(rows)


def test_toxicity_sample(spark):
    """Labels of absent documents take no place; long texts are cut, not left out; ties and repeats are settled."""
    rows = [(i, f"t{i} " * (2000 if i == 1 else 3)) for i in range(40)] + [(2, "again"), (2, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    got = toxicity.sample(df, labels.union(labels), 50, 100)
    want = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(got["doc_id"]) == want and all(got["toxic"] == got["doc_id"] % 2) and got["text"].str.len().max() <= 104
    assert got[got["doc_id"] == 2]["text"].tolist() == ["again"]
    few = toxicity.sample(df.union(df), labels, 3, 100)
    assert few.groupby("toxic").size().tolist() == [3, 3] and set(few["doc_id"]) <= set(want)
    twice = df.where("doc_id in (3, 4)")
    scores = toxicity.toxicity(twice.union(twice), labels, train_on=df, steps=2).collect()
    assert len(scores) == 4 and len({(r["doc_id"], r["score"]) for r in scores}) == 2


def test_language_stage_rejects_below_the_score_where_it_is_often_wrong(spark):
    rng = random.Random(11)
    words = {"de": "der die und nicht straße schön über ich zwei".split(), "en": "the and with that this from which were have".split()}
    rows = []
    for i in range(600):
        lang = "de" if i % 2 else "en"
        mixed = i % 20 == 0  # texts in both languages, labelled with either
        rows.append((i, " ".join(rng.choice(words[rng.choice(["de", "en"]) if mixed else lang]) for _ in range(60)), rng.choice(["de", "en"]) if mixed else lang, "x", 1.0))
    rows += [(900, "123 !", "en", "x", 1.0), (901, None, "en", "x", 1.0), (902, rows[1][1], "de", "x", 1.0), (902, rows[1][1], "de", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang string, _lang_score double")
    model = langid.train(df, per_language=150, checked=150, steps=60)
    assert 0.5 < model["least"] < 1
    out = langid.accepted(df, per_language=150, checked=150, steps=60)
    kept = [r["doc_id"] for r in out.collect()]
    clean = [i for i in range(600) if i % 20]
    assert out.columns == df.columns and kept.count(902) == 2 and not {900, 901} & set(kept)
    assert len(set(kept) & set(clean)) >= 0.97 * len(clean) and len(set(kept) & set(range(0, 600, 20))) <= 25
    assert langid.least_score(model | {"langs": []}, None) == 0.0 and langid.accepted(df.where("doc_id < 0")).count() == 0


def test_toxicity_stage_leaves_columns_alone(spark):
    rows = [(i, "bad idiot words " * 5 if i % 4 == 0 else "good fine words " * 5, "x", 2.0) for i in range(80)] + [(900, None, "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _toxicity string, TOXIC double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    out = toxicity.accepted(df.union(df), labels, steps=40)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(2 * [*(i for i in range(80) if i % 4), 900])


def test_packing_of_repeated_and_null_rows(spark):
    rows = [(1, "a b c " * 200), (1, "a b c " * 200), (None, "x y"), (None, "x y"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("k"))
    out = packing.pack(df, queries.vocabulary_path(), window=64).collect()
    ends = [r for r in out if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == 6 and [r["doc_tokens"] for r in ends if r["doc_id"] in (3, 4)] == [1, 1]
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 64
    assert packing.pack(df.where("doc_id = 9"), queries.vocabulary_path(), window=64).count() == 0
