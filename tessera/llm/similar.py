"""Near copies by shingle similarity: SimHash fingerprints, tiled comparison, exact verification.

A document is the set of its distinct k-word shingles; equal sets are one class.  A class's fingerprint
is the majority of each bit over its shingles' hashes, in as many bits as needed.  Classes that agree on
all bits of some band are put into one cell, and inside it only classes of like sizes share tiles.  A
pair of tiles is compared by exclusive-or and bit counts; rows whose bit counts differ beyond the radius
are skipped.  A pair of tiles returns links that connect its candidates, never all of them.

What the links connect is then verified by exact Jaccard similarities.  A small part is gathered once
and all its pairs are counted.  In a large one the links themselves are verified first (among them one
from each class to the neighbour with most neighbours, so that copies meet their original); after that
all candidates between classes that are still apart are verified, in tiles.

Fingerprints only suggest, and may miss a pair.  So what they leave apart is compared by an exact filter
(see remaining()), and the groups are those of all pairs of the least similarity, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, annotate, batch_rows, checked_broadcast, connected_components, fresh
from tessera.llm.simhash import SALT, forest, shingle_hashes

TILE = 2048  # classes in a tile of fingerprints, on average at most
CELL = 16384  # classes in a cell, on average at most
PART = 256  # classes of a part that is gathered in one row, and of a tile that carries shingle sets
ELEMENTS = 500_000  # shingles of such a part or tile (4 MB), unless a single text has more
SEEN = 128  # bits of the fingerprint that are compared
MISSED = 0.005  # share of the pairs at exactly the least similarity that may agree on no band
SAMPLED = 8192  # classes, on average, whose shingles tell which are common; it is an order only, no shingle is left out
COMMON = 50_000  # shingles of that order
DENSE = 64  # classes that share a shingle, above which their tiles carry parities and return a forest of the candidates, not each
RATIO = 1.25001  # classes of one tile differ in size by this factor at most
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
SKETCH = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("doc_id", "h", "key")),
        T.StructField("n", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("s0", "s1")),
        T.StructField("cells", T.ArrayType(T.IntegerType())),
        T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("parity", T.BinaryType()),
    ]
)


def bit_chance(least: float) -> float:
    """Chance that a bit differs between two texts of that similarity: the angle of their sets over pi."""
    return math.acos(2 * least / (1 + least)) / math.pi


def bands(n: int, least: float, cell: int = CELL) -> tuple[int, int]:
    """Bits of a band and number of bands for n classes.

    Bands are as wide as keeps cells at `cell` classes on average, and as many as MISSED asks for; so
    the comparisons of a class do not grow with n, and its bands grow with log(n) to a power.  What they miss
    remaining() finds.
    """
    width = max(0, math.ceil(math.log2(max(1.0, n / cell))))
    return width, 1 if width == 0 else math.ceil(math.log(MISSED) / math.log(1 - (1 - bit_chance(least)) ** width))


def radius(least: float) -> int:
    """Differing bits of SEEN up to which two classes are candidates: 3.1 deviations above the mean at `least`."""
    p = bit_chance(least)
    return math.ceil(SEEN * p + 3.1 * math.sqrt(SEEN * p * (1 - p)))


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """(64 * words,) booleans: bits that are set in over half of the hashes, each mixed anew for every word."""
    ones = np.zeros(64 * words, np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):
        z = h[at : at + 255, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return 2 * ones > len(h)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct XXH64 of a text's k-word shingles; no words: none."""
    return np.unique(shingle_hashes((text or "").encode("utf-8", "replace"), k).astype(np.uint64))


def key_of(s: np.ndarray) -> int:
    """XXH64 of a shingle set, the name of its class; empty: 0."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(s.astype(">u8").tobytes()) if len(s) else 0


def prefix(s: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set (sorted) in an order that all sets share: common ones last, rarer first, then by hash.

    Sets of the least similarity share at least ceil(least * size) shingles of each, so they share one of these.
    """
    kept = len(s) - math.ceil(least * len(s) - 1e-9) + 1
    order = np.argsort(common, kind="stable") if len(common) else np.zeros(1, np.int64)
    names = common[order] if len(common) else np.zeros(1, np.uint64)
    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
    rank = np.where(names[at] == s, order[at] + 1, 0) if len(common) else np.zeros(len(s), np.int64)
    return s[np.argsort(rank, kind="stable")[:kept]]


def parity(s: np.ndarray) -> bytes:
    """Whether the number of shingles is odd, by their last bits; at least two bits a shingle.

    Two sets differ in as many shingles at least as their parities differ in bits.
    """
    width = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def parities(raw: list[bytes], width: int) -> np.ndarray:
    """(len(raw), width // 8): parities as words, longer ones folded to `width` bytes."""
    return np.array([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0) for b in raw])


def sketcher(k: int, width: int, count: int, least: float, common):  # noqa: ANN001, ANN201
    words = max(SEEN // 64, -(-width * count // 64))

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        power = 1 << np.arange(width, dtype=np.int64)
        for pdf in batches:
            keys, sizes, seen, cells, first, odd = [], [], np.zeros((len(pdf), SEEN // 8), np.uint8), [], [], []
            for i, text in enumerate(pdf["text"].tolist()):
                s = shingle_set(text, k)
                bits = majority(s, words)
                keys.append(key_of(s))
                sizes.append(len(s))
                first.append(prefix(s, common.value, least).view(np.int64))
                odd.append(parity(s))
                seen[i] = np.packbits(bits[:SEEN])
                cells.append((bits[: width * count].reshape(count, width) @ power if width else np.zeros(1)).astype(np.int32))
            pair = seen.view(np.int64)
            key = np.array(keys, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "h": pdf["h"], "key": key, "n": sizes, "s0": pair[:, 0], "s1": pair[:, 1], "cells": cells, "prefix": first, "parity": odd})

    return sketches


def near_bits(x: dict, y: dict, limit: int, least: float, rows: int = 256) -> np.ndarray:
    """(len(x), len(y)): differing bits where two classes are candidates, else 255.  Tiles are ordered by bit count."""
    out = np.full((len(x["key"]), len(y["key"])), 255, np.uint8)
    for at in range(0, len(out), rows):
        part = slice(at, at + rows)
        count = x["count"][part]
        lo, hi = np.searchsorted(y["count"], [count[0] - limit, count[-1] + limit + 1])
        d = np.bitwise_count(x["s0"][part, None] ^ y["s0"][None, lo:hi])
        d += np.bitwise_count(x["s1"][part, None] ^ y["s1"][None, lo:hi])
        nx, ny = x["n"][part, None], y["n"][None, lo:hi]
        d[(d > limit) | (nx < least * ny) | (ny < least * nx)] = 255
        out[part, lo:hi] = d
    return out


def unpacked(pdf: pd.DataFrame, i: int, side: str) -> dict:
    """The columns of a tile, ordered by the bit count of the fingerprint."""
    out = {c[2:]: np.asarray(pdf[c].iat[i], None if c == f"{side}_s" else np.int64) for c in pdf if c.startswith(f"{side}_")}
    out |= {c: out[c].view(np.uint64) for c in ("s0", "s1") if c in out}
    out["count"] = sum((np.bitwise_count(out[c]).astype(np.int64) for c in ("s0", "s1") if c in out), np.zeros(len(out["key"]), np.int64))
    order = np.lexsort((out["key"], out["count"]))
    sets = {"s": [np.frombuffer(out["s"][k], np.int64) for k in order]} if "s" in out else {}
    return {c: v[order] for c, v in out.items() if c != "s"} | sets


def proposer(limit: int, least: float):  # noqa: ANN201
    """mapInPandas function over tile pairs: a spanning forest of the candidates, and each class's best-connected one."""

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, same in enumerate(pdf["same"]):
                x = unpacked(pdf, k, "x")
                y = x if same else unpacked(pdf, k, "y")
                d = near_bits(x, y, limit, least)
                if same:
                    np.fill_diagonal(d, 255)
                near = d <= limit
                if not near.any():
                    continue
                i, j = forest(d, limit, bool(same))
                a, b = [x["key"][i]], [y["key"][j]]
                for hit, own, other in ((near, x["key"], y["key"]), (near.T, y["key"], x["key"]))[: 1 if same else 2]:
                    some = np.flatnonzero(hit.any(1))
                    degree = hit.sum(0, dtype=np.int32)
                    best = [int(np.where(row, degree, -1).argmax()) for row in hit[some]]
                    a.append(own[some])
                    b.append(other[best])
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return propose


def common(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """(len(x), len(y)): sizes of the intersections of sorted sets, by products of incidence matrices."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat = np.concatenate([*x, *y]) if len(x) + len(y) else np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in (*x, *y)], np.int64)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = times[column] > 1
    row, column = row[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        held = np.zeros((len(sizes), min(width, int(column[hi - 1]) - at + 1)), np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def similarities(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)): Jaccard similarities; two empty sets: 0."""
    both = common(x, y).astype(np.float64)
    total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
    return both / np.maximum(total, 1)


def verifier(limit: int, least: float):  # noqa: ANN201
    """mapInPandas function over tile pairs with sets: verified links that connect what all verified ones would.

    Classes of one label are connected already.  In a `whole` row all pairs count, else candidates (without
    fingerprints, all of like sizes).
    """

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, (same, whole) in enumerate(zip(pdf["same"], pdf["whole"], strict=True)):
                x = unpacked(pdf, k, "x")
                y = x if same else unpacked(pdf, k, "y")
                hit = x["label"][:, None] != y["label"][None, :]
                if "s0" not in x:
                    hit &= (x["n"][:, None] >= least * y["n"][None, :]) & (y["n"][None, :] >= least * x["n"][:, None])
                elif not whole:
                    hit &= near_bits(x, y, limit, least) <= limit
                i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                if not len(i):
                    continue
                hit = hit[np.ix_(i, j)] & (similarities([x["s"][v] for v in i], [y["s"][v] for v in j]) >= least)
                d = np.zeros((len(x["key"]), len(y["key"])), np.uint8) + 255
                d[np.ix_(i, j)] = np.where(hit, 0, 255)
                left, right = forest(d, 0, bool(same))
                yield pd.DataFrame({"a": x["key"][left], "b": y["key"][right]})

    return verify


def confirm(least: float):  # noqa: ANN201
    """mapInPandas function over links with both sets: those of the least similarity."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = ([np.frombuffer(s, np.int64) for s in pdf[c]] for c in ("sa", "sb"))
            k = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - k
            yield pdf[["a", "b"]][k >= least * total]

    return check


def like_size(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(RATIO)).cast("int")


def tile_pairs(rows: DataFrame, where: list[str], tile: int, elements: int | None = None) -> DataFrame:
    """same, x_*, y_*: pairs of tiles of rows (key, n, ...) that share a cell and have like sizes; each column as an array.

    A cell is dealt into as many parts as keep them at `tile` rows (and `elements` shingles) on average.
    """
    by = [*where, "z"]
    rows = rows.withColumn("z", like_size(F.col("n")))
    parts = F.ceil(F.count("*") / F.lit(tile))
    if elements:
        parts = F.greatest(parts, F.least(F.count("*"), F.ceil(F.sum("n") / F.lit(elements))))
    sizes = rows.groupBy(*by).agg(parts.alias("parts")).where("parts > 1")
    dealt = rows.join(checked_broadcast(sizes), by, "left")
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    held = [c for c in rows.columns if c not in by]
    # A tile is gathered once for each side of the pairs; its order is fixed when it is read.
    t = dealt.groupBy(*by, part.alias("part")).agg(F.collect_list(F.struct(*held)).alias("x"))
    left = t.withColumn("to", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("z", F.col("z") + F.col("to"))
    right = t.select(*by, F.col("part").alias("other"), F.col("x").alias("y"))
    pairs = left.join(right, by).where("to = 1 or part < other or (part = other and size(x) > 1)")
    same = (F.col("to") == 0) & (F.col("part") == F.col("other"))
    return pairs.select(same.alias("same"), *[F.col(f"x.{c}").alias(f"x_{c}") for c in held], *[F.when(~same, F.col(f"y.{c}")).alias(f"y_{c}") for c in held])


def links(docs: DataFrame, groups: DataFrame, single: DataFrame, shingle: int, least: float, tile: int, part: int, scratch: Scratch) -> DataFrame:
    """Verified links (a, b) of classes, which connect what all verified candidates would connect."""
    limit, cores = radius(least), docs.sparkSession.sparkContext.defaultParallelism
    some = groups.where("n > 0")
    held = some.select("key", F.col("n").cast("long").alias("n"), "s0", "s1", F.posexplode("cells").alias("band", "cell"))
    pairs = tile_pairs(held, ["band", "cell"], tile)
    proposed = scratch.write(pairs.repartition(4 * cores).mapInPandas(proposer(limit, least), LINKS), rows=64)
    proposed = scratch.write(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return settled(docs, proposed, some.withColumn("label", F.col("key")), held, ["band", "cell"], ("s0", "s1"), single, shingle, least, part, scratch)


def settled(
    docs: DataFrame, proposed: DataFrame, some: DataFrame, held: DataFrame, where: list[str], bits: tuple, single: DataFrame, shingle: int, least: float, part: int, scratch: Scratch
) -> DataFrame:
    """Verified links (a, b) of classes of different labels, which connect what all verified candidates would connect.

    proposed (a, b) connects all candidates; some has the classes, held their cells (columns `where`).
    """
    limit, cores = radius(least), docs.sparkSession.sparkContext.defaultParallelism
    comps = connected_components(proposed, "a", "b", scratch)
    ends = some.select("key", F.col("n").cast("long").alias("n"), *bits, "label", "rep")
    ends = scratch.write(ends.join(comps.withColumnRenamed("node", "key"), "key"))
    # A set is computed from the text of the first document of its class.
    reps = checked_broadcast(ends.select(F.col("key").alias("_key"), F.col("rep.doc_id").alias("_doc"), F.col("rep.h").alias("_hash")))
    texts = single.join(reps, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_hash"))).select("_key", "text")
    sets = annotate(texts, "text", set_bytes(shingle), [T.StructField("s", T.BinaryType())], keep_text=False)
    sets = scratch.write(sets.withColumnRenamed("_key", "key"))
    size = ends.groupBy("component").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    large = scratch.write(size.where((F.col("nodes") > part) | (F.col("shingles") > ELEMENTS)).select("component"))
    row = ("key", "n", *bits, "label", "s")
    small = ends.join(checked_broadcast(large), "component", "left_anti").join(sets, "key")
    gathered = small.groupBy("component").agg(F.collect_list(F.struct(*row)).alias("x")).where("size(x) > 1")
    gathered = gathered.select(F.lit(True).alias("same"), F.lit(True).alias("whole"), *[F.col(f"x.{c}").alias(f"x_{c}") for c in row])
    found = scratch.write(gathered.repartition(4 * cores).mapInPandas(verifier(limit, least), LINKS), rows=16)
    if not large.limit(1).count():
        return found
    mine = ends.join(checked_broadcast(large), "component", "left_semi")
    first = proposed.join(mine.select(F.col("key").alias("a")), "a", "left_semi")
    first = first.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    sure = scratch.write(first.mapInPandas(confirm(least), LINKS), rows=64)
    # Classes that were one label stay one.
    told = sure.unionByName(mine.where("label <> key").select(F.col("key").alias("a"), F.col("label").alias("b")))
    joined = connected_components(told, "a", "b", scratch).select(F.col("node").alias("key"), F.col("component").alias("_label"))
    mine = scratch.write(mine.join(joined, "key", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label"))
    # Parts whose classes these links connect are done.
    apart = mine.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("component")
    mine = mine.join(checked_broadcast(apart), "component", "left_semi").join(sets, "key").select("component", *row)
    crossed = tile_pairs(mine.join(held.select("key", *where), "key"), ["component", *where], part, ELEMENTS)
    crossed = crossed.where("size(array_distinct(concat(x_label, coalesce(y_label, array())))) > 1").withColumn("whole", F.lit(False))
    rest = scratch.write(crossed.repartition(4 * cores).mapInPandas(verifier(limit, least), LINKS), rows=16)
    return found.unionByName(sure).unionByName(rest)


def filtered(x: dict, y: dict, least: float, same: bool) -> np.ndarray:
    """(tile pairs, classes of x, classes of y): whether label, sizes and the place of the shared shingle allow the least similarity.

    With the first shingle that two sets share at places i and j, they share no more than what is left of each from there on.
    """
    nx, ny = x["n"][:, :, None], y["n"][:, None, :]
    room = np.minimum(nx - x["at"][:, :, None], ny - y["at"][:, None, :])
    hit = (x["label"][:, :, None] != y["label"][:, None, :]) & (nx >= least * ny) & (ny >= least * nx)
    hit &= room >= least / (1 + least) * (nx + ny) - 1e-6
    return np.triu(hit, 1) if same else hit


def unlike(px: np.ndarray, py: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows of parities differ in more bits than sets of that similarity can."""
    return np.bitwise_count(px ^ py).sum(1, dtype=np.int64) > (1 - least) / (1 + least) * (nx + ny) + 1e-6


def suggester(least: float):  # noqa: ANN201
    """mapInPandas function over tile pairs of classes that share a shingle of their prefixes: their candidates, as far as filtered() tells."""

    def suggest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes: dict[tuple, list[tuple]] = {}
            for k, same in enumerate(pdf["same"].tolist()):
                x = {c: pdf[f"x_{c}"].iat[k] for c in ("key", "n", "label", "at")}
                y = x if same else {c: pdf[f"y_{c}"].iat[k] for c in x}
                shapes.setdefault((same, len(x["key"]), len(y["key"])), []).append((x, y))
            for (same, m, q), all_ in shapes.items():
                for at in range(0, len(all_), each := max(1, 1_000_000 // (m * q))):
                    x, y = ({c: np.array([t[side][c] for t in all_[at : at + each]], np.int64) for c in ("key", "n", "label", "at")} for side in (0, 1))
                    k, i, j = np.nonzero(filtered(x, y, least, same))
                    a, b = x["key"][k, i], y["key"][k, j]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return suggest


def dense_suggester(least: float):  # noqa: ANN201
    """The same over tiles with parities: a forest that connects the candidates which parities leave."""

    def suggest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, same in enumerate(pdf["same"].tolist()):
                x = {c: pdf[f"x_{c}"].iat[k] for c in ("key", "n", "label", "at", "parity")}
                y = x if same else {c: pdf[f"y_{c}"].iat[k] for c in x}
                width = min(map(len, (*x["parity"], *y["parity"])))
                px, py = (parities(t["parity"], width) for t in (x, y))
                x, y = ({c: np.array(t[c], np.int64)[None] for c in ("key", "n", "label", "at")} for t in (x, y))
                _, i, j = np.nonzero(filtered(x, y, least, same))
                d = np.full((len(px), len(py)), 255, np.uint8)
                for at in range(0, len(i), step := max(1, 4_000_000 // width)):
                    p, q = i[at : at + step], j[at : at + step]
                    d[p, q] = np.where(unlike(px[p], py[q], x["n"][0, p], y["n"][0, q], least), 255, 0)
                i, j = forest(np.minimum(d, d.T) if same else d, 0, same)
                yield pd.DataFrame({"a": x["key"][0, i], "b": y["key"][0, j]})

    return suggest


def sifter(least: float):  # noqa: ANN201
    """mapInPandas function over pairs with sizes and parities: those that the parities leave."""

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            width = np.minimum(pdf["pa"].map(len), pdf["pb"].map(len)).to_numpy()
            for w in np.unique(width).tolist():
                part = pdf[width == w]
                far = unlike(parities(part["pa"].tolist(), w), parities(part["pb"].tolist(), w), part["na"].to_numpy(), part["nb"].to_numpy(), least)
                yield part[["a", "b"]][~far]

    return sift


def remaining(docs: DataFrame, groups: DataFrame, known: DataFrame, single: DataFrame, shingle: int, least: float, tile: int, part: int, scratch: Scratch) -> DataFrame | None:
    """Verified links (a, b) between groups that `known` (node, component) leaves apart: with it, they connect all classes of the least similarity.

    Similar sets share a shingle of their prefixes.  Only shingles in the prefixes of classes of several groups are gone into, so
    a group of near copies that is connected already costs a row for each shingle of a prefix and no pair.  What sizes, places and
    parities leave is verified by the sets themselves.  None: there are no such links.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    some = groups.where("n > 0").withColumn("n", F.col("n").cast("long"))
    some = some.join(checked_broadcast(known.withColumnRenamed("node", "key"), 200_000), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
    places = some.select("key", "n", "label", F.posexplode("prefix").alias("at", "shingle")).withColumn("at", F.col("at").cast("long"))
    shared = places.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("classes")).where("low <> high")
    shared = scratch.write(shared.select("shingle", "classes"))
    held = scratch.write(places.join(checked_broadcast(shared.select("shingle"), 200_000), "shingle"))
    dense = checked_broadcast(shared.where(F.col("classes") > DENSE).select("shingle"), 200_000)
    pairs = tile_pairs(held.join(dense, "shingle", "left_anti"), ["shingle"], tile)
    pairs = scratch.write(pairs.repartition(4 * cores).mapInPandas(suggester(least), LINKS), rows=4096).distinct()
    odd = some.select("key", "n", "parity")
    for c in "ab":
        pairs = pairs.join(odd.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")), c)
    proposed = scratch.write(pairs.mapInPandas(sifter(least), LINKS), rows=1024)
    if dense.limit(1).count():
        tiles = tile_pairs(held.join(dense, "shingle", "left_semi").join(odd.select("key", "parity"), "key"), ["shingle"], tile, 8 * ELEMENTS)
        proposed = proposed.unionByName(scratch.write(tiles.repartition(4 * cores).mapInPandas(dense_suggester(least), LINKS), rows=16))
    proposed = scratch.write(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not proposed.limit(1).count():
        return None
    return settled(docs, proposed, some, held, ["shingle"], (), single, shingle, least, part, scratch)


def common_shingles(rows: DataFrame, shingle: int, n: int) -> np.ndarray:
    """Shingles of several of about SAMPLED texts, drawn by a hash of the text (copies of one text count once); the commonest last, COMMON at most."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"shingle": np.concatenate([shingle_set(t, shingle) for t in pdf["text"]]).view(np.int64)})

    batch_rows(rows.sparkSession)
    share = min(1.0, SAMPLED / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"]).select("text")
    times = drawn.mapInPandas(shingles, "shingle long").groupBy("shingle").count().where("count > 2")
    best = times.orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()
    return best["shingle"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def set_bytes(k: int):  # noqa: ANN201
    """For annotate(): each text's shingle set as sorted 64-bit integers."""

    def make():  # noqa: ANN202
        return lambda texts: ([np.sort(shingle_set(t, k).view(np.int64)).tobytes() for t in texts],)

    return make


def classes(docs: DataFrame, shingle: int = 5, least: float = 0.8, tile: int = TILE, part: int = PART, cell: int = CELL) -> DataFrame:
    """doc_id, h, rep for every row of docs (doc_id, text): h is the text's hash, rep the (doc_id, h) that stands for its group.

    Groups are connected by shingle similarities of `least` or more.  rep is the group's smallest id
    (null ids come last), of equal ids the one with the smallest hash.  Texts of equal shingle sets are
    one group, and so are all texts without a word.  Equal ids with different texts are different
    documents.  An empty table gives an empty result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    n = docs.count()
    width, count = bands(n, least, cell)
    common = spark.sparkContext.broadcast(common_shingles(rows, shingle, n))
    sketched = scratch.write(rows.mapInPandas(sketcher(shingle, width, count, least, common), SKETCH), rows=400)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    groups = sketched.groupBy("key").agg(first, F.count("*").alias("docs"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "cells", "prefix", "parity")])
    groups = scratch.write(groups)
    twice = sketched.groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    single = rows.dropDuplicates(["doc_id", "h"]) if twice else rows
    found = scratch.write(connected_components(links(docs, groups, single, shingle, least, tile, part, scratch), "a", "b", scratch))
    more = remaining(docs, groups, found, single, shingle, least, tile, part, scratch)
    if more is not None:
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b", scratch)
    root = groups.join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = root.groupBy("component").agg(F.min("rep").alias("best"), F.sum("docs").alias("members"))
    # Only groups of several documents need another representative; their copies are dealt over SALT parts.
    known = root.join(lowest, "component").where("members > 1").select("key", "best")
    known = known.select("key", "best", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = sketched.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALT)).cast("int"))
    out = salted.join(known, ["key", "salt"], "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    return out.select("doc_id", "h", F.coalesce("best", own).alias("rep"))


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, **kw) -> DataFrame:  # noqa: ANN003
    """The rows of docs, unchanged, that stand for their group (see classes()); repeated rows come once.

    Of several rows with one id and one text, one stays; rows with one id and different texts are
    judged each by its own text.  Null and empty texts and such without a word are one group.  A tie
    between ids is decided by the text's hash.  An empty table stays empty; extra columns pass, whatever their names.
    """
    found = Scratch(docs.sparkSession, "kept").write(classes(docs, shingle, least, **kw))
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("h") == F.col("rep.h")))).select("doc_id", "h").distinct()
    h, d, g = (fresh(docs, c) for c in ("hash", "id", "gone"))
    gone = checked_broadcast(gone.select(F.col("doc_id").alias(d), F.col("h").alias(g)))
    rows = docs.withColumn(h, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left_anti")
    twice = found.groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    # Texts are shuffled only if rows repeat.
    return (out.dropDuplicates(["doc_id", h]) if twice else out).drop(h)
