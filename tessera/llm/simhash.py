"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into cells by the population counts of their parts (halves, or finer
where there are more fingerprints).  Two fingerprints that differ in r bits lie in cells whose counts
differ by r in sum at most, so only such cells' tiles are compared, with numpy exclusive-or and bit
counts.  A pair of tiles returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, checked_broadcast, connected_components

TILE = 4096  # fingerprints in a tile, on average at most
SALT = 64  # parts into which the copies of one fingerprint are dealt in joins
PAIRS = 200_000  # comparisons of a fingerprint at most, on average, before cells are made finer
FINGERPRINTS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "fp")])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all k-word shingles (big-endian unsigned), repeats included; no words: none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # ASCII only: A-Z, and the white space \x20 \x09-\x0d
    if not words:
        return np.zeros(0, ">u8")
    flat = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    k = min(k, len(words))
    starts = (ends - n)[: len(words) - k + 1].tolist()
    return np.array([xxh64_intdigest(flat[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], ">u8")


def simhash64(text: bytes, k: int, seed: int = 42) -> int:
    """Bits that are set in over half of a text's shingle hashes, repeats included; no words: 0."""
    h = shingle_hashes(text, k, seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprinter(k: int):  # noqa: ANN201
    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([simhash64((t or "").encode("utf-8", "replace"), k) for t in pdf["text"].tolist()], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    return fingerprints


def forest(distance: np.ndarray, radius: int, same: bool) -> tuple[list[int], list[int]]:
    """Row and column numbers of a least spanning forest of the entries up to radius.

    distance (n, m), small integers; same: rows and columns are the same things.  Nearer entries come
    first, and each returned entry joined two groups, so there are fewer than n + m.
    """
    hit = distance <= radius
    rows = np.flatnonzero(hit.any(1))
    cols = rows if same else np.flatnonzero(hit.any(0))
    if len(rows) < len(distance) or len(cols) < distance.shape[1]:  # most things have no neighbour
        left, right = forest(distance[np.ix_(rows, cols)], radius, same)
        return rows[left].tolist(), cols[right].tolist()
    n, m = distance.shape
    label = np.arange(n if same else n + m)
    column = label[:m] if same else label[n:]  # a view: it follows label
    left, right = [], []
    for r in range(radius + 1):
        near = distance == r
        if same:
            np.fill_diagonal(near, False)
        for i in np.flatnonzero(near.any(1)):
            cols = np.flatnonzero(near[i])
            for j in cols[np.unique(column[cols], return_index=True)[1]]:
                if column[j] != label[i]:
                    left.append(int(i))
                    right.append(int(j))
                    label[label == column[j]] = label[i]
    return left, right


def differing(a: np.ndarray, b: np.ndarray, rows: int = 256) -> np.ndarray:
    """Numbers of differing bits between two tiles (uint64), in blocks of rows."""
    out = np.empty((len(a), len(b)), np.uint8)
    for at in range(0, len(a), rows):
        np.bitwise_count(a[at : at + rows, None] ^ b[None, :], out=out[at : at + rows])
    return out


def comparer(radius: int):  # noqa: ANN201
    """mapInPandas function over tile pairs: links of a least spanning forest of the pairs up to radius."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same, *tile in zip(pdf["same"], pdf["x"], pdf["y"], strict=True):
                x, y = (np.ascontiguousarray(v, np.int64).view(np.uint64) for v in tile)
                d = differing(x, y)
                if same:
                    np.fill_diagonal(d, 255)
                left, right = forest(d, radius, bool(same))
                if left:
                    yield pd.DataFrame({"a": x.view(np.int64)[left], "b": y.view(np.int64)[right]})

    return compare


def steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of the bit counts of `parts` parts that add up to radius at most; of d and -d, one."""
    out = [()]
    for _ in range(parts):
        out = [(*o, i) for o in out for i in range(-radius, radius + 1) if sum(map(abs, o)) + abs(i) <= radius]
    return [o for o in out if o >= (0,) * parts]


def finest(n: int, radius: int) -> int:
    """Parts whose bit counts make a cell: the fewest that leave a fingerprint PAIRS comparisons on average.

    For random fingerprints, bit counts of a part of w bits are equal with a chance of
    1 / sqrt(pi * w), and of the cells' neighbours len(steps) count.
    """
    for parts in (2, 4, 8):
        if n * len(steps(parts, radius)) / math.sqrt(math.pi * 64 / parts) ** parts <= PAIRS:
            return parts
    return 16 if radius <= 2 else 8


def links(distinct: DataFrame, radius: int, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Links a, b that connect all fingerprints (fp, distinct) within `radius` bits.

    A cell holds the fingerprints with the same bit counts of their parts.  Two fingerprints within
    the radius lie in cells whose counts differ by no more than it in sum, so only their tiles meet.
    """
    spark = distinct.sparkSession
    if parts is None:
        parts = finest(distinct.count(), radius) if radius <= 3 else 1
    width = 64 // parts
    mask = F.lit((1 << width) - 1) if width < 64 else F.lit(-1)
    counts = F.array(*[F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(mask)) for i in range(parts)])
    cells = distinct.select("fp", counts.alias("c"))
    size = cells.groupBy("c").agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts")).where("parts > 1")
    dealt = cells.join(checked_broadcast(size), "c", "left")
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
    # Sorted, because a tile is gathered once for each side of the pairs and its order must agree.
    t = dealt.groupBy("c", part.alias("part")).agg(F.sort_array(F.collect_list("fp")).alias("x"))
    ahead = F.array(*[F.array(*[F.lit(i) for i in o]) for o in steps(parts, radius)])
    left = t.select("x", F.col("part").alias("s"), "c", F.explode(ahead).alias("to"))
    own = F.forall("to", lambda i: i == 0)
    left = left.select("x", "s", own.alias("own"), F.zip_with("c", "to", lambda a, b: a + b).alias("c"))
    pairs = left.join(t.select("c", F.col("part").alias("o"), F.col("x").alias("y")), "c").where("not own or s < o or (s = o and size(x) > 1)")
    pairs = pairs.select((F.col("own") & (F.col("s") == F.col("o"))).alias("same"), "x", "y")
    return pairs.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(comparer(radius), LINKS)


def components(docs: DataFrame, shingle: int = 3, radius: int = 2, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """doc_id, fp (signed), component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable through fingerprints within `radius` bits.  Null, empty
    and blank texts have fingerprint 0 and link like any other; repeated rows and equal texts share a
    fingerprint.  Rows without an id link too; a null names a component only where it has no other id.  An empty table gives an empty result.  Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fps = scratch.write(rows.mapInPandas(fingerprinter(shingle), FINGERPRINTS), rows=400)
    groups = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = scratch.write(links(groups.select("fp"), radius, tile, parts), rows=64)
    found = connected_components(found, "a", "b", scratch)
    root = groups.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left")
    root = root.withColumn("component", F.coalesce("component", "fp"))
    lowest = root.groupBy("component").agg(F.min("least").alias("component_id"))
    # Only groups of several documents need their id looked up; their copies are dealt over SALT parts.
    known = root.join(lowest, "component").where("n > 1 or not component_id <=> least")
    known = known.select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = fps.withColumn("salt", F.floor(F.rand(1) * SALT).cast("int"))
    out = salted.join(known, ["fp", "salt"], "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """components() with the fingerprint as 16 lower-case hexadecimal digits."""
    out = components(docs, shingle, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
