"""Embedding near-duplicates: random-hyperplane hashing, exact cosines, connected components.

Equal vectors are one class.  A class's sketch is the signs of its products with random hyperplanes;
each of several tables hashes it to some of these bits.  Classes of one bucket whose sketches are near
enough are candidates, and a pair counts in the first table in which it shares a bucket.  Only classes
with a candidate there carry their vector to that bucket, where all pairs are compared exactly, in
tiles.  A tile pair returns each class's number of links and a spanning forest, never all pairs.
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
from tessera.llm.simhash import SALT, forest

TILE = 2048  # sketches in a tile, and vectors at most
TILE_BYTES = 4 << 20  # of a tile's vectors
BUCKET = 512  # classes in a bucket, on average at most
MISSED = 0.015  # share of the pairs at exactly the least cosine that may share no bucket
SEEN = 4  # words of a sketch, at least, all of which are compared
BUCKETS = T.StructType(
    [
        T.StructField("rep", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)
PLACES = T.StructType([T.StructField("rep", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("code", T.IntegerType())])
FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def tables_for(n: int, least: float) -> tuple[int, int]:
    """Number of tables, and bits of each, for n classes.

    Buckets keep BUCKET classes on average, and there are as many tables as MISSED asks for.
    """
    bits = max(1, math.ceil(math.log2(max(2.0, n / BUCKET))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(MISSED) / math.log(1 - same)), bits


def reach(words: int, least: float) -> int:
    """Differing bits of a sketch up to which a pair is a candidate: 3.5 deviations above the mean at `least`."""
    n, p = 64 * words, math.acos(least) / math.pi
    return math.ceil(n * p + 3.5 * math.sqrt(n * p * (1 - p)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planes(dim: int, words: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, 64 * words))


def signs(x: np.ndarray, words: int, seed: int) -> np.ndarray:
    """(vectors, 64 * words) booleans: the sides of the hyperplanes on which unit vectors lie."""
    return x @ planes(x.shape[1], words, seed) >= 0


def codes_of(bits: np.ndarray, tables: int, width: int) -> np.ndarray:
    return bits[:, : tables * width].reshape(len(bits), tables, width) @ (1 << np.arange(width, dtype=np.int64))


def hasher(tables: int, width: int, words: int, seed: int):  # noqa: ANN201
    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len), sort=False):
                bits = signs(unit(np.stack(part["v"].to_list()).astype(np.float64)), words, seed)
                codes = codes_of(bits, tables, width).astype(np.int32)
                packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
                yield pd.DataFrame({"rep": part["rep"].array, "dim": np.int32(dim), "codes": list(codes), "sketch": packed})

    return hash_rows


def first_shared(x: np.ndarray, y: np.ndarray, t: int) -> np.ndarray:
    """Whether rows of codes, which agree in table t, agree in none before."""
    return ~(x[:, :t] == y[:, :t]).any(axis=1)


def proposer(limit: int):  # noqa: ANN201
    """mapInPandas function over pairs of tiles of sketches: the places (rep, t, code) of classes with a candidate."""

    def side(pdf: pd.DataFrame, k: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sketch = np.frombuffer(b"".join(pdf[f"{name}_sketch"].iat[k]), np.uint64).reshape(len(pdf[f"{name}_rep"].iat[k]), -1)
        return np.asarray(pdf[f"{name}_rep"].iat[k], np.int64), np.stack(pdf[f"{name}_codes"].iat[k]), sketch

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, (same, t, code) in enumerate(zip(pdf["same"], pdf["t"], pdf["code"], strict=True)):
                ids, cx, x = side(pdf, k, "x")
                ids2, cy, y = (ids, cx, x) if same else side(pdf, k, "y")
                hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
                for at in range(0, len(x), 256):
                    d = np.zeros((len(x[at : at + 256]), len(y)), np.uint16)
                    for w in range(x.shape[1]):
                        d += np.bitwise_count(x[at : at + 256, w, None] ^ y[None, :, w])
                    i, j = np.nonzero(d <= limit)
                    i += at
                    if same:
                        i, j = i[i < j], j[i < j]
                    new = first_shared(cx[i], cy[j], t)
                    hit_x[i[new]] = True
                    hit_y[j[new]] = True
                found = np.unique(np.concatenate([ids[hit_x], ids2[hit_y]]))
                if len(found):
                    yield pd.DataFrame({"rep": found, "t": np.int32(t), "code": np.int32(code)})

    return propose


def comparer(least: float, tables: int, width: int, words: int, seed: int):  # noqa: ANN201
    """mapInPandas function over pairs of tiles of vectors: links (a, b) of a spanning forest, and numbers of links (a, links)."""

    def side(pdf: pd.DataFrame, k: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        v = unit(np.stack(pdf[f"{name}_v"].iat[k]).astype(np.float64))
        return np.asarray(pdf[f"{name}_rep"].iat[k], np.int64), np.asarray(pdf[f"{name}_n"].iat[k], np.int64), v, codes_of(signs(v, words, seed), tables, width)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, (same, t) in enumerate(zip(pdf["same"], pdf["t"], strict=True)):
                ids, n, x, cx = side(pdf, k, "x")
                ids2, n2, y, cy = (ids, n, x, cx) if same else side(pdf, k, "y")
                near = x @ y.T >= least
                if same:
                    near &= np.arange(len(ids))[:, None] < np.arange(len(ids))[None, :]
                for e in range(t):  # the pair counted in an earlier table
                    near &= cx[:, e, None] != cy[None, :, e]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                d = np.where(near, 0, 1).astype(np.uint8)
                if same:
                    d = np.minimum(d, d.T)
                left, right = forest(d, 0, bool(same))
                yield pd.DataFrame({"a": ids[left], "b": pd.array(ids2[right], "Int64"), "links": 0})
                for who, other, sizes, own in ((i, j, n2, ids), (j, i, n, ids2)):
                    links = np.bincount(who, weights=sizes[other], minlength=len(own)).astype(np.int64)
                    yield pd.DataFrame({"a": own[links > 0], "b": pd.array([None] * int((links > 0).sum()), "Int64"), "links": links[links > 0]})

    return compare


def tile_pairs(rows: DataFrame, tile: int) -> DataFrame:
    """same, t, code, x_*, y_*: pairs of tiles of the rows of a bucket (dim, t, code); each other column as an array."""
    by = ["dim", "t", "code"]
    large = rows.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts")).where("parts > 1")
    held = [c for c in rows.columns if c not in by]
    dealt = rows.join(checked_broadcast(large), by, "left")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
    t = dealt.groupBy(*by, part.alias("part"), F.col("parts").isNotNull().alias("many")).agg(F.collect_list(F.struct(*held)).alias("x"))
    t = t.where("many or size(x) > 1")
    x, y = [F.col(f"x.{c}").alias(f"x_{c}") for c in held], [F.col(f"y.{c}").alias(f"y_{c}") for c in held]
    nothing = [F.lit(None).cast(T.ArrayType(rows.schema[c].dataType)).alias(f"y_{c}") for c in held]
    own = t.where("size(x) > 1").select(F.lit(True).alias("same"), "t", "code", *x, *nothing)
    many = t.where("many")
    other = many.select(*by, F.col("part").alias("part2"), F.col("x").alias("y"))
    pairs = many.join(other, by).where("part < part2").select(F.lit(False).alias("same"), "t", "code", *x, *y)
    return own.unionByName(pairs).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, tables: int | None = None, bits: int | None = None, tile: int = TILE, seed: int = 5
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Links have a cosine of `least` or more, computed in double precision; pairs below never link.
    Tables and their bits follow from the number of vectors, so that 98 in 100 of the pairs at a cosine
    of `least` are found, of closer ones more.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different lengths never link.  Equal vectors
    link with each other.  A row is a vector of its own, also where its id repeats or is null; a null id
    never names a component, unless all its members' are null, and is kept only there.  An empty
    table gives an empty result.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v"), F.when(v.isNotNull(), bad).alias("bad"))
    usable = F.coalesce(F.col("v").isNotNull() & ~F.col("bad") & F.exists("v", lambda x: x != 0), F.lit(False))
    key = F.when(usable, F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    rows = rows.select("vec_id", "v", key.alias("key"))
    ids = scratch.write(rows.select("vec_id", "key"))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = scratch.write(classes.withColumn("rep", F.monotonically_increasing_id()))  # a name that holds once it is written
    count, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    auto = tables_for(count, least)
    tables, bits = tables or auto[0], bits or auto[1]
    words = max(SEEN, -(-tables * bits // 64))
    sketches = classes.select("rep", "v").mapInPandas(hasher(tables, bits, words, seed), BUCKETS)
    sketches = scratch.write(sketches, rows=2048)
    placed = sketches.select("rep", "codes", "sketch", "dim", F.posexplode("codes").alias("t", "code"))
    places = tile_pairs(placed, tile).mapInPandas(proposer(reach(words, least)), PLACES)
    places = scratch.write(scratch.write(places, rows=32).distinct())
    # Vectors meet again where they have a candidate; most are alone and go nowhere.
    met = places.join(classes.select("rep", "n", "v", F.size("v").alias("dim")), "rep")
    most = max(64, min(tile, TILE_BYTES // (8 * longest)))
    found = tile_pairs(met.select("dim", "t", "code", "rep", "n", "v"), most)
    found = scratch.write(found.mapInPandas(comparer(least, tables, bits, words, seed), FOUND), rows=4)
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("b is not null").select("a", "b"), "a", "b", scratch)
    known = classes.select("key", "rep", "n", "least").join(links, "rep", "left")
    known = known.join(comp.select(F.col("node").alias("rep"), F.col("component").alias("root")), "rep", "left")
    known = known.select("key", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")).where("n_links > 0")
    lowest = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(lowest, "root").select("key", "n_links", "component", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = ids.withColumn("salt", F.floor(F.rand(1) * SALT).cast("int"))
    out = salted.join(known, ["key", "salt"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
