"""Pairs of a group whose values differ by more than a tolerance, counted by their sides' features instead of made (inventory E11 and J9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = 4096, 65_536  # rows of a group on the two sides of one comparison


def apart(x: np.ndarray, held: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each x how many of the held values (in ascending order) lie below and above it by more than the tolerance, by x - value as rounded.

    The rounded difference never rises with the value, so both counts are places in the order; they are
    looked up and then moved until the differences beside them are as they should.
    """

    def settled(at: np.ndarray, beyond) -> np.ndarray:  # noqa: ANN001
        """The first place that is not `beyond`; these come first."""
        while True:
            up = (at < len(held)) & beyond(held[np.minimum(at, len(held) - 1)])
            down = ~up & (at > 0) & ~beyond(held[np.maximum(at - 1, 0)])
            if not (up.any() or down.any()):
                return at
            at = at + up - down

    if not len(held):
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    low = settled(np.searchsorted(held, x - tolerance, "left"), lambda v: x - v > tolerance)
    high = settled(np.searchsorted(held, x + tolerance, "right"), lambda v: ~(v - x > tolerance))
    return low, len(held) - high


def _tiles(df: DataFrame, group: str, key: str, features: list[str], y: str, size: int, name: str) -> DataFrame:
    """g and arrays of a group's rows, dealt by the key's hash into parts of about `size`; a value that is null or not finite is in none."""
    bare = [F.col(key).alias("k"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(y).cast("double").alias("y")]
    rows = df.select(F.col(group).alias("g"), *bare).where("g is not null and k is not null and abs(y) < double('Infinity')")
    parts = rows.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / F.lit(size)).alias("_n"))
    dealt = rows.join(parts, F.col("g") == F.col("_g")).withColumn("part", F.pmod(F.xxhash64("k"), F.col("_n")))
    held = ["k", *[f"f{i}" for i in range(len(features))], "y"]
    return dealt.groupBy("g", "part").agg(F.collect_list(F.struct(*held)).alias("x")).select("g", *[F.col(f"x.{c}").alias(f"{name}_{c}") for c in held])


def _compared(df: DataFrame, group: str, key: str, features: list[str], y: str, tolerance: float, tell, schema: str, left: int, right: int) -> DataFrame:  # noqa: ANN001
    """What tell(keys, kinds on the left, each row's kind, kinds on the right, counts) gives for the tiles of all groups, as rows.

    counts: for each kind on the right, how many of its rows lie below and above each row on the left.
    """
    a, b = _tiles(df, group, key, features, y, left, "a"), _tiles(df, group, key, features, y, right, "b").withColumnRenamed("g", "h")
    n = len(features)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for s in "ab":
                    flat = lambda c: batch.column(f"{s}_{c}")[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    kinds, of = np.unique(np.stack([flat(f"f{j}") for j in range(n)], 1), axis=0, return_inverse=True)
                    sides.append((kinds, of.reshape(-1), flat("y")))
                (mine, of, x), (others, to, v) = sides
                order = np.lexsort((v, to))
                v, ends = v[order], np.searchsorted(to[order], np.arange(len(others) + 1))
                counts = (apart(x, v[ends[j] : ends[j + 1]], tolerance) for j in range(len(others)))
                keys = batch.column("a_k")[i].values
                yield pa.RecordBatch.from_pydict(tell(keys, mine, of, others, counts))

    return a.join(b, F.col("g") == F.col("h")).drop("g", "h").repartition(4 * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def gap_histogram(df: DataFrame, group: str, key: str, features: list[str], y: str, tolerance: float, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """d0, d1, ..., won, pairs: of the ordered pairs of a group whose y differ by more than the tolerance, how many have each difference of features.

    won: 1 if the left y is the larger, else 0.  A row is compared with a group's distinct features, of which there
    should be few, by lookups in their sorted values; so no pair is made and the work grows as the rows.
    """
    n = len(features)

    def tell(keys, mine, of, others, counts) -> dict:  # noqa: ANN001
        count = np.zeros((2, len(mine), len(others)), np.int64)
        for j, (below, above) in enumerate(counts):
            for won, k in ((1, below), (0, above)):
                count[won, :, j] = np.bincount(of, k, len(mine))
        won, a, b = np.nonzero(count)
        return {f"d{j}": mine[a, j] - others[b, j] for j in range(n)} | {"won": won.astype(np.int32), "pairs": count[won, a, b]}

    ds = [f"d{j}" for j in range(n)]
    out = _compared(df, group, key, features, y, tolerance, tell, ", ".join(f"{d} double" for d in ds) + ", won int, pairs long", left, right)
    return out.groupBy(*ds, "won").agg(F.sum("pairs").alias("pairs"))


def mean_over_pairs(df: DataFrame, group: str, key: str, features: list[str], y: str, tolerance: float, value: dict[tuple, float], left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """key, pairs, mean: for each row with such pairs (see gap_histogram()) the mean of value[differences of features] over them."""

    def tell(keys, mine, of, others, counts) -> dict:  # noqa: ANN001
        worth = np.array([[value[tuple(d)] for d in (m - others).tolist()] for m in mine])
        pairs, total = np.zeros(len(of), np.int64), np.zeros(len(of))
        for j, (below, above) in enumerate(counts):
            pairs += below + above
            total += (below + above) * worth[of, j]
        return {"key": keys, "pairs": pairs, "total": total}

    out = _compared(df, group, key, features, y, tolerance, tell, f"key {df.schema[key].dataType.simpleString()}, pairs long, total double", left, right)
    out = out.groupBy("key").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total")).where("pairs > 0")
    return out.select(F.col("key").alias(key), "pairs", (F.col("total") / F.col("pairs")).alias("mean"))
