"""Signed feature hashing of text (inventory D15)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\b\w+\b")
GAP = re.compile(r"\s\s+")
FIELDS = ("char_at", "char_value", "word_at", "word_value")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def char_hashes(text: str, low: int, high: int) -> np.ndarray:
    """Hashes of all runs of low to high characters, white space of two or more characters taken as one blank."""
    points = np.frombuffer(GAP.sub(" ", text).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    out = []
    for n in range(low, high + 1):
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = mixed(h * np.uint64(0x100000001B3) + points[j : j + len(h)])
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of all words and of all pairs of neighbouring words."""
    known: dict[str, int] = {}
    one = []
    for w in WORD.findall(text):
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        one.append(known[w])
    h = np.array(one, dtype=np.uint64)
    return np.concatenate([h, mixed(h[:-1] * np.uint64(0x100000001B3) + h[1:])]) if len(h) else h


def signed(h: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns in ascending order and their sums of signs, scaled to length 1; sums of zero are left out.

    A hash's low bits are its column, the bit above them its sign.
    """
    at = (h % np.uint64(columns)).astype(np.int64)
    sign = 1 - 2 * ((h // np.uint64(columns)) % np.uint64(2)).astype(np.int64)
    col, place = np.unique(at, return_inverse=True)
    value = np.bincount(place, weights=sign, minlength=len(col))
    col, value = col[value != 0], value[value != 0]
    return col, value / np.linalg.norm(value) if len(value) else value


PIECE = 1 << 20  # bytes of text whose vectors a worker holds at once, unless a single text has more


def pieces(batches: Iterator) -> Iterator:
    """Arrow batches cut where their texts (column t) come to PIECE bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        t = b.column("t")
        ends = np.cumsum(pc.binary_length(t.cast(pa.binary())).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            yield b.slice(at, to - at)
            at = to


def hashed_features(docs: DataFrame, key: str, text: str, columns: int = 1 << 16) -> DataFrame:
    """key, char_at, char_value, word_at, word_value: two sparse vectors of length 1 for each text.

    Character runs of 3 to 5, and words and pairs of words, case kept, are hashed to `columns` columns
    each, with a sign from the hash, so that collisions cancel on average.  A null text is empty, and an
    empty one has no columns.  A row's vectors are bounded by its text and by `columns`, and a worker holds
    those of PIECE bytes of text at once, however large the batches that it is given.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists(parts: list[np.ndarray], kind) -> pa.Array:  # noqa: ANN001
            ends = np.cumsum([0, *map(len, parts)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))

        for b in pieces(batches):
            cols: tuple[list, ...] = ([], [], [], [])
            for t in b.column("t").to_pylist():
                for k, h in enumerate((char_hashes(t, 3, 5), word_hashes(t))):
                    at, value = signed(h, columns)
                    cols[2 * k].append(at.astype(np.int32))
                    cols[2 * k + 1].append(value)
            arrays = [lists(c, pa.int32() if k % 2 == 0 else pa.float64()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([b.column("key"), *arrays], names=["key", *FIELDS])

    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = d.mapInArrow(run, f"key {kind}, char_at array<int>, char_value array<double>, word_at array<int>, word_value array<double>")
    return out.withColumnRenamed("key", key)
