"""Packing token sequences into windows by minimum bin slack.

Documents are cut into whole windows and one rest.  The rests' lengths form a multiset of at most
`window` different lengths, however many documents there are, so the plan is made from its counts:
each pattern holds the longest length that is left and, by a bitset subset-sum over the others, the
lengths that fill the window closest; it is repeated as often as the counts allow.  Documents get
their places by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, prefix_within

END = 1  # the id that closes every document
WINDOW = 2048
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def encoder(vocabulary: bytes):  # noqa: ANN201
    """Text to an array of ids, from a byte-level BPE file of the tokenizers library.

    The ids are those of that library.  A second implementation of the same merges does the work,
    several times faster; texts on which the two could differ (special strings) go to the library.
    """
    import json

    import tiktoken

    spec = json.loads(vocabulary)
    # The 256 printable stand-ins that byte-level BPE files use for bytes.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = []  # the library's own, made when the first text needs it

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_str(vocabulary.decode()))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def cutter(vocabulary, window: int, keep: bool):  # noqa: ANN001, ANN201
    """mapInPandas function: (doc_id, text) to pieces; vocabulary: a broadcast of the file's bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary.value)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window].tobytes()
                    out.append((doc, at, len(part) // 4, zlib.crc32(part), len(ids), part if keep else None))
            frame = pd.DataFrame(out, columns=PIECES.names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return cut


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) whose total comes closest to room without exceeding it.

    reach has bit s set if some choice of the lengths so far totals s.  Copies are added in powers
    of two.  Going back over the bitsets before each length gives the copies that were used.
    """
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        trail.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left > 0:
            k = min(step, left)
            reach |= (reach << (k * length)) & mask
            left, step = left - k, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        copies = 0
        while not before >> total & 1:
            total -= length
            copies += 1
        if copies:
            used.append((length, copies))
    return used[::-1]


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first copy)."""
    left, taken = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while left:
        seed = max(left)
        rest = {n: c - (n == seed) for n, c in left.items()}
        chosen = dict(fill(rest, window - seed))
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            rows.append((n, taken[n], sequence, c, offset))
            offset += n * c
            taken[n] += c * times
            left[n] -= c * times
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def pack_pieces(pieces: DataFrame, window: int, rows_each: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...), which must be a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `window` rows at most
    parts = max(1, -(-sum(counts.values()) // rows_each))
    by: dict[int, list] = {}
    for n, *row in plan(counts, window):
        by.setdefault(n, []).append(dict(zip(("rank", "sequence", "copies", "offset"), row, strict=True)))
    part = pa.struct([(c, pa.int64()) for c in ("rank", "sequence", "copies", "offset")])
    # An Arrow table; a list of rows would start Python workers of another kind on all executors, which stay.
    table = spark.createDataFrame(pa.table({"n": pa.array(list(by), pa.int64()), "a": pa.array(list(by.values()), pa.list_(part))}))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts))).withColumn("_one", F.lit(1))
    ranked = prefix_within(keyed, ["length"], "_bucket", ["doc_id", "start", "ids_crc32"], "_one", "_rank", nulls=False)
    placed = ranked.join(F.broadcast(table), F.col("length") == F.col("n"))
    at = F.get("a", F.size(F.filter("a", lambda x: x["rank"] <= F.col("_rank"))) - 1)
    placed = placed.withColumn("_p", at).withColumn("_k", F.col("_rank") - F.col("_p.rank"))
    copies = F.col("_p.copies")
    return placed.select(
        *pieces.columns,
        (F.col("_p.sequence") + F.floor(F.col("_k") / copies)).cast("long").alias("sequence_id"),
        (F.col("_p.offset") + F.col("_k") % copies * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for every piece.

    A document is its text's ids and END; a null or empty text has END only.  ids, where kept, are
    little-endian unsigned 32-bit.  Sequences have no gaps from 0; what lacks to `window` is padding.
    Each of several equal rows is packed; which of them gets which place is not defined.  An empty
    table gives an empty result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = rows.mapInPandas(cutter(vocabulary, window, keep_ids), PIECES)
    if not keep_ids:
        pieces = pieces.drop("ids")
    return pack_pieces(Scratch(spark, "packing").write(pieces, rows=400), window)
