"""Fingerprints of files, tables and sets (inventory 2.17)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.contracts import require


def row_text(*cols: str) -> Column:
    """A row as canonical text: columns in the given order, null as \\N, joined by commas."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])


def frame_fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """H3: a digest of a table that doesn't depend on the order of its rows, repeats included.

    The sha256 of each row is summed in four 64-bit words modulo 2^64 (kept as decimals), and the sums
    and the count are hashed; so any number of rows is combined before the shuffle.
    """
    h = F.sha2(row_text(*cols), 256)
    words = [F.sum(F.conv(F.substring(h, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    text = F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(w, F.lit(0)).cast("string") for w in words])
    return df.agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("n"))


def set_fingerprint(c: Column) -> Column:
    """H5: sha256 of the distinct values, sorted, one on a line; for sets of bounded size."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(c.cast("string"))), "\n"), 256)


def sequence_fingerprint(key: Column, row: Column) -> Column:
    """H6: sha256 of the rows' JSON in the order of a key; for sequences of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("r"))))
    return F.sha2(F.array_join(F.transform(rows, lambda x: x["r"]), "\n"), 256)


def changed_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """H8: for every common column, how many keys have different values."""
    cols = [c for c in a.columns if c in b.columns and c != key]
    other = b.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in cols])
    counts = a.join(other, key).agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in cols])
    return counts.select(F.explode(rows).alias("x")).select("x.column", "x.changed")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """H1: name, length, md5 and sha256 of the files under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(name.alias("name"), "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def verified_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """H2: every listed file with its state: verified, differs, missing."""
    m = manifest.select("name", F.col("md5").alias("expected"))
    out = m.join(files.select("name", "md5"), "name", "left")
    state = F.when(F.col("md5").isNull(), "missing").when(F.col("md5") == F.col("expected"), "verified").otherwise("differs")
    return out.select("name", state.alias("state"))


def packed_text(c: Column | str) -> Column:
    """The UTF-8 bytes of a text after their number, as a big-endian unsigned 32-bit integer."""
    data = F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)


def _big_endian(v: pd.Series) -> pd.Series:
    raw = v.astype("float64").to_numpy(dtype=">f8").tobytes()
    return pd.Series([raw[i : i + 8] for i in range(0, len(raw), 8)])


def packed_double(c: Column | str) -> Column:
    """The eight big-endian IEEE-754 bytes of a double; null: not a number.  No SQL function has them."""
    pack = F.pandas_udf(_big_endian, T.BinaryType())
    return pack(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(float("nan"))))


def semantic_hash(df: DataFrame, key: str, values: list[str], most: int = 1_000_000) -> DataFrame:
    """H4: sha256 over ids and IEEE-754 bits in the order of the key.

    One digest over all rows in order needs them together, so a table of more than `most` rows raises;
    frame_fingerprint() is for tables of any size.
    """
    require(df.limit(most + 1).count() <= most, "table_size", f"more than {most} rows")
    rows = df.select(F.col(key).alias("k"), F.concat(packed_text(F.col(key).cast("string")), *[packed_double(c) for c in values]).alias("b"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", F.hex("b").alias("b")))), lambda r: r["b"])
    return rows.agg(F.sha2(F.unhex(F.array_join(ordered, "")), 256).alias("digest"))
