"""Sources and sinks (inventory 2.1)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.contracts import require


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """Tab for .tsv and .txt, comma for others; types are given, not guessed; columns are pruned."""
    sep = "\t" if path.lower().rstrip("/").endswith((".tsv", ".txt")) else ","
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False)
    return df.select(*columns) if columns else df


def sharded(spark: SparkSession, path: str, shards: int, rows_each: int | None = None) -> DataFrame:
    """Parquet with an exact number of files (and of rows in each)."""
    df = spark.read.parquet(path)
    counts = df.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
    got = counts.agg(F.count("*"), F.min("n"), F.max("n")).first()
    require(got[0] == shards, "shards", f"{got[0]}, not {shards}")
    require(rows_each is None or got[1] == got[2] == rows_each, "shard_rows", f"{got[1]} to {got[2]}")
    return df


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped, or (strict) raise, as do lines that are no record."""
    lines = spark.read.text(path)
    blank = F.trim("value") == ""
    if strict:
        require(lines.where(blank).limit(1).count() == 0, "blank_line", path)
    parsed = lines.where(~blank).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    first = T.StructType.fromDDL(schema).fieldNames()
    if strict:
        empty = reduce(lambda a, b: a & b, [F.col(f"r.{c}").isNull() for c in first])
        require(parsed.where(empty).limit(1).count() == 0, "bad_record", path)
    return parsed.select("r.*")


def record_text(record: Column) -> Column:
    """The text of a JSON record: a string itself, or its text, input or original field."""
    fields = [F.get_json_object(record, f"$.{k}") for k in ("text", "input", "original")]
    plain = F.when(F.startswith(F.ltrim(record), F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), record, F.lit("}")), "$.v"))
    return F.coalesce(plain, *fields)


def md5_manifest(spark: SparkSession, path: str) -> DataFrame:
    """md5 and name of lines `<md5>  [*]<name>`; other lines are skipped."""
    pattern = r"^([0-9a-f]{32})\s+\*?(.+)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 1).alias("md5"), F.trim(F.regexp_extract("value", pattern, 2)).alias("name"))


def dirty_reference(spark: SparkSession, path: str) -> DataFrame:
    """Season and strain of a two-column text with an unknown delimiter, comments and perhaps a header.

    The season is the field with a year; the strain the other one.
    """
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    fields = F.transform(F.split("value", r"[\t;,|]"), lambda x: F.trim(x))
    year = lambda x: F.regexp_extract(x, r"((?:19|20)\d{2})", 1)
    d = lines.select(F.filter(fields, lambda x: x != "").alias("f")).where(F.size("f") >= 2)
    first_is_season = F.get("f", 0).rlike(r"^(19|20)\d{2}")
    season = F.when(first_is_season, F.get("f", 0)).otherwise(F.get("f", 1))
    strain = F.when(first_is_season, F.get("f", 1)).otherwise(F.get("f", 0))
    out = d.select(year(season).try_cast("int").alias("season"), strain.alias("strain"))
    return out.where("season is not null")


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """The union of several tables with the name of each."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def replayed(source: DataFrame, chosen: DataFrame, position: str, content: str, digest: str) -> DataFrame:
    """The source's rows at chosen positions; a row whose content has another hash raises."""
    from tessera.operators.joins import small

    want = chosen.select(F.col(position), F.col(digest).alias("_want"))
    got = source.join(small(want), position)
    same = F.sha2(F.col(content), 256) == F.col("_want")
    checked = F.when(same, F.col(content)).otherwise(F.raise_error(F.lit("content has changed")).cast("string"))
    return got.withColumn(content, checked).drop("_want")


def locked_file(spark: SparkSession, path: str, name: str, sha256: str) -> str:
    """The path of the only file below a folder with this name and hash."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    rows = f.where(F.sha2("content", 256) == sha256).select("path").limit(2).collect()
    require(len(rows) == 1, "locked_file", f"{len(rows)} files {name} with this hash")
    return rows[0]["path"]


def new_table(df: DataFrame, path: str) -> DataFrame:
    """Parquet, whole or absent; an existing path raises.  Returns the manifest of its files."""
    df.write.mode("errorifexists").parquet(path)
    files = df.sparkSession.read.parquet(path)
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    return files.groupBy(name.alias("file"), size.alias("bytes")).agg(F.count("*").alias("n"))


def canonical_csv(df: DataFrame, path: str, digits: int = 9) -> None:
    """CSV with columns by name and a fixed format of doubles."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in sorted(df.dtypes)]
    df.select(*cols).write.mode("errorifexists").csv(path, header=True, lineSep="\n")


def canonical_json(df: DataFrame, path: str) -> None:
    """One JSON record a line, keys by name."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def label_free_bundle(df: DataFrame, path: str, allowed: list[str], forbidden: tuple[str, ...]) -> str:
    """Only allow-listed columns are written, none that is forbidden; returns the table's fingerprint."""
    from tessera.operators.contracts import require_columns
    from tessera.operators.integrity import frame_fingerprint

    out = require_columns(df.select(*allowed), allowed, exact=True, forbidden=forbidden)
    out.write.mode("errorifexists").parquet(path)
    return frame_fingerprint(df.sparkSession.read.parquet(path), *allowed).first()["fingerprint"]


def load_bundle(spark: SparkSession, path: str, allowed: list[str], fingerprint: str) -> DataFrame:
    from tessera.operators.contracts import require_columns
    from tessera.operators.integrity import frame_fingerprint

    df = require_columns(spark.read.parquet(path), allowed)
    require(set(df.columns) == set(allowed), "columns_differ", str(df.columns))
    require(frame_fingerprint(df, *allowed).first()["fingerprint"] == fingerprint, "bundle_changed", path)
    return df


def report(rows: DataFrame, title: str, most: int = 200) -> str:
    """A Markdown table of an aggregate (at most `most` rows; more raise)."""
    got = rows.limit(most + 1).collect()
    require(len(got) <= most, "report_size", f"more than {most} rows")
    cols = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]) for c in cols) + " |" for r in got)]) + "\n"


def tensors(spark: SparkSession, path: str, member: str, expected: tuple[dict[str, int], int, str] | None = None) -> DataFrame:
    """Rows of an array in .npz shards as (shard, row, values); non-finite values raise.

    expected: rows of each shard, values of a row and their type; a shard that differs raises.
    """

    def rows(batches):  # noqa: ANN001, ANN202
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)[member]
                if expected and (a.shape, str(a.dtype)) != ((expected[0][name.rsplit("/", 1)[-1]], expected[1]), expected[2]):
                    raise ValueError(f"{name} holds {a.shape} of {a.dtype}")
                if not np.isfinite(a).all():
                    raise ValueError(f"{name} holds values that are not finite")
                flat = a.reshape(len(a), -1).astype("float32")
                yield pd.DataFrame({"shard": name.rsplit("/", 1)[-1], "row": range(len(flat)), "values": list(flat)})

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return f.mapInPandas(rows, "shard string, row long, values array<float>")


def atomic_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file, whole or absent: written under another name in the same folder and renamed; an existing one raises."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    require(not fs.exists(target), "exists", path)
    out = fs.create(part, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    require(fs.rename(part, target), "rename", path)


def sealed_tensors(spark: SparkSession, path: str, member: str, manifest: DataFrame, width: int, dtype: str = "float32") -> DataFrame:
    """tensors() of shards that agree with a manifest (shard, start, stop, sha256).

    The shards are those of the manifest, byte by byte; their ranges leave no gap from 0, and each has
    stop - start rows of `width` values of the given type.  Anything else raises.
    """
    ranges = sorted((r["start"], r["stop"], r["shard"]) for r in manifest.collect())  # one row a shard
    require(all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and (not ranges or ranges[0][0] == 0), "ranges", str(ranges[:4]))
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    there = f.select(F.element_at(F.split("path", "/"), -1).alias("shard"), F.sha2("content", 256).alias("found"))
    bad = there.join(manifest.select("shard", "sha256"), "shard", "full_outer").where(~F.col("found").eqNullSafe(F.col("sha256"))).limit(3).collect()
    require(not bad, "seal", str([r["shard"] for r in bad]))
    rows = {shard: stop - start for start, stop, shard in ranges}
    return tensors(spark, path, member, (rows, width, dtype))
