"""Shared plumbing: durable intermediates, ranking without one big window, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # of an Arrow batch, unless a single row has more: it is held by the JVM and, twice, by the worker
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (a local session, as in tests) a temporary folder of this
    process is used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="tessera-")
    return _FALLBACK[app]


class Scratch:
    """Tables written to the shared folder; they cut lineage and survive lost executors.

    A returned table may still read them, so they stay until clean() is called.
    """

    roots: ClassVar[list[str]] = []  # of this process, oldest first

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.roots.append(self.root)

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """rows: bound of the rows in an Arrow batch for this job alone, which then has BATCH_BYTES at most, too."""
        path = f"{self.root}/{self.n:04d}"
        self.n += 1
        before = {k: self.spark.conf.get(k) for k in (BATCH, BYTES)}
        if rows is not None:
            self.spark.conf.set(BATCH, str(rows))
            self.spark.conf.set(BYTES, str(BATCH_BYTES))
        try:
            df.write.mode("errorifexists").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables that operators of this process wrote since there were `since` folders of them.

    Call it when the tables that they returned are written or no longer needed.
    """
    for root in Scratch.roots[since:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del Scratch.roots[since:]


def batch_rows(spark: SparkSession, rows: int = 400) -> None:
    """Bound the rows of an Arrow batch by `rows`, and its bytes by BATCH_BYTES.

    Plans read the setting when they run, which for a returned table is after this call.  So it is
    only ever lowered: the tightest bound that any operator of the session asked for holds for all.
    """
    now = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(rows, now) if now > 0 else rows))
    spark.conf.set(BYTES, str(BATCH_BYTES))


def checked_broadcast(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A narrow table, to be broadcast if it has at most `most` rows, else to be shuffled like any other."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def prefix_within(df: DataFrame, group: list[str], bucket: str, order: list[str], size: str, out: str, nulls: bool = True) -> DataFrame:
    """Sum of `size` over the rows of the same group that come before a row.

    A group is read in ascending (bucket, order).  Sums run inside (group, bucket); bucket totals
    (a small table: groups x buckets) give each bucket its offset.  So a group that holds a third
    of the rows is still dealt over all its buckets.  Without nulls in the group's columns (nulls=False)
    the rows meet their totals where the window left them, else they are shuffled once more.
    """
    from pyspark.sql import Window as W

    inner = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(*group, bucket)
        .agg(F.sum(size).alias("_t"))
        .withColumn("_before", F.coalesce(F.sum("_t").over(across), F.lit(0)))
        .drop("_t")
    )
    left = df.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    if not nulls:
        return left.join(totals, [*group, bucket]).select(*df.columns, (F.col("_in") + F.col("_before")).alias(out))
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(totals[c]) for c in [*group, bucket]])
    return left.join(totals, cond).select(*[left[c] for c in df.columns], (F.col("_in") + F.col("_before")).alias(out))


def hash_sample(df: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """At most `most` rows of each label: those with the least hash of a key (columns _h and _k are added).

    Rows above a hash threshold, which leaves about four times as many as needed, go before any
    shuffle, so what the window sees is bounded by the number of labels, not by the table.
    """
    from pyspark.sql import Window as W

    share = df.groupBy(label).agg(F.least(F.lit(1.0), F.lit(4.0 * most) / F.count("*")).alias("_share"))
    share = share.select(F.col(label).alias("_label"), "_share")
    h = F.xxhash64(key)
    # _share has one row for each label
    near = df.withColumn("_h", h).join(F.broadcast(share), F.col(label) == F.col("_label"))
    near = near.where(F.col("_h") / float(1 << 63) <= 2 * F.col("_share") - 1).drop("_label", "_share")
    return near.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy("_h"))).where(F.col("_k") <= most)


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node that has an edge: columns node, component.

    Alternates large-star and small-star steps until the edge table stops changing.  Steps are
    group-by-minimum (combined before the shuffle) and joins; no node's neighbours are gathered.
    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    cur = scratch.write(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v")
        nxt = scratch.write(nxt.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        scratch.drop(cur)
        cur = nxt
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.distinct())


def annotate(df: DataFrame, text: str, make, fields: list[T.StructField], keep_text: bool = True) -> DataFrame:  # noqa: ANN001
    """Adds columns computed from a text column in Python; all other columns pass as they are.

    make() is called once in each task and gives a function from a list of texts to one list of
    values for each of fields.
    """
    if clash := {f.name for f in fields} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    batch_rows(df.sparkSession)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        fn = make()
        for b in batches:
            values = fn(b.column(text).to_pylist())
            new = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(values, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], names=[*names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))
