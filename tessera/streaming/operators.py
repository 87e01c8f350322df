"""Incremental forms of scans, deduplication and counts (inventory 2.18)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.text import scratch_root


def stream(spark: SparkSession, path: str, files_each: int = 4) -> DataFrame:
    """A table's files as a stream, a few at a time."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its result as a table.

    Append goes to Parquet, exactly once by the sink's log.  Complete and update write each batch to a
    folder of its own; of an update stream the newest row of a key is the caller's to pick (_batch).
    """
    spark = df.sparkSession
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/_batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/*")
    if mode == "complete":
        last = out.agg(F.max("_batch").alias("b")).scalar()
        out = out.where(F.col("_batch") == last).drop("_batch")
    return out


def first_of_each(df: DataFrame, content: str) -> DataFrame:
    """A row for each content, the first that came; the state holds hashes only."""
    return df.withColumn("content_hash", F.sha2(content, 256)).dropDuplicates(["content_hash"])


def running_counts(df: DataFrame, **conditions: str) -> DataFrame:
    """Counts so far of the rows that meet each condition."""
    return df.groupBy().agg(*[F.count_if(F.expr(c)).alias(name) for name, c in conditions.items()])


def bounded_top(k: int) -> Callable:
    """Z3: for applyInPandasWithState: the k least (order, id) of each key seen so far."""

    def update(key, frames, state):  # noqa: ANN001, ANN202
        import pandas as pd

        best = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            best = sorted([*best, *zip(f["order"].tolist(), f["id"].tolist(), strict=True)])[:k]
        state.update(([o for o, _ in best], [int(i) for _, i in best]))
        yield pd.DataFrame({"key": [key[0]], "ids": [[int(i) for _, i in best]]})

    return update


def top_of_each(df: DataFrame, key: str, order: str, item: str, k: int = 2) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(order).cast("string").alias("order"), F.col(item).cast("long").alias("id"))
    return rows.groupBy("key").applyInPandasWithState(bounded_top(k), "key string, ids array<long>", "orders array<string>, ids array<long>", "update", "NoTimeout")


def windowed(df: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Z7 (an extension, without a counterpart in the inventory): counts and sums in event-time windows."""
    w = df.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").cast("string").alias("window_start"), *keys, "n", "total")
