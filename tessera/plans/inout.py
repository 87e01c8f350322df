"""Sources, sinks and streams as queries (inventory 2.1 and 2.18): tables are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import integrity as H
from tessera.operators.text import scratch_root
from tessera.plans.base import r9
from tessera.registry import query, table
from tessera.sources import readers as S
from tessera.streaming import operators as Z


def _new(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


@query("S1_S2_S19_delimited_round_trip", "SELECT s_suppkey, s_acctbal FROM supplier")
def delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "supplier.csv")
    S.canonical_csv(table(spark, sf_dir, "supplier"), path)
    return S.delimited(spark, path, "s_acctbal double, s_name string, s_nationkey int, s_suppkey bigint", ["s_suppkey", "s_acctbal"])


@query("S4_S5_early_filter_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def early_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


@query("S6_S7_S16_S18_S20_sharded_table", "SELECT count(*) AS n, CAST(4 AS BIGINT) AS shards FROM orders")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "orders")
    manifest = S.new_table(table(spark, sf_dir, "orders").repartition(4, "o_orderkey"), path)
    S.sharded(spark, path, 4)
    return manifest.agg(F.sum("n").alias("n"), F.count("*").alias("shards"))


@query("S8_S21_json_lines", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "nation.jsonl")
    S.canonical_json(table(spark, sf_dir, "nation"), path)
    return S.json_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int", strict=True)


@query(
    "S9_record_text",
    "SELECT conv_id, turn, text AS extracted FROM conversations",
)
def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 3
    field = lambda k: F.to_json(F.struct(F.col("text").alias(k)))
    record = F.when(kind == 0, field("text")).when(kind == 1, field("input")).otherwise(field("original"))
    return c.select("conv_id", "turn", S.record_text(record).alias("extracted"))


@query("S10_dirty_reference", "SELECT 2000 + n_nationkey AS season, 'A/' || n_name AS strain FROM nation")
def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    year, name = (F.col("n_nationkey") + 2000).cast("string"), F.concat(F.lit("A/"), "n_name")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(";", year, name)).otherwise(F.concat_ws("\t", name, year))
    path = _new(spark, "reference.txt")
    head = spark.createDataFrame([("# seasons",), ("season;strain",), ("",)], "value string")
    n.select(line.alias("value")).unionByName(head).write.text(path)
    return S.dirty_reference(spark, path)


@query("S11_H1_H2_manifest", "SELECT 'verified' AS state, CAST(3 AS BIGINT) AS files UNION ALL SELECT 'missing', 1")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a table, their hashes and a manifest that lists them and one that isn't there."""
    path, listed = _new(spark, "part"), _new(spark, "md5.txt")
    table(spark, sf_dir, "part").repartition(3, "p_partkey").write.parquet(path)
    files = H.file_hashes(spark, path).where("name like 'part-%'")
    lines = files.select(F.concat_ws("  ", "md5", "name").alias("value"))
    gone = spark.createDataFrame([("0" * 32 + " *gone.parquet",)], "value string")
    lines.unionByName(gone).write.text(listed)
    return H.verified_manifest(files, S.md5_manifest(spark, listed)).groupBy("state").agg(F.count("*").alias("files"))


@query("S13_two_pass_replay", "SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id % 20 = 0")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chosen = d.where("doc_id % 20 = 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    return S.replayed(d.select("doc_id", "text"), chosen, "doc_id", "text", "digest").select("doc_id", F.md5("text").alias("content"))


@query("S14_tagged_union", "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    parts = {x: d.where(F.col("lang") == x).select("doc_id") for x in ("en", "fr")}
    return S.tagged_union(parts, "lang").groupBy("lang").agg(F.count("*").alias("n"))


@query("S17_S22_label_free_bundle", "SELECT count(*) AS n, round(sum(n_chars), 6) AS chars FROM documents")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, cols = _new(spark, "bundle"), ["doc_id", "n_chars"]
    seal = S.label_free_bundle(table(spark, sf_dir, "documents"), path, cols, ("quality", "toxic"))
    return S.load_bundle(spark, path, cols, seal).agg(F.count("*").alias("n"), F.round(F.sum("n_chars").cast("double"), 6).alias("chars"))


@query("S23_S24_locked_file_report")
def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "region")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(path)
    f = H.file_hashes(spark, path).where("name like 'part-%'").first()
    found = S.locked_file(spark, path, f["name"], f["sha256"])
    text = S.report(spark.read.parquet(found).orderBy("r_regionkey"), "Regions")
    return spark.createDataFrame([(text,)], "report string")


@query("Z1_Z2_streaming_dedup", "SELECT count(*) AS n, count(DISTINCT content_hash) AS contents FROM (SELECT DISTINCT sha256(text) AS content_hash FROM documents)")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Z.stream(spark, f"{sf_dir}/documents.parquet")
    out = Z.drained(Z.first_of_each(d, "text").select("doc_id", "content_hash"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("contents"))


@query(
    "Z3_streaming_top_two",
    "SELECT source AS key, array_to_string(list(doc_id ORDER BY h, doc_id), ',') AS ids FROM (SELECT source, doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256(text), doc_id) AS k FROM documents) WHERE k <= 2 GROUP BY source",
)
def streaming_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Z.stream(spark, f"{sf_dir}/documents.parquet").withColumn("h", F.sha2("text", 256))
    out = Z.drained(Z.top_of_each(d, "source", "h", "doc_id"), "update")
    last = out.groupBy("key").agg(F.max_by("ids", "_batch").alias("ids"))
    return last.select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("Z4_Z5_streaming_counts", "SELECT count(*) AS scanned, count_if(n_chars >= 500) AS eligible, count_if(lang = 'en') AS english FROM documents")
def streaming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Z.stream(spark, f"{sf_dir}/documents.parquet")
    return Z.drained(Z.running_counts(d, scanned="true", eligible="n_chars >= 500", english="lang = 'en'"), "complete")


@query(
    "Z7_event_time_windows",
    "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 9) AS total FROM events GROUP BY ALL",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Z.stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = Z.drained(Z.windowed(e, "ts", "1 day", "2 days", "event_type"), "complete")
    return out.withColumn("total", r9("total"))
