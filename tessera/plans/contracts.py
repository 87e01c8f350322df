"""Contracts and name rules whose outcome is a table (inventory 2.2, 2.3), tensors and packed bytes."""

from __future__ import annotations

import hashlib
import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import contracts as K
from tessera.operators import integrity as H
from tessera.plans.base import PANEL, panel, r9
from tessera.registry import query, table
from tessera.sources import readers as S

BANNED = ("doc_id", "vec_id", "text", "embedding")


def outcome(check) -> str:  # noqa: ANN001
    """`ok`, or the code of the contract that a call breaks."""
    try:
        check()
    except K.ContractError as e:
        return e.code
    return "ok"


@query(
    "F15_K8_aggregate_only",
    f"""SELECT table_name AS name, CASE WHEN bool_or(column_name IN {BANNED}) THEN 'row_level_field' ELSE 'ok' END AS state
FROM information_schema.columns WHERE table_name IN ('documents', 'embeddings', 'nation', 'labels', 'benchmark') GROUP BY table_name
UNION ALL SELECT 'nested', 'row_level_field' UNION ALL SELECT 'by_language', 'ok'""",
)
def aggregate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("documents", "embeddings", "nation", "labels", "benchmark")}
    d = frames["documents"]
    frames["nested"] = d.groupBy("lang").agg(F.collect_list(F.struct(F.struct("doc_id").alias("row"))).alias("rows"))
    frames["by_language"] = d.groupBy("lang").agg(F.count("*").alias("n"))
    rows = [(n, outcome(lambda f=f: K.aggregate_only(f.schema, BANNED))) for n, f in frames.items()]
    return spark.createDataFrame(rows, "name string, state string")


LIMITS = {"quality_rate": 0.9, "toxic_rate": 0.001, "mean_gap": 1.0, "absent": 1.0}


@query(
    "F16_tolerance_gates",
    f"""WITH m AS (SELECT avg(quality) AS quality_rate, avg(toxic) AS toxic_rate, avg(quality) - avg(toxic) AS mean_gap FROM labels),
v AS (SELECT 'quality_rate' AS metric, quality_rate AS value FROM m UNION ALL SELECT 'toxic_rate', toxic_rate FROM m UNION ALL SELECT 'mean_gap', mean_gap FROM m UNION ALL SELECT 'absent', NULL),
l(metric, most) AS (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in LIMITS.items())})
SELECT metric, round(value, 9) AS value, most, CASE WHEN abs(value) <= most THEN 'ok' ELSE 'tolerance' END AS state FROM v JOIN l USING (metric)""",
)
def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.avg("quality"), F.avg("toxic")
    found = table(spark, sf_dir, "labels").agg(q.alias("quality_rate"), t.alias("toxic_rate"), (q - t).alias("mean_gap")).first().asDict()
    rows = [(k, found.get(k), v, outcome(lambda k=k, v=v: K.within(found, {k: v}))) for k, v in LIMITS.items()]
    return spark.createDataFrame(rows, "metric string, value double, most double, state string").withColumn("value", r9("value"))


@query(
    "F17_same_features",
    f"""WITH {PANEL}, f AS (SELECT study, list(DISTINCT feature ORDER BY feature) AS features FROM panel WHERE NOT (study = 4 AND feature = 'click') GROUP BY study)
SELECT CAST(a.study AS INT) AS one, CAST(b.study AS INT) AS other, CASE WHEN a.features = b.features THEN 'ok' ELSE 'features_differ' END AS state FROM f a JOIN f b ON a.study < b.study""",
)
def same_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies as wide tables; the last one lacks a feature."""
    p = panel(spark, sf_dir).where("not (study = 4 and feature = 'click')")
    names = p.select("study", "feature").distinct().groupBy("study").agg(F.array_sort(F.collect_set("feature")).alias("f"))
    wide = {r["study"]: spark.createDataFrame([], ", ".join(f"f_{x} double" for x in r["f"])) for r in names.collect()}  # five studies
    rows = [(int(a), int(b), outcome(lambda a=a, b=b: K.same_features(wide[a], wide[b], "f_"))) for a in wide for b in wide if a < b]
    return spark.createDataFrame(rows, "one int, other int, state string")


PREFIXES = "CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN '{f}'" for p, f in K.FAMILIES.items()) + " END"


@query(
    "P18_feature_families",
    f"""WITH n AS (SELECT p || event_type AS name FROM (SELECT DISTINCT event_type FROM events), (VALUES ('len_'), ('tok_'), ('emb_'), ('zzz_')) v(p))
SELECT coalesce({PREFIXES}, 'feature_family') AS family, name FROM n""",
)
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of derived columns by family; those of none with the contract's code."""
    kinds = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())  # the kinds of events
    names = [p + k for p in ("len_", "tok_", "emb_", "zzz_") for k in kinds]
    rows = []
    for name in names:
        state = outcome(lambda name=name: K.feature_families([name]))
        rows.append((next(iter(K.feature_families([name]))) if state == "ok" else state, name))
    return spark.createDataFrame(rows, "family string, name string")


@query(
    "P19_closest_feature",
    """WITH d AS (SELECT DISTINCT day(ts) AS d FROM events WHERE day(ts) % 4 = 1), n AS (SELECT unnest(range(1, 32)) AS n)
SELECT CAST(n AS INT) AS n, 'w' || arg_min(d, (abs(d - n), d)) || '_mean' AS feature FROM n, d GROUP BY n""",
)
def closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("d")).where("d % 4 = 1").distinct().collect()  # 8 days at most
    columns = [f"w{r['d']}_mean" for r in days]
    return spark.createDataFrame([(n, K.closest_feature(columns, "w", "_mean", n)) for n in range(1, 32)], "n int, feature string")


@query(
    "P21_first_available",
    """SELECT 'documents' AS name, count(*) AS n, sum(n_chars)::BIGINT AS length FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark""",
)
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of texts: the first of two columns that a table has, else counted."""
    out = []
    for name in ("documents", "benchmark"):
        t = table(spark, sf_dir, name)
        n = K.first_available(t, ["n_tokens", "n_chars"], F.length("text"))
        out.append(t.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(n).cast("long").alias("length")))
    return out[0].unionByName(out[1])


@query(
    "S15_S17_sealed_tensors",
    """SELECT 'shard-' || (n_nationkey // 7) || '.npz' AS shard, CAST(n_nationkey % 7 AS BIGINT) AS "row", CAST(n_nationkey AS BIGINT) AS first, CAST(n_regionkey AS DOUBLE) AS second FROM nation""",
)
def sealed_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations as shards of an array of seven rows each, sealed by a manifest and read back."""
    from tessera.plans.inout import _new

    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()
    whole, path, manifest = np.array(rows, np.float32).reshape(-1, 2), _new(spark, "tensors"), []
    for k, at in enumerate(range(0, len(whole), 7)):
        buffer = io.BytesIO()
        np.savez(buffer, values=whole[at : at + 7])
        S.atomic_bytes(spark, f"{path}/shard-{k}.npz", buffer.getvalue())
        manifest.append((f"shard-{k}.npz", at, min(at + 7, len(whole)), hashlib.sha256(buffer.getvalue()).hexdigest()))
    seal = spark.createDataFrame(manifest, "shard string, start long, stop long, sha256 string")
    t = S.sealed_tensors(spark, path, "values", seal, width=2)
    return t.select("shard", "row", F.get("values", 0).cast("long").alias("first"), F.get("values", 1).cast("double").alias("second"))


@query(
    "X14_binary_pack",
    """SELECT s_suppkey, lpad(hex(octet_length(encode(s_name))), 8, '0') || hex(encode(s_name)) AS id_hex, CAST(CAST(CAST(s_acctbal AS DOUBLE) AS BIT) AS VARCHAR) AS bits FROM supplier""",
)
def binary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    high, low = (F.conv(F.substring(F.hex(H.packed_double("s_acctbal")), i, 8), 16, 2) for i in (1, 9))
    return s.select("s_suppkey", F.hex(H.packed_text("s_name")).alias("id_hex"), F.concat(F.lpad(high, 32, "0"), F.lpad(low, 32, "0")).alias("bits"))
