"""Tables that several queries share, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import h60, h60_sql
from tessera.registry import table


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurements: participant, study, day, timepoint, feature, value."""
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    tp = F.when(day == 1, "Pre-vacc").when(day <= 7, (day - 7).cast("string")).otherwise(day.cast("string"))
    return e.select(
        F.col("event_id"),
        F.col("user_id").alias("participant"),
        (F.col("user_id") % 5).alias("study"),
        day.alias("day"),
        tp.alias("timepoint"),
        F.col("event_type").alias("feature"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


PANEL = """panel AS (
  SELECT event_id, user_id AS participant, user_id % 5 AS study, day(ts) AS day,
         CASE WHEN day(ts) = 1 THEN 'Pre-vacc' WHEN day(ts) <= 7 THEN CAST(day(ts) - 7 AS VARCHAR) ELSE CAST(day(ts) AS VARCHAR) END AS timepoint,
         event_type AS feature, value, CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with four scores: s1 to s3 real, s4 with many ties."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.log1p(F.col("n_chars").cast("double")).alias("s1"),
        (spaces / (F.col("n_chars") + 1.0)).alias("s2"),
        ((h60("s3", F.col("doc_id")) % 1000) / 1000.0).alias("s3"),
        F.floor(F.col("n_chars") / 200.0).cast("double").alias("s4"),
    )
    return d.join(lab.select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("t")), "doc_id")


SCORED = f"""scored AS (
  SELECT d.doc_id, lang, source, n_chars, ln(1 + CAST(n_chars AS DOUBLE)) AS s1,
         (length(text) - length(replace(text, ' ', ''))) / (n_chars + CAST(1 AS DOUBLE)) AS s2,
         ({h60_sql("'s3'", "d.doc_id")} % 1000) / CAST(1000 AS DOUBLE) AS s3,
         floor(n_chars / CAST(200 AS DOUBLE)) AS s4, quality AS y, toxic AS t
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def avg_rank_sql(v: str, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    both = f"PARTITION BY {group}, {v}" if group else f"PARTITION BY {v}"
    return f"(rank() OVER ({part}ORDER BY {v}) + (count(*) OVER ({both}) - 1) / CAST(2 AS DOUBLE))"


def unit_rank_sql(v: str, group: str = "") -> str:
    n = f"count(*) OVER (PARTITION BY {group})" if group else "count(*) OVER ()"
    return f"(CASE WHEN {n} = 1 THEN 0.5 ELSE ({avg_rank_sql(v, group)} - 1) / ({n} - 1) END)"


def r9(c):  # noqa: ANN001, ANN201
    """Doubles are rounded before two engines' results are compared; minus zero becomes zero."""
    return F.round(c, 9) + 0.0
