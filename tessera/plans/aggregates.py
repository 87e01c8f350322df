"""Aggregations (inventory 2.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import ngrams as N
from tessera.operators import panel as P
from tessera.operators import ranks as R
from tessera.operators import text as D
from tessera.plans.base import PANEL, panel, r9, unit_rank_sql
from tessera.operators.text import written
from tessera.registry import query, spread, table

# The positivity rule: a group with a value that is not positive has no geometric mean.
GM = "CASE WHEN bool_and({0} > 0) THEN exp(avg(ln(CASE WHEN {0} > 0 THEN {0} END))) END".format
GM_OF_ALL = "CASE WHEN bool_and(coalesce({0} > 0, false)) THEN exp(avg(ln(CASE WHEN {0} > 0 THEN {0} END))) END".format
KEYS = ["participant", "feature"]
BASE = f"""{PANEL},
base AS (
  SELECT participant, feature, coalesce(avg(CASE WHEN timepoint = 'Pre-vacc' THEN value END),
         avg(CASE WHEN TRY_CAST(timepoint AS DOUBLE) <= 0 THEN value END)) AS baseline
  FROM panel GROUP BY participant, feature)"""


@query("A1_group_mean", "SELECT lang, source, round(avg(n_chars), 9) AS mean_chars, count(*) AS n FROM documents GROUP BY lang, source")
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", "source").agg(r9(F.avg("n_chars")).alias("mean_chars"), F.count("*").alias("n"))


@query("A2_timepoint_mean", f"WITH {PANEL} SELECT participant, feature, round(avg(value), 9) AS day_value FROM panel WHERE day = 8 GROUP BY ALL")
def timepoint_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).where("day = 8").groupBy(*KEYS).agg(r9(F.avg("value")).alias("day_value"))


@query("A3_prioritised_baseline", f"WITH {BASE} SELECT participant, feature, round(baseline, 9) AS baseline FROM base WHERE baseline IS NOT NULL")
def prioritised_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prioritised_baseline(panel(spark, sf_dir), KEYS).withColumn("baseline", r9("baseline"))


@query("A3_J8_U1_baseline_union_antijoin", f"WITH {BASE} SELECT participant, feature, round(baseline, 9) AS baseline FROM base WHERE baseline IS NOT NULL")
def baseline_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prioritised_baseline_by_anti_join(panel(spark, sf_dir), KEYS).withColumn("baseline", r9("baseline"))


@query(
    "baseline_fold_change_rank",
    f"""WITH {BASE},
target AS (SELECT participant, feature, avg(value) AS target FROM panel WHERE day BETWEEN 8 AND 14 GROUP BY ALL),
fc AS (SELECT participant, feature, ln(target / baseline) AS fc FROM base JOIN target USING (participant, feature) WHERE baseline IS NOT NULL)
SELECT participant, feature, round(fc, 9) AS fc, round({unit_rank_sql("fc", "feature")}, 9) AS fc_rank FROM fc""",
)
def baseline_fold_change_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    target = p.where("day between 8 and 14").groupBy(*KEYS).agg(F.avg("value").alias("target"))
    fc = P.prioritised_baseline(p, KEYS).join(target, KEYS).withColumn("fc", P.log_ratio(F.col("target"), F.col("baseline")))
    fc = R.with_places(D.written(fc.select(*KEYS, "fc")), "fc", "fc_rank", R.unit_of, "feature")
    return fc.select(*KEYS, r9("fc").alias("fc"), r9("fc_rank").alias("fc_rank"))


@query(
    "A4_baseline_rows",
    f"""WITH {PANEL}, m AS (SELECT *, max(CAST(timepoint = 'Pre-vacc' AS INT)) OVER (PARTITION BY participant, feature) AS has FROM panel)
SELECT event_id, participant, feature, timepoint FROM m
WHERE CASE WHEN has = 1 THEN timepoint = 'Pre-vacc' ELSE coalesce(TRY_CAST(timepoint AS DOUBLE) <= 0, false) END""",
)
def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.baseline_rows(panel(spark, sf_dir), KEYS).select("event_id", "participant", "feature", "timepoint")


@query("A5_geometric_mean", f"WITH {PANEL} SELECT study, feature, round({GM('value')}, 9) AS gm FROM panel GROUP BY ALL")
def geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("study", "feature").agg(r9(P.geometric_mean(F.col("value"))).alias("gm"))


@query(
    "A6_two_level_geometric_mean",
    f"""WITH {PANEL}, s AS (SELECT study, participant, feature, {GM('value')} AS v FROM panel GROUP BY ALL)
SELECT study, participant, round({GM_OF_ALL('v')}, 9) AS gm, count(*) AS panel_size FROM s GROUP BY ALL""",
)
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panel(spark, sf_dir).groupBy("study", "participant", "feature").agg(P.geometric_mean(F.col("value")).alias("v"))
    return s.groupBy("study", "participant").agg(r9(P.geometric_mean(F.col("v"), nulls=False)).alias("gm"), F.count("*").alias("panel_size"))


@query(
    "A7_complete_panel",
    f"""WITH {PANEL}, s AS (SELECT participant, feature, {GM('value')} AS v FROM panel WHERE day <= 7 AND feature IN ('click', 'error', 'view') GROUP BY ALL)
SELECT participant, round({GM_OF_ALL('v')}, 9) AS panel_gm FROM s GROUP BY participant HAVING count(DISTINCT feature) = 3""",
)
def complete_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).where("day <= 7")
    return P.complete_panel(p, ["participant"], "feature", "value", ["click", "error", "view"]).withColumn("panel_gm", r9("panel_gm"))


@query(
    "A8_distinct_counts",
    f"WITH {PANEL} SELECT count(*) AS n, count(DISTINCT participant) AS participants, count(DISTINCT study) AS studies, count(DISTINCT feature) AS features FROM panel",
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.count_distinct
    return panel(spark, sf_dir).agg(
        F.count("*").alias("n"), d("participant").alias("participants"), d("study").alias("studies"), d("feature").alias("features")
    )


@query(
    "A9_named_aggregates",
    f"""WITH {PANEL} SELECT participant, min(study) AS study, round(avg(value), 9) AS mean_value, count(DISTINCT feature) AS features, count(*) AS n
FROM panel GROUP BY participant""",
)
def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("participant").agg(
        F.min("study").alias("study"), r9(F.avg("value")).alias("mean_value"), F.count_distinct("feature").alias("features"), F.count("*").alias("n")
    )


@query(
    "A10_repeat_aggregation",
    f"""WITH {PANEL} SELECT participant, feature, count(DISTINCT day) AS repeats, round(avg(value), 9) AS prediction,
       max(k) - min(k) <= 1e-12 AS target_constant FROM panel GROUP BY ALL""",
)
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy(*KEYS).agg(
        F.count_distinct("day").alias("repeats"), r9(F.avg("value")).alias("prediction"), (F.max("k") - F.min("k") <= 1e-12).alias("target_constant")
    )


@query(
    "A11_window_rollup",
    """SELECT l_orderkey, round(avg(l_quantity), 9) AS quantity_mean, round(max(l_quantity), 9) AS quantity_max,
round(coalesce(stddev_pop(l_quantity), 0), 9) AS quantity_std, round(avg(l_discount), 9) AS discount_mean, round(max(l_discount), 9) AS discount_max,
round(coalesce(stddev_pop(l_discount), 0), 9) AS discount_std, max(l_linenumber) AS lines_max, count(*) AS n FROM lineitem GROUP BY l_orderkey""",
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = []
    for c, name in (("l_quantity", "quantity"), ("l_discount", "discount")):
        aggs += [r9(F.avg(c)).alias(f"{name}_mean"), r9(F.max(c)).alias(f"{name}_max"), r9(F.coalesce(F.stddev_pop(c), F.lit(0.0))).alias(f"{name}_std")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*aggs, F.max("l_linenumber").alias("lines_max"), F.count("*").alias("n"))


@query(
    "A12_span_contrast_rollup",
    f"""WITH {PANEL}, c AS (SELECT participant, feature, avg(CASE WHEN day > 20 THEN value END) - avg(CASE WHEN day <= 3 THEN value END) AS delta FROM panel GROUP BY ALL)
SELECT participant, round(max(delta), 9) AS delta_max, round(avg(delta), 9) AS delta_mean, count(delta) AS coverage FROM c GROUP BY participant""",
)
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda cond: F.avg(F.when(F.expr(cond), F.col("value")))
    c = panel(spark, sf_dir).groupBy(*KEYS).agg((part("day > 20") - part("day <= 3")).alias("delta"))
    return c.groupBy("participant").agg(r9(F.max("delta")).alias("delta_max"), r9(F.avg("delta")).alias("delta_mean"), F.count("delta").alias("coverage"))


@query(
    "A13_A14_A25_stratum_counts",
    """WITH b AS (SELECT lang, least(14, greatest(9, CAST(floor(log2(n_chars)) AS INT))) AS bucket FROM documents),
c AS (SELECT lang, bucket, count(*) AS n, grouping(lang, bucket) AS level FROM b GROUP BY GROUPING SETS ((lang, bucket), (lang), (bucket), ()))
SELECT coalesce(lang, '*') AS lang, coalesce(bucket, -1) AS bucket, n, round(n / CAST(sum(n) OVER (PARTITION BY level) AS DOUBLE), 9) AS share FROM c""",
)
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.canonical import length_bucket

    b = table(spark, sf_dir, "documents").select("lang", length_bucket(F.col("n_chars")).alias("bucket"))
    c = b.groupingSets([["lang", "bucket"], ["lang"], ["bucket"], []], "lang", "bucket").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("level"))
    return c.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("bucket", F.lit(-1)).alias("bucket"), "n", r9(share).alias("share"))


SIGNATURE = f"""{PANEL}, s AS (SELECT participant, array_to_string(list_sort(list(DISTINCT feature)), '+') AS signature, count(DISTINCT feature) AS items FROM panel WHERE day <= 5 GROUP BY participant)"""


@query(
    "A15_A16_complete_panel_signature",
    f"""WITH {SIGNATURE}, c AS (SELECT signature, items, count(*) AS support FROM s GROUP BY ALL)
SELECT signature, items, support, row_number() OVER (ORDER BY items DESC, support DESC, signature) AS place FROM c""",
)
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).where("day <= 5")
    s = p.groupBy("participant").agg(F.array_sort(F.collect_set("feature")).alias("a"))
    c = s.groupBy(F.array_join("a", "+").alias("signature"), F.size("a").cast("long").alias("items")).agg(F.count("*").alias("support"))
    place = F.row_number().over(W.orderBy(F.desc("items"), F.desc("support"), "signature")).cast("long")  # one row a signature
    return c.withColumn("place", place)


@query(
    "A17_weighted_mean",
    """WITH w AS (SELECT l_returnflag AS flag, CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END AS z, l_quantity AS q
FROM (SELECT *, (l_discount - CAST(0.05 AS DOUBLE)) * 40 AS x FROM lineitem))
SELECT flag, round(sum(z * q) / nullif(sum(q), 0), 9) AS score FROM w GROUP BY flag""",
)
def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.canonical import sigmoid

    z = sigmoid((F.col("l_discount") - 0.05) * 40.0)
    w = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), z.alias("z"), F.col("l_quantity").alias("q"))
    return w.groupBy("flag").agg(r9(F.sum(F.col("z") * F.col("q")) / F.nullif(F.sum("q"), F.lit(0.0))).alias("score"))


@query(
    "A18_union_max_weighted_mean",
    """WITH p AS (SELECT l_orderkey, l_suppkey % 4 AS position, arg_max(l_discount, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)) AS z,
                  arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)) AS w FROM lineitem GROUP BY ALL)
SELECT l_orderkey, round(sum(z * w) / nullif(sum(w), 0), 9) AS score, count(*) AS positions FROM p GROUP BY l_orderkey""",
)
def union_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("l_discount", "l_quantity"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")).alias("v")
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 4).alias("position")).agg(last)
    z, w = F.col("v.l_discount"), F.col("v.l_quantity")
    return p.groupBy("l_orderkey").agg(r9(F.sum(z * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("score"), F.count("*").alias("positions"))


@query(
    "A19_A21_guards",
    """SELECT l_orderkey, bool_and(l_quantity > 10) AS every_large, bool_or(l_discount > 0.05) AS some_discount,
       count(DISTINCT l_returnflag) = 1 AS one_flag FROM lineitem GROUP BY l_orderkey""",
)
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_quantity") > 10).alias("every_large"),
        F.bool_or(F.col("l_discount") > 0.05).alias("some_discount"),
        (F.count_distinct("l_returnflag") == 1).alias("one_flag"),
    )


@query(
    "A20_quantile_summary",
    f"""WITH {PANEL} SELECT feature, count(value) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.1), 9) AS q10,
round(quantile_cont(value, 0.9), 9) AS q90, round(min(value), 9) AS low, round(max(value), 9) AS high FROM panel GROUP BY feature""",
)
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: r9(F.percentile("value", F.lit(p)))
    return panel(spark, sf_dir).groupBy("feature").agg(
        F.count("value").alias("n"), r9(F.avg("value")).alias("mean"), q(0.5).alias("median"), q(0.1).alias("q10"), q(0.9).alias("q90"),
        r9(F.min("value")).alias("low"), r9(F.max("value")).alias("high"),
    )


@query(
    "A22_coverage_summary",
    """SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, count(l.doc_id) AS with_view,
       count(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 1 END) AS complete_view
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").withColumn("here", F.lit(1))
    return d.join(lab, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.count("here").alias("with_view"),
        F.count_if(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("complete_view"),
    )


@query(
    "A23_S3_scan_counters",
    """SELECT event_type, count_if(value < 1) AS below_one, count_if(value IS NULL) AS missing, count_if(TRY_CAST(props AS DOUBLE) IS NULL) AS unparsed,
       count(DISTINCT CASE WHEN day(ts) = 1 THEN user_id END) AS participants_day1, count(DISTINCT user_id) AS participants FROM events GROUP BY event_type""",
)
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") < 1).alias("below_one"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if(F.col("props").try_cast("double").isNull()).alias("unparsed"),
        F.count_distinct(F.when(F.dayofmonth("ts") == 1, F.col("user_id"))).alias("participants_day1"), F.count_distinct("user_id").alias("participants"),
    )


BYTES = """b AS (SELECT doc_id, lang, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
p AS (SELECT doc_id, lang, h, unnest(range(1, n + 1)) AS i FROM b),
m AS (SELECT doc_id, lang, substr(h, 2 * greatest(i - 4, 1) - 1, 2 * (i - greatest(i - 4, 1))) AS longest, substr(h, 2 * i - 1, 2) AS next, count(*) AS k FROM p GROUP BY ALL),
g AS (SELECT doc_id, lang, longest, next, k, w AS width, right(longest, 2 * w) AS context FROM (SELECT *, unnest(range(0, length(longest) // 2 + 1)) AS w FROM m))"""


@query(
    "A24_ngram_counts",
    f"""WITH {BYTES}, j AS (SELECT lang, width, context, next, sum(k) AS joint FROM g GROUP BY ALL)
SELECT lang, CAST(width AS INT) AS width, context, next, CAST(joint AS BIGINT) AS joint, CAST(sum(joint) OVER (PARTITION BY lang, width, context) AS BIGINT) AS context_count FROM j""",
)
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each byte follows each context of 0 to 4 bytes in a language, and how often the context occurs."""
    d = spread(table(spark, sf_dir, "documents"))
    c = N.language_counts(N.task_counts(d, "lang", "text"))
    width, digits = N.width_of(F.col("gram")), F.lpad(F.hex("gram"), 12, "0")
    chars = F.substring(digits, F.lit(11) - 2 * width, 2 * width)
    return c.select("lang", width.alias("width"), chars.alias("context"), F.right(digits, F.lit(2)).alias("next"), "joint", F.col("context").alias("context_count"))


@query(
    "A26_group_panel",
    f"""WITH {PANEL}, p AS (SELECT * FROM panel WHERE day <= 10),
gp AS (SELECT study, list_sort(list(DISTINCT feature)) AS panel FROM p GROUP BY study),
e AS (SELECT study, participant, feature, avg(value) AS v FROM p GROUP BY ALL),
m AS (SELECT study, participant, list_sort(list(DISTINCT feature)) AS mine, {GM('v')} AS gm, avg(v) AS mean, stddev_pop(v) AS sd FROM e GROUP BY ALL)
SELECT m.study, participant, round(gm, 9) AS gm, round(mean, 9) AS mean, round(sd, 9) AS sd FROM m JOIN gp ON m.study = gp.study AND mine = panel""",
)
def group_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.group_panel(panel(spark, sf_dir).where("day <= 10"), "study", "participant", "feature", "value")
    return g.select("study", "participant", *[r9(c).alias(c) for c in ("gm", "mean", "sd")])


@query(
    "A27_matched_subset_proxy",
    f"""WITH {PANEL}, e AS (SELECT study, participant, feature, avg(CASE WHEN day <= 10 THEN value END) AS pre, avg(CASE WHEN day > 20 THEN value END) AS post FROM panel GROUP BY ALL),
g AS (SELECT study, participant, {GM('pre')} AS pre_gm, {GM('post')} AS post_gm, count(*) AS items FROM e WHERE pre IS NOT NULL AND post IS NOT NULL GROUP BY ALL)
SELECT study, participant, items, round(pre_gm, 9) AS pre_gm, round(post_gm, 9) AS post_gm, round({unit_rank_sql("ln(post_gm / pre_gm)", "study")}, 9) AS fold_rank FROM g
WHERE pre_gm IS NOT NULL AND post_gm IS NOT NULL""",
)
def matched_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda cond: F.avg(F.when(F.expr(cond), F.col("value")))
    e = panel(spark, sf_dir).groupBy("study", *KEYS).agg(part("day <= 10").alias("pre"), part("day > 20").alias("post")).dropna(subset=["pre", "post"])
    gm = P.geometric_mean
    g = e.groupBy("study", "participant").agg(gm(F.col("pre")).alias("pre_gm"), gm(F.col("post")).alias("post_gm"), F.count("*").alias("items"))
    g = g.dropna(subset=["pre_gm", "post_gm"]).withColumn("fold", F.ln(F.col("post_gm") / F.col("pre_gm")))
    return g.select("study", "participant", "items", r9("pre_gm").alias("pre_gm"), r9("post_gm").alias("post_gm"), r9(R.unit_rank(F.col("fold"), "study")).alias("fold_rank"))
