"""Statistics and evaluation metrics (inventory 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import canonical as C
from tessera.functions.hashing import h60, h60_sql
from tessera.operators import arrays as A
from tessera.operators import metrics as M
from tessera.operators import ranks as R
from tessera.plans.base import PANEL, SCORED, avg_rank_sql, panel, r9, scored, unit_rank_sql
from tessera.operators.metrics import correlation
from tessera.registry import query, table

AR = avg_rank_sql
SPEARMAN = f"""{SCORED}, r AS (SELECT source, {AR("s1", "source")} AS a, {AR("s2", "source")} AS b FROM scored),
rho AS (SELECT source, count(*) AS n, CASE WHEN count(*) < 3 THEN 'insufficient_n' WHEN min(a) = max(a) THEN 'constant_target' WHEN min(b) = max(b) THEN 'constant_prediction' ELSE 'ok' END AS status,
  CASE WHEN count(*) >= 3 AND min(a) <> max(a) AND min(b) <> max(b) THEN (covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)) END AS rho FROM r GROUP BY source)"""


@query("M1_M2_spearman_by_group", f"WITH {SPEARMAN} SELECT source, n, status, round(rho, 9) AS rho FROM rho")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spearman(scored(spark, sf_dir), "s1", "s2", "source").withColumn("rho", r9("rho"))


@query("M3_spearman_summary", f"WITH {SPEARMAN} SELECT round(avg(rho), 9) AS mean, round(quantile_cont(rho, 0.5), 9) AS median, round(min(rho), 9) AS low, round(max(rho), 9) AS high, count(rho) AS groups FROM rho")
def spearman_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.spearman(scored(spark, sf_dir), "s1", "s2", "source")
    return r.agg(r9(F.avg("rho")).alias("mean"), r9(F.percentile("rho", F.lit(0.5))).alias("median"), r9(F.min("rho")).alias("low"), r9(F.max("rho")).alias("high"), F.count("rho").alias("groups"))


@query(
    "M4_pooled_within_group_spearman",
    f"""WITH {SCORED}, r AS (SELECT {unit_rank_sql("s1", "source")} AS a, {unit_rank_sql("s3", "source")} AS b FROM scored) SELECT round((covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)), 9) AS rho, count(*) AS n FROM r""",
)
def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scored(spark, sf_dir).select(R.unit_rank(F.col("s1"), "source").alias("a"), R.unit_rank(F.col("s3"), "source").alias("b"))
    return r.agg(r9(correlation("a", "b")).alias("rho"), F.count("*").alias("n"))


@query(
    "M5_direction_inference",
    f"""WITH {SPEARMAN}, v AS (SELECT quantile_cont(rho, 0.5) AS med, sum(sign(rho)) AS signs FROM rho)
SELECT CASE WHEN med <> 0 THEN CAST(sign(med) AS INT) WHEN signs <> 0 THEN CAST(sign(signs) AS INT) ELSE -1 END AS direction FROM v""",
)
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.spearman(scored(spark, sf_dir), "s1", "s2", "source").agg(F.percentile("rho", F.lit(0.5)).alias("med"), F.sum(F.signum("rho")).alias("signs"))
    first = lambda c: F.when(F.col(c) != 0, F.signum(c).cast("int"))
    return v.select(F.coalesce(first("med"), first("signs"), F.lit(-1)).alias("direction"))


@query(
    "M24_rank_agreement",
    f"""WITH {SCORED}, r AS (SELECT lang, {unit_rank_sql("s1", "lang")} AS a, {unit_rank_sql("s2", "lang")} AS b, {unit_rank_sql("s3", "lang")} AS c, {unit_rank_sql("s4", "lang")} AS d FROM scored),
p AS (SELECT lang, count(*) AS rows, [covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), covar_pop(a, c) / nullif(stddev_pop(a) * stddev_pop(c), 0), covar_pop(a, d) / nullif(stddev_pop(a) * stddev_pop(d), 0), covar_pop(b, c) / nullif(stddev_pop(b) * stddev_pop(c), 0),
covar_pop(b, d) / nullif(stddev_pop(b) * stddev_pop(d), 0), covar_pop(c, d) / nullif(stddev_pop(c) * stddev_pop(d), 0)] AS rho,
count_if(abs(b - a) > 1e-12) AS moved_s2, avg(abs(b - a)) AS sb, max(abs(b - a)) AS xb, count_if(abs(c - a) > 1e-12) AS moved_s3, avg(abs(c - a)) AS sc, max(abs(c - a)) AS xc, count_if(abs(d - a) > 1e-12) AS moved_s4, avg(abs(d - a)) AS sd, max(abs(d - a)) AS xd FROM r GROUP BY lang)
SELECT lang, rows, CAST(len(list_filter(rho, lambda x: x IS NOT NULL)) AS BIGINT) AS pairs, round(list_min(rho), 9) AS rho_min, round(list_median(rho), 9) AS rho_median, round(list_max(rho), 9) AS rho_max,
moved_s2, round(sb, 9) AS shift_mean_s2, round(xb, 9) AS shift_max_s2, moved_s3, round(sc, 9) AS shift_mean_s3, round(xc, 9) AS shift_max_s3, moved_s4, round(sd, 9) AS shift_mean_s4, round(xd, 9) AS shift_max_s4 FROM p""",
)
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike four scores rank the documents of each language, and how far three of them move them against the first."""
    out = M.rank_agreement(scored(spark, sf_dir), ["s1", "s2", "s3", "s4"], "lang")
    return out.select("lang", "rows", "pairs", *[r9(c).alias(c) if c.startswith(("rho", "shift")) else F.col(c) for c in out.columns[3:]])


@query(
    "M6_correlation_matrix",
    f"""WITH {SCORED}, l AS (SELECT doc_id, name, value FROM (SELECT doc_id, s1, s2, s3, s4 FROM scored) UNPIVOT (value FOR name IN (s1, s2, s3, s4)))
SELECT a.name AS a, b.name AS b, round((covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0)), 9) AS r FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY ALL""",
)
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of columns in one pass: no self-join is needed for a fixed list of columns."""
    cols = ["s1", "s2", "s3", "s4"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = scored(spark, sf_dir).agg(*[r9(correlation(a, b)).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])
    return one.select(F.explode(rows).alias("x")).select("x.a", "x.b", "x.r")


@query(
    "M7_rank_rmse",
    f"""WITH {SCORED}, r AS (SELECT source, {unit_rank_sql("s1", "source")} AS a, {unit_rank_sql("s2", "source")} AS b FROM scored) SELECT source, round(sqrt(avg((a - b) * (a - b))), 9) AS rmse FROM r GROUP BY source""",
)
def rank_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scored(spark, sf_dir).select("source", R.unit_rank(F.col("s1"), "source").alias("a"), R.unit_rank(F.col("s2"), "source").alias("b"))
    return r.groupBy("source").agg(r9(M.rmse(F.col("a"), F.col("b"))).alias("rmse"))


def auc_sql(score: str, group: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"""(SELECT {group + "," if group else ""} (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(y) * sum(1 - y), 0) AS auc,
sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {group + "," if group else ""} {score}) - 1) / CAST(2 AS DOUBLE) AS rk FROM scored) GROUP BY ALL)"""


@query("M8_M13_auc_by_stratum", f"WITH {SCORED} SELECT lang, round(auc, 9) AS auc, positives, negatives FROM {auc_sql('s4', 'lang')} UNION ALL SELECT 'all', round(auc, 9), positives, negatives FROM {auc_sql('s4', '')}")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    every = M.auc(s.withColumn("lang", F.lit("all")), "s4", "y", "lang")
    return M.auc(s, "s4", "y", "lang").unionByName(every).withColumn("auc", r9("auc"))


CURVE = f"""{SCORED}, h AS (SELECT s4, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY s4),
c AS (SELECT s4, pos, neg, sum(pos) OVER (ORDER BY s4 DESC) AS tp, sum(neg) OVER (ORDER BY s4 DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h),
r AS (SELECT s4, tp / CAST(p AS DOUBLE) AS tpr, fp / CAST(n AS DOUBLE) AS fpr, (tp - pos) / CAST(p AS DOUBLE) AS tpr0, (fp - neg) / CAST(n AS DOUBLE) AS fpr0, fp, neg, n FROM c)"""


@query(
    "M9_partial_auc",
    f"""WITH {CURVE}, s AS (SELECT *, least(fpr, 0.1) AS e, CASE WHEN fpr > fpr0 THEN (tpr - tpr0) / (fpr - fpr0) ELSE 0 END AS k FROM r WHERE fpr0 < 0.1),
a AS (SELECT sum((e - fpr0) * (tpr0 + tpr0 + k * (e - fpr0)) / 2) AS area FROM s) SELECT round(0.5 * (1 + (area - 0.005) / (0.1 - 0.005)), 9) AS partial_auc FROM a""",
)
def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.partial_auc(scored(spark, sf_dir), "s4", "y", 0.1).withColumn("partial_auc", r9("partial_auc"))


@query("M10_tpr_at_fpr", " UNION ALL ".join(f"SELECT {f} AS rate, (WITH {CURVE} SELECT round(coalesce(max(CASE WHEN fpr <= {f} THEN tpr END), 0), 9) FROM r) AS tpr" for f in (0.01, 0.05, 0.2)))
def tpr_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    parts = [M.tpr_at(s, "s4", "y", f).select(F.lit(f).alias("rate"), r9("tpr").alias("tpr")) for f in (0.01, 0.05, 0.2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "M11a_tie_block_boundary",
    f"""WITH {CURVE}, b AS (SELECT CAST(max(floor(n * CAST(0.1 AS DOUBLE) + 1e-12)) AS BIGINT) AS allowed, coalesce(max(CASE WHEN fp > floor(n * CAST(0.1 AS DOUBLE) + 1e-12) THEN s4 END), CAST('-inf' AS DOUBLE)) AS cutoff FROM r WHERE neg > 0)
SELECT allowed, cutoff, sum(CAST(s4 > cutoff AND y = 1 AS INT))::BIGINT AS tp, sum(CAST(s4 > cutoff AND y = 0 AS INT))::BIGINT AS fp FROM scored, b GROUP BY allowed, cutoff""",
)
def tie_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tie_block_boundary(scored(spark, sf_dir), "s4", "y", 0.1)


@query(
    "M11b_order_statistic_threshold",
    f"""WITH {SCORED}, k AS (SELECT lang, greatest(1, CAST(floor(sum(1 - y) * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS allowed FROM scored GROUP BY lang),
o AS (SELECT lang, s4, row_number() OVER (PARTITION BY lang ORDER BY s4 DESC) AS i FROM scored WHERE y = 0), t AS (SELECT o.lang, allowed, s4 AS cutoff FROM o JOIN k ON o.lang = k.lang AND i = allowed)
SELECT t.lang, allowed, cutoff, sum(CAST(s4 > cutoff AND y = 1 AS INT))::BIGINT AS tp, sum(CAST(s4 > cutoff AND y = 0 AS INT))::BIGINT AS fp FROM scored JOIN t ON scored.lang = t.lang GROUP BY ALL""",
)
def order_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.order_statistic_threshold(scored(spark, sf_dir), "s4", "y", 0.1, "lang")


@query(
    "M12_interpolated_tpr",
    f"""WITH {CURVE}, t AS (SELECT fpr, max(tpr) AS tpr FROM r GROUP BY fpr UNION ALL SELECT 0, 0 WHERE NOT EXISTS (SELECT 1 FROM r WHERE fpr = 0)),
n AS (SELECT *, lead(fpr) OVER (ORDER BY fpr) AS nf, lead(tpr) OVER (ORDER BY fpr) AS nt FROM t)
SELECT round(max(CASE WHEN nf IS NULL THEN tpr ELSE tpr + (nt - tpr) * (0.07 - fpr) / (nf - fpr) END), 9) AS tpr FROM n WHERE fpr <= 0.07 AND (nf IS NULL OR nf > 0.07)""",
)
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.interpolated_tpr(scored(spark, sf_dir), "s4", "y", 0.07).withColumn("tpr", r9("tpr"))


DETECT = f"""{SCORED}, q AS (SELECT quantile_cont(s1, 0.9) AS a, quantile_cont(s2, 0.9) AS b, quantile_cont(s3, 0.9) AS c FROM scored),
d AS (SELECT doc_id, y, name, hit FROM (SELECT doc_id, y, s1 > a AS s1, s2 > b AS s2, s3 > c AS s3 FROM scored, q) UNPIVOT (hit FOR name IN (s1, s2, s3)))"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    q = s.agg(*[F.percentile(c, F.lit(0.9)).alias(f"q{c}") for c in ("s1", "s2", "s3")])
    hits = [(F.col(c) > q.select(f"q{c}").scalar()).alias(c) for c in ("s1", "s2", "s3")]
    return s.select("doc_id", "y", *hits)


@query(
    "M14_U7_detection_overlap",
    f"""WITH {DETECT}, h AS (SELECT doc_id, name FROM d WHERE hit), p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM d a, d b WHERE a.name < b.name)
SELECT p.a, p.b, count(CASE WHEN x AND y2 THEN 1 END) AS common, count(CASE WHEN x OR y2 THEN 1 END) AS either, round(CASE WHEN count(CASE WHEN x OR y2 THEN 1 END) = 0 THEN 1.0 ELSE count(CASE WHEN x AND y2 THEN 1 END) / CAST(count(CASE WHEN x OR y2 THEN 1 END) AS DOUBLE) END, 9) AS jaccard
FROM p JOIN (SELECT a.name AS na, b.name AS nb, a.hit AS x, b.hit AS y2 FROM d a JOIN d b ON a.doc_id = b.doc_id) z ON z.na = p.a AND z.nb = p.b GROUP BY p.a, p.b""",
)
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["s1", "s2", "s3"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    d = _detected(spark, sf_dir)
    one = d.agg(*[f(F.col(a), F.col(b)).alias(f"{k}_{a}_{b}") for a, b in pairs for k, f in (("c", lambda x, y: F.count_if(x & y)), ("e", lambda x, y: F.count_if(x | y)))])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{a}_{b}").alias("common"), F.col(f"e_{a}_{b}").alias("either")) for a, b in pairs])
    out = one.select(F.inline(rows))
    share = F.when(F.col("either") == 0, 1.0).otherwise(F.col("common") / F.nullif("either", F.lit(0)))
    return out.withColumn("jaccard", r9(share))


@query(
    "M15_pair_accuracy",
    f"""WITH {SCORED}, r AS (SELECT lang, y, s2, row_number() OVER (PARTITION BY lang, y ORDER BY {h60_sql("'acc'", "doc_id")}) AS k FROM scored)
SELECT a.lang, round(avg(CASE WHEN a.s2 > b.s2 THEN 1.0 WHEN a.s2 = b.s2 THEN 0.5 ELSE 0.0 END), 9) AS accuracy, count(*) AS pairs FROM r a JOIN r b ON a.lang = b.lang AND a.k = b.k AND a.y = 1 AND b.y = 0 GROUP BY a.lang""",
)
def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("lang", "y").orderBy(h60("acc", F.col("doc_id"))))
    r = scored(spark, sf_dir).withColumn("k", k)
    p = r.groupBy("lang", "k").agg(F.max(F.when(F.col("y") == 1, F.col("s2"))).alias("a"), F.max(F.when(F.col("y") == 0, F.col("s2"))).alias("b")).dropna()
    win = F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    return p.groupBy("lang").agg(r9(F.avg(win)).alias("accuracy"), F.count("*").alias("pairs"))


@query(
    "M16_novelty_proxy_score",
    f"""WITH {DETECT}, w AS (SELECT doc_id, any_value(y) AS y, bool_or(hit AND name = 's3') AS mine, avg(CASE WHEN name <> 's3' THEN CAST(hit AS INT) END) AS overlap FROM d GROUP BY doc_id)
SELECT round(0.5 * ((SELECT auc FROM {auc_sql("s3", "")}) + sum(CASE WHEN y = 1 AND mine THEN 1 - overlap ELSE 0 END) / nullif(sum(y), 0)), 9) AS proxy FROM w""",
)
def proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detected(spark, sf_dir)
    seen = (F.col("s1").cast("int") + F.col("s2").cast("int")) / 2.0
    novelty = F.sum(F.when((F.col("y") == 1) & F.col("s3"), 1 - seen).otherwise(0.0)) / F.nullif(F.sum("y"), F.lit(0))
    area = M.auc(scored(spark, sf_dir), "s3", "y").select("auc").scalar()
    return d.agg(novelty.alias("n")).select(r9(0.5 * (area + F.col("n"))).alias("proxy"))


@query(
    "M17_M18_M19_study_distance",
    f"""WITH {PANEL}, s AS (SELECT study, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(CAST(k IS NULL OR k < 20 AS INT)) AS missing FROM panel GROUP BY study),
f AS (SELECT study, feature, count(*) / CAST(sum(count(*)) OVER (PARTITION BY study) AS DOUBLE) AS p FROM panel GROUP BY study, feature),
tv AS (SELECT a.study AS a, b.study AS b, 0.5 * sum(abs(a.p - b.p)) AS tv FROM f a JOIN f b ON a.feature = b.feature AND a.study < b.study GROUP BY ALL)
SELECT x.study AS a, y.study AS b, round((least(1, abs(x.med - y.med) / nullif(x.iqr, 0)) + abs(x.missing - y.missing) + tv) / 3, 9) AS distance FROM s x JOIN s y ON x.study < y.study JOIN tv ON tv.a = x.study AND tv.b = y.study""",
)
def study_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = p.groupBy("study").agg(q.alias("q"), F.avg((F.col("k").isNull() | (F.col("k") < 20)).cast("int")).alias("missing"))
    s = s.select("study", F.col("q")[1].alias("med"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "missing")
    f = p.groupBy("study", "feature").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("study")))
    side = lambda df, m: df.select(*[F.col(c).alias(f"{c}_{m}") for c in df.columns])
    tv = side(f, "a").join(side(f, "b"), F.col("feature_a") == F.col("feature_b")).where("study_a < study_b")
    tv = tv.groupBy("study_a", "study_b").agg((0.5 * F.sum(F.abs(F.col("p_a") - F.col("p_b")))).alias("tv"))
    out = tv.join(side(s, "a"), "study_a").join(side(s, "b"), "study_b")
    location = F.least(F.lit(1.0), F.abs(F.col("med_a") - F.col("med_b")) / F.nullif("iqr_a", F.lit(0.0)))
    total = (location + F.abs(F.col("missing_a") - F.col("missing_b")) + F.col("tv")) / 3
    return out.select(F.col("study_a").alias("a"), F.col("study_b").alias("b"), r9(total).alias("distance"))


@query(
    "M18_robust_scale_fallback",
    f"""WITH {PANEL}, m AS (SELECT study, feature, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM panel GROUP BY ALL),
d AS (SELECT p.study, p.feature, 1.4826 * quantile_cont(abs(value - med), 0.5) AS mad FROM panel p JOIN m ON p.study = m.study AND p.feature = m.feature GROUP BY ALL)
SELECT study, feature, round(CASE WHEN iqr > 1e-12 THEN iqr WHEN mad > 1e-12 THEN mad END, 9) AS scale FROM m JOIN d USING (study, feature)""",
)
def robust_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("study", "feature", "value")
    m = p.groupBy("study", "feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    d = p.join(m, ["study", "feature"]).groupBy("study", "feature").agg(
        F.first(F.col("q")[2] - F.col("q")[0]).alias("iqr"), (1.4826 * F.percentile(F.abs(F.col("value") - F.col("q")[1]), F.lit(0.5))).alias("mad")
    )
    return d.select("study", "feature", r9(F.when(F.col("iqr") > 1e-12, F.col("iqr")).when(F.col("mad") > 1e-12, F.col("mad"))).alias("scale"))


@query(
    "M19_total_variation",
    """WITH l AS (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, doc_id % 2 AS side FROM documents), p AS (SELECT side, coalesce(lang, '<missing>') AS level, count(*) / CAST(sum(count(*)) OVER (PARTITION BY side) AS DOUBLE) AS p FROM l GROUP BY side, coalesce(lang, '<missing>'))
SELECT round(0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 9) AS distance FROM (SELECT * FROM p WHERE side = 0) a FULL JOIN (SELECT * FROM p WHERE side = 1) b ON a.level = b.level""",
)
def variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    return M.total_variation(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "lang").withColumn("distance", r9("distance"))


@query(
    "M20_feature_shift",
    f"""WITH {SCORED}, l AS (SELECT lang = 'en' AS src, name, value FROM scored UNPIVOT (value FOR name IN (s1, s2, s3))),
g AS (SELECT name, quantile_cont(CASE WHEN src THEN value END, 0.5) AS ms, quantile_cont(CASE WHEN NOT src THEN value END, 0.5) AS mt, quantile_cont(CASE WHEN src THEN value END, 0.75) - quantile_cont(CASE WHEN src THEN value END, 0.25) AS iqr FROM l GROUP BY name)
SELECT name, round(abs(mt - ms) / nullif(iqr, 0), 9) AS shift, (SELECT count(DISTINCT source) FROM scored WHERE lang <> 'en' AND source NOT IN (SELECT source FROM scored WHERE lang = 'en')) AS unseen_levels FROM g""",
)
def feature_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    src = F.col("lang") == "en"
    lv = s.select(src.alias("src"), "doc_id", "s1", "s2", "s3").unpivot(["src", "doc_id"], ["s1", "s2", "s3"], "name", "value")
    q = lambda c, p: F.percentile(F.when(c, F.col("value")), F.lit(p))
    g = lv.groupBy("name").agg(q(F.col("src"), 0.5).alias("ms"), q(~F.col("src"), 0.5).alias("mt"), (q(F.col("src"), 0.75) - q(F.col("src"), 0.25)).alias("iqr"))
    unseen = s.where(~src).join(s.where(src).select("source").distinct(), "source", "left_anti").agg(F.count_distinct("source").alias("n")).scalar()
    return g.select("name", r9(F.abs(F.col("mt") - F.col("ms")) / F.nullif("iqr", F.lit(0.0))).alias("shift"), unseen.alias("unseen_levels"))


@query(
    "M21_effective_size",
    "SELECT l_returnflag, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 6) AS effective FROM lineitem GROUP BY l_returnflag",
)
def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(M.effective_size(F.col("l_quantity")), 6).alias("effective"))


@query(
    "M22_M23_promotion_gate",
    f"""WITH {SCORED}, f AS (SELECT doc_id % 5 AS fold, (covar_pop(s1, y) / nullif(stddev_pop(s1) * stddev_pop(y), 0)) AS a, (covar_pop(s2, y) / nullif(stddev_pop(s2) * stddev_pop(y), 0)) AS b FROM scored GROUP BY doc_id % 5)
SELECT count_if(b > a) AS wins, count(*) AS folds, round(avg(b - a), 9) AS mean_gain, count_if(b > a) >= count(*) // 2 + 1 AND avg(b - a) > 0 AND min(b - a) > -0.05 AS promoted FROM f""",
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scored(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("fold")).agg((correlation("s2", "y") - correlation("s1", "y")).alias("g"))
    wins = F.count_if(F.col("g") > 0)
    ok = (wins >= F.floor(F.count("*") / 2) + 1) & (F.avg("g") > 0) & (F.min("g") > -0.05)
    return f.agg(wins.alias("wins"), F.count("*").alias("folds"), r9(F.avg("g")).alias("mean_gain"), ok.alias("promoted"))


@query("M25_row_coverage", "SELECT d.doc_id, CAST(lang IS NOT NULL AS INT) + CAST(quality IS NOT NULL AS INT) + CAST(toxic IS NOT NULL AS INT) AS present FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def row_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", sum((F.col(c).isNotNull().cast("int") for c in ("lang", "quality", "toxic")), F.lit(0)).alias("present"))


@query(
    "M26_depth_profile",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), q AS (SELECT vec_id, list_avg(a) AS m, list_stddev_pop(a) AS s, list_min(a) AS lo, list_max(a) AS hi, a,
  list_transform(range(0, 16), lambda i: a[CAST(floor(i * (len(a) - 1) / CAST(15 AS DOUBLE)) AS BIGINT) + 1] + (i * (len(a) - 1) / CAST(15 AS DOUBLE) - floor(i * (len(a) - 1) / CAST(15 AS DOUBLE))) * (a[least(CAST(floor(i * (len(a) - 1) / CAST(15 AS DOUBLE)) AS BIGINT) + 2, len(a))] - a[CAST(floor(i * (len(a) - 1) / CAST(15 AS DOUBLE)) AS BIGINT) + 1])) AS p FROM a)
SELECT vec_id, round(m, 9) AS mean, round(s, 9) AS std, round(lo, 9) AS low, round(hi, 9) AS high, round(p[2], 9) AS p1, round(p[9], 9) AS p8, round(p[16], 9) AS p15 FROM q""",
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen interpolated points of a vector and its moments, inside the row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")).withColumn("m", A.mean(F.col("a")))
    last = F.size("a") - 1

    def point(i: int):  # noqa: ANN202
        at = F.lit(float(i)) * last / 15.0
        k = F.floor(at).cast("int")
        x, y = F.get("a", k), F.get("a", F.least(k + 1, last))
        return r9(x + (at - F.floor(at)) * (y - x)).alias(f"p{i}")

    std = F.sqrt(A.mean(F.transform("a", lambda x: (x - F.col("m")) * (x - F.col("m")))))
    return e.select("vec_id", r9("m").alias("mean"), r9(std).alias("std"), r9(F.array_min("a")).alias("low"), r9(F.array_max("a")).alias("high"), point(1), point(8), point(15))


@query(
    "M27_vector_geometry",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), s AS (SELECT vec_id, a[1:32] AS x, a[33:64] AS y, a FROM a)
SELECT vec_id, round(sqrt(list_dot_product(a, a) / len(a)), 9) AS rms, round(list_dot_product(x, y) / greatest(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)), 1e-12), 9) AS cosine,
round(sqrt(list_dot_product(list_transform(range(1, 33), lambda i: y[i] - x[i]), list_transform(range(1, 33), lambda i: y[i] - x[i]))) / greatest(sqrt(list_dot_product(x, x)), 1e-12), 9) AS relative_delta FROM s""",
)
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    e = e.select("vec_id", "a", F.slice("a", 1, 32).alias("x"), F.slice("a", 33, 32).alias("y"))
    e = e.withColumn("d", F.zip_with("y", "x", lambda p, q: p - q))
    a, x, y = F.col("a"), F.col("x"), F.col("y")
    return e.select("vec_id", r9(F.sqrt(A.dot(a, a) / F.size(a))).alias("rms"), r9(A.cosine(x, y)).alias("cosine"), r9(A.norm(F.col("d")) / F.greatest(A.norm(x), F.lit(1e-12))).alias("relative_delta"))


@query("M28_rounding_interval", "SELECT c_custkey, round(6 * (round(c_acctbal / 10000, 2) - 0.005), 9) AS low, round(6 * (round(c_acctbal / 10000, 2) + 0.005), 9) AS high FROM customer")
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = C.rounded(F.col("c_acctbal") / 10000, 2)
    return table(spark, sf_dir, "customer").select("c_custkey", r9(6 * (shown - 0.005)).alias("low"), r9(6 * (shown + 0.005)).alias("high"))


@query(
    "M29_held_out_direction",
    f"""WITH {SPEARMAN}, q AS (SELECT source, {unit_rank_sql("s2", "source")} AS u, {unit_rank_sql("s1", "source")} AS v FROM scored),
h AS (SELECT x.source, sign(round(quantile_cont(y.rho, 0.5), 9)) AS dir FROM rho x JOIN rho y ON x.source <> y.source GROUP BY x.source)
SELECT q.source, CAST(any_value(dir) AS INT) AS direction, round(covar_pop(v, u * dir) / nullif(stddev_pop(v) * stddev_pop(u * dir), 0), 9) + 0 AS rho FROM q JOIN h ON q.source = h.source GROUP BY q.source""",
)
def held_out_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign learnt on all other sources (one row each), applied to the held-out source's ranks."""
    s = scored(spark, sf_dir)
    g = M.spearman(s, "s1", "s2", "source").select("source", "rho")
    o = g.select(F.col("source").alias("other"), F.col("rho").alias("r"))
    h = g.join(o, F.col("source") != F.col("other")).groupBy("source").agg(F.signum(r9(F.percentile("r", F.lit(0.5)))).alias("dir"))
    r = s.select("source", R.unit_rank(F.col("s1"), "source").alias("v"), R.unit_rank(F.col("s2"), "source").alias("u")).join(h, "source")
    return r.groupBy("source").agg(F.first("dir").cast("int").alias("direction"), r9(correlation(F.col("v"), F.col("u") * F.col("dir"))).alias("rho"))


@query(
    "M30_tie_structure",
    f"""WITH {SCORED}, v AS (SELECT lang, s4, count(*) AS k FROM scored GROUP BY lang, s4) SELECT lang, count_if(k > 1) AS tie_groups, max(k) AS largest, sum(CASE WHEN k > 1 THEN k ELSE 0 END)::BIGINT AS tied_rows FROM v GROUP BY lang""",
)
def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scored(spark, sf_dir).groupBy("lang", "s4").agg(F.count("*").alias("k"))
    return v.groupBy("lang").agg(F.count_if(F.col("k") > 1).alias("tie_groups"), F.max("k").alias("largest"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("tied_rows"))
