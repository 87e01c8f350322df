"""Audits of eligibility, overlap, shift and strata, and the whole forms of several sequence and vector features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import arrays as A
from tessera.operators import audits as U
from tessera.operators import linear as L
from tessera.operators import metrics as M
from tessera.operators import ranks as R
from tessera.operators import sequences as Q
from tessera.operators import text as D
from tessera.operators.joins import small
from tessera.operators.positions import numbered
from tessera.plans.base import PANEL, SCORED, panel, r9, scored, unit_rank_sql
from tessera.plans.evaluation import SPEARMAN
from tessera.registry import query, spread, table

DETECTED = f"""{SCORED}, q AS (SELECT quantile_cont(s1, 0.9) AS q1, quantile_cont(s2, 0.9) AS q2, quantile_cont(s3, 0.9) AS q3 FROM scored), hit AS (SELECT s1 > q1 AS s1, s2 > q2 AS s2, s3 > q3 AS s3 FROM scored, q)"""


@query(
    "M14_unique_detections",
    f"""WITH {DETECTED} SELECT 's1' AS name, count_if(s1) AS hits, count_if(s1 AND NOT s2 AND NOT s3) AS unique_hits FROM hit UNION ALL SELECT 's2', count_if(s2), count_if(s2 AND NOT s1 AND NOT s3) FROM hit
UNION ALL SELECT 's3', count_if(s3), count_if(s3 AND NOT s1 AND NOT s2) FROM hit""",
)
def unique_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.evaluation import _detected

    return U.unique_detections(_detected(spark, sf_dir), ["s1", "s2", "s3"])


@query(
    "M13_metrics_by_stratum",
    f"""WITH {SCORED}, e AS (SELECT list_distinct([quantile_cont(n_chars, 0.2), quantile_cont(n_chars, 0.4), quantile_cont(n_chars, 0.6), quantile_cont(n_chars, 0.8)]) AS e FROM scored),
b AS (SELECT scored.*, CAST(len(list_filter(e, lambda x: n_chars > x)) AS VARCHAR) AS bin FROM scored, e), k AS (SELECT 'language' AS kind, lang AS stratum, y, s4 FROM b UNION ALL SELECT 'length', bin, y, s4 FROM b UNION ALL SELECT 'all', 'all', y, s4 FROM b),
r AS (SELECT *, rank() OVER (PARTITION BY kind, stratum ORDER BY s4) + (count(*) OVER (PARTITION BY kind, stratum, s4) - 1) / CAST(2 AS DOUBLE) AS rk FROM k),
a AS (SELECT kind, stratum, count(*) AS rows, sum(y)::BIGINT AS positives, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM r GROUP BY ALL),
h AS (SELECT kind, stratum, s4, sum(y) AS p, sum(1 - y) AS n FROM k GROUP BY ALL), c AS (SELECT kind, stratum, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER w AS pp, sum(n) OVER w AS nn FROM h WINDOW d AS (PARTITION BY kind, stratum ORDER BY s4 DESC), w AS (PARTITION BY kind, stratum)),
t AS (SELECT kind, stratum, coalesce(max(CASE WHEN fp / nn <= 0.05 THEN tp / pp END), 0) AS tpr FROM c GROUP BY ALL)
SELECT kind, stratum, rows, positives, round(auc, 9) AS auc, round(tpr, 9) AS tpr05 FROM a JOIN t USING (kind, stratum) WHERE rows >= 20 AND positives > 0 AND positives < rows""",
)
def metrics_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and true positive rate at 5 % false ones by language, by length quintile and over all; strata of 20 rows and both classes."""
    s = R.qcut(scored(spark, sf_dir), "n_chars", 5, "bin")
    kind = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("stratum"))
    k = s.select("y", "s4", F.explode(F.array(kind("language", F.col("lang")), kind("length", F.col("bin").cast("string")), kind("all", F.lit("all")))).alias("k")).select("y", "s4", "k.*")
    n = k.groupBy("kind", "stratum").agg(F.count("*").alias("rows"), F.sum("y").alias("positives"))
    both = M.auc(k, "s4", "y", "kind", "stratum").select("kind", "stratum", "auc").join(M.tpr_at(k, "s4", "y", 0.05, "kind", "stratum"), ["kind", "stratum"])
    out = n.where("rows >= 20 and positives > 0 and positives < rows").join(both, ["kind", "stratum"])
    return out.select("kind", "stratum", "rows", "positives", r9("auc").alias("auc"), r9("tpr").alias("tpr05"))


@query(
    "M20_shift_audit",
    f"""WITH {SCORED}, d AS (SELECT lang = 'en' AS src, s1, CASE WHEN doc_id % 11 <> 0 THEN s2 END AS s2, s3, s4, source, CASE WHEN doc_id % 7 <> 0 THEN CAST(floor(log2(n_chars)) AS INT) END AS bucket FROM scored),
l AS (SELECT src, name, value FROM d UNPIVOT INCLUDE NULLS (value FOR name IN (s1, s2, s3, s4))),
n AS (SELECT name, quantile_cont(value, 0.5) FILTER (src) AS ms, quantile_cont(value, 0.75) FILTER (src) - quantile_cont(value, 0.25) FILTER (src) AS iqr, quantile_cont(value, 0.5) FILTER (NOT src) AS mh,
abs(avg(CAST(value IS NULL AS INT)) FILTER (src) - avg(CAST(value IS NULL AS INT)) FILTER (NOT src)) AS gap FROM l GROUP BY name), s AS (SELECT *, abs(mh - ms) / CASE WHEN iqr <= 1e-12 THEN 1e-12 ELSE iqr END AS shift FROM n),
c AS (SELECT src, 'source' AS col, coalesce(source, '?') AS level FROM d UNION ALL SELECT src, 'bucket', coalesce(CAST(bucket AS VARCHAR), '?') FROM d), v AS (SELECT col, level, count_if(src) AS a, count_if(NOT src) AS b FROM c GROUP BY ALL),
w AS (SELECT *, sum(a) OVER (PARTITION BY col) AS ta, sum(b) OVER (PARTITION BY col) AS tb FROM v), t AS (SELECT col, 0.5 * sum(abs(a / ta - b / tb)) AS tv, count_if(a = 0) AS levels, sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS unseen, any_value(tb) AS rows FROM w GROUP BY col)
SELECT count(*) AS features, count(shift) AS usable, count(*) - count(shift) AS unavailable, count_if(iqr <= 1e-12) AS zero_iqr, round(avg(shift), 9) AS mean_shift, round(quantile_cont(shift, 0.9), 9) AS p90_shift, round(avg(gap), 9) AS mean_missing_delta,
(SELECT sum(levels)::BIGINT FROM t) AS unseen_levels, (SELECT round(sum(unseen) / sum(rows), 9) FROM t) AS unseen_fraction, (SELECT round(avg(tv), 9) FROM t) AS mean_tv, (SELECT round(max(tv), 9) FROM t) AS max_tv FROM s""",
)
def shift_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English labelled documents as source, all others as held: shifts of four numeric and two categorical columns."""
    s = scored(spark, sf_dir).withColumn("s2", F.when(F.col("doc_id") % 11 != 0, F.col("s2")))
    s = s.withColumn("bucket", F.when(F.col("doc_id") % 7 != 0, F.floor(F.log2("n_chars")).cast("int")))
    out = U.shift_audit(s, F.col("lang") == "en", ["s1", "s2", "s3", "s4"], ["source", "bucket"])
    real = ("mean_shift", "p90_shift", "mean_missing_delta", "unseen_fraction", "mean_tv", "max_tv")
    return out.select(*[r9(c).alias(c) if c in real else F.col(c) for c in out.columns])


@query(
    "M17_study_distances",
    f"""WITH {PANEL}, w AS (SELECT study, participant, avg(value) FILTER (feature = 'click') AS click, avg(value) FILTER (feature = 'purchase' AND day <= 10) AS purchase, avg(k) FILTER (day <= 20) AS age, any_value('k' || (participant % 3)) AS sex, any_value('g' || (participant % 7)) AS race FROM panel GROUP BY study, participant),
l AS (SELECT study, name, value FROM w UNPIVOT INCLUDE NULLS (value FOR name IN (click, purchase, age))), q AS (SELECT study, name, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(CAST(value IS NULL AS INT)) AS gone FROM l GROUP BY ALL),
d AS (SELECT study, name, quantile_cont(abs(value - med), 0.5) AS mad FROM l JOIN q USING (study, name) GROUP BY study, name), s AS (SELECT *, CASE WHEN iqr > 1e-12 THEN iqr WHEN mad > 1e-12 THEN 1.4826 * mad END AS scale FROM q JOIN d USING (study, name)),
p AS (SELECT a.study AS a, b.study AS b, name, least(1, abs(a.med - b.med) / a.scale) AS loc, abs(a.gone - b.gone) AS gap, a.med IS NOT NULL AND b.med IS NOT NULL AND a.scale IS NOT NULL AS ok FROM s a JOIN s b USING (name) WHERE a.study < b.study),
c AS (SELECT a, b, avg(loc) FILTER (ok AND name <> 'age') AS location, avg(gap) FILTER (name <> 'age') AS missingness, any_value(loc) FILTER (ok AND name = 'age') AS al, any_value(gap) FILTER (name = 'age') AS ag FROM p GROUP BY a, b), g AS (SELECT *, list_avg(list_filter([al, ag], lambda x: x IS NOT NULL)) AS age FROM c),
f AS (SELECT study, 'sex' AS col, sex AS level FROM w UNION ALL SELECT study, 'race', race FROM w), n AS (SELECT study, col, level, k / CAST(sum(k) OVER (PARTITION BY study, col) AS DOUBLE) AS share FROM (SELECT study, col, level, count(*) AS k FROM f GROUP BY study, col, level)),
t AS (SELECT x.study AS a, y.study AS b, 1 - sum(least(x.share, y.share)) / 2 AS categorical FROM n x JOIN n y USING (col, level) WHERE x.study < y.study GROUP BY x.study, y.study)
SELECT a, b, round(location, 9) AS location, round(missingness, 9) AS missingness, round(age, 9) AS age, round(coalesce(categorical, 1), 9) AS categorical,
round(list_avg(list_filter([location, missingness, age, coalesce(categorical, 1)], lambda x: x IS NOT NULL)), 9) AS distance FROM g LEFT JOIN t USING (a, b)""",
)
def study_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of five studies' participants by two assays, an age and two categories."""
    p = panel(spark, sf_dir)
    part = lambda cond, c: F.avg(F.when(F.expr(cond), F.col(c)))
    w = p.groupBy("study", "participant").agg(part("feature = 'click'", "value").alias("click"), part("feature = 'purchase' and day <= 10", "value").alias("purchase"), part("day <= 20", "k").alias("age"))
    w = w.withColumn("sex", F.concat(F.lit("k"), (F.col("participant") % 3).cast("string"))).withColumn("race", F.concat(F.lit("g"), (F.col("participant") % 7).cast("string")))
    out = U.study_distances(w, "study", ["click", "purchase"], "age", ["sex", "race"])
    return out.select("a", "b", *[r9(c).alias(c) for c in out.columns[2:]])


@query(
    "M26_full_profile",
    f"""WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), p AS (SELECT vec_id, a, len(a) AS n, list_avg(a) AS m,
list_transform(range(0, 16), lambda i: a[CAST(floor(i * (len(a) - 1) / CAST(15 AS DOUBLE)) AS BIGINT) + 1] + (i * (len(a) - 1) / CAST(15 AS DOUBLE) - floor(i * (len(a) - 1) / CAST(15 AS DOUBLE))) * (a[least(CAST(floor(i * (len(a) - 1) / CAST(15 AS DOUBLE)) AS BIGINT) + 2, len(a))] - a[CAST(floor(i * (len(a) - 1) / CAST(15 AS DOUBLE)) AS BIGINT) + 1])) AS p FROM a)
SELECT vec_id, {", ".join(f"round(p[{i + 1}], 9) AS p{i:02d}" for i in range(16))}, round(m, 9) AS mean, round(list_stddev_pop(a), 9) AS std, round(list_min(a), 9) AS low, round(list_max(a), 9) AS high,
{", ".join(f"round(list_aggregate(a, 'quantile_cont', {q}), 9) AS q{int(100 * q)}" for q in (0.25, 0.5, 0.75))},
round(list_sum(list_transform(range(0, n), lambda i: (a[i + 1] - m) * (i / CAST(n - 1 AS DOUBLE) - 0.5))) / list_sum(list_transform(range(0, n), lambda i: (i / CAST(n - 1 AS DOUBLE) - 0.5) * (i / CAST(n - 1 AS DOUBLE) - 0.5))), 9) AS slope FROM p""",
)
def full_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen interpolated points of a vector over its depth, its moments and quartiles, and its slope over depth."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    e = e.withColumn("p", A.interpolated(F.col("a"), 16)).withColumn("o", F.array_sort("a")).withColumn("m", A.mean(F.col("a")))
    std = F.sqrt(A.mean(F.transform("a", lambda x: (x - F.col("m")) * (x - F.col("m")))))
    return e.select(
        "vec_id", *[r9(F.get("p", i)).alias(f"p{i:02d}") for i in range(16)], r9("m").alias("mean"), r9(std).alias("std"), r9(F.array_min("a")).alias("low"), r9(F.array_max("a")).alias("high"),
        *[r9(A.sorted_quantile(F.col("o"), q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)], r9(A.slope(F.col("a"))).alias("slope"),
    )


@query(
    "M29_pooled_direction",
    f"""WITH {SPEARMAN}, q AS (SELECT source, s1, {unit_rank_sql("s2", "source")} AS u FROM scored),
h AS (SELECT x.source, sign(round(quantile_cont(y.rho, 0.5), 9)) AS dir FROM rho x JOIN rho y ON x.source <> y.source GROUP BY x.source),
turned AS (SELECT q.source, s1, CASE WHEN dir < 0 THEN 1 - u ELSE u END AS prediction FROM q JOIN h USING (source)),
ranked AS (SELECT rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY round(prediction, 12)) + (count(*) OVER (PARTITION BY round(prediction, 12)) - 1) / CAST(2 AS DOUBLE) AS b FROM turned)
SELECT count(*) AS rows, (SELECT count(*) FROM h) AS folds, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 9) AS pooled FROM ranked""",
)
def pooled_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank correlation over all held sources together: each source's ranks turned by the sign learnt on the others."""
    s = scored(spark, sf_dir)
    g = M.spearman(s, "s1", "s2", "source").select("source", "rho")
    o = g.select(F.col("source").alias("other"), F.col("rho").alias("r"))
    h = g.join(o, F.col("source") != F.col("other")).groupBy("source").agg(F.signum(r9(F.percentile("r", F.lit(0.5)))).alias("dir"))  # one row a source
    r = R.with_places(s.select("source", "s1", "s2"), "s2", "u", R.unit_of, "source").join(small(h), "source")
    r = r.select("s1", F.round(F.when(F.col("dir") < 0, 1 - F.col("u")).otherwise(F.col("u")), 12).alias("p"))
    plain = lambda rank, n: rank
    r = R.with_places(R.with_places(r, "s1", "a", plain), "p", "b", plain)
    from tessera.operators.metrics import correlation

    return r.agg(F.count("*").alias("rows"), r9(correlation("a", "b")).alias("pooled")).select("rows", h.agg(F.count("*").alias("n")).scalar().alias("folds"), "pooled")


@query(
    "Q7_budget_deltas",
    """WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS DOUBLE)) AS v FROM documents), n AS (SELECT doc_id, v, len(v) AS n FROM t WHERE len(v) >= 8),
s AS (SELECT DISTINCT doc_id, v, n, least(n - 4, CAST(floor(n * f) AS BIGINT)) AS start FROM n, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) a(f)),
c AS (SELECT doc_id, start, list_avg(v[greatest(1, start - 27):start + 4]) AS c32, CASE WHEN start + 4 >= 128 THEN list_avg(v[start - 123:start + 4]) END AS c128, CASE WHEN start + 4 >= 512 THEN list_avg(v[start - 507:start + 4]) END AS c512 FROM s WHERE start + 4 >= 32)
SELECT doc_id, count(*) AS spans, count(c512) AS long_spans, round(avg(c128 - c32), 9) AS delta_128_32, round(avg(c512 - c32), 9) AS delta_512_32 FROM c GROUP BY doc_id""",
)
def budget_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same four target tokens seen in contexts of 32, 128 and 512 tokens that end with them; a context that a text lacks gives none, and no delta."""
    v = F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("double"))
    d = table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).where(F.size("v") >= 8)
    n = F.size("v")
    starts = F.array_distinct(F.array(*[F.least(n - 4, F.floor(n * f).cast("int")) for f in (0.25, 0.5, 0.75)]))
    d = d.select("doc_id", "v", F.explode(starts).alias("s")).withColumn("end", F.col("s") + 4).where("end >= 32")
    mean = lambda k: F.when(F.col("end") >= k, A.mean(F.slice("v", F.greatest(F.col("end") - k + 1, F.lit(1)), F.lit(k))))
    d = d.select("doc_id", mean(32).alias("c32"), mean(128).alias("c128"), mean(512).alias("c512"))
    return d.groupBy("doc_id").agg(
        F.count("*").alias("spans"), F.count("c512").alias("long_spans"), r9(F.avg(F.col("c128") - F.col("c32"))).alias("delta_128_32"), r9(F.avg(F.col("c512") - F.col("c32"))).alias("delta_512_32")
    )


@query(
    "Q8_rank_rates",
    """WITH t AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: 1 + CAST(floor(abs(x) * 8) AS BIGINT)) AS k FROM embeddings)
SELECT vec_id, round(len(list_filter(k, lambda x: x <= 1)) / CAST(len(k) AS DOUBLE), 9) AS top1_rate, round(len(list_filter(k, lambda x: x <= 5)) / CAST(len(k) AS DOUBLE), 9) AS top5_rate, round(list_avg(list_transform(k, lambda x: ln(x))), 9) AS log_rank FROM t""",
)
def rank_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ranks that tokens took: the shares of first ranks and of ranks up to five, and the mean log rank."""
    k = F.transform("embedding", lambda x: 1 + F.floor(F.abs(x.cast("double")) * 8))
    return table(spark, sf_dir, "embeddings").select("vec_id", k.alias("k")).select("vec_id", *[r9(c).alias(n) for n, c in Q.rank_features(F.col("k")).items()])


CONDITIONS = {"raw_suffix_256": ("suffix", 256, False), "raw_suffix_254": ("suffix", 254, False), "bos_suffix_254": ("suffix", 254, True), "bos_prefix_254": ("prefix", 254, True), "bos_middle_254": ("middle", 254, True)}


@query(
    "Q16_context_plans",
    f"""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE octet_length(encode(text)) >= 2),
c(condition, region, room, wrapped) AS (VALUES {", ".join(f"('{k}', '{r}', {n}, {str(w).lower()})" for k, (r, n, w) in CONDITIONS.items())}),
s AS (SELECT doc_id, condition, wrapped, h, least(n, room) AS used, CASE WHEN n <= room OR region = 'prefix' THEN 0 WHEN region = 'suffix' THEN n - room ELSE (n - room) // 2 END AS start FROM b, c)
SELECT doc_id, condition, used AS selected, CASE WHEN wrapped THEN used ELSE used - 1 END AS scored, CASE WHEN wrapped THEN used + 2 ELSE used END AS attended, CAST(256 AS BIGINT) AS width, md5(substr(h, 2 * start + 1, 2 * used)) AS content FROM s""",
)
def context_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five conditions of a text's byte code: a region, with or without its wrapper, padded to 256 ids, and what of it is scored."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "text").where(F.octet_length("text") >= 2).select("doc_id", Q.byte_ids(F.col("text")).alias("ids"))
    plans = F.array(*[F.struct(F.lit(k).alias("condition"), *Q.context_plan(F.col("ids"), r, n, w, 256)) for k, (r, n, w) in CONDITIONS.items()])
    p = d.select("doc_id", F.explode(F.filter(plans, lambda x: x["condition"].isNotNull())).alias("p")).select("doc_id", "p.*")
    body = F.slice("input_ids", F.when(F.col("wrapped"), 2).otherwise(1), F.col("selected").cast("int"))
    content = F.md5(F.array_join(F.transform(body, lambda i: F.lpad(F.hex((i - Q.SHIFT).cast("long")), 2, "0")), ""))
    attended = F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x)
    return p.select("doc_id", "condition", "selected", "scored", attended.alias("attended"), F.size("input_ids").cast("long").alias("width"), content.alias("content"))


@query(
    "J2_checked_view",
    "SELECT d.doc_id, lang, quality AS view_quality, l.doc_id IS NOT NULL AS has_view FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def checked_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as an optional view whose study (the language) must be the document's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    view = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("view_quality")).join(d, "doc_id")
    return U.attach_view(d, view, ["doc_id"], "lang").select("doc_id", "lang", "view_quality", "has_view")


RECORDS = """CASE doc_id % 6 WHEN 0 THEN '"1"' WHEN 1 THEN 'true' WHEN 2 THEN '2' ELSE '1' END"""


@query(
    "F4_eligible_records",
    "SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 5000 AND trim(text, ' ') <> '' AND doc_id % 6 NOT IN (1, 2) AND doc_id % 5 NOT IN (0, 1, 2)",
)
def eligible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON records with copies of several types and autogenerated flags that are true, text or false."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    copies = F.expr(RECORDS)
    flag = F.when(F.col("doc_id") % 5 == 0, "true").when(F.col("doc_id") % 5 == 1, '"false"').when(F.col("doc_id") % 5 == 2, "0").otherwise("false")
    body = F.to_json(F.struct(F.col("text").alias("content"), F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path")))
    record = F.concat(F.rtrim(body, F.lit("}")), F.lit(', "copies": '), copies, F.lit(', "autogenerated": '), flag, F.lit("}"))
    return d.where(U.eligible(record, 200, 5000)).select("doc_id")


@query(
    "X4_identifier_words",
    r"""WITH i AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || 'XMLNode2' AS id FROM part)
SELECT p_partkey, array_to_string(regexp_extract_all(id, '[A-Za-z][a-z0-9]*'), '|') AS words FROM i""",
)
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of snake- and camel-case names that are made of a part's name and type."""
    camel = F.array_join(F.transform(F.split("p_type", " "), lambda w: F.initcap(F.lower(w))), "")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), camel, F.lit("XMLNode2"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("id"))
    return p.select("p_partkey", F.array_join(Q.identifier_words(F.col("id")), "|").alias("words"))


@query("S14_all_languages", "SELECT coalesce(lang, 'und') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table for each language that occurs, united again with its tag."""
    from tessera.sources.readers import tagged_union

    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.coalesce("lang", F.lit("und")).alias("l"))
    names = sorted(r["l"] for r in d.select("l").distinct().collect())  # one a language
    parts = {x: d.where(F.col("l") == x).drop("l") for x in names}
    return tagged_union(parts, "lang").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("T10_S12_bounded_scan", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500")
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 events by position; every task keeps 500 at most."""
    return table(spark, sf_dir, "events").select("event_id", "event_type").orderBy("event_id").limit(500)


@query(
    "G22_panel_overlap_splits",
    f"""WITH {PANEL}, r AS (SELECT feature AS s, participant % 40 AS u, k AS m, k < 12 AS hit FROM panel), v AS (SELECT s AS held, count(DISTINCT CASE WHEN hit THEN m END) AS validation_members FROM r GROUP BY s),
t AS (SELECT held, count(DISTINCT r.s) AS n FROM v, r WHERE r.s <> held AND r.hit AND NOT EXISTS (SELECT 1 FROM r x WHERE x.s = held AND x.u = r.u) GROUP BY held)
SELECT v.held, validation_members, coalesce(n, 0) AS training_studies, CASE WHEN validation_members = 0 THEN 'zero_panel_overlap' WHEN coalesce(n, 0) < 3 THEN 'too_few_training_studies' END AS skipped FROM v LEFT JOIN t USING (held)""",
)
def panel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as studies and groups of users as subjects: which splits have a panel's members on both sides."""
    p = panel(spark, sf_dir).select("feature", (F.col("participant") % 40).alias("u"), F.col("k"))
    return U.overlap_splits(p, "feature", "u", "k", list(range(12)), 3)


@query("D7_D14_group_diagnostics")
def group_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups with dense numbers, by size: how many groups and rows, and whether they are single."""
    from tessera.plans.corpus import minhash_groups

    g = minhash_groups(spark, sf_dir)
    ids = numbered(g.select("group").distinct(), ["group"], out="dense")
    sizes = g.join(ids, "group").groupBy("dense").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"), F.min("dense").alias("first_group"), F.max("dense").alias("last_group"))


@query("D8_source_linked_groups")
def source_linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k groups joined with the links of rows that come from one batch of a source (a hundred neighbouring ids)."""
    from tessera.plans.corpus import bottom_k_groups

    near = bottom_k_groups(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("batch"))
    first = d.groupBy("batch").agg(F.min("doc_id").alias("a"))
    own = d.join(first, "batch").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    links = near.where(F.col("doc_id") != F.col("group")).select(F.col("group").alias("a"), F.col("doc_id").alias("b")).unionByName(own)
    return D.groups(near, "doc_id", links).select(F.col("node").alias("doc_id"), "group")


@query("D9_sampled_simhash")
def sampled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints of at most 256 evenly spaced shingles, case kept."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.regexp_extract_all("text", F.lit(D.TOKEN), F.lit(0)).alias("w"))
    d = d.select("doc_id", D.spaced_shingle_hashes(F.col("w"), 5, 256).alias("s"))
    return d.select("doc_id", D.simhash_bits(F.col("s"), 64).alias("bits"))


@query("E18_retention_ridge")
def retention_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log2 of late over early values of a participant's feature, by a ridge on the early one and an age whose gaps are filled with its median."""
    part = lambda cond, c: F.avg(F.when(F.expr(cond), F.col(c)))
    p = panel(spark, sf_dir).groupBy("participant", "feature").agg(part("day <= 10", "value").alias("early"), part("day > 20", "value").alias("late"), part("k >= 40", "k").alias("age"))
    p = p.where("early > 0 and late > 0").withColumn("x", F.ln("early")).withColumn("y", F.log2(F.col("late") / F.col("early")))
    filled = D.written(p.withColumn("age", F.coalesce("age", p.agg(F.percentile("age", F.lit(0.5)).alias("m")).scalar())))
    m = L.moments(filled, ["x", "age", "y"], ["feature"])
    at = m.at(["x", "age"])
    b = L.raw(L.ridge(m.total(), at, 3, 1.0), m.shift, at, 3)
    return filled.select("participant", "feature", r9("y").alias("y"), r9(L.predicted(["x", "age"], F.array(*[F.lit(float(v)) for v in b]))).alias("prediction"))


@query("E11_E20_study_ranker")
def study_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's mean chance to win against every region's reference customers, averaged over the regions.

    References are the 40 customers of a region with the least hash; a boosted classifier is fitted on their
    pairs inside a region, both ways, by differences of what they ordered; the target is the balance.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tessera.operators.cohort import fixed_sample
    from tessera.operators.joins import within_group_pairs

    names = ["orders", "mean_price", "top_price", "urgent"]
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("top_price"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent")
    )
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("study"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey").join(o, "c_custkey", "left").na.fill(0.0, names)  # nations are 25
    c = D.written(c.select("c_custkey", "study", "c_acctbal", *names))
    ref = D.written(fixed_sample(c, ["study"], "c_custkey", 40, "e20").drop("place"))
    side = lambda df, m: df.select(F.col("c_custkey").alias(m), *[F.col(x).alias(f"{x}_{m}") for x in names])
    gap = [(F.col(f"{x}_left") - F.col(f"{x}_right")).alias(f"d_{x}") for x in names]
    pairs = within_group_pairs(ref, "study", "c_custkey", "c_custkey", "c_acctbal", 100.0)
    train = pairs.join(side(ref, "left"), "left").join(side(ref, "right"), "right").select(*gap, (F.col("delta") > 0).cast("double").alias("y"))
    wide = VectorAssembler(inputCols=[f"d_{x}" for x in names], outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(wide.transform(train))
    refs = side(ref, "right").join(F.broadcast(ref.select(F.col("c_custkey").alias("right"), F.col("study").alias("of"))), "right")
    every = side(c, "left").join(F.broadcast(refs), F.col("left") != F.col("right"))  # 40 references of each of five regions
    won = model.transform(wide.transform(every.select("left", "of", *gap))).groupBy("left", "of").agg(F.avg(vector_to_array("probability")[1]).alias("p"))
    return won.groupBy(F.col("left").alias("c_custkey")).agg(F.count("*").alias("studies"), r9(F.avg("p")).alias("win_chance"))
