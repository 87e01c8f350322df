"""Ranks, percentiles and orderings (inventory 2.6 and 2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.canonical import length_bucket
from tessera.functions.hashing import h60, h60_sql
from tessera.operators import ranks as R
from tessera.operators.positions import numbered
from tessera.operators import text as D
from tessera.plans.base import PANEL, SCORED, avg_rank_sql, panel, r9, scored, unit_rank_sql
from tessera.registry import query, table

AR = avg_rank_sql


@query(
    "W1_W2_W3_W9_rank_variants",
    f"""SELECT doc_id, round({unit_rank_sql("n_chars", "lang")}, 9) AS unit_rank, round({AR("n_chars", "lang")} / count(*) OVER (PARTITION BY lang), 9) AS pct_rank,
round(({AR("n_chars", "lang")} - 0.5) / count(*) OVER (PARTITION BY lang), 9) AS mid_rank,
row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS place FROM documents""",
)
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lambda rank, n: F.struct(R.unit_of(rank, n).alias("unit"), (rank / n).alias("pct"), ((rank - 0.5) / n).alias("mid"))
    d = R.with_places(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "r", every, "lang")
    d = numbered(d, ["n_chars", "doc_id"], "lang", out="place")
    return d.select("doc_id", r9("r.unit").alias("unit_rank"), r9("r.pct").alias("pct_rank"), r9("r.mid").alias("mid_rank"), (F.col("place") + 1).alias("place"))


@query(
    "W4_W5_W8_reference_ecdf",
    f"""WITH {SCORED}, w AS (SELECT *, sum(1 - y) OVER (PARTITION BY lang ORDER BY s4) AS upto, sum(1 - y) OVER (PARTITION BY lang, s4) AS eq,
  sum(1 - y) OVER (PARTITION BY lang) AS n0, count(*) OVER (PARTITION BY lang) AS n, rank() OVER (PARTITION BY lang ORDER BY s4) - 1 AS below, count(*) OVER (PARTITION BY lang, s4) AS ties FROM scored)
SELECT doc_id, round((upto - eq + CAST(0.5 AS DOUBLE) * eq) / nullif(n0, 0), 9) AS ecdf_mid, round(upto / CAST(nullif(n0, 0) AS DOUBLE), 9) AS ecdf_right,
round(CASE WHEN n >= 3 THEN (below + CAST(0.5 AS DOUBLE) * (ties - 1)) / (n - 1) END, 9) AS loo FROM w""",
)
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.reference_ecdf(scored(spark, sf_dir).withColumn("ref", F.col("y") == 0), "s4", "ref", "lang")
    others = lambda rank, n: F.when(n >= 3, (rank - 1.0) / F.nullif(n - 1, F.lit(0)))
    d = R.with_places(d, "s4", "loo", others, "lang")
    return d.select("doc_id", r9("ecdf_mid").alias("ecdf_mid"), r9("ecdf_right").alias("ecdf_right"), r9("loo").alias("loo"))


@query(
    "W5_ecdf_with_backoff",
    f"""WITH {SCORED}, w AS (SELECT doc_id, sum(1 - y) OVER (PARTITION BY source ORDER BY s4) / CAST(nullif(sum(1 - y) OVER (PARTITION BY source), 0) AS DOUBLE) AS mine,
  sum(1 - y) OVER (ORDER BY s4) / CAST(nullif(sum(1 - y) OVER (), 0) AS DOUBLE) AS everyone, sum(1 - y) OVER (PARTITION BY source) AS refs FROM scored)
SELECT doc_id, round(CASE WHEN refs >= 3 THEN mine ELSE everyone END, 9) AS calibrated FROM w""",
)
def ecdf_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group's reference where it has enough rows, else everyone's."""
    s = scored(spark, sf_dir).select("doc_id", "source", "s4", (F.col("y") == 0).alias("ref"))
    mine = R.reference_ecdf(s, "s4", "ref", "source").select("doc_id", "s4", "ref", F.when(F.col("references") >= 3, F.col("ecdf_right")).alias("mine"))
    both = R.reference_ecdf(mine, "s4", "ref")
    return both.select("doc_id", r9(F.coalesce("mine", "ecdf_right")).alias("calibrated"))


@query(
    "W6_W7_rank_with_missing",
    f"""WITH {PANEL}, g AS (SELECT study, participant, avg(CASE WHEN feature = 'click' AND day <= 4 THEN value END) AS v FROM panel GROUP BY ALL),
r AS (SELECT study, participant, {unit_rank_sql("v", "study")} AS rk FROM g WHERE v IS NOT NULL)
SELECT g.study, g.participant, round(rk, 9) AS known_rank, round(coalesce(rk, 0.5), 9) AS filled_rank FROM g LEFT JOIN r USING (study, participant)""",
)
def with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel(spark, sf_dir).groupBy("study", "participant").agg(F.avg(F.when(F.expr("feature = 'click' and day <= 4"), F.col("value"))).alias("v"))
    rk = R.known_rank(F.col("v"), "study")
    return g.select("study", "participant", r9(rk).alias("known_rank"), r9(F.coalesce(rk, F.lit(0.5))).alias("filled_rank"))


@query(
    "W10_donor_rank_broadcast",
    f"""WITH {PANEL}, d AS (SELECT study, participant, avg(value) AS v FROM panel GROUP BY ALL), r AS (SELECT *, {unit_rank_sql("v", "study")} AS rk FROM d)
SELECT p.event_id, p.participant, round(rk, 9) AS donor_rank FROM panel p JOIN r USING (study, participant)""",
)
def donor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("event_id", "study", "participant", "value")
    d = p.groupBy("study", "participant").agg(F.avg("value").alias("v"))
    d = d.select("study", "participant", r9(R.unit_rank(F.col("v"), "study")).alias("donor_rank"))
    return p.join(d, ["study", "participant"]).select("event_id", "participant", "donor_rank")


LEVELS = f"""WITH {SCORED}, b AS (SELECT *, least(14, greatest(9, CAST(floor(log2(n_chars)) AS INT))) AS bucket FROM scored),
m AS (SELECT doc_id, ({AR("s3")} - 0.5) / count(*) OVER () AS g, ({AR("s3", "lang")} - 0.5) / count(*) OVER (PARTITION BY lang) AS l, count(*) OVER (PARTITION BY lang) AS nl,
  ({AR("s3", "lang, bucket")} - 0.5) / count(*) OVER (PARTITION BY lang, bucket) AS c, count(*) OVER (PARTITION BY lang, bucket) AS nc FROM b),
f AS (SELECT doc_id, g, CASE WHEN nl >= 20 THEN l ELSE g END AS l2, CASE WHEN nc >= 20 THEN c WHEN nl >= 20 THEN l ELSE g END AS c2 FROM m)"""


@query("W11_calibrated_percentile", LEVELS + " SELECT doc_id, round(0.25 * g + 0.5 * l2 + 0.25 * c2, 9) AS calibrated FROM f")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter global, half language, a quarter language and length; small cells back off.

    Ranks come from counts of distinct scores in ranges, so no window gathers a language or all rows.
    """
    b = D.written(scored(spark, sf_dir).select("doc_id", "lang", "s3", length_bucket(F.col("n_chars")).alias("bucket")))
    mid = lambda rank, n: F.struct(((rank - 0.5) / n).alias("p"), n.alias("n"))
    m = R.with_places(b, "s3", "g", mid)
    m = R.with_places(m, "s3", "l", mid, "lang")
    m = R.with_places(m, "s3", "c", mid, "lang", "bucket")
    lang = F.when(F.col("l.n") >= 20, F.col("l.p")).otherwise(F.col("g.p"))
    cell = F.when(F.col("c.n") >= 20, F.col("c.p")).otherwise(lang)
    return m.select("doc_id", r9(0.25 * F.col("g.p") + 0.5 * lang + 0.25 * cell).alias("calibrated"))


@query(
    "W22_rank_with_override",
    f"""WITH {SCORED} SELECT doc_id, round(CASE WHEN count(*) OVER (PARTITION BY source) >= 20 THEN {AR("s4", "source")} / count(*) OVER (PARTITION BY source) ELSE {AR("s4")} / count(*) OVER () END, 9) AS rk FROM scored""",
)
def override(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.written(scored(spark, sf_dir).select("doc_id", "source", "s4"))
    pct = lambda rank, n: F.struct((rank / n).alias("p"), n.alias("n"))
    s = R.with_places(R.with_places(s, "s4", "mine", pct, "source"), "s4", "everyone", pct)
    return s.select("doc_id", r9(F.when(F.col("mine.n") >= 20, F.col("mine.p")).otherwise(F.col("everyone.p"))).alias("rk"))


@query(
    "W12_quantile_buckets",
    """WITH e AS (SELECT lang, list_sort(list_distinct(quantile_cont(floor(n_chars / 500), [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM documents GROUP BY lang)
SELECT doc_id, CAST(len(list_filter(edges[2:len(edges) - 1], lambda x: floor(n_chars / 500) > x)) AS INT) AS bucket FROM documents JOIN e USING (lang)""",
)
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 500).cast("double").alias("v"))
    return R.qcut(d, "v", 4, "bucket", "lang").select("doc_id", "bucket")


@query(
    "W13_T3_top_per_group",
    """SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(text), doc_id) AS place FROM documents) WHERE place <= 2""",
)
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    place = F.row_number().over(W.partitionBy("source").orderBy("h", "doc_id"))
    return d.withColumn("place", place).where("place <= 2").select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query("W14_group_centred", f"WITH {PANEL} SELECT event_id, round(value - avg(value) OVER (PARTITION BY study, feature), 9) AS centred FROM panel")
def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("event_id", r9(F.col("value") - F.avg("value").over(W.partitionBy("study", "feature"))).alias("centred"))


@query(
    "W15_M18_robust_scale",
    f"""WITH {PANEL}, q AS (SELECT study, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM panel GROUP BY study)
SELECT event_id, round(CASE WHEN b - a > 1e-12 THEN (value - m) / (b - a) ELSE 0 END, 9) AS scaled FROM panel JOIN q USING (study)""",
)
def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.robust_scale(panel(spark, sf_dir), "value", "scaled", "study").select("event_id", r9("scaled").alias("scaled"))


@query(
    "W16_sliding_mean_max",
    """WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
w AS (SELECT vec_id, i, avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM x)
SELECT vec_id, round(max(m), 9) AS best FROM w WHERE i >= 8 GROUP BY vec_id""",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest mean of 8 neighbouring components, from prefix sums inside the row: no shuffle."""
    from tessera.operators.arrays import best_window_mean

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.select("vec_id", F.round(best_window_mean(F.col("a"), 8), 9).alias("best"))


@query(
    "W17_W18_rank_movement",
    f"""WITH {SCORED}, r AS (SELECT lang, {unit_rank_sql("s1", "lang")} AS a, {unit_rank_sql("s2", "lang")} AS b FROM scored)
SELECT lang, count_if(abs(a - b) > 1e-12) AS changed, round(avg(abs(a - b)), 9) AS mean_shift, round(max(abs(a - b)), 9) AS max_shift FROM r GROUP BY lang""",
)
def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    r = s.select("lang", F.abs(R.unit_rank(F.col("s1"), "lang") - R.unit_rank(F.col("s2"), "lang")).alias("d"))
    return r.groupBy("lang").agg(F.count_if(F.col("d") > 1e-12).alias("changed"), r9(F.avg("d")).alias("mean_shift"), r9(F.max("d")).alias("max_shift"))


@query(
    "W19_marginal_remap",
    f"""WITH {SCORED}, a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY s2, doc_id) AS k FROM scored),
b AS (SELECT lang, s1, row_number() OVER (PARTITION BY lang ORDER BY s1, doc_id) AS k FROM scored)
SELECT doc_id, round(s1, 9) AS remapped FROM a JOIN b USING (lang, k)""",
)
def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    a = s.select("doc_id", "lang", R.ordinal(F.col("s2"), F.col("doc_id"), "lang").alias("k"))
    b = s.select("lang", "s1", R.ordinal(F.col("s1"), F.col("doc_id"), "lang").alias("k"))
    return a.join(b, ["lang", "k"]).select("doc_id", r9("s1").alias("remapped"))


@query(
    "W20_E4_quantile_remap",
    f"""WITH {SCORED}, r AS (SELECT doc_id, lang, {unit_rank_sql("s1", "lang")} AS rk, s3 FROM scored),
c AS (SELECT doc_id, lang, least(1.0, greatest(0.0, rk + 0.2 * (s3 - 0.5))) AS want FROM r),
b AS (SELECT lang, list(s1 ORDER BY s1) AS xs FROM scored GROUP BY lang)
SELECT doc_id, round(xs[CAST(floor(want * (len(xs) - 1)) AS BIGINT) + 1] + (want * (len(xs) - 1) - floor(want * (len(xs) - 1)))
  * (xs[least(CAST(floor(want * (len(xs) - 1)) AS BIGINT) + 2, len(xs))] - xs[CAST(floor(want * (len(xs) - 1)) AS BIGINT) + 1]), 9) AS remapped FROM c JOIN b USING (lang)""",
)
def quantile_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantile of s1 at a bounded, corrected rank.

    Every row looks up its two neighbours in order by a join on (language, place): no group is gathered.
    """
    s = scored(spark, sf_dir)
    rk = s.select("doc_id", "lang", R.unit_rank(F.col("s1"), "lang").alias("rk"), "s3", R.size("lang").alias("n"))
    want = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rk") + 0.2 * (F.col("s3") - 0.5)))
    c = rk.withColumn("at", want * (F.col("n") - 1)).withColumn("k", F.floor("at") + 1)
    o = s.select("lang", "s1", R.ordinal(F.col("s1"), F.col("doc_id"), "lang").cast("long").alias("k"))
    nxt = F.coalesce(F.lead("s1").over(W.partitionBy("lang").orderBy("k")), F.col("s1"))
    o = o.withColumn("next", nxt)
    out = c.join(o, ["lang", "k"])
    return out.select("doc_id", F.round(F.col("s1") + (F.col("at") - F.floor("at")) * (F.col("next") - F.col("s1")), 9).alias("remapped"))


@query("T1_T2_sorted_head", "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 50")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(50)
    return o.select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"))


@query(
    "T3_keep_first",
    "SELECT p_brand, arg_max(p_partkey, (p_size, p_retailprice, -p_partkey)) AS p_partkey FROM part GROUP BY p_brand",
)
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", "p_retailprice", -F.col("p_partkey"))).alias("p_partkey"))


@query(
    "T4_T5_tail_means",
    """WITH s AS (SELECT vec_id, list_sort(CAST(embedding AS DOUBLE[])) AS a FROM embeddings),
k AS (SELECT *, greatest(1, CAST(ceil(len(a) * 20 / CAST(100 AS DOUBLE)) AS BIGINT)) AS k FROM s)
SELECT vec_id, round(list_avg(a[1:k]), 9) AS low_mean, round(list_avg(a[len(a) - k + 1:len(a)]), 9) AS high_mean FROM k""",
)
def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.arrays import tail_mean

    a = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(tail_mean(a, 20), 9).alias("low_mean"), F.round(tail_mean(a, 20, top=True), 9).alias("high_mean"))


@query(
    "T6_bottom_k_sketch",
    f"""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents),
h AS (SELECT doc_id, {h60_sql("w")} AS h FROM w), k AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS k FROM (SELECT DISTINCT doc_id, h FROM h))
SELECT doc_id, array_to_string(list(h ORDER BY h), ' ') || repeat(' -1', 8 - CAST(count(*) AS INT)) AS sketch FROM k WHERE k <= 8 GROUP BY doc_id""",
)
def sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.transform(F.array_distinct(F.split("text", " ", -1)), lambda w: h60(w))
    low = F.slice(F.array_sort(F.array_distinct(h)), 1, 8)
    padded = F.concat(low, F.array_repeat(F.lit(-1).cast("long"), 8 - F.size(low)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(padded, lambda x: x.cast("string")), " ").alias("sketch"))


@query(
    "T7_E15_lexicographic_best",
    f"""WITH {SCORED}, m AS (SELECT source, lang, round(avg(s2), 4) AS a, count(*) AS n FROM scored GROUP BY ALL)
SELECT source, arg_max(lang, (a, n, lang)) AS best FROM m GROUP BY source""",
)
def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir).groupBy("source", "lang").agg(F.round(F.avg("s2"), 4).alias("a"), F.count("*").alias("n"))
    return m.groupBy("source").agg(F.max_by("lang", F.struct("a", "n", "lang")).alias("best"))


@query("T8_hash_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS place FROM documents")
def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("source").orderBy(F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(order).cast("long").alias("place"))


@query(
    "T9_top_layers_ensemble",
    """WITH x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
m AS (SELECT i, round(abs(avg(CASE WHEN label = 0 THEN v END) - avg(CASE WHEN label <> 0 THEN v END)), 9) AS gap FROM x GROUP BY i),
t AS (SELECT i FROM m ORDER BY gap DESC, i LIMIT 5) SELECT vec_id, round(avg(v), 9) AS ensemble FROM x JOIN t USING (i) GROUP BY vec_id""",
)
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "f")).withColumn("v", F.col("f").cast("double"))
    gap = F.abs(F.avg(F.when(F.col("label") == 0, F.col("v"))) - F.avg(F.when(F.col("label") != 0, F.col("v"))))
    best5 = x.groupBy("i").agg(r9(gap).alias("gap")).orderBy(F.desc("gap"), "i").limit(5).select("i")
    return x.join(F.broadcast(best5), "i").groupBy("vec_id").agg(F.round(F.avg("v"), 9).alias("ensemble"))


@query("T10_S12_first_by_position", "SELECT event_id, event_type FROM events WHERE event_id < 500")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id < 500").select("event_id", "event_type")
