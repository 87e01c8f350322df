"""Sampling, splits, weights and resampling (inventory 2.12 and 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.canonical import length_bucket
from tessera.functions.hashing import h60, h60_sql
from tessera.operators import cohort as G
from tessera.operators import metrics as M
from tessera.operators import ranks as R
from tessera.operators import splits as S
from tessera.operators.positions import numbered
from tessera.operators.text import dealt, written
from tessera.plans.base import PANEL, SCORED, avg_rank_sql, panel, r9, scored, unit_rank_sql
from tessera.operators.metrics import correlation
from tessera.registry import query, table

BUCKET = "least(14, greatest(9, CAST(floor(log2(n_chars)) AS INT)))"


@query(
    "G1_stratified_hash_sample",
    f"WITH {SCORED}, r AS (SELECT doc_id, lang, y, row_number() OVER (PARTITION BY lang, y ORDER BY {h60_sql(chr(39) + 'g1' + chr(39), 'doc_id')}, doc_id) AS place FROM scored) SELECT doc_id, lang, y, place FROM r WHERE place <= 8",
)
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.fixed_sample(scored(spark, sf_dir), ["lang", "y"], "doc_id", 8, "g1")
    return s.select("doc_id", "lang", "y", F.col("place").cast("long").alias("place"))


ALLOC = f"""{SCORED}, b AS (SELECT doc_id, lang, y, {BUCKET} AS bucket FROM scored), c AS (SELECT lang, bucket, least(sum(y), sum(1 - y))::BIGINT AS capacity FROM b GROUP BY ALL),
s AS (SELECT *, 25 * capacity / CAST(sum(capacity) OVER () AS DOUBLE) AS share FROM c WHERE capacity > 0), f AS (SELECT *, floor(share) AS base FROM s),
e AS (SELECT *, row_number() OVER (ORDER BY round(share - base, 9) DESC, lang, bucket) <= 25 - sum(base) OVER () AS extra FROM f), alloc AS (SELECT lang, bucket, capacity, CAST(base + CAST(extra AS INT) AS BIGINT) AS allocated FROM e)"""


def _alloc(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = scored(spark, sf_dir).withColumn("bucket", length_bucket(F.col("n_chars")))
    c = b.groupBy("lang", "bucket").agg(F.least(F.sum("y"), F.sum(1 - F.col("y"))).alias("capacity"))
    return b, G.allocation(c, ["lang", "bucket"], 25)


@query("G2_A13_matched_allocation", f"WITH {ALLOC} SELECT * FROM alloc")
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alloc(spark, sf_dir)[1]


@query(
    "G3_allocated_rows",
    f"""WITH {ALLOC}, r AS (SELECT doc_id, b.lang, b.bucket, y, row_number() OVER (PARTITION BY b.lang, b.bucket, y ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM b)
SELECT doc_id, y FROM r JOIN alloc ON r.lang = alloc.lang AND r.bucket = alloc.bucket WHERE place <= allocated""",
)
def allocated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, alloc = _alloc(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("lang", "bucket", "y").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id"))
    return b.withColumn("place", place).join(alloc, ["lang", "bucket"]).where("place <= allocated").select("doc_id", "y")


@query("G5_greedy_cluster_assignment")
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").withColumn("bucket", length_bucket(F.col("n_chars")))
    c = b.groupBy((F.col("doc_id") % 97).alias("cluster"), F.concat_ws("/", "lang", F.col("bucket").cast("string")).alias("stratum")).agg(F.count("*").alias("n"))
    return G.greedy_assignment(c, "cluster", "stratum", "n", 0.5, "g5")


@query(
    "G6_G7_G8_folds",
    f"""WITH {SCORED}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h60_sql("'g6'", "doc_id")}, doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang, y ORDER BY {h60_sql("'g8'", "doc_id")}, doc_id) AS k FROM scored)
SELECT doc_id, CASE WHEN p <= n // 2 THEN 'development' ELSE 'holdout' END AS half, CAST({h60_sql("'g7'", "doc_id")} % 5 AS INT) AS hash_fold, CAST((k - 1) % 5 AS INT) AS fold FROM r""",
)
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbered(scored(spark, sf_dir).select("doc_id", "lang", "y"), [h60("g6", F.col("doc_id")), "doc_id"], "lang", out="p")
    n = d.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    d = d.join(F.broadcast(n), F.col("lang").eqNullSafe(F.col("l")))  # one row a language
    d = numbered(d, [h60("g8", F.col("doc_id")), "doc_id"], "lang", "y", out="k")
    half = F.when(F.col("p") < F.floor(F.col("n") / 2), "development").otherwise("holdout")
    return d.select("doc_id", half.alias("half"), G.hash_fold(F.col("doc_id"), 5, "g7").alias("hash_fold"), (F.col("k") % 5).cast("int").alias("fold"))


@query(
    "G8_nested_splits",
    f"""WITH {SCORED}, r AS (SELECT doc_id, lang, y, CAST((row_number() OVER (PARTITION BY lang, y ORDER BY {h60_sql("'g8'", "doc_id")}, doc_id) - 1) % 5 AS INT) AS fold FROM scored),
x AS (SELECT *, CAST(unnest(range(0, 5)) AS INT) AS outer_fold FROM r),
p AS (SELECT doc_id, outer_fold, 5 * (row_number() OVER (PARTITION BY outer_fold, lang, y ORDER BY {h60_sql("'nested'", "outer_fold", "doc_id")}, doc_id) - 1) AS p, count(*) OVER (PARTITION BY outer_fold, lang, y) AS n FROM x WHERE fold <> outer_fold)
SELECT doc_id, outer_fold, CASE WHEN p < n THEN 'select' WHEN p < 2 * n THEN 'early' ELSE 'train' END AS role FROM p UNION ALL SELECT doc_id, outer_fold, 'hold' FROM x WHERE fold = outer_fold""",
)
def nested_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five outer folds by language and label, and inside each fitting set 60, 20 and 20 of a hundred to train, stop early and select."""
    s = numbered(scored(spark, sf_dir), [h60("g8", F.col("doc_id")), "doc_id"], "lang", "y", out="place")
    s = s.select("doc_id", "lang", "y", (F.col("place") % 5).cast("int").alias("fold"))
    return S.nested_split(s, ["lang", "y"], "doc_id", "fold", 5, "nested").select("doc_id", F.col("outer").alias("outer_fold"), "role")


@query("G9_stratified_group_folds")
def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in five folds: near-duplicate groups stay whole, languages and labels are spread evenly."""
    from tessera.plans.corpus import minhash_groups

    g = minhash_groups(spark, sf_dir).select("doc_id", "group")
    d = scored(spark, sf_dir).select("doc_id", "lang", "y").join(g, "doc_id")
    d = written(d)
    folds = S.stratified_group_folds(d, "group", ["lang", "y"], 5, "g9")
    return d.join(folds, "group").select("doc_id", "group", "fold")


@query("G13_balanced_group_folds")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return G.balanced_folds(sizes, "source", "n", 4)


@query(
    "G10_leave_one_language_out",
    "SELECT h.lang AS held, CASE WHEN d.lang = h.lang THEN 'validation' ELSE 'train' END AS role, count(*) AS n FROM documents d, (SELECT DISTINCT lang FROM documents) h GROUP BY ALL",
)
def leave_language_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each split from the languages' counts; rows are not repeated for each split."""
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())  # one row a language
    both = F.array(F.struct(F.lit("validation").alias("role"), F.col("n").alias("n")), F.struct(F.lit("train").alias("role"), (F.col("t") - F.col("n")).alias("n")))
    return c.withColumn("t", total).select(F.col("lang").alias("held"), F.explode(both).alias("x")).select("held", "x.role", "x.n").where("n > 0")


@query(
    "G11_G14_purged_leave_one_group_out",
    """WITH h AS (SELECT DISTINCT o_orderpriority AS held FROM orders), s AS (SELECT DISTINCT o_orderpriority AS held, o_custkey FROM orders),
r AS (SELECT h.held, o.o_orderpriority = h.held AS val, s.o_custkey IS NOT NULL AS seen, o.o_custkey FROM orders o CROSS JOIN h LEFT JOIN s ON s.held = h.held AND s.o_custkey = o.o_custkey)
SELECT held, count_if(val) AS validation, count_if(NOT val AND NOT seen) AS train, count_if(NOT val AND seen) AS purged, count(DISTINCT CASE WHEN NOT val AND seen THEN o_custkey END) AS purged_subjects FROM r GROUP BY held""",
)
def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.purged_leave_one_out(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")


CELLS = "(SELECT l_suppkey % 10 AS study, l_partkey % 8 AS strain, l_orderkey AS subject FROM lineitem)"


@query(
    "G12_simultaneous_holdout",
    f"""WITH r AS {CELLS}, c AS (SELECT study, strain, count(DISTINCT subject) AS subjects FROM r GROUP BY ALL ORDER BY subjects DESC, study, strain LIMIT 4),
s AS (SELECT DISTINCT c.study AS hs, c.strain AS ht, r.subject FROM c JOIN r ON r.study = c.study AND r.strain = c.strain)
SELECT c.study AS held_study, c.strain AS held_strain, count_if(r.study = c.study AND r.strain = c.strain) AS validation,
count_if(r.study <> c.study AND r.strain <> c.strain AND s.subject IS NULL) AS train FROM c CROSS JOIN r LEFT JOIN s ON s.hs = c.study AND s.ht = c.strain AND s.subject = r.subject GROUP BY c.study, c.strain""",
)
def simultaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four held cells: training rows share neither study, strain nor subject with the cell."""
    li = table(spark, sf_dir, "lineitem")
    r = li.select((F.col("l_suppkey") % 10).alias("study"), (F.col("l_partkey") % 8).alias("strain"), F.col("l_orderkey").alias("subject"))
    c = r.groupBy("study", "strain").agg(F.count_distinct("subject").alias("k")).orderBy(F.desc("k"), "study", "strain").limit(4)
    held = F.broadcast(c.agg(F.collect_list(F.struct("study", "strain")).alias("held")))  # one row of four cells
    e = r.crossJoin(held).select("study", "strain", "subject", F.explode("held").alias("h"))
    e = e.select("subject", F.col("h.study").alias("held_study"), F.col("h.strain").alias("held_strain"), (F.col("study") == F.col("h.study")).alias("a"), (F.col("strain") == F.col("h.strain")).alias("b"))
    per = e.groupBy("held_study", "held_strain", "subject").agg(F.count_if(F.expr("a and b")).alias("v"), F.count_if(F.expr("not a and not b")).alias("t"))
    return per.groupBy("held_study", "held_strain").agg(F.sum("v").alias("validation"), F.sum(F.when(F.col("v") == 0, F.col("t")).otherwise(0)).alias("train"))


@query(
    "G15_G16_weights",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS a, l_linestatus AS b, l_suppkey % 7 AS c FROM lineitem),
n AS (SELECT *, (SELECT count(DISTINCT a) FROM r) AS ka, (SELECT count(*) FROM r) AS n, count(*) OVER (PARTITION BY a, b, c) AS k, count(*) OVER (PARTITION BY a) AS na FROM r),
kb AS (SELECT a, count(DISTINCT b) AS kb FROM r GROUP BY a), kc AS (SELECT a, b, count(DISTINCT c) AS kc FROM r GROUP BY a, b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(n / (CAST(ka AS DOUBLE) * kb * kc * k), 9) AS nested, round(n / (CAST(ka AS DOUBLE) * na), 9) AS equal FROM n JOIN kb ON n.a = kb.a JOIN kc ON n.a = kc.a AND n.b = kc.b""",
)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    r = table(spark, sf_dir, "lineitem").select(*keys, F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), (F.col("l_suppkey") % 7).alias("c"))
    w = G.hierarchical_weights(r, ["a", "b", "c"]).withColumnRenamed("weight", "nested")
    return G.equal_weights(w, "a").select(*keys, r9("nested").alias("nested"), r9("weight").alias("equal"))


@query(
    "G17_similarity_weights",
    """WITH d AS (SELECT c_mktsegment AS name, round(abs(avg(c_acctbal) - 4500), 6) AS d FROM customer GROUP BY 1), s AS (SELECT coalesce(quantile_cont(CASE WHEN d > 1e-12 THEN d END, 0.5), 1) AS s, min(d) AS low FROM d),
r AS (SELECT name, exp(greatest(-50, -(d - low) / s)) AS raw FROM d, s) SELECT name, round(0.5 / count(*) OVER () + 0.5 * raw / sum(raw) OVER (), 9) AS weight FROM r""",
)
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.round(F.abs(F.avg("c_acctbal") - 4500), 6).alias("d"))
    return G.similarity_weights(d, "name", "d").withColumn("weight", r9("weight"))


@query("G18_bounded_mean_one_weights")
def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of market segments (one row each); the factor is found on that small table."""
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m")).orderBy("c_mktsegment").collect()
    w = G.bounded_mean_one({r[0]: r["m"] for r in rows}, {r[0]: r["n"] for r in rows}, 0.5, 2.0)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in w.items()], "c_mktsegment string, weight double")


@query(
    "G19_within_group_shuffle",
    f"""WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), b AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY {h60_sql("'g19'", "doc_id")}, doc_id) AS k FROM documents)
SELECT doc_id, n_chars AS shuffled FROM a JOIN b ON a.source = b.source AND a.k = b.k""",
)
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return G.shuffled_within(d, "source", "doc_id", "n_chars", "g19").select("doc_id", "shuffled")


@query(
    "G21_G22_auxiliary_purge",
    """WITH held AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0), k AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM held))
SELECT c_mktsegment, count(*) AS kept, CASE WHEN count(*) < 100 THEN 'too_few_rows' END AS skipped FROM k GROUP BY c_mktsegment""",
)
def auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 50 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    k = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").join(held, "c_custkey", "left_anti")
    return k.groupBy("c_mktsegment").agg(F.count("*").alias("kept")).withColumn("skipped", F.when(F.col("kept") < 100, "too_few_rows"))


@query(
    "G23_first_by_content_hash",
    "SELECT doc_id, lang FROM (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256(text), d.doc_id) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE k <= 5",
)
def first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h")).join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.row_number().over(W.partitionBy("lang", "quality").orderBy("h", "doc_id"))
    return d.withColumn("k", k).where("k <= 5").select("doc_id", "lang")


REPS = 1000  # replicates of a bootstrap
SUBSAMPLES, COHORT, PUBLIC = 200, 40, 12  # of a subsampling: replicates, rows of a source, and those of them that are public


DRAWN = 2_000_000  # rows of a few numbers each that are sent to all executors; draws from more are shuffled


def resampled(s: DataFrame, strata: list[str], seed: str, columns: list[str], reps: int = REPS) -> DataFrame:
    """rep and the row's columns, once for each time the row is drawn; strata keep their sizes.

    A draw is a hash of (replicate, stratum, slot) modulo the stratum's size: rows are numbered
    inside their stratum, draws are made in place and looked up by number.  The columns that are asked for go to
    where the draws are, which are `reps` times as many: up to DRAWN rows as one array a stratum and column, so that
    the driver and the executors hold little more than the numbers; more rows are joined by (stratum, number).
    """
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in strata])
    order = W.partitionBy(*strata).orderBy("doc_id")
    s = s.withColumn("_s", name).withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*strata)))
    s = written(s.select(*columns, "_s", "_i", "_n"))
    slots = dealt(s).select("_s", "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draw = F.pmod(h60(seed, F.col("rep"), F.col("_s"), F.col("_i")), F.col("_n"))
    draws = slots.select("rep", F.col("_s").alias("_t"), draw.alias("_d"))
    if s.limit(DRAWN + 1).count() > DRAWN:
        return draws.join(s, (F.col("_t") == F.col("_s")) & (F.col("_d") == F.col("_i"))).drop("_t", "_d", "_s", "_i", "_n")
    held = s.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_i", *columns))).alias("_a"))
    held = written(held.select("_s", *[F.col(f"_a.{c}").alias(c) for c in columns]))  # one row a stratum
    return draws.join(F.broadcast(held), F.col("_t") == F.col("_s")).select("rep", *[F.get(c, F.col("_d").cast("int")).alias(c) for c in columns])


def resampled_sql(strata: str, seed: str, reps: int = REPS) -> str:
    return f"""z AS (SELECT *, {strata} AS st, row_number() OVER (PARTITION BY {strata} ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY {strata}) AS n FROM scored),
sl AS (SELECT st, i, n, unnest(range(0, {reps})) AS rep FROM z), dr AS (SELECT rep, st, {h60_sql(f"'{seed}'", "rep", "st", "i")} % n AS d FROM sl),
bs AS (SELECT rep, z.* FROM dr JOIN z ON dr.st = z.st AND dr.d = z.i)"""


def rep_auc_sql(score: str, source: str = "bs") -> str:
    return f"""(SELECT rep, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(y) * sum(1 - y), 0) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY rep ORDER BY {score}) + (count(*) OVER (PARTITION BY rep, {score}) - 1) / CAST(2 AS DOUBLE) AS rk FROM {source}) GROUP BY rep)"""


def summary(c: str) -> list:
    q = lambda p: r9(F.percentile(c, F.lit(p)))
    return [r9(F.avg(c)).alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"), F.count(c).alias("replicates")]


SUMMARY = "round(avg({0}), 9) AS mean, round(quantile_cont({0}, 0.025), 9) AS low, round(quantile_cont({0}, 0.975), 9) AS high, count({0}) AS replicates".format


@query("B1_B7_stratified_bootstrap", f"WITH {SCORED}, {resampled_sql("lang || '/' || y", 'b1')} SELECT {SUMMARY('auc')} FROM {rep_auc_sql('s4')}")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc(resampled(scored(spark, sf_dir), ["lang", "y"], "b1", ["y", "s4"]), "s4", "y", "rep").agg(*summary("auc"))


@query(
    "B2_paired_bootstrap",
    f"WITH {SCORED}, {resampled_sql("lang || '/' || y", 'b2')}, a AS {rep_auc_sql('s4')}, b AS {rep_auc_sql('s2')}, d AS (SELECT a.auc - b.auc AS d FROM a JOIN b ON a.rep = b.rep) SELECT {SUMMARY('d')} FROM d",
)
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resampled(scored(spark, sf_dir), ["lang", "y"], "b2", ["y", "s4", "s2"])
    a, b = M.auc(r, "s4", "y", "rep").select("rep", "auc"), M.auc(r, "s2", "y", "rep").select("rep", F.col("auc").alias("other"))
    return a.join(b, "rep").select((F.col("auc") - F.col("other")).alias("d")).agg(*summary("d"))


@query(
    "B3_cluster_bootstrap",
    f"""WITH {SCORED}, g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM scored)),
dr AS (SELECT rep, {h60_sql("'b3'", "rep", "i")} % n AS d FROM (SELECT *, unnest(range(0, {2 * REPS})) AS rep FROM g)), bs AS (SELECT rep, s.y, s.s4 FROM dr JOIN g ON dr.d = g.i JOIN scored s ON s.source = g.source),
ok AS (SELECT rep FROM bs GROUP BY rep HAVING count(DISTINCT y) = 2 ORDER BY rep LIMIT {REPS}), v AS (SELECT * FROM bs WHERE rep IN (SELECT rep FROM ok)) SELECT {SUMMARY('auc')} FROM {rep_auc_sql('s4', 'v')}""",
)
def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are drawn (one row each); twice as many replicates as needed, the first REPS with both classes count."""
    s = scored(spark, sf_dir).select("source", "y", "s4")
    g = s.select("source").distinct().withColumn("i", F.row_number().over(W.orderBy("source")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    d = g.select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(2 * REPS - 1))).alias("rep")).select("rep", F.pmod(h60("b3", F.col("rep"), F.col("i")), F.col("n")).alias("i"))
    times = d.join(g.select("i", "source"), "i").groupBy("rep", "source").agg(F.count("*").alias("times"))
    hist = s.groupBy("source", "s4").agg(F.sum("y").alias("p"), F.count("*").alias("k"))
    h = times.join(hist, "source").groupBy("rep", "s4").agg(F.sum(F.col("times") * F.col("p")).alias("p"), F.sum(F.col("times") * F.col("k")).alias("k"))
    down, every = W.partitionBy("rep").orderBy(F.desc("s4")), W.partitionBy("rep")
    neg = F.col("k") - F.col("p")
    h = h.withColumn("tp", F.sum("p").over(down)).withColumn("all_pos", F.sum("p").over(every)).withColumn("all_neg", F.sum(neg).over(every))
    area = F.sum(neg * (F.col("tp") - F.col("p") + F.col("p") / 2.0)) / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))
    return h.groupBy("rep").agg(area.alias("auc")).where("auc is not null").orderBy("rep").limit(REPS).agg(*summary("auc"))


SUB = f"""{SCORED}, r AS (SELECT rep, source, doc_id, s1, s2, s3, row_number() OVER (PARTITION BY rep, source ORDER BY {h60_sql("'b4'", "rep", "doc_id")}, doc_id) AS k FROM (SELECT *, unnest(range(0, {SUBSAMPLES})) AS rep FROM scored)),
c AS (SELECT *, CASE WHEN k <= {PUBLIC} THEN 'public' ELSE 'private' END AS part FROM r WHERE k <= {COHORT}),
rk AS (SELECT rep, source, part, {avg_rank_sql("s1", "rep, source, part")} AS t, {avg_rank_sql("s2", "rep, source, part")} AS a, {avg_rank_sql("s3", "rep, source, part")} AS b FROM c),
d AS (SELECT rep, source, part, CASE WHEN count(*) >= 3 THEN round((covar_pop(t, a) / nullif(stddev_pop(t) * stddev_pop(a), 0)) - (covar_pop(t, b) / nullif(stddev_pop(t) * stddev_pop(b), 0)), 9) END AS delta FROM rk GROUP BY ALL)"""


def _subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("source", "doc_id", "s1", "s2", "s3", F.explode(F.sequence(F.lit(0), F.lit(SUBSAMPLES - 1))).alias("rep"))
    k = F.row_number().over(W.partitionBy("rep", "source").orderBy(h60("b4", F.col("rep"), F.col("doc_id")), "doc_id"))
    c = s.withColumn("k", k).where(F.col("k") <= COHORT).withColumn("part", F.when(F.col("k") <= PUBLIC, "public").otherwise("private"))
    rank = lambda x: R.average_rank(F.col(x), "rep", "source", "part").alias(f"r{x}")
    d = c.select("rep", "source", "part", rank("s1"), rank("s2"), rank("s3")).groupBy("rep", "source", "part")
    return d.agg(F.when(F.count("*") >= 3, r9(correlation("rs1", "rs2") - correlation("rs1", "rs3"))).alias("delta"))


@query(
    "B4_repeated_subsampling",
    f"""WITH {SUB}, w AS (SELECT rep, source, max(CASE WHEN part = 'public' THEN delta END) AS pu, max(CASE WHEN part = 'private' THEN delta END) AS pr FROM d GROUP BY ALL)
SELECT source, count(CASE WHEN pu IS NOT NULL AND pr IS NOT NULL THEN 1 END) AS valid, round(avg(pr), 9) AS private_mean, round(quantile_cont(pr, 0.1), 9) AS private_q10, round(quantile_cont(pr, 0.9), 9) AS private_q90,
round(avg(CASE WHEN (pu >= 0) = (pr >= 0) THEN 1.0 ELSE 0.0 END), 9) AS sign_agreement FROM w WHERE pu IS NOT NULL AND pr IS NOT NULL GROUP BY source""",
)
def subsampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _subsamples(spark, sf_dir).groupBy("rep", "source").pivot("part", ["public", "private"]).agg(F.first("delta")).dropna()
    q = lambda p: r9(F.percentile("private", F.lit(p)))
    same = F.when((F.col("public") >= 0) == (F.col("private") >= 0), 1.0).otherwise(0.0)
    return w.groupBy("source").agg(F.count("*").alias("valid"), r9(F.avg("private")).alias("private_mean"), q(0.1).alias("private_q10"), q(0.9).alias("private_q90"), r9(F.avg(same)).alias("sign_agreement"))


@query(
    "B5_B8_small_subset_sensitivity",
    f"""WITH {SUB}, n AS (SELECT source, count(*) AS n FROM scored GROUP BY source), v AS (SELECT source, count(delta) AS valid, count(*) - count(delta) AS invalid, avg(CAST(delta > 0 AS INT)) AS positive FROM d WHERE part = 'private' GROUP BY source)
SELECT n.source, CASE WHEN n < {COHORT} THEN 'not_run_too_few' ELSE 'ok' END AS status, CASE WHEN n >= {COHORT} THEN valid END AS valid, CASE WHEN n >= {COHORT} THEN invalid END AS invalid, round(CASE WHEN n >= {COHORT} THEN positive END, 9) AS positive_fraction FROM n JOIN v ON n.source = v.source""",
)
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    v = _subsamples(spark, sf_dir).where("part = 'private'").groupBy("source")
    v = v.agg(F.count("delta").alias("valid"), (F.count("*") - F.count("delta")).alias("invalid"), F.avg((F.col("delta") > 0).cast("int")).alias("p"))
    run = F.col("n") >= COHORT
    only = lambda c: F.when(run, F.col(c))
    return n.join(v, "source").select("source", F.when(run, "ok").otherwise("not_run_too_few").alias("status"), only("valid").alias("valid"), only("invalid").alias("invalid"), r9(only("p")).alias("positive_fraction"))


@query(
    "B6_source_jackknife",
    f"""WITH {PANEL}, p AS (SELECT study, participant, avg(value) AS v FROM panel GROUP BY ALL), j AS (SELECT h.study AS dropped, p.participant, {unit_rank_sql("v", "h.study")} AS rk FROM p JOIN (SELECT DISTINCT study FROM p) h ON p.study <> h.study)
SELECT participant, round(quantile_cont(rk, 0.5), 9) AS median_rank, count(*) AS drops FROM j GROUP BY participant""",
)
def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).groupBy("study", "participant").agg(F.avg("value").alias("v"))
    e = p.select("participant", "study", "v", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dropped")).where("study <> dropped")
    j = e.select("participant", R.unit_rank(F.col("v"), "dropped").alias("rk"))
    return j.groupBy("participant").agg(r9(F.percentile("rk", F.lit(0.5))).alias("median_rank"), F.count("*").alias("drops"))
