"""Text deduplication and token sequences (inventory 2.14 and 2.15)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.hashing import h60, h60_sql
from tessera.operators import arrays as A
from tessera.operators import ngrams as N
from tessera.operators import sequences as Q
from tessera.operators import text as D
from tessera.operators.joins import small
from tessera.plans.aggregates import BYTES
from tessera.plans.base import r9
from tessera.registry import query, spread, table


@query("D1_exact_dedup", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY lang, doc_id) AS k FROM documents) WHERE k = 1")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_dedup(table(spark, sf_dir, "documents"), F.col("text"), "lang", "doc_id").select("doc_id", "lang")


@query("D2_duplicate_counts", "SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content"))
    return d.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(
    "D3_cross_split_overlap",
    "SELECT count(*) AS shared FROM (SELECT DISTINCT sha256(text) FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT sha256(text) FROM documents WHERE doc_id % 2 = 1)",
)
def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.sha2("text", 256).alias("h"))
    both = h.groupBy("h").agg(F.count_distinct("side").alias("k")).where("k = 2")
    return both.agg(F.count("*").alias("shared"))


SHINGLES = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z_]\w*|\d+|[^\s]') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END AS s FROM t)"""


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII tokens only, so that both engines' \\w agree."""
    w = F.regexp_extract_all(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "")), F.lit(D.TOKEN), F.lit(0))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", w.alias("w")).select("doc_id", D.shingles(F.col("w")).alias("s"))


def _hashed(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Documents, or those of a table of ids k, with the hashes of their 5-token shingles."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    if ids is not None:
        d = d.join(small(ids, 1_000_000).withColumnRenamed("k", "doc_id"), "doc_id", "left_semi")
    return d.select("doc_id", D.tokens(F.col("text")).alias("w")).select("doc_id", D.shingle_hashes(F.col("w")).alias("s"))


def _groups(spark: SparkSession, sf_dir: str, keys, least: float) -> DataFrame:  # noqa: ANN001
    """node, group: of texts connected by a shingle similarity of `least` or more where they share a key."""
    signed = D.signatures(_hashed(spark, sf_dir), "doc_id", "s", keys)
    near = D.links(signed, lambda ids: _hashed(spark, sf_dir, ids).withColumnRenamed("doc_id", "k"), least)
    return D.groups(table(spark, sf_dir, "documents"), "doc_id", near)


ASCII_SHINGLES = SHINGLES.replace("lower(text)", r"lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))")


@query("D4_X3_token_shingles", f"WITH {ASCII_SHINGLES} SELECT doc_id, len(s) AS shingles, md5(array_to_string(list_sort(s), '|')) AS content FROM s")
def shingle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingled(spark, sf_dir).select("doc_id", F.size("s").cast("long").alias("shingles"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("content"))


@query(
    "D12_J10_shingle_jaccard_pairs",
    f"""WITH {ASCII_SHINGLES}, e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
SELECT a, b, round(k / CAST(na + nb - k AS DOUBLE), 9) AS similarity FROM c WHERE k / CAST(na + nb - k AS DOUBLE) >= 0.8""",
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.prefix_pairs(_shingled(spark, sf_dir), "doc_id", "s", 0.8).withColumn("similarity", r9("similarity"))


@query("D5_D6_D7_D11_D14_minhash_groups")
def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts with a shingle similarity of 0.6 or more, by banded min-hashes: id, group, its size."""
    g = _groups(spark, sf_dir, D.minhash_keys(), 0.6)
    size = g.groupBy("group").agg(F.count("*").alias("size"))
    return g.join(size, "group").select(F.col("node").alias("doc_id"), "group", "size")


@query("D8_bottom_k_groups")
def bottom_k_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above by bottom-k sketches in 8 bands of 4, similarity 0.85, joined with the links of equal texts."""
    g = _groups(spark, sf_dir, D.low_keys(8, 4, 0.85), 0.85)
    return g.select(F.col("node").alias("doc_id"), "group")


@query("D9_D10b_J11_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.written(_hashed(spark, sf_dir))
    b = D.written(d.select("doc_id", D.simhash(F.col("s")).alias("bits")))
    g = D.groups(b, "doc_id", D.simhash_pairs(b, "doc_id", "bits", 6))
    return g.join(b, F.col("node") == F.col("doc_id")).select("doc_id", "bits", "group")


@query(
    "D13_sequence_distance",
    """WITH s AS (SELECT p_partkey, p_name || ' ' || p_type AS s FROM part), k AS (SELECT p_partkey, upper(s) AS s, list_distinct(list_transform(range(1, greatest(CAST(length(s) AS BIGINT) - 1, 2)), lambda i: substr(upper(s), i, 3))) AS k FROM s)
SELECT a.p_partkey, round(1 - len(list_intersect(a.k, b.k)) / CAST(len(list_distinct(list_concat(a.k, b.k))) AS DOUBLE), 9) AS distance FROM k a JOIN k b ON b.p_partkey = a.p_partkey + 1""",
)
def sequence_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("s"))
    b = s.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("t"))
    return s.join(b, "p_partkey").select("p_partkey", r9(D.sequence_distance(F.col("s"), F.col("t"))).alias("distance"))


@query("D15_feature_hashing")
def feature_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed vectors of character 3- to 5-grams and of word 1- and 2-grams: their columns, the columns' checksum and the values'."""
    from tessera.operators.hashed import hashed_features

    d = hashed_features(spread(table(spark, sf_dir, "documents")), "doc_id", "text")

    def told(part: str) -> list:
        at, value = F.col(f"{part}_at"), F.col(f"{part}_value")
        spot = F.aggregate(at, F.lit(0).cast("long"), lambda s, x: (s * 31 + x) % 1_000_000_007)
        mass = F.aggregate(F.zip_with(at, value, lambda i, v: v * F.sin(i.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        return [F.size(at).alias(f"{part}_columns"), spot.alias(f"{part}_spot"), r9(mass).alias(f"{part}_mass")]

    return d.select("doc_id", *told("char"), *told("word"))


@query("Q1_byte_code", "SELECT doc_id, CAST(octet_length(encode(text)) AS INT) AS ids, true AS round_trip FROM documents")
def byte_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", Q.byte_ids(F.col("text")).alias("ids"))
    return d.select("doc_id", F.size("ids").alias("ids"), (Q.byte_text(F.col("ids")) == F.col("text")).alias("round_trip"))


@query(
    "Q3_Q4_padded_windows",
    f"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w, unnest(range(0, 4)) AS round FROM documents), n AS (SELECT *, greatest(len(w) - 30, 0) AS room FROM t),
s AS (SELECT *, CASE round WHEN 0 THEN 0 WHEN 1 THEN room // 2 WHEN 2 THEN room ELSE {h60_sql("'window'", "round", "doc_id")} % (room + 1) END AS start FROM n)
SELECT doc_id, round, CAST(start AS BIGINT) AS start, 32 AS width, CAST(least(len(w), 30) + 2 AS INT) AS used, md5(array_to_string(w[start + 1:start + 30], ' ')) AS content FROM s""",
)
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("round"))
    start = Q.policy_start(F.col("round"), F.size("w"), F.lit(30), F.col("doc_id"))
    d = d.withColumn("start", start).withColumn("part", F.slice("w", (F.col("start") + 1).cast("int"), F.lit(30)))
    ids, mask, _ = Q.padded(F.transform("w", lambda x: F.length(x) + 3), F.col("start"), 30)
    used = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    return d.select("doc_id", "round", "start", F.size(ids).alias("width"), used.alias("used"), F.md5(F.array_join("part", " ")).alias("content"))


@query(
    "Q5_Q6_Q7_context_contrast",
    """WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS DOUBLE)) AS v FROM documents), n AS (SELECT doc_id, v, len(v) AS n FROM t WHERE len(v) >= 8),
s AS (SELECT doc_id, v, n, least(n - 4, CAST(floor(n * f) AS BIGINT)) AS start FROM n, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) a(f)),
d AS (SELECT DISTINCT doc_id, v, start FROM s), c AS (SELECT doc_id, start, list_avg(v[greatest(1, start - 31):start + 4]) AS c32, list_avg(v[greatest(1, start - 127):start + 4]) AS c128 FROM d)
SELECT doc_id, count(*) AS spans, round(avg(c128 - c32), 9) AS delta FROM c GROUP BY doc_id""",
)
def context_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored spans of four tokens; the difference of a mean over two context budgets before each."""
    v = F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("double"))
    d = table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).where(F.size("v") >= 8)
    n = F.size("v")
    starts = F.array_distinct(F.array(*[F.least(n - 4, F.floor(n * f).cast("int")) for f in (0.25, 0.5, 0.75)]))
    d = d.select("doc_id", "v", F.explode(starts).alias("s"))

    def budget(k: int):  # noqa: ANN202
        low = F.greatest(F.lit(1), F.col("s") - k + 1)
        return A.mean(F.slice("v", low, F.col("s") + 4 - low + 1))

    return d.select("doc_id", (budget(128) - budget(32)).alias("c")).groupBy("doc_id").agg(F.count("*").alias("spans"), r9(F.avg("c")).alias("delta"))


@query(
    "Q8_token_statistics",
    """WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), s AS (SELECT vec_id, a, list_sort(a) AS o FROM t)
SELECT vec_id, round(list_avg(a), 9) AS mean, round(list_median(a), 9) AS median, round(list_avg(o[1:4]), 9) AS min_k_05, round(list_avg(o[1:7]), 9) AS min_k_10, round(list_avg(o[1:13]), 9) AS min_k_20,
round(len(list_filter(a, lambda x: x > 0)) / CAST(len(a) AS DOUBLE), 9) AS top_rate, round(list_avg(list_transform(a, lambda x: ln(1 + abs(x)))), 9) AS log_mean FROM s""",
)
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")).withColumn("o", F.array_sort("a"))
    a, n = F.col("a"), F.size("a")
    middle = (F.get("o", F.floor((n - 1) / 2).cast("int")) + F.get("o", F.floor(n / 2).cast("int"))) / 2
    return e.select(
        "vec_id", r9(A.mean(a)).alias("mean"), r9(middle).alias("median"), *[r9(A.tail_mean(a, p)).alias(f"min_k_{p:02d}") for p in (5, 10, 20)],
        r9(F.size(F.filter(a, lambda x: x > 0)) / n).alias("top_rate"), r9(A.mean(F.transform(a, lambda x: F.log1p(F.abs(x))))).alias("log_mean"),
    )


SHARD = 4096  # rows of a shard that is cut into batches, on average


@query("Q9_padded_batches")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches of ascending length inside each source's shards: id, length, shard, batch.

    A source has as many shards as keep them at SHARD rows on average, so what one task holds (ids and
    lengths) does not grow with the source.
    """
    from tessera.operators.cohort import batches
    from tessera.operators.joins import small

    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(F.split("text", " ", -1)).alias("n"))
    shards = d.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / F.lit(SHARD)).alias("shards"))
    d = d.join(small(shards), F.col("source").eqNullSafe(F.col("s")))
    d = d.select("doc_id", "source", "n", F.pmod(h60("q9", F.col("doc_id")), F.col("shards")).cast("int").alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id"])
        return pdf.assign(batch=list(batches(pdf["n"].tolist(), 16384)))[["doc_id", "source", "n", "shard", "batch"]]

    return d.groupBy("source", "shard").applyInPandas(run, "doc_id long, source string, n int, shard int, batch int")


@query(
    "Q10_loo_ngram_logprob",
    f"""WITH {BYTES}, lj AS (SELECT doc_id, lang, width, context, next, sum(k) AS j FROM g GROUP BY ALL), lc AS (SELECT doc_id, lang, width, context, sum(j) AS c FROM lj GROUP BY ALL),
gj AS (SELECT lang, width, context, next, sum(j) AS gj FROM lj GROUP BY ALL), gc AS (SELECT lang, width, context, sum(c) AS gc FROM lc GROUP BY ALL),
r AS (SELECT g.doc_id, longest, next, width, k, gj - j AS joint, gc - c AS ctx FROM g JOIN lj USING (doc_id, lang, width, context, next) JOIN lc USING (doc_id, lang, width, context) JOIN gj USING (lang, width, context, next) JOIN gc USING (lang, width, context)),
x AS (SELECT doc_id, longest, next, any_value(k) AS k, arg_max(ln((joint + CAST(0.5 AS DOUBLE)) / (ctx + 128)), width) AS logp FROM r WHERE width = 0 OR ctx >= 4 GROUP BY doc_id, longest, next)
SELECT doc_id, CAST(sum(k) AS BIGINT) AS bytes, round(sum(k * logp) / sum(k), 9) AS mean_logp FROM x GROUP BY doc_id HAVING sum(k) > 1""",
)
def loo_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log probability of a text's bytes by the language's other texts; texts of less than two bytes have none."""
    out = N.loo_scores(spread(table(spark, sf_dir, "documents")), "doc_id", "lang", "text")
    return out.where("bytes > 1").select("doc_id", "bytes", r9(F.col("logp") / F.col("bytes")).alias("mean_logp"))


@query(
    "Q11_Q16_X15_offsets",
    """WITH t AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE length(text) >= 12) SELECT doc_id, CAST(octet_length(encode(substr(text, 1, 10))) AS INT) AS byte_at_10,
CAST(octet_length(encode(text)) AS INT) AS bytes, md5(substr(text, 1, 8)) AS prefix_crop, md5(substr(text, CAST(length(text) - 7 AS BIGINT), 8)) AS suffix_crop, w[1] = substr(text, 1, CAST(length(w[1]) AS BIGINT)) AS aligned FROM t""",
)
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 12).select("doc_id", "text", F.get(F.split("text", " ", -1), 0).alias("w"))
    t = F.col("text")
    return d.select(
        "doc_id", F.octet_length(F.left("text", F.lit(10))).alias("byte_at_10"), F.octet_length(t).alias("bytes"), F.md5(F.left("text", F.lit(8))).alias("prefix_crop"),
        F.md5(F.right("text", F.lit(8))).alias("suffix_crop"), (F.substring(t, F.lit(1), F.length("w")) == F.col("w")).alias("aligned"),
    )


@query("Q12_Q14_character_weights")
def character_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of characters by the spans that they are part of, and of tokens by their characters, summed up for each text."""
    from tessera.operators.spans import span_weights

    d = span_weights(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return d.withColumn("weight", r9("weight")).withColumn("token_weight", r9("token_weight"))


@query(
    "Q15_format_errors",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count_if(regexp_matches(line, '^ +\t|^\t+ ')) AS mixed, count_if(regexp_matches(line, '[^ ]  +[^ ]') AND NOT starts_with(ltrim(line), '#')) AS spacing FROM l GROUP BY doc_id""",
)
def format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    count = lambda f: F.size(F.filter("l", f)).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    return d.select(
        "doc_id", F.size("l").cast("long").alias("lines"), count(lambda x: x.rlike(r"^ +\t|^\t+ ")).alias("mixed"),
        count(lambda x: x.rlike("[^ ]  +[^ ]") & ~F.startswith(F.ltrim(x), F.lit("#"))).alias("spacing"),
    )


