"""Projections, filters, contracts, joins, sets and reshapes (inventory 2.2 to 2.4, 2.8 to 2.10)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import canonical as C
from tessera.functions.hashing import h60, h60_sql
from tessera.operators import arrays as A
from tessera.operators import contracts as K
from tessera.operators import joins as J
from tessera.operators import panel as P
from tessera.operators import text as D
from tessera.operators import positions as O
from tessera.plans.base import PANEL, SCORED, panel, r9, scored
from tessera.operators.metrics import correlation
from tessera.registry import query, spread, table


@query(
    "P1_P4_P5_P27_canonical_strings",
    r"""WITH s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '  A/' || c_mktsegment || '/ 2009_cell ' WHEN 1 THEN 'B/x  y' WHEN 2 THEN 'n/a'
WHEN 3 THEN c_name || ' Cell' ELSE NULL END AS s FROM customer)
SELECT c_custkey, trim(regexp_replace(coalesce(s, ''), '\s+', ' ', 'g')) AS normal,
regexp_replace(trim(regexp_replace(coalesce(s, ''), '\s+', ' ', 'g')), '(?i)(_|\s+)cell$', '_MDCK') AS strain,
regexp_replace(regexp_replace(trim(regexp_replace(coalesce(s, ''), '\s+', ' ', 'g')), '(?i)(_|\s+)cell$', '_MDCK'), '(?i)[_ ](mdck|egg|cell)$', '') AS component,
CASE WHEN lower(trim(s)) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'not available', 'unknown') THEN s END AS known FROM s""",
)
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    s = F.when(k == 0, F.concat(F.lit("  A/"), "c_mktsegment", F.lit("/ 2009_cell "))).when(k == 1, "B/x  y").when(k == 2, "n/a").when(k == 3, F.concat("c_name", F.lit(" Cell")))
    d = table(spark, sf_dir, "customer").select("c_custkey", s.alias("s"))
    s = F.col("s")
    return d.select("c_custkey", C.normal_text(s).alias("normal"), C.strain(s).alias("strain"), C.component_identity(C.strain(s)).alias("component"), C.without_sentinels(s).alias("known"))


@query(
    "P2_canonical_timepoint",
    """WITH s AS (SELECT event_id, day(ts) AS d, CASE event_id % 6 WHEN 0 THEN 'Day ' || day(ts) WHEN 1 THEN ' PRE_VACC ' WHEN 2 THEN day(ts) || '.0' WHEN 3 THEN 'd' || day(ts) WHEN 4 THEN 'Baseline' ELSE 'week two' END AS s FROM events)
SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'Pre-vacc' WHEN 4 THEN 'Pre-vacc' WHEN 5 THEN 'week two' ELSE CAST(d AS VARCHAR) END AS timepoint,
CASE WHEN event_id % 6 IN (0, 2, 3) THEN CAST(d AS DOUBLE) END AS number FROM s""",
)
def timepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("event_id") % 6, F.dayofmonth("ts").cast("string")
    s = F.when(k == 0, F.concat(F.lit("Day "), d)).when(k == 1, " PRE_VACC ").when(k == 2, F.concat(d, F.lit(".0"))).when(k == 3, F.concat(F.lit("d"), d)).when(k == 4, "Baseline").otherwise("week two")
    e = table(spark, sf_dir, "events").select("event_id", s.alias("s"))
    return e.select("event_id", C.timepoint(F.col("s")).alias("timepoint"), C.day_number(F.col("s")).alias("number"))


@query(
    "P3_P6_P10_P11_P24_relabel",
    """SELECT c_custkey, CASE upper(c_mktsegment) WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'industry' ELSE c_mktsegment END AS segment,
CASE c_custkey % 6 WHEN 0 THEN 'PBMC' WHEN 1 THEN 'whole_blood' WHEN 2 THEN 'B_cell' WHEN 3 THEN 'other_blood' WHEN 4 THEN 'not_reported' ELSE 'other_reported' END AS material,
CASE WHEN c_nationkey < 5 AND c_acctbal > 0 THEN 'proxy' ELSE c_mktsegment END AS relabelled, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS label FROM customer""",
)
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, "frozen pbmc").when(k == 1, "Whole-Blood").when(k == 2, "B cells").when(k == 3, "cord blood").when(k == 5, "saliva")
    member = F.when(F.col("c_custkey") % 2 == 0, "Member").otherwise("non-member")
    mask = (F.col("c_nationkey") < 5) & (F.col("c_acctbal") > 0)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", C.synonym(F.col("c_mktsegment"), {"building": "construction", "machinery": "industry"}).alias("segment"),
        C.material(raw).alias("material"), F.when(mask, "proxy").otherwise(F.col("c_mktsegment")).alias("relabelled"), C.label(member).alias("label"),
    )


@query(
    "P7_P8_P9_marker_states",
    """WITH s AS (SELECT p_partkey, p_partkey % 4 AS k, p_size FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '+' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'not_reported' ELSE '' END AS state,
CASE k WHEN 0 THEN 'CD19+ CD3-|fresh' WHEN 1 THEN 'CD27+ CD27-|and' WHEN 2 THEN '|FROZEN FRESH ' || p_size ELSE '|CD27 THAWED' END AS signature,
CASE k WHEN 0 THEN 'fresh' WHEN 1 THEN 'not_reported' WHEN 2 THEN 'mixed' ELSE 'frozen' END AS processing FROM s""".replace("|fresh", "|CD27+|FRESH").replace("CD19+ CD3-|CD27+|FRESH", "CD27+ CD3-|FRESH").replace("|and", "|AND"),
)
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, "CD3- fresh CD27+").when(k == 1, "CD27+ and CD27-").when(k == 2, F.concat(F.lit("frozen fresh "), F.col("p_size").cast("string"))).otherwise("cd27 thawed")
    d = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    s = F.col("s")
    return d.select("p_partkey", C.marker_state(s, "CD27").alias("state"), C.gate_signature(s).alias("signature"), C.processing_state(s).alias("processing"))


@query(
    "P12_P13_P14_P15_derived_columns",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(31) || 'participant:' || doc_id ELSE source || chr(31) || lang END AS key,
len(list_filter([0, 200, 1000, 4000], lambda e: e <= n_chars)) - 1 AS bin, least(14, greatest(9, CAST(floor(log2(n_chars)) AS INT))) AS bucket,
round(greatest(log2(n_chars) - 10, 0), 9) AS hinge FROM documents""",
)
def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise(" ")
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.subject_key(subject, F.col("doc_id"), F.col("source")).alias("key"), C.fixed_bin(n, [0, 200, 1000, 4000]).cast("long").alias("bin"),
        C.length_bucket(n).alias("bucket"), r9(C.hinge(F.log2(n), 1024)).alias("hinge"),
    )


@query(
    "P16_P17_P20_interactions",
    f"""WITH {SCORED}, c AS (SELECT avg(s1) AS m FROM scored WHERE doc_id % 5 <> 0)
SELECT doc_id, round((s1 - m) * s2, 9) AS s2_x_length, round((s1 - m) * s3, 9) AS s3_x_length, round(s1 * s2, 9) AS s1_x_s2, round(s1 * s3, 9) AS s1_x_s3, round(s2 * s3, 9) AS s2_x_s3, round(-s2, 9) AS s2_oriented FROM scored, c""",
)
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length interactions centred on the fit rows' mean; all pairs of three columns; a sign per column."""
    s = scored(spark, sf_dir)
    centre = s.where("doc_id % 5 <> 0").agg(F.avg("s1").alias("m")).scalar()
    cols = ["s1", "s2", "s3"]
    centred = [r9((F.col("s1") - centre) * F.col(c)).alias(f"{c}_x_length") for c in cols[1:]]
    pairs = [r9(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return s.select("doc_id", *centred, *pairs, r9(-F.col("s2")).alias("s2_oriented"))


@query(
    "P22_P23_F13_content_identity",
    """SELECT doc_id, sha256(text) AS content, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS signature, length(text || ' #' || substr(sha256(text), 1, 4)) AS probed_length,
lang || '-' || sha256(text) AS sample_id, true AS identity_holds FROM documents""",
)
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("content", F.sha2("text", 256)).withColumn("sample_id", F.concat_ws("-", "lang", F.sha2("text", 256)))
    holds = F.substring_index("sample_id", "-", -1) == F.col("content")
    probed = F.concat("text", F.lit(" #"), F.substring("content", 1, 4))
    signature = F.sha2(F.to_json(F.struct("lang", "source")), 256)
    return d.select("doc_id", "content", signature.alias("signature"), F.length(probed).cast("long").alias("probed_length"), "sample_id", holds.alias("identity_holds"))


@query(
    "P25_static_text_features",
    r"""WITH t AS (SELECT doc_id, lang, text, length(text) AS n, string_split(text, chr(10)) AS lines FROM documents),
f AS (SELECT *, list_transform(lines, lambda x: length(x)) AS ls FROM t)
SELECT doc_id, round(ln(1 + n), 9) AS log_chars, round(ln(1 + len(lines)), 9) AS log_lines, round(list_avg(ls), 9) AS line_mean, round(list_stddev_pop(ls), 9) AS line_std, list_max(ls) AS line_max,
round((n - length(regexp_replace(text, '[0-9]', '', 'g'))) / CAST(greatest(n, 1) AS DOUBLE), 9) AS digit_rate,
round((n - length(regexp_replace(text, '[.,;:!?]', '', 'g'))) / CAST(greatest(n, 1) AS DOUBLE), 9) AS punctuation_rate,
round((n - length(regexp_replace(text, '[A-Z]', '', 'g'))) / CAST(greatest(n, 1) AS DOUBLE), 9) AS upper_rate, CAST(lang = 'en' AS INT) AS lang_en, CAST(lang = 'fr' AS INT) AS lang_fr FROM f""",
)
def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), F.length("text")
    share = lambda p: r9((n - F.length(F.regexp_replace(t, p, ""))) / F.greatest(n, F.lit(1)))
    lengths = F.transform(F.split(t, "\n"), lambda x: F.length(x).cast("double"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", lengths.alias("ls"))
    mean = A.mean(F.col("ls"))
    d = d.withColumn("m", mean)
    std = F.sqrt(A.mean(F.transform("ls", lambda x: (x - F.col("m")) * (x - F.col("m")))))
    one = lambda v: (F.col("lang") == v).cast("int")
    return d.select(
        "doc_id", r9(F.log1p(n.cast("double"))).alias("log_chars"), r9(F.log1p(F.size("ls").cast("double"))).alias("log_lines"), r9("m").alias("line_mean"), r9(std).alias("line_std"),
        F.array_max("ls").cast("long").alias("line_max"), share("[0-9]").alias("digit_rate"), share("[.,;:!?]").alias("punctuation_rate"), share("[A-Z]").alias("upper_rate"),
        one("en").alias("lang_en"), one("fr").alias("lang_fr"),
    )


@query(
    "P26_strain_parse",
    r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A/H3N2/' || p_brand || '/' || (1990 + p_size) WHEN 1 THEN 'B/Victoria/' || p_size || '/2017_MDCK' ELSE 'unknown' END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'H3N2' WHEN 1 THEN 'B/Victoria' END AS family, CASE WHEN s LIKE '%MDCK' THEN 'MDCK' END AS substrate,
CASE p_partkey % 3 WHEN 0 THEN CAST(regexp_extract(s, '([0-9]{4})$', 1) AS INT) WHEN 1 THEN 2017 END AS isolation_year FROM s""",
)
def strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    year, size = (F.col("p_size") + 1990).cast("string"), F.col("p_size").cast("string")
    s = F.when(k == 0, F.concat(F.lit("A/H3N2/"), "p_brand", F.lit("/"), year)).when(k == 1, F.concat(F.lit("B/Victoria/"), size, F.lit("/2017_MDCK"))).otherwise("unknown")
    got = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    d = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    family = F.coalesce(got("s", r"^A/(H\d+N\d+)"), got("s", "^(B/(?:Victoria|Yamagata))"))
    return d.select("p_partkey", family.alias("family"), F.upper(got("s", "(?i)_(mdck|egg|cell)$")).alias("substrate"), got("s", r"/(\d{4})(?:_[A-Za-z]+)?$").cast("int").alias("isolation_year"))


@query(
    "P28_column_isolation",
    "SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS kept, '-99' AS c_nationkey, '-99' AS c_mktsegment FROM customer",
)
def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_acctbal").cast("string").alias("kept"), *[F.lit("-99").alias(x) for x in ("c_nationkey", "c_mktsegment")])


@query(
    "F1_F2_F3_F4_filters",
    """SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 300 AND 5000 AND regexp_matches(lower(text), '(^| )the |(^| )le ') AND contains(text, ',') AND trim(text) <> ''""",
)
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(300, 5000))
    return d.where(F.lower("text").rlike("(^| )the |(^| )le ") & F.contains("text", F.lit(",")) & (F.trim("text") != "")).select("doc_id")


@query(
    "F5_F6_F7_F9_F10_contracts",
    "SELECT count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem",
)
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table passes its contracts before it is summed."""
    li = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("string"))
    li = K.numeric(K.require_columns(li, ["l_orderkey", "l_quantity"], forbidden=("toxic", "quality")), "l_quantity")
    K.require_finite(li, "l_quantity", positive=True)
    K.require_unique(table(spark, sf_dir, "orders"), "o_orderkey")
    return li.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query(
    "F8_F14_U5_key_contracts",
    "SELECT (SELECT count(*) FROM labels l WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS outside, (SELECT min(c) FROM (SELECT count(*) c FROM supplier GROUP BY s_suppkey)) AS least, (SELECT count(*) FROM nation) AS nations",
)
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, docs, sup = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "supplier")
    K.require_balance(sup, 1, "s_suppkey")
    n = table(spark, sf_dir, "nation")
    K.require_same_keys(n, n.select("n_nationkey").distinct(), "n_nationkey")
    outside = lab.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("outside"))
    return outside.select("outside", F.lit(1).cast("long").alias("least"), n.agg(F.count("*").alias("n")).scalar().alias("nations"))


@query(
    "F11_F12_metadata_conflicts",
    """SELECT l_orderkey, count(DISTINCT l_returnflag || '/' || l_linestatus) AS signatures, round(CASE WHEN count(DISTINCT l_returnflag || '/' || l_linestatus) = 1 THEN avg(l_quantity) END, 9) AS value,
count(DISTINCT l_returnflag || '/' || l_linestatus) <> 1 AS conflict FROM lineitem GROUP BY l_orderkey""",
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.single_value(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.concat_ws("/", "l_returnflag", "l_linestatus"), "l_quantity")
    return s.withColumn("value", r9("value"))


@query(
    "F19_compatibility_levels",
    f"""WITH {PANEL}, r AS (SELECT participant, study, unnest([{{'level': 'exact', 's': feature || '/' || k}}, {{'level': 'feature', 's': feature}}, {{'level': 'half', 's': CAST(k >= 50 AS VARCHAR)}}, {{'level': 'timepoint', 's': timepoint}}]) AS x FROM panel WHERE day = 1),
p AS (SELECT x.level AS level, participant, study, min(x.s) AS signature, min(x.s) = max(x.s) AS one FROM r GROUP BY ALL),
t AS (SELECT level, CASE WHEN bool_and(one) AND min(signature) = max(signature) THEN min(signature) END AS target FROM p WHERE study = 0 GROUP BY level)
SELECT level, target IS NOT NULL AS reference_defined, count_if(study = 1 AND one AND signature = target) AS compatible, count_if(study = 1 AND one AND signature = target) >= 8 AS meets_minimum FROM p LEFT JOIN t USING (level) GROUP BY level, target""",
)
def compatibility_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants of study 1 whose baseline metadata is that of study 0, at four levels of strictness."""
    p = panel(spark, sf_dir).where("day = 1")
    levels = {"exact": F.concat_ws("/", "feature", F.col("k").cast("string")), "feature": F.col("feature"), "half": (F.col("k") >= 50).cast("string"), "timepoint": F.col("timepoint")}
    return P.compatibility(p, levels, "participant", "study", 0, 1, 8)


@query(
    "F18_soft_failure",
    """WITH c AS (SELECT n.n_name, count(s_suppkey) AS k, (covar_pop(s_suppkey, s_acctbal) / nullif(stddev_pop(s_suppkey) * stddev_pop(s_acctbal), 0)) AS r FROM nation n LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL)
SELECT n_name, CASE WHEN k >= 3 THEN 'ok' ELSE 'not_evaluable' END AS status, CASE WHEN k < 3 THEN 'fewer than 3 rows' END AS reason, round(CASE WHEN k >= 3 THEN r END, 9) AS value FROM c""",
)
def soft_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    c = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("k"), correlation("s_suppkey", "s_acctbal").alias("r"))
    ok = F.col("k") >= 3
    return c.select("n_name", F.when(ok, "ok").otherwise("not_evaluable").alias("status"), F.when(~ok, "fewer than 3 rows").alias("reason"), r9(F.when(ok, F.col("r"))).alias("value"))


@query(
    "J1_J3_J6_F7_validated_dim_join",
    """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before the dimensions are joined, so one shuffle carries little."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("p"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = J.enrich(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    out = J.enrich(J.one_to_one(o, c, ["c_custkey"]), n, ["n_nationkey"])
    return out.groupBy("r_name", "n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("p"), 2).alias("price"))


@query(
    "J2_J4_left_view_join",
    "SELECT d.doc_id, lang, quality AS view_quality, l.doc_id IS NOT NULL AS has_view FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def view_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("view_quality"), F.lit(True).alias("has"))
    out = J.one_to_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), lab, ["doc_id"], "left")
    return out.select("doc_id", "lang", "view_quality", F.coalesce("has", F.lit(False)).alias("has_view"))


@query(
    "J16_aligned_by_position",
    """WITH a AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS p FROM labels), b AS (SELECT doc_id AS other, lang, row_number() OVER (ORDER BY doc_id) AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT p - 1 AS position, doc_id, quality, lang FROM a JOIN b USING (p) WHERE doc_id = other""",
)
def aligned_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and their documents, each sorted by itself, put side by side; every pair is of one document."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("other"), "lang")
    d = d.join(lab.select(F.col("doc_id").alias("other")), "other", "left_semi")
    return O.aligned(lab, d, ["doc_id"], ["other"], F.col("doc_id") == F.col("other")).drop("other")


@query("J5_coverage_exact", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def coverage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    b = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("d"))
    return J.coverage_exact(a, b, ["l_orderkey"]).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query(
    "J7_J8_U2_U3_semi_anti_split",
    """SELECT 'labelled' AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'unlabelled', count(*), sum(n_chars)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id")
    part = lambda how, name: d.join(lab, "doc_id", how).agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return part("left_semi", "labelled").unionByName(part("left_anti", "unlabelled"))


@query(
    "J9_within_group_pairs",
    """WITH p AS (SELECT a.c_nationkey, a.c_custkey AS l, b.c_custkey AS r, a.c_acctbal - b.c_acctbal AS d FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey
AND a.c_custkey <> b.c_custkey AND a.c_mktsegment <> b.c_mktsegment AND abs(a.c_acctbal - b.c_acctbal) > 500)
SELECT c_nationkey, l AS left_key, r AS right_key, round(d, 6) AS delta FROM p""",
)
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    p = J.within_group_pairs(c, "c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal", 500)
    return p.select("c_nationkey", F.col("left").alias("left_key"), F.col("right").alias("right_key"), F.round("delta", 6).alias("delta"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _parities(half: int) -> str:
    """Of each letter's number of occurrences the lowest bit, or the one above, as an integer in SQL."""
    return " + ".join(f"(((length(text) - length(replace(text, '{c}', ''))) >> {half}) & 1)::BIGINT * {1 << i}" for i, c in enumerate(LETTERS))


@query(
    "J11_hamming_blocks",
    f"""WITH b AS (SELECT doc_id, {_parities(0)} AS x, {_parities(1)} AS y FROM documents), d AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.x, b.x)) + bit_count(xor(a.y, b.y)) AS d FROM b a JOIN b b ON a.doc_id < b.doc_id)
SELECT a, b, d::INT AS distance FROM d WHERE d <= 6""",
)
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose letter counts modulo four, as 52 bits, differ in six bits at most."""
    bits = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("long")
        bits = bits.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(1)), i)).bitwiseOR(F.shiftleft(F.shiftright(n, 1).bitwiseAND(F.lit(1)), 26 + i))
    d = D.written(spread(table(spark, sf_dir, "documents")).select("doc_id", bits.alias("x")))
    return J.hamming_pairs(d, "doc_id", "x", 6, 52)


@query(
    "J12_nearest_in_family",
    """WITH q AS (SELECT s_suppkey, s_nationkey AS nk, s_acctbal FROM supplier), p AS (SELECT c_nationkey AS nk, c_name, c_acctbal FROM customer)
SELECT s_suppkey, arg_min(c_name, (round(abs(s_acctbal - c_acctbal), 6), c_name)) AS nearest, min(round(abs(s_acctbal - c_acctbal), 6)) AS distance FROM q JOIN p USING (nk) GROUP BY s_suppkey""",
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"), "s_acctbal")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"), "c_name", "c_acctbal")
    return J.nearest_value(q, p, "nk", "s_acctbal", "c_acctbal", 6, "s_suppkey", "c_name")


ALIGNED = f"""r AS (SELECT doc_id, lang, y, least(14, greatest(9, CAST(floor(log2(n_chars)) AS INT))) AS bucket,
  row_number() OVER (PARTITION BY lang, least(14, greatest(9, CAST(floor(log2(n_chars)) AS INT))), y ORDER BY {h60_sql("'pair'", "doc_id")}, doc_id) AS k FROM scored)"""


@query(
    "J13_G4_matched_pairs",
    f"""WITH {SCORED}, {ALIGNED} SELECT a.lang, a.bucket, a.k AS place, a.doc_id AS one, b.doc_id AS zero FROM r a JOIN r b ON a.lang = b.lang AND a.bucket = b.bucket AND a.k = b.k AND a.y = 1 AND b.y = 0 WHERE a.k <= 10""",
)
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("bucket", C.length_bucket(F.col("n_chars")))
    out = J.rank_aligned(s, ["lang", "bucket"], "y", h60("pair", F.col("doc_id")), "doc_id").where("place <= 10")
    return out.withColumn("place", F.col("place").cast("long"))


@query(
    "J14_J15_two_timepoints",
    f"""WITH {PANEL}, d AS (SELECT participant, feature, avg(CASE WHEN day = 2 THEN value END) AS early, avg(CASE WHEN day = 28 THEN value END) AS late FROM panel GROUP BY ALL)
SELECT participant, feature, round(early, 9) AS early, round(late, 9) AS late, round(log2(late / early), 9) AS shift FROM d WHERE early IS NOT NULL AND late IS NOT NULL""",
)
def two_timepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda cond: F.avg(F.when(F.expr(cond), F.col("value")))
    d = panel(spark, sf_dir).groupBy("participant", "feature").agg(part("day = 2").alias("early"), part("day = 28").alias("late")).dropna()
    return d.select("participant", "feature", r9("early").alias("early"), r9("late").alias("late"), r9(P.log_ratio(F.col("late"), F.col("early"), F.log2)).alias("shift"))


@query(
    "J17_aligned_arrays",
    """SELECT a.vec_id, CAST(len(a.embedding) AS INT) AS width, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS product
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND len(a.embedding) = len(b.embedding)""",
)
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(b, "vec_id").where(F.size("x") == F.size("y")).select("vec_id", F.size("x").alias("width"), r9(A.dot(F.col("x"), F.col("y"))).alias("product"))


@query("J18_group_statistic", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS group_size FROM customer")
def group_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.count("*").over(W.partitionBy("c_nationkey")).alias("group_size"))


@query(
    "J19_A8_presence_overlap",
    f"""WITH {PANEL}, p AS (SELECT DISTINCT study, participant, feature FROM panel WHERE day <= 3)
SELECT a.study, a.feature AS fa, b.feature AS fb, count(*) AS both_present FROM p a JOIN p b ON a.study = b.study AND a.participant = b.participant AND a.feature < b.feature GROUP BY ALL""",
)
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).where("day <= 3").select("study", "participant", "feature").distinct()
    a, b = p.withColumnRenamed("feature", "fa"), p.withColumnRenamed("feature", "fb")
    return a.join(b, ["study", "participant"]).where("fa < fb").groupBy("study", "fa", "fb").agg(F.count("*").alias("both_present"))


@query(
    "J20_exclusion_by_hash",
    "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 7 = 0 AND sha256(e.text) = sha256(d.text))",
)
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.where("doc_id % 7 = 0").select("h").distinct(), "h", "left_anti").select("doc_id")


@query(
    "U1_U4_union",
    "SELECT kind, count(*) AS n, count(DISTINCT nation) AS nations FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier UNION ALL SELECT 'any', n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)) GROUP BY kind",
)
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    both = c.select("nation").union(s.select("nation")).distinct().withColumn("kind", F.lit("any"))
    return c.unionByName(s).unionByName(both, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("nation").alias("nations"))


@query(
    "U6_first_appearance",
    "SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY l_suppkey",
)
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen"))


@query(
    "R1_R2_R3_pivots",
    f"""WITH {PANEL} SELECT participant, round(avg(CASE WHEN feature = 'click' THEN value END), 9) AS click, round(avg(CASE WHEN feature = 'view' THEN value END), 9) AS view,
round(avg(CASE WHEN feature = 'absent' THEN value END), 9) AS absent, count(CASE WHEN feature = 'click' THEN 1 END) AS n_click, count(CASE WHEN feature = 'error' THEN 1 END) AS n_error FROM panel GROUP BY participant""",
)
def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    wide = p.groupBy("participant").pivot("feature", ["click", "view", "absent"]).agg(F.avg("value"))
    counts = p.groupBy("participant").pivot("feature", ["click", "error"]).count().na.fill(0)
    wide = wide.select("participant", *[r9(c).alias(c) for c in ("click", "view", "absent")])
    return wide.join(counts.select("participant", F.col("click").alias("n_click"), F.col("error").alias("n_error")), "participant")


@query(
    "R4_R7_wide_to_long",
    f"WITH {SCORED} SELECT doc_id, 's1' AS score, round(s1, 9) AS value FROM scored UNION ALL SELECT doc_id, 's2', round(s2, 9) FROM scored UNION ALL SELECT doc_id, 's9', NULL FROM scored",
)
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("s9", F.lit(None).cast("double"))
    return s.unpivot("doc_id", ["s1", "s2", "s9"], "score", "value").withColumn("value", r9("value"))


@query(
    "R5_Q2_token_windows",
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n, least(len(w), 64) AS k FROM t),
s AS (SELECT DISTINCT doc_id, unnest([0, (n - k) // 2, n - k]) AS start, k, w FROM n) SELECT doc_id, start, k AS width, md5(array_to_string(w[start + 1:start + k], ' ')) AS content FROM s""",
)
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.sequences import window_starts

    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    n = F.size("w")
    k = F.least(n, F.lit(64))
    d = d.select("doc_id", "w", k.alias("k"), F.explode(window_starts(n, k)).alias("start"))
    content = F.md5(F.array_join(F.slice("w", F.col("start") + 1, F.col("k")), " "))
    return d.select("doc_id", F.col("start").cast("long").alias("start"), F.col("k").cast("long").alias("width"), content.alias("content"))


@query(
    "R6_G20_exposure_schedule",
    f"""WITH r AS (SELECT doc_id, unnest(range(0, 3)) AS round FROM documents) SELECT round, doc_id, row_number() OVER (PARTITION BY round, doc_id % 4 ORDER BY {h60_sql("'expo'", "round", "doc_id")}, doc_id) AS place, doc_id % 4 AS shard FROM r""",
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once a round, in a hashed order; orders are by shard, so rounds are dealt over tasks."""
    r = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("round"))
    order = W.partitionBy("round", "shard").orderBy(h60("expo", F.col("round"), F.col("doc_id")), "doc_id")
    return r.withColumn("place", F.row_number().over(order).cast("long"))


@query(
    "X1_X2_X3_X4_X12_strings",
    r"""SELECT c_custkey, upper(c_mktsegment) AS up, starts_with(c_name, 'Customer#00') AS starts, contains(c_name, '7') AS has7, split_part(c_name, '#', 2) AS number,
CAST(len(regexp_extract_all(c_name || ' x1=2', '[A-Za-z_]\w*|\d+|[^\s]')) AS INT) AS tokens, array_to_string(regexp_extract_all('camelCaseName', '[A-Z]?[a-z]+'), '_') AS parts, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'unknown') AS filled FROM customer""",
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.concat("c_name", F.lit(" x1=2")), F.lit(r"[A-Za-z_]\w*|\d+|[^\s]"), F.lit(0))
    parts = F.regexp_extract_all(F.lit("camelCaseName"), F.lit("[A-Z]?[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("up"), F.startswith("c_name", F.lit("Customer#00")).alias("starts"), F.contains("c_name", F.lit("7")).alias("has7"),
        F.substring_index("c_name", "#", -1).alias("number"), F.size(tokens).alias("tokens"), F.array_join(parts, "_").alias("parts"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("unknown")).alias("filled"),
    )


@query(
    "X5_X6_X11_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 9) AS logistic, round(ln(1 + q), 9) AS l1p, round(sqrt(q), 9) AS root, round(exp(-q / 10), 9) AS e, sign(x) AS s,
floor(q / 7) AS fl, ceil(q / 7) AS ce, least(1.0, greatest(0.0, x)) AS clipped, CASE WHEN q <= 25 THEN greatest(q, l_discount * 100) ELSE q END AS chosen FROM (SELECT *, (l_tax - CAST(0.04 AS DOUBLE)) * 100 AS x, l_quantity AS q FROM lineitem)""",
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("x", (F.col("l_tax") - 0.04) * 100).withColumn("q", F.col("l_quantity").cast("string").try_cast("double"))
    x, q = F.col("x"), F.col("q")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r9(C.sigmoid(x)).alias("logistic"), r9(F.log1p(q)).alias("l1p"), r9(F.sqrt(q)).alias("root"), r9(F.exp(-q / 10)).alias("e"), F.signum(x).cast("int").alias("s"),
        F.floor(q / 7).alias("fl"), F.ceil(q / 7).alias("ce"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)).alias("clipped"), F.when(q <= 25, F.greatest(q, F.col("l_discount") * 100)).otherwise(q).alias("chosen"),
    )


@query(
    "X7_array_functions",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) SELECT vec_id, len(a) AS n, round(list_avg(a), 9) AS mean, round(list_stddev_pop(a), 9) AS std, round(list_min(a[1:8]), 9) AS low, round(list_dot_product(a[1:32], a[33:64]), 9) AS halves, len(list_distinct(list_concat(a[1:4], a[3:6]))) AS kinds FROM a""",
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")).withColumn("m", A.mean(a))
    std = F.sqrt(A.mean(F.transform(a, lambda x: (x - F.col("m")) * (x - F.col("m")))))
    return e.select(
        "vec_id", F.size(a).cast("long").alias("n"), r9("m").alias("mean"), r9(std).alias("std"), r9(F.array_min(F.slice(a, 1, 8))).alias("low"), r9(A.dot(F.slice(a, 1, 32), F.slice(a, 33, 32))).alias("halves"),
        F.size(F.array_distinct(F.concat(F.slice(a, 1, 4), F.slice(a, 3, 4)))).cast("long").alias("kinds"),
    )


@query(
    "X8_X13_years_and_bits",
    """SELECT o_orderkey, CAST(regexp_extract(CAST(o_orderdate AS VARCHAR), '([0-9]{4})', 1) AS INT) AS year, bit_count(xor(o_orderkey, o_custkey))::INT AS distance, (o_orderkey >> 3) & 7 AS bits FROM orders""",
)
def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", F.regexp_extract(F.col("o_orderdate").cast("string"), "([0-9]{4})", 1).cast("int").alias("year"),
        F.bit_count(F.col("o_orderkey").bitwiseXOR(F.col("o_custkey"))).alias("distance"), F.shiftright("o_orderkey", 3).bitwiseAND(F.lit(7)).alias("bits"),
    )


@query(
    "X9_X10_json_and_hashes",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{"k":' || CAST(json_extract_string(props, '$.k') AS INT) || ',"type":"' || event_type || '"}' AS canonical, md5(event_type || event_id) AS m, sha256(event_type || event_id) AS s,
"""
    + h60_sql("event_type", "event_id")
    + " AS h FROM events",
)
def json_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int").getField("k")
    both = F.concat("event_type", F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("canonical"), F.md5(both).alias("m"), F.sha2(both, 256).alias("s"), h60(F.col("event_type"), F.col("event_id")).alias("h"),
    )


