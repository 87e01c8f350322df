"""Eligibility, overlap and shift audits (inventory F4, G22, J2, M14, M17 and M20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.contracts import require
from tessera.operators.joins import one_to_one, small


def eligible(record: Column, low: int, high: int) -> Column:
    """whether a JSON record may be used: content and path non-blank strings, content of low to high characters,
    autogenerated the boolean false (no string, no number), copies the number 1 or the string "1" (true is neither).
    A record that doesn't parse may not."""
    v = F.try_parse_json(record)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.try_variant_get(v, path, "string")
    named = [(kind(f"$.{c}") == "STRING") & (F.trim(text(f"$.{c}")) != "") for c in ("content", "path")]
    length = F.char_length(text("$.content")).between(low, high)
    fresh = (kind("$.autogenerated") == "BOOLEAN") & ~F.try_variant_get(v, "$.autogenerated", "boolean")
    single = (kind("$.copies") == "BIGINT") & (text("$.copies") == "1") | (kind("$.copies") == "STRING") & (F.trim(text("$.copies")) == "1")
    return F.coalesce(reduce(lambda a, b: a & b, [*named, length, fresh, single]), F.lit(False))


def attach_view(base: DataFrame, view: DataFrame, on: list[str], study: str) -> DataFrame:
    """Base with the columns of an optional view (1:1, left) and has_view; raises if a matched row's study differs.

    A study that one side has and the other lacks differs, too.
    """
    mark = view.withColumnRenamed(study, "_study").withColumn("has_view", F.lit(True))
    out = one_to_one(base, mark, on, "left").withColumn("has_view", F.coalesce("has_view", F.lit(False)))
    bad = out.where(F.col("has_view") & ~F.col(study).eqNullSafe(F.col("_study"))).limit(1).count()
    require(not bad, "view", f"{study} differs between a row and its view")
    return out.drop("_study")


def overlap_splits(df: DataFrame, study: str, subject: str, member: str, panel: list[str], inner: int) -> DataFrame:
    """For each held study held, validation_members, training_studies and skipped (null: eligible).

    A study overlaps the panel by its rows' members that are in it.  A split is skipped if the held study has
    none, or if fewer than `inner` other studies overlap once the held study's subjects are purged from them.
    """
    r = df.select(F.col(study).alias("s"), F.col(subject).alias("u"), F.col(member).alias("m"), F.col(member).isin(panel).alias("hit"))
    studies = r.groupBy("s").agg(F.count_distinct(F.when(F.col("hit"), F.col("m"))).alias("validation_members"))
    # A subject's rows count for the studies that it is in; it is purged where it is in the held one.
    pairs = r.where("hit").select("s", "u").distinct()
    where = r.select(F.col("s").alias("held"), F.col("u").alias("v")).distinct()
    support = pairs.groupBy("s").agg(F.count("*").alias("subjects"))
    shared = pairs.join(where, F.col("u") == F.col("v")).where("s <> held").groupBy("s", "held").agg(F.count("*").alias("purged"))
    held = studies.select(F.col("s").alias("h"), "validation_members")
    # one row a pair of studies
    cells = held.join(small(support), F.col("h") != F.col("s"), "left")
    cells = cells.join(shared.withColumnRenamed("s", "s2"), (F.col("s") == F.col("s2")) & (F.col("h") == F.col("held")), "left")
    left = F.coalesce("subjects", F.lit(0)) - F.coalesce("purged", F.lit(0))
    g = cells.groupBy("h", "validation_members").agg(F.count_if(left > 0).alias("training_studies"))
    reason = F.when(F.col("validation_members") == 0, "zero_panel_overlap").when(F.col("training_studies") < inner, "too_few_training_studies")
    return g.select(F.col("h").alias("held"), "validation_members", "training_studies", reason.alias("skipped"))


def unique_detections(df: DataFrame, names: list[str]) -> DataFrame:
    """Name, hits, unique_hits: rows that a detector marks, and those that no other one does."""
    one = df.agg(*[c for n in names for c in (F.count_if(n).alias(f"h_{n}"), F.count_if(F.col(n) & ~reduce(lambda a, b: a | b, [F.col(o) for o in names if o != n])).alias(f"u_{n}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"h_{n}").alias("hits"), F.col(f"u_{n}").alias("unique_hits")) for n in names])))


def level_distances(df: DataFrame, side: Column, columns: list[str]) -> DataFrame:
    """column, tv, unseen_levels, unseen_rows, rows: of side true (source) against false (held); null is a level."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("\x1e")).alias("level")) for c in columns])
    n = df.select(side.alias("side"), F.explode(cells).alias("x")).groupBy("x.column", "x.level").agg(F.count_if("side").alias("a"), F.count_if(~F.col("side")).alias("b"))
    totals = n.groupBy(F.col("column").alias("_c")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    n = n.join(F.broadcast(totals), F.col("column") == F.col("_c"))  # one row a column
    part = F.abs(F.col("a") / F.nullif("ta", F.lit(0)) - F.col("b") / F.nullif("tb", F.lit(0)))
    new = (F.col("a") == 0) & (F.col("b") > 0)
    return n.groupBy("column").agg((0.5 * F.sum(part)).alias("tv"), F.count_if(new).alias("unseen_levels"), F.sum(F.when(new, F.col("b")).otherwise(0)).alias("unseen_rows"), F.max("tb").alias("rows"))


def shift_audit(df: DataFrame, side: Column, numeric: list[str], categorical: list[str], epsilon: float = 1e-12) -> DataFrame:
    """One row: how the held rows (side false) differ from the source's (side true), without labels.

    features, usable, unavailable, zero_iqr; mean_shift and p90_shift of the held medians in the source's
    interquartile ranges (a range of zero counts as epsilon); mean_missing_delta; unseen_levels,
    unseen_fraction, mean_tv and max_tv of the categorical columns.
    """
    d = df.withColumn("_side", side)
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    of = lambda c, which: F.when(F.col("_side") == which, clean(c))
    missing = lambda c, which: F.avg(F.when(F.col("_side") == which, clean(c).isNull().cast("double")))
    cells = []
    for c in numeric:
        q = F.percentile(of(c, True), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        cells.append(F.struct(q.alias("q"), F.percentile(of(c, False), F.lit(0.5)).alias("held"), F.abs(missing(c, True) - missing(c, False)).alias("gap")))
    one = d.agg(F.array(*cells).alias("n"))
    iqr = lambda x: x["q"][2] - x["q"][0]
    known = F.filter("n", lambda x: x["q"].isNotNull() & x["held"].isNotNull())
    shifts = F.array_sort(F.transform(known, lambda x: F.abs(x["held"] - x["q"][1]) / F.when(iqr(x) <= epsilon, epsilon).otherwise(iqr(x))))
    one = one.select("n", known.alias("k"), shifts.alias("s"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    at = F.lit(0.9) * (F.size("s") - 1)
    low, high = F.get("s", F.floor(at).cast("int")), F.get("s", F.ceil(at).cast("int"))
    one = one.select(
        F.size("n").cast("long").alias("features"),
        F.size("k").cast("long").alias("usable"),
        (F.size("n") - F.size("k")).cast("long").alias("unavailable"),
        F.size(F.filter("k", lambda x: iqr(x) <= epsilon)).cast("long").alias("zero_iqr"),
        mean(F.col("s")).alias("mean_shift"),
        (low + (at - F.floor(at)) * (high - low)).alias("p90_shift"),
        mean(F.transform("n", lambda x: F.coalesce(x["gap"], F.lit(0.0)))).alias("mean_missing_delta"),
    )
    lv = level_distances(d, F.col("_side"), categorical).agg(
        F.sum("unseen_levels").alias("unseen_levels"), (F.sum("unseen_rows") / F.nullif(F.sum("rows"), F.lit(0))).alias("unseen_fraction"), F.avg("tv").alias("mean_tv"), F.max("tv").alias("max_tv")
    )
    return one.crossJoin(F.broadcast(lv))  # one row and one row


def study_distances(df: DataFrame, study: str, assays: list[str], age: str, categorical: list[str]) -> DataFrame:
    """A, b, location, missingness, age, categorical, distance for each pair of studies, a < b.

    location: mean over the assays of |difference of medians| over a's interquartile range (1.4826 MAD where that is
    zero), at most 1; missingness: mean |difference of the shares of nulls|; age: the mean of both for the
    age; categorical: mean total variation, null being a level.  Equal weights; what isn't defined is left out.
    """
    from pyspark.sql import Window as W

    cols = [*assays, age]
    q = df.groupBy(study).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{c}") for c in cols], *[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in cols])
    q = small(q)  # one row a study
    off = df.join(q, study).groupBy(study).agg(*[F.percentile(F.abs(F.col(c) - F.col(f"q_{c}")[1]), F.lit(0.5)).alias(f"d_{c}") for c in cols])
    s = q.join(off, study)

    def scale(c: str) -> Column:
        iqr = F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]
        return F.when(iqr > 1e-12, iqr).when(F.col(f"d_{c}") > 1e-12, 1.4826 * F.col(f"d_{c}"))

    s = s.select(F.col(study).alias("s"), *[x for c in cols for x in (F.col(f"q_{c}")[1].alias(f"med_{c}"), scale(c).alias(f"scale_{c}"), F.col(f"m_{c}"))])
    side = lambda m: s.select(*[F.col(c).alias(f"{m}_{c}") for c in s.columns])
    pairs = side("a").join(side("b"), F.col("a_s") < F.col("b_s"))

    def known_mean(parts: list[Column]) -> Column:
        a = F.filter(F.array(*parts), lambda x: x.isNotNull())
        return F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(a), F.lit(0))

    near = lambda c: F.least(F.lit(1.0), F.abs(F.col(f"a_med_{c}") - F.col(f"b_med_{c}")) / F.col(f"a_scale_{c}"))
    # least() skips nulls: without a median or a scale there is no location
    location = lambda c: F.when(F.col(f"a_med_{c}").isNotNull() & F.col(f"b_med_{c}").isNotNull() & F.col(f"a_scale_{c}").isNotNull(), near(c))
    gap = lambda c: F.abs(F.col(f"a_m_{c}") - F.col(f"b_m_{c}"))
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("\x1e")).alias("l")) for c in categorical])
    p = df.select(F.col(study).alias("s"), F.explode(cells).alias("x")).groupBy("s", "x.c", "x.l").agg(F.count("*").alias("n"))
    p = p.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("s", "c")))  # levels of one column and study
    one, two = p.select(F.col("s").alias("sa"), "c", "l", F.col("p").alias("pa")), p.select(F.col("s").alias("sb"), "c", "l", F.col("p").alias("pb"))
    # 0.5 sum |pa - pb| = 1 - sum min(pa, pb)
    both = one.join(two, ["c", "l"]).where("sa < sb").groupBy("sa", "sb").agg(F.sum(F.least("pa", "pb")).alias("common"))
    out = pairs.join(both, (F.col("a_s") == F.col("sa")) & (F.col("b_s") == F.col("sb")), "left")
    out = out.select(
        F.col("a_s").alias("a"),
        F.col("b_s").alias("b"),
        known_mean([location(c) for c in assays]).alias("location"),
        known_mean([gap(c) for c in assays]).alias("missingness"),
        known_mean([location(age), gap(age)]).alias("age"),
        (1 - F.coalesce("common", F.lit(0.0)) / len(categorical)).alias("categorical"),
    )
    return out.withColumn("distance", known_mean([F.col(c) for c in ("location", "missingness", "age", "categorical")]))
