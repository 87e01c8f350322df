"""Aggregations of long measurement tables (inventory 2.5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import BASELINE
from tessera.operators.contracts import require


def geometric_mean(c: Column, nulls: bool = True) -> Column:
    """A5: exp(mean(ln x)) of a group's values; null if any of them is not positive.

    nulls: whether null values are left out; if not, a null makes the result null, too.  Use
    require_positive() where a value that is not positive must stop the job.
    """
    fits = c > 0 if nulls else F.coalesce(c > 0, F.lit(False))
    return F.when(F.bool_and(fits), F.exp(F.avg(F.ln(F.when(c > 0, c)))))


def log_ratio(a: Column, b: Column, log=F.ln) -> Column:  # noqa: ANN001
    """log(a / b) as floating point has it, for every pair of doubles: x / 0 is infinite, 0 / 0 and negative ratios are NaN, log 0 is minus infinity."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    ratio = F.when(b != 0, a / b).when(a.isNull() | b.isNull(), None).when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(ratio == 0, -inf).when(ratio < 0, nan).otherwise(log(ratio))


def require_positive(df: DataFrame, value: str) -> DataFrame:
    """A5's contract: no value is 0 or less (nulls pass); raises the number of rows that are, else returns df."""
    n = df.agg(F.count_if(F.col(value) <= 0)).first()[0]
    require(n == 0, "not_positive", f"{n} values of {value}")
    return df


def prioritised_baseline(df: DataFrame, keys: list[str], out: str = "baseline") -> DataFrame:
    """A3: mean of the `Pre-vacc` rows of a key, else of its rows at day 0 or before, else no row.

    Both means come from one pass over the data.
    """
    number = F.col("timepoint").try_cast("double")
    literal = F.avg(F.when(F.col("timepoint") == BASELINE, F.col("value")))
    early = F.avg(F.when(number <= 0, F.col("value")))
    return df.groupBy(*keys).agg(F.coalesce(literal, early).alias(out)).where(F.col(out).isNotNull())


def prioritised_baseline_by_anti_join(df: DataFrame, keys: list[str], out: str = "baseline") -> DataFrame:
    """A3 as the union of the literal rows' means and of those of keys without any."""
    literal = df.where(F.col("timepoint") == BASELINE).groupBy(*keys).agg(F.avg("value").alias(out))
    early = df.where(F.col("timepoint").try_cast("double") <= 0).groupBy(*keys).agg(F.avg("value").alias(out))
    return literal.unionByName(early.join(literal.select(*keys), keys, "left_anti"))


def baseline_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """A4: the literal baseline rows of a key if it has any, else its rows at day 0 or before."""
    from pyspark.sql import Window as W

    literal = F.col("timepoint") == BASELINE
    has = F.max(literal.cast("int")).over(W.partitionBy(*keys))
    early = F.coalesce(F.col("timepoint").try_cast("double") <= 0, F.lit(False))
    return df.withColumn("_has", has).where(F.when(F.col("_has") == 1, literal).otherwise(early)).drop("_has")


def complete_panel(df: DataFrame, entity: list[str], item: str, value: str, items: list[str]) -> DataFrame:
    """Geometric mean of the entities that have every item of the panel; null if an item's is null."""
    some = df.where(F.col(item).isin(items)).groupBy(*entity, item).agg(geometric_mean(F.col(value)).alias("_v"))
    whole = some.groupBy(*entity).agg(F.count_distinct(item).alias("_n"), geometric_mean(F.col("_v"), nulls=False).alias("panel_gm"))
    return whole.where(F.col("_n") == len(items)).drop("_n")


def group_panel(df: DataFrame, group: str, entity: str, item: str, value: str) -> DataFrame:
    """As A7, with the panel of a group being all items that occur in it."""
    panel = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("_panel"))
    each = df.groupBy(group, entity, item).agg(F.avg(value).alias("_v"))
    mine = each.groupBy(group, entity).agg(
        F.array_sort(F.collect_set(item)).alias("_mine"),
        geometric_mean(F.col("_v")).alias("gm"),
        F.avg("_v").alias("mean"),
        F.stddev_pop("_v").alias("sd"),
    )
    return mine.join(panel, group).where(F.col("_mine") == F.col("_panel")).drop("_mine", "_panel")


def single_value(df: DataFrame, keys: list[str], signature: Column, value: str) -> DataFrame:
    """mean of a key whose rows share one signature and have values throughout; else null and a flag."""
    sig = signature.alias("_sig")
    g = df.select(*keys, sig, F.col(value).alias("_v")).groupBy(*keys)
    g = g.agg(
        F.count_distinct("_sig").alias("signatures"),
        F.bool_and(F.col("_sig").isNotNull() & F.col("_v").isNotNull()).alias("_whole"),
        F.avg("_v").alias("_mean"),
    )
    ok = (F.col("signatures") == 1) & F.col("_whole")
    return g.select(*keys, "signatures", F.when(ok, F.col("_mean")).alias("value"), (~ok).alias("conflict"))


def compatibility(df: DataFrame, levels: dict[str, Column], subject: str, study: str, reference, target, least: int) -> DataFrame:  # noqa: ANN001
    """level, reference_defined, compatible, meets_minimum for each level of strictness.

    levels: a row's metadata signature by level; null ones are ignored.  A subject of a study has a
    signature if all its rows agree; the reference study has one if all its subjects have the same.
    compatible counts the target study's subjects with that one.  Rows become one minimum and maximum a
    subject and level before anything is joined.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("level"), s.cast("string").alias("s")) for n, s in levels.items()])
    r = df.select(F.col(subject).alias("_subject"), F.col(study).alias("_study"), F.explode(rows).alias("x"))
    p = r.groupBy("x.level", "_subject", "_study").agg(F.min("x.s").alias("low"), F.max("x.s").alias("high"))
    of = lambda which, c: F.when(F.col("_study").eqNullSafe(F.lit(which)), c)
    own = p.groupBy("level").agg(
        F.min(of(reference, F.col("low"))).alias("low"),
        F.max(of(reference, F.col("high"))).alias("high"),
    )
    wanted = own.select(F.col("level").alias("_level"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("wanted"))
    p = p.join(F.broadcast(wanted), F.col("level") == F.col("_level"))  # one row a level
    hit = F.count_if(of(target, (F.col("low") == F.col("high")) & (F.col("low") == F.col("wanted"))))
    g = p.groupBy("level").agg(F.max(F.col("wanted").isNotNull()).alias("reference_defined"), hit.alias("compatible"))
    return g.withColumn("meets_minimum", F.col("compatible") >= least)
