"""Row positions in a sorted table, without one big sort task (inventory J16, G6, G8 and G9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.contracts import require
from tessera.operators.joins import small
from tessera.operators.text import written


def numbered(df: DataFrame, order: list[Column | str], *group: str, out: str = "position", parts: int | None = None) -> DataFrame:
    """df with each row's place, from 0, in its group by the order; rows of equal order are in any order.

    Rows are dealt by ranges of the order; a range's rows are ranked by themselves, and the numbers of rows
    before it in each group are its offsets (a table of ranges times groups).  So a group that holds all
    rows is ranked by as many tasks as there are ranges.
    """
    spark = df.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = {f"_o{i}": (F.col(o) if isinstance(o, str) else o) for i, o in enumerate(order)}
    t = df.select("*", *[v.alias(k) for k, v in keys.items()]).repartitionByRange(parts, *keys)
    t = written(t.withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    n = t.groupBy("_part", *group).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    n = n.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_{g}_") for g in group], "_before")
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}_")) for g in group], F.col("_part") == F.col("_p"))
    here = F.row_number().over(W.partitionBy("_part", *group).orderBy(*keys)) - 1
    t = t.withColumn("_here", here).join(small(n), on)
    return t.select(*df.columns, (F.col("_here") + F.col("_before")).alias(out))


def aligned(a: DataFrame, b: DataFrame, order_a: list[Column | str], order_b: list[Column | str], same: Column) -> DataFrame:
    """The i-th row of a with the i-th of b, each in its order, with position.

    same: the identity that every pair must satisfy (of columns of both, which have distinct names).
    Raises if the numbers of rows differ or a pair fails; a comparison with a null fails, too.
    """
    left, right = numbered(a, order_a), numbered(b, order_b, out="_position")
    both = written(left.join(right, F.col("position") == F.col("_position"), "full_outer").withColumn("_same", F.coalesce(same, F.lit(False))))
    rows, bad, lone = both.agg(F.count("*"), F.count_if(~F.col("_same")), F.count_if(F.col("position").isNull() | F.col("_position").isNull())).first()
    require(not lone, "alignment", f"{lone} of {rows} positions have a row on one side only")
    require(not bad, "alignment", f"{bad} of {rows} positions differ in identity")
    return both.drop("_position", "_same")
