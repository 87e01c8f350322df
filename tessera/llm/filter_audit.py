"""Filter interaction audit: what each filter removes, in every order and of every subset of filters.

Each document becomes a mask of the filters that it fails, and masks are counted by part.  A subset-zeta
transform turns a part's counts into the survivors of every subset of filters; a step of an order is
then the difference between two neighbouring subsets, for all documents as for labelled ones.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: The filter that is not a condition on one text: the text stands under a smaller id as well.
COPIES = "E"


def failures() -> dict[str, Column]:
    """Conditions of failure on the columns text, n (words), distinct (words), in the order of the mask's bits."""
    text = F.col("text")
    return {
        "A": F.col("n") < 200,
        "B": 100 * F.col("distinct") < 50 * F.col("n"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failed(docs: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """doc_id, part, h (of the text), mask, rows: equal rows are counted together, before any shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    d = d.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    d = d.select("doc_id", "part", F.sha2("text", 256).alias("h"), mask.alias("mask"))
    return d.groupBy("doc_id", "part", "h", "mask").agg(F.count("*").alias("rows"))


def mask_counts(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail; the last bit is COPIES.

    A text's first id is a minimum combined before the shuffle; rows meet it by id and text together,
    and labels by id, so no key gathers a group of copies.  A row without an id is no copy and makes
    none, and has no labels.  An id with several label rows counts by its largest.
    """
    conditions = failures() if conditions is None else conditions
    scratch = Scratch(docs.sparkSession, "audit")
    rows = scratch.write(failed(docs, conditions))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"))
    first = first.where("first is not null").select(F.col("h").alias("_h"), "first")
    lab = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_d"))
    lab = lab.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without an id would meet in one task of a join, where they find nothing: they go beside it.
    known = rows.where("doc_id is not null")
    known = known.join(lab, F.col("doc_id") == F.col("_d"), "left").join(first, (F.col("doc_id") == F.col("first")) & (F.col("h") == F.col("_h")), "left")
    bit = F.when(F.col("first").isNull(), 1 << len(conditions)).otherwise(0)
    known = known.select("part", (F.col("mask") + bit).alias("mask"), "rows", "good", "toxic")
    none = F.lit(None).cast("boolean")
    every = known.unionByName(rows.where("doc_id is null").select("part", "mask", "rows", none.alias("good"), none.alias("toxic")))
    weight = lambda c: F.sum(F.when(F.col(c), F.col("rows")).otherwise(0))
    return every.groupBy("part", "mask").agg(F.sum("rows").alias("n"), weight("good").alias("good"), weight("toxic").alias("toxic"))


KINDS = ("n", "good", "toxic")


def survivors(parts: DataFrame, k: int) -> DataFrame:
    """part, left: for every subset of k filters (its place in the array) the n, good and toxic that survive it.

    parts: mask_counts().  Zeta: one pass for each filter makes of the counts by failed mask the sums over all
    masks inside a set; a subset's survivors fail nothing but filters outside it.
    """
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*KINDS))))  # 2^k cells at most
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in KINDS])
    z = parts.groupBy("part").agg(cells.alias("cells"))
    z = z.select("part", F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: F.coalesce(F.try_element_at("cells", m), none)).alias("z"))
    for bit in (1 << i for i in range(k)):

        def add(x: Column, m: Column) -> Column:
            other = F.get("z", m - bit)  # noqa: B023  (called in this turn of the loop)
            return F.when(m.bitwiseAND(F.lit(bit)) > 0, F.struct(*[(x[c] + other[c]).alias(c) for c in KINDS])).otherwise(x)  # noqa: B023

        z = z.select("part", F.transform("z", add).alias("z"))
    return z.select("part", F.reverse("z").alias("left"))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every step of every order of the filters, for every part.  A null text is an empty one and a null
    source the part of the empty string.  Equal texts are copies of the smallest id's (rows that repeat
    it included are not); a row without an id is neither.  An empty table gives an empty result; other
    columns of both tables are ignored.  The transform sees one row a part, so its work grows with the
    parts and not with the documents.
    """
    conditions = failures() if conditions is None else conditions
    letters = "".join(conditions) + COPIES
    k, full = len(letters), (1 << len(letters)) - 1
    at = lambda subset, kind="n": F.get("left", subset)[kind]
    left = survivors(mask_counts(docs, labels, conditions), k)

    def all_orders(i: int) -> Column:
        """A filter's removals summed over all orders: each set before it stands in so many of them."""
        before = [s for s in range(full + 1) if not s >> i & 1]
        orders = {s: factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in before}
        return sum((F.lit(orders[s]) * (at(F.lit(s)) - at(F.lit(s | 1 << i))) for s in before), F.lit(0))

    left = left.select("part", "left", F.array(*[all_orders(i) for i in range(k)]).alias("shapley"))
    steps = []
    for p in permutations(range(k)):
        done = 0
        for step, i in enumerate(p):
            steps.append(F.struct(F.lit("".join(letters[j] for j in p)).alias("filter_order"), F.lit(step + 1).alias("step"), F.lit(i).alias("i"), F.lit(done).alias("before")))
            done |= 1 << i
    out = left.select("part", "left", "shapley", F.explode(F.array(*steps)).alias("s")).select("part", "left", "shapley", "s.*")
    own = F.get(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("i"))
    out = out.withColumn("own", own).withColumn("after", F.col("before") + F.col("own"))
    lost = lambda kind: at(F.col("before"), kind) - at(F.col("after"), kind)
    return out.select(
        "part",
        "filter_order",
        "step",
        at(F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (at(F.lit(0)) - at(F.col("own")) - lost("n")).alias("redundant"),
        (at(full - F.col("own")) - at(F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("i")).alias("shapley"),
    )
