"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled, are cut into blocks of equal words.  Slots carry the points of the golden-ratio
sequence; a slot goes to the source whose stretch of the cumulative weights, in blocks, holds its
point.  Slots of a source are ranked, and slot r takes block r (modulo the source's blocks).  What a
source gives is what its slots take: a few blocks more or less than its target.  Blocks of small
sources are therefore short, a thousandth of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import Scratch, checked_broadcast, fresh, prefix_within

GOLDEN = 0.6180339887498949
BLOCK = 512  # words, at most
BLOCKS = 1024  # of a source, at least, as far as it has as many words
MOST = 3  # times that a word may be taken
SPACE = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{SPACE}]+"))).cast("long")


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target of every source of rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3 and so on again, and share all words; no target
    exceeds MOST times its source.  The fixed point of resharing the excess is min(level * weight,
    cap) with one level for all: in order of cap / weight, the level that remains for a source and the
    later ones is highest at the first source that it leaves below its cap.  One row per source.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("weight", ((rank - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(MOST))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    level = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(every)
    target = F.least(F.coalesce(level * F.col("weight"), F.col("cap")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def goals(rows: DataFrame, block: int) -> DataFrame:
    """targets() with length (words of a block), blocks and need (blocks that the target amounts to, a double).  One row per source."""
    g = targets(rows).withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {BLOCKS}"))).cast("long"))
    g = g.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    return g.withColumn("need", F.col("target") / F.greatest("source_size", F.lit(1)) * F.col("blocks"))


def slots(goal: DataFrame, step: float = GOLDEN) -> DataFrame:
    """id, source, rank: the schedule's slots in order; rank counts the slots of a source from 0.

    goal: a written table of goals(); step: slot i has the point i * step modulo 1.  Points are looked up
    in a grid, so the number of sources, whose stretches may be many in one cell, is not limited; the
    grid is broadcast only if it is small.
    """
    spark = goal.sparkSession
    some = goal.select("source", "need").where("need > 0")
    total, count = some.agg(F.coalesce(F.sum("need"), F.lit(0.0)), F.count("*")).first()
    by = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.sum("need").over(by)
    last = F.row_number().over(by) == count
    ends = some.withColumn("hi", F.when(last, 1.0).otherwise(upto / F.lit(total or 1.0))).withColumn("lo", F.lag("hi", 1, 0.0).over(W.orderBy(F.col("source").asc_nulls_last())))
    cells = max(64, 2 * count)
    grid = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    grid = grid.select("source", "lo", "hi", "cell")
    i = F.col("id")
    point = i * F.lit(step) - F.floor(i * F.lit(step))
    at = spark.range(0, round(total)).select(i, F.floor(i / F.lit(65536)).alias("chunk"), point.alias("u"))
    at = at.withColumn("cell", F.floor(F.col("u") * cells)).join(checked_broadcast(grid, 100_000), "cell").where("u >= lo and u < hi")
    at = at.select("id", "chunk", "source", F.lit(1).alias("one"))
    return prefix_within(at, ["source"], "chunk", ["id"], "one", "rank").select("id", "source", "rank")


def schedule(goal: DataFrame, step: float = GOLDEN) -> DataFrame:
    """source, block, uses: how many slots take each block of each source; none is taken over MOST times."""
    g = goal.select(F.col("source").alias("s"), "blocks")
    ranked = slots(goal, step).join(checked_broadcast(g, 100_000), F.col("source").eqNullSafe(F.col("s"))).where(F.col("rank") < MOST * F.col("blocks"))
    return ranked.groupBy("source", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))


def mix_rows(docs: DataFrame, block: int = BLOCK, rows_each: int = 4096, step: float = GOLDEN) -> DataFrame:
    """doc_id, source, h, size, source_size, target, taken for every row of docs (doc_id, text, source); h hashes the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string"), F.xxhash64(text).alias("h"), word_count(text).alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = scratch.write(rows.withColumn("key", key))
    goal = scratch.write(goals(rows, block))
    parts = max(1, -(-rows.count() // rows_each))
    # Copies of one id (or of the null one) are dealt by their texts, too.
    slot = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(parts)
    some = rows.where("size > 0").withColumn("bucket", F.shiftright(slot, 32))
    some = some.withColumn("bucket", F.when(F.col("doc_id").isNull(), parts + F.pmod(F.xxhash64("h"), F.lit(parts))).otherwise(F.col("bucket")))
    placed = prefix_within(some, ["source"], "bucket", ["key", "doc_id", "h"], "size", "start")
    placed = scratch.write(placed.drop("key", "bucket"))
    length = checked_broadcast(goal.select(F.col("source").alias("s"), "length"), 100_000)
    pieces = placed.join(length, F.col("source").eqNullSafe(F.col("s"))).withColumn("end", F.col("start") + F.col("size"))
    pieces = pieces.select("source", "start", "end", "length", F.explode(F.sequence(F.expr("start div length"), F.expr("(end - 1) div length"))).alias("block"))
    words = F.least("end", (F.col("block") + 1) * F.col("length")) - F.greatest("start", F.col("block") * F.col("length"))
    pieces = pieces.select("source", "start", "block", words.alias("words"))
    u = schedule(goal, step).select(F.col("source").alias("s"), F.col("block").alias("b"), "uses")
    got = pieces.join(u, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    got = got.groupBy(F.col("source").alias("s"), F.col("start").alias("from")).agg(F.sum(F.col("words") * F.col("uses")).alias("got"))
    out = placed.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("from")), "left")
    out = out.select("doc_id", "source", "h", "size", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    out = out.unionByName(rows.where("size = 0").select("doc_id", "source", "h", "size", F.lit(0).cast("long").alias("taken")))
    g = checked_broadcast(goal.select(F.col("source").alias("s"), "source_size", "target"), 100_000)
    return out.join(g, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "h", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK, step: float = GOLDEN) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source).

    taken counts words with repeats, at most MOST times the document's size.  A null, empty or blank
    text has size 0 and takes nothing; null sources form a source of their own.  Repeated rows each
    have a place in the order; equal rows may swap theirs.  An empty table gives an empty result.
    The order of a source's documents is that of md5(doc_id), rows without an id last, so reruns agree.
    A source takes its target to within a few blocks, as its slots fall.  Extra columns are ignored.
    """
    return mix_rows(docs, block, step=step).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken.

    A document taken n times in whole comes n times; where the mix ends inside a document, one more
    row holds its first words only, joined by spaces (n_chars is set to what is left).
    """
    cols = docs.columns
    n, k, h, t, got = (fresh(docs, c) for c in ("size", "place", "hash", "turn", "taken"))
    same = W.partitionBy("doc_id", "source", h)
    left = docs.withColumn(n, word_count(F.col("text"))).withColumn(h, F.xxhash64(F.col("text").cast("string")))
    left = left.withColumn(k, F.row_number().over(same.orderBy(n)))
    right = mix_rows(docs, block).where("taken > 0").select(F.col("doc_id").alias("r_id"), F.col("source").alias("r_source"), F.col("h").alias("r_h"), F.col("taken").alias("r_taken"))
    right = right.withColumn("r_k", F.row_number().over(W.partitionBy("r_id", "r_source", "r_h").orderBy("r_taken")))
    r = right.select(F.struct("r_id", "r_source", "r_h", "r_k", "r_taken").alias(fresh(docs, "r")))
    r_ = lambda c: F.col(f"{fresh(docs, 'r')}.r_{c}")
    on = F.col("doc_id").eqNullSafe(r_("id")) & F.col("source").cast("string").eqNullSafe(r_("source")) & F.col(h).eqNullSafe(r_("h")) & (F.col(k) == r_("k"))
    out = left.join(r, on).select(*cols, n, r_("taken").alias(got))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col(got) / F.col(n)).cast("int"))).alias(t))
    rest = (F.col(got) - (F.col(t) - 1) * F.col(n)).cast("int")
    bare = F.regexp_replace("text", f"^[{SPACE}]+", "")
    cut = F.array_join(F.slice(F.split(bare, f"[{SPACE}]+"), F.lit(1), F.greatest(rest, F.lit(0))), " ")
    out = out.withColumn("text", F.when(rest >= F.col(n), F.col("text")).otherwise(cut))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*cols)
