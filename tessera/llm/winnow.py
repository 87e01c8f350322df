"""Benchmark decontamination by winnowing: spans that documents share with test items.

Of every window of `span` words the least hash of its k-grams is its fingerprint.  Equal windows have
equal fingerprints, so every shared span of that many words is found.  Neighbouring windows mostly
share theirs: a run of such windows is looked up once, and where an item has that fingerprint the hit
is extended, window by window, by comparing the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, checked_broadcast, fresh
from tessera.llm.license_scan import grams, words_of


def minima(g: Column, width: int) -> Column:
    """The least of every `width` neighbours; fewer values: none."""
    none = F.array().cast("array<bigint>")
    if width == 1:
        return g
    at = F.sequence(F.lit(1), F.size(g) - (width - 1))
    return F.when(F.size(g) >= width, F.transform(at, lambda s: F.array_min(F.slice(g, s, width)))).otherwise(none)


def shape(length: int, k: int) -> tuple[int, int]:
    """Words of a gram and grams of a window of that many words."""
    gram = min(k, length)
    return gram, length - gram + 1


def windows(items: DataFrame, span: int, k: int) -> DataFrame:
    """length, x (the words), fp, items (sorted ids): the distinct windows of all items.

    An item of fewer than `span` words is one window of its own length, one without words has none.
    Null ids are the empty id.
    """
    i = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    i = i.where(F.size("w") > 0).withColumn("length", F.least(F.lit(span), F.size("w")))
    i = i.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("s"))
    i = i.select("item", "length", F.slice("w", F.col("s"), F.col("length")).alias("w"))
    fp = F.lit(None).cast("bigint")
    for length in range(1, span + 1):
        fp = F.when(F.col("length") == length, F.array_min(grams(F.col("w"), shape(length, k)[0]))).otherwise(fp)
    i = i.select("item", "length", F.array_join("w", " ").alias("x"), fp.alias("fp"))
    return i.groupBy("length", "x").agg(F.min("fp").alias("fp"), F.array_sort(F.collect_set("item")).alias("items"))


def runs(docs: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """doc_id, h, n_words, length, fp, lo, ctx: runs of windows with one fingerprint, and their words.

    One more row a document, with length 0, stands for itself.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.md5(text).alias("h"), words_of(text).alias("w"))
    sizes = sorted({shape(n, k)[0] for n in lengths})
    d = d.select("*", *[grams(F.col("w"), g).alias(f"g{g}") for g in sizes])
    d = d.select("doc_id", "h", "w", *[minima(F.col(f"g{g}"), m).alias(f"m{n}") for n in lengths for g, m in [shape(n, k)]])

    def starts(m: str) -> Column:
        at = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))

    d = d.select("*", *[starts(f"m{n}").alias(f"p{n}") for n in lengths])
    own = F.struct(F.lit(0).alias("length"), F.xxhash64("doc_id", "h").alias("fp"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))

    def run(n: int) -> Column:
        m, p = F.col(f"m{n}"), F.col(f"p{n}")
        last = lambda j: F.coalesce(F.get(p, j + 1), F.size(m)) - 1
        return F.transform(p, lambda i, j: F.struct(F.lit(n).alias("length"), F.get(m, i).alias("fp"), i.alias("lo"), last(j).alias("hi")))

    # Of an exploded column the planner would infer a filter and push it below, lambda by lambda; not so of an expression.
    d = d.select("doc_id", "h", "w", F.explode(F.concat(F.array(own), *[run(n) for n in lengths])).alias("r")).select("doc_id", "h", "w", "r.*")
    # What the join carries is the run's words; they are cut only where the fingerprint is found.
    ctx = F.slice("w", F.col("lo") + 1, F.when(F.col("length") == 0, 0).otherwise(F.col("hi") - F.col("lo") + F.col("length")))
    return d.select("doc_id", "h", F.size("w").alias("n_words"), "length", "fp", "lo", "hi", ctx.alias("ctx"))


def shared_windows(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """doc_id, h (of the text), n_words, start, length, x, items: every window of a document that an item has.

    One row a document with length 0 stands for itself.  The items' windows are broadcast if they are
    few; else fingerprints are shuffled with the words of their runs.  However many items share a
    fingerprint, a document's window meets one row: the windows are distinct, and compared whole.
    """
    scratch = Scratch(docs.sparkSession, "winnow")
    w = scratch.write(windows(items, span, k))
    lengths = sorted(r[0] for r in w.select("length").distinct().collect())  # `span` numbers at most
    known = w.select(F.col("length").alias("_n"), F.col("fp").alias("_fp")).distinct()
    r = runs(docs, lengths, k)
    r = r.join(checked_broadcast(known, 200_000), (F.col("length") == F.col("_n")) & (F.col("fp") == F.col("_fp")), "left")
    r = r.where("length = 0 or _n is not null").drop("_n", "_fp", "fp")
    r = r.select("doc_id", "h", "n_words", "length", "lo", "ctx", F.explode(F.sequence("lo", "hi")).alias("start"))
    x = F.array_join(F.slice("ctx", F.col("start") - F.col("lo") + 1, F.col("length")), " ")
    # a text's hash with a character that no word has: such rows meet nothing, each in a task of its own
    x = F.when(F.col("length") == 0, F.concat(F.lit("#"), "h")).otherwise(x)
    r = r.select("doc_id", "h", "n_words", "start", "length", x.alias("x"))
    w = w.select(F.col("length").alias("_n"), F.col("x").alias("_x"), "items")
    r = r.join(checked_broadcast(w, 200_000), (F.col("length") == F.col("_n")) & (F.col("x") == F.col("_x")), "left")
    return r.where("length = 0 or _n is not null").drop("_n", "_x")


def report(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items for every row of docs.

    spans: the merged stretches of hit words as (first, last).  A null or empty text has no words; null
    item ids are the empty id; items with one id are one.  Equal rows are worked on once and come back
    as often as they came.  Empty tables: no items, no hits; no documents, no rows.  Extra columns are ignored.
    What is gathered for a document is bounded by its windows.
    """
    hit = F.when(F.col("length") > 0, F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    g = shared_windows(docs, items, span, k).groupBy("doc_id", "h")
    g = g.agg(
        F.count_if(F.col("length") == 0).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.collect_set("items").alias("sets"),
    )
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def add(s: Column, x: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        joined = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(last["end"] >= x["start"], joined).otherwise(F.concat(s, F.array(x)))

    g = g.withColumn("merged", F.aggregate("hits", zero, add))
    g = g.withColumn("items", F.array_sort(F.array_distinct(F.flatten("sets"))))
    n_hit = F.aggregate("merged", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    g = g.withColumn("n_hit", n_hit).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return g.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.transform("merged", lambda x: F.struct(x["start"].alias("first"), (x["end"] - 1).alias("last"))).alias("spans"),
        "items",
    )


def decontaminated(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """The rows of docs, all columns, whose text shares no window with an item."""
    bad = shared_windows(docs, items, span, k).where("length > 0").select("doc_id", "h").distinct()
    one, two = fresh(docs, "_bad_id"), fresh(docs, "_bad_h")
    bad = bad.select(F.col("doc_id").alias(one), F.col("h").alias(two))
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(one)) & (text == F.col(two)), "left_anti")
