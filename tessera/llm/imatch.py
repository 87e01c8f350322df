"""I-Match fingerprints: hashes of a text's distinct terms of medium document frequency.

The lexicon holds the terms whose inverse document frequency lies in a band.  A fingerprint hashes a
text's lexicon terms, sorted, once over the whole lexicon and once over each of a number of random
subsets of it: for each of several seeds, which are independent, and each of several rates.  They are
the same for all texts.  Texts that differ in some terms still agree on the subsets that hold none of
these.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import Scratch, checked_broadcast

SEEDS = 12  # randomised lexicons of each rate
RATES = (2, 4, 6, 8, 10)  # a term is in a lexicon with a chance of 1 in 2 to this power
FIELD = 10  # bits of a term's hash that one seed uses; a 64-bit hash serves 6 seeds
EMPTY = "----"  # a subset without a term of the text
SHELVES = 1 << 15  # of the lexicon, by term hash
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # after lower-casing


def term_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of a text's words; null: none."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")
    hashes = F.array_distinct(F.transform(F.split(flat, " "), lambda w: F.xxhash64(w)))
    return F.array_sort(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def lexicon(docs: DataFrame, commonest: float = 0.25, rarest: float = 1 / 512) -> DataFrame:
    """Hashes (h) of the terms that occur in a share of all documents between rarest and commonest.

    At most (mean number of distinct terms of a document) / rarest terms can be that frequent, however
    many documents there are; that bounds the lexicon.
    """
    total = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return terms.where((F.col("df") >= rarest * total) & (F.col("df") <= commonest * total)).select("h")


def shelved(lex: DataFrame) -> DataFrame:
    """The lexicon as one row: an array of SHELVES arrays of hashes."""
    spark = lex.sparkSession
    shelf = lex.groupBy(F.pmod("h", F.lit(SHELVES)).alias("i")).agg(F.collect_list("h").alias("hs"))
    every = spark.range(SHELVES).select(F.col("id").alias("i")).join(shelf, "i", "left")
    every = every.select(F.struct("i", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs")).alias("s"))
    return every.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["hs"]).alias("lexicon"))


def with_fingerprint(df: DataFrame, text: str, name: str, shelves: DataFrame) -> DataFrame:
    """Adds name: struct(whole, subsets).

    whole hashes all lexicon terms (of a text with none of them: all its terms); subsets has, for each
    rate, the hashes of the terms in each seed's subset (16 bits; EMPTY for none).
    """
    # The lexicon enters as a scalar subquery.  It is referenced once, by the next projection, so the
    # optimizer merges the two and no row ever carries it.
    cols = df.columns
    df = df.select(*cols, term_hashes(F.col(text)).alias("_all"))
    df = df.select(*cols, "_all", shelves.scalar().alias("_lexicon"))
    inside = F.filter("_all", lambda h: F.array_contains(F.get(F.col("_lexicon"), F.pmod(h, F.lit(SHELVES)).cast("int")), h))
    df = df.select(*cols, "_all", inside.alias("_in"))
    df = df.withColumn("_t", F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.col("_all")))

    # A term is in a seed's subset if the last bits of the seed's field of its hash are zero.  Fields of
    # seed m are cut from the hash with seed m div 6.  Subsets of lower rates are cut from those of higher.
    def member(seed: int, rate: int) -> str:
        of = "h" if seed < 6 else f"xxhash64(h, {seed // 6})"
        mask = ((1 << rate) - 1) << (seed % 6 * FIELD)
        return f"({of} & {mask}L) = 0L"

    last = "_t"
    for k, rate in enumerate(RATES):
        cut = [f"filter({last if k == 0 else f'get({last}, {m})'}, h -> {member(m, rate)})" for m in range(SEEDS)]
        # Each is named twice, here and for its hashes, so the optimizer keeps it as a column and does not
        # compute it anew.
        df = df.withColumn(f"_c{k}", F.expr(f"array({', '.join(cut)})"))
        last = f"_c{k}"

    def hashed(col: str) -> Column:
        return F.expr(f"transform({col}, a -> if(size(a) = 0, '{EMPTY}', lower(lpad(hex(xxhash64(a) & 65535), 4, '0'))))")

    whole = F.when(F.size("_t") > 0, F.lower(F.lpad(F.hex(F.xxhash64("_t")), 16, "0"))).otherwise("")
    subsets = F.array(*[hashed(f"_c{k}") for k in range(len(RATES))])
    df = df.withColumn(name, F.struct(whole.alias("whole"), subsets.alias("subsets")))
    return df.drop("_all", "_in", "_t", *[f"_c{k}" for k in range(len(RATES))])


def as_string(fp: Column) -> Column:
    return F.concat_ws("|", fp["whole"], F.array_join(F.transform(fp["subsets"], lambda s: F.array_join(s, "")), "|"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets, not empty on both sides, on which two fingerprints agree; equal: 1.

    It is taken over the lower rates, from the lowest one on at which half of the seeds or more have a
    term of either text (over all rates if there is none); so it is about the share of common terms.
    """

    def counts(x: Column, y: Column) -> Column:
        both = F.zip_with(x, y, lambda p, q: F.when((p == EMPTY) & (q == EMPTY), 0).when(p == q, 1).otherwise(2))
        start = F.struct(F.lit(0).alias("agree"), F.lit(0).alias("some"))
        return F.aggregate(both, start, lambda s, v: F.struct((s["agree"] + (v == 1).cast("int")).alias("agree"), (s["some"] + (v > 0).cast("int")).alias("some")))

    def add(s: Column, x: Column) -> Column:
        agree, some = F.when(s["done"], 0).otherwise(x["agree"]), F.when(s["done"], 0).otherwise(x["some"])
        done = s["done"] | (x["some"] * 2 >= SEEDS)
        return F.struct((s["agree"] + agree).alias("agree"), (s["some"] + some).alias("some"), done.alias("done"))

    each = F.zip_with(F.reverse(a["subsets"]), F.reverse(b["subsets"]), counts)  # from the lowest rate on
    start = F.struct(F.lit(0).alias("agree"), F.lit(0).alias("some"), F.lit(False).alias("done"))
    share = F.aggregate(each, start, add, lambda s: s["agree"] / F.greatest(s["some"], F.lit(1)))
    same, none = a["whole"] == b["whole"], (a["whole"] == "") | (b["whole"] == "")
    return F.when(same, 1.0).when(none, 0.0).otherwise(share).cast("double")


def in_order(docs: DataFrame, rows_each: int = 1000) -> DataFrame:
    """doc_id, text, _h, _bucket, _extra: rows dealt into stretches of about rows_each rows in ascending order.

    The order is that of ids, nulls last; equal ids are in the order of their texts' hashes (_h).  Each
    stretch ends with an extra copy of the row that follows it (after the last: the first), so that a
    window over one stretch sees every row's successor.  Stretches are cut in two steps, at quantiles of
    the ids and, inside each range, at its own quantiles; a range of one id alone (a repeated or the null
    one) is cut by the hashes.  So no stretch grows with the table, nor with the rows of one id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "order")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    parts = -(-rows.count() // rows_each)
    wide = max(1, math.ceil(math.sqrt(parts)))
    share = [i / wide for i in range(1, wide)]

    def quantiles(c: Column | str) -> Column:
        return F.percentile_approx(c, share, 100 * wide) if share else F.array().cast("array<bigint>")

    found = rows.agg(quantiles("doc_id").alias("q")).first()["q"] or []  # wide numbers
    twice = {q for q, n in Counter(found).items() if n > 1 and q < (1 << 63) - 1}
    cuts = sorted(set(found) | {q + 1 for q in twice})  # an id that fills more than a range has one of its own
    cut = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    first = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(cut, lambda c: c <= F.col("doc_id"))))
    rows = rows.withColumn("_range", first)
    inner = rows.groupBy("_range").agg(
        (F.coalesce(F.min("doc_id"), F.lit(0)) == F.coalesce(F.max("doc_id"), F.lit(0))).alias("alone"), quantiles("doc_id").alias("ids"), quantiles("_h").alias("hashes")
    )
    none = F.array().cast("array<bigint>")
    inner = inner.select("_range", "alone", F.coalesce(F.when(F.col("alone"), F.col("hashes")).otherwise(F.col("ids")), none).alias("cuts"))
    # One row: the cuts of each range, at most (wide + 2) x wide numbers.
    places = spark.range(len(cuts) + 2).select(F.col("id").cast("int").alias("_range")).join(inner, "_range", "left")
    places = places.select(F.struct("_range", F.coalesce("alone", F.lit(True)).alias("alone"), F.coalesce("cuts", none).alias("cuts")).alias("s"))
    places = scratch.write(places.agg(F.array_sort(F.collect_list("s")).alias("places")))
    rows = rows.select("*", F.get(places.scalar(), F.col("_range")).alias("_place"))
    value = F.when(F.col("_place.alone"), F.col("_h")).otherwise(F.col("doc_id"))
    rows = rows.withColumn("_value", value)
    second = F.size(F.filter("_place.cuts", lambda c: c <= F.col("_value")))
    rows = rows.select("doc_id", "text", "_h", (F.col("_range") * F.lit(1 << 20) + second).cast("long").alias("_bucket"))
    least = F.min(F.struct("doc_id", "_h"))
    heads = rows.groupBy("_bucket").agg(least.alias("head"))  # one row a stretch
    by = W.orderBy("_bucket")
    heads = heads.select("head", F.coalesce(F.lag("_bucket").over(by), F.max("_bucket").over(W.partitionBy())).alias("_ends"))
    heads = scratch.write(heads.select(F.col("head.doc_id").alias("_d"), F.col("head._h").alias("_k"), "_ends"))
    extra = rows.join(checked_broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")))
    extra = extra.groupBy("doc_id", "_h", "_ends").agg(F.first("text").alias("text"))
    extra = extra.select("doc_id", "text", "_h", F.col("_ends").alias("_bucket"), F.lit(1).alias("_extra"))
    return rows.withColumn("_extra", F.lit(0)).unionByName(extra)


def fingerprints(docs: DataFrame, commonest: float = 0.25, rarest: float = 1 / 512) -> DataFrame:
    """doc_id, fingerprint (string) for every row; equal texts have equal fingerprints."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shelves = Scratch(docs.sparkSession, "imatch").write(shelved(lexicon(rows, commonest, rarest)))
    return with_fingerprint(rows, "text", "_fp", shelves).select("doc_id", as_string(F.col("_fp")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, commonest: float = 0.25, rarest: float = 1 / 512) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    Of n_chars code points the last quarter (rounded down) is replaced by as many first ones of the
    next document in the order of ids (nulls last; equal ids by their texts' hashes, so repeated rows
    follow each other).  A null text counts as empty; an empty one has the fingerprint without terms.  A
    text without lexicon terms is fingerprinted by all its terms.  An empty table gives an empty
    result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "imatch")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shelves = scratch.write(shelved(lexicon(rows, commonest, rarest)))
    by = W.partitionBy("_bucket").orderBy("_extra", F.col("doc_id").asc_nulls_last(), "_h")
    near = in_order(docs).withColumn("_next", F.lead("text").over(by))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    near = near.withColumn("n_chars", n.cast("long"))
    near = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), k)))
    near = with_fingerprint(near.drop("_next"), "text", "fp", shelves)
    near = with_fingerprint(near, "edited", "fp2", shelves)
    slim = near.select("doc_id", "_h", "_bucket", "_extra", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "fp2")
    slim = slim.withColumn("fp3", F.lead("fp").over(by)).where("_extra = 0")
    return slim.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("fp2")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp2")).alias("near_edited"),
        likeness(F.col("fp"), F.col("fp3")).alias("near_next"),
    )
