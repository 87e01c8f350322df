"""URL filters by a cascade of Bloom filters.

A list's keys are hosts with a path prefix.  Level 1 encodes the listed keys; level 2 the keys of
the corpus that level 1 passes though they are not listed; level 3 the listed keys that level 2
passes; and so on until a level passes nothing wrong.  The depth at which a key is first refused
tells whether it is listed, exactly for every key of the corpus, so urls are judged without a join.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, ascii_lower, checked_broadcast

# The rules (host and path).
BLOCK = ("com/en/", "example.net/de/8", "org/es/")
ALLOW = ("example.com/en/7", "net/de/")
# Hosts that the method itself blocks where no rule fits.
LISTED = tuple(
    f"{name}.example.{top}/" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")
)
HASHES = 4
SHAPES = 64  # forms of keys (host labels, length of path) that are looked up in one projection
LARGEST = 1 << 28  # bits of one level at most: 32 MB, which every executor holds; more keys are judged in parts
SHARE = 10  # bits a key, at least


Keys = tuple[str, ...] | DataFrame


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def shapes(listed: DataFrame) -> list[tuple[int, int]]:
    """The pairs of number of host labels and length of path (with its slash) that occur in a list.

    They are few whatever the list: as many as there are such pairs of small numbers.
    """
    host = F.substring_index("key", "/", 1)
    rows = listed.select(F.size(F.split(host, "\\.")).alias("labels"), (F.length("key") - F.length(host)).alias("path")).distinct()
    return sorted(tuple(r) for r in rows.collect())


def candidates(host: Column, path: Column, forms: list[tuple[int, int]]) -> list[Column]:
    """Keys that could be listed: the host's last labels with the path's first characters.

    Only the combinations of label count and path length that occur in the list can match; one
    column each, null where the url is too short.
    """
    labels = F.split(host, "\\.")
    out = []
    for count, length in forms:
        suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - count + 1, F.lit(1)), F.lit(count)), ".")
        fits = (F.size(labels) >= count) & (F.length(path) >= length)
        out.append(F.when(fits, F.concat(suffix, F.substring(path, 1, length))))
    return out


def place(key: Column, level: int, i: int, bits: int) -> Column:
    """Hash i of a key at a level: both parts are below `bits` before they are added."""
    first, step = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(-level)), F.lit(bits))
    return F.pmod(first + i * step, F.lit(bits))


def bits_for(n: int) -> int:
    """A power of two of at least SHARE bits a key."""
    return max(64, 1 << math.ceil(math.log2(max(1, n) * SHARE)))


def shard(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(parts))


def encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the filter's bits as an array of 64-bit words; its size is checked by bits_for()."""
    at = F.explode(F.array(*[place(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("at")
    words = keys.select(at).select((F.col("at") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    words = words.unionByName(keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda s: s["b"]).alias("words"))


def passes(key: Column, words: Column, level: int, bits: int) -> Column:
    out = F.lit(True)
    for i in range(HASHES):
        at = place(key, level, i, bits)
        word = F.get(words, (at / 64).cast("int"))
        out &= F.getbit(word, (at % 64).cast("int")) == 1
    return out


class Cascade:
    """Exact membership of a list, for the keys of one corpus, or for one of `parts` parts of them by hash.

    inside, outside: the corpus's keys (key) that are listed, and those that are not; a written table and
    any.  Judging needs no join.
    """

    def __init__(self, inside: DataFrame, outside: DataFrame, scratch: Scratch, part: int = 0, parts: int = 1, most: int = 40):
        self.levels: list[tuple[DataFrame, int]] = []
        self.part, self.parts = part, parts
        mine, others = (d if parts == 1 else d.where(shard(F.col("key"), parts) == part) for d in (inside, outside))
        n = mine.count()
        while n:
            level = len(self.levels) + 1
            if level > most:
                raise RuntimeError("the cascade did not close")
            bits = bits_for(n)
            words = scratch.write(encode(mine, level, bits))
            self.levels.append((words, bits))
            wrong = scratch.write(others.where(passes(F.col("key"), words.scalar(), level, bits)))
            mine, others, n = wrong, mine, wrong.count()

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is listed: an odd number of levels pass it in a row."""
        out = F.lit(False)
        for level in range(len(self.levels), 0, -1):
            words, bits = self.levels[level - 1]
            out = F.when(passes(key, words.scalar(), level, bits), ~out).otherwise(False)
        return out if self.parts == 1 else (shard(key, self.parts) == self.part) & out


def judge(pages: DataFrame, block: Keys = BLOCK, allow: Keys = ALLOW, listed: Keys = LISTED, largest: int = LARGEST) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    The three lists are tables with a column key (host and path prefix), of any size, or a few strings.
    The longest rule that fits decides (rules are distinct, so two of one length that fit one url are
    equal).  Without a rule, a url under a listed key is blocked, any other allowed.  A null url, and one
    without `://`, has an empty host and path and fits nothing.  Repeated rows are judged each; an
    empty table gives an empty result.  Extra columns are ignored.

    Filters are built once from the distinct keys that the urls could fit; a list of which more occur than
    a level of `largest` bits holds is judged in parts by hash, one after the other.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    lists = [x if isinstance(x, DataFrame) else spark.createDataFrame([(k,) for k in x], "key string") for x in (block, allow, listed)]
    lists = [x.select("key").distinct() for x in lists]
    forms = [(i, form) for i, x in enumerate(lists) for form in shapes(x)]
    groups = [forms[at : at + SHAPES] for at in range(0, len(forms), SHAPES)]

    def keys_of(group: list[tuple[int, tuple[int, int]]]) -> list[Column]:
        return [candidates(F.col("host"), F.col("path"), [form])[0].alias(f"k{j}") for j, (_, form) in enumerate(group)]

    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    if not groups:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    every = [rows.select(F.explode(F.array_compact(F.array(*keys_of(g)))).alias("key")) for g in groups]
    universe = scratch.write(reduce(DataFrame.union, every).distinct())
    inside, outside, parts = [], [], 1
    for x in lists:
        keys = checked_broadcast(x)
        inside.append(scratch.write(universe.join(keys, "key", "left_semi")))
        outside.append(universe.join(keys, "key", "left_anti"))
        parts = max(parts, -(-inside[-1].count() * SHARE // largest))
    done = rows.select("page_id", "host", "path", none.alias("best"), F.lit(False).alias("own"))
    for part in range(parts):
        cascades = [Cascade(a, b, scratch, part, parts) for a, b in zip(inside, outside, strict=True)]
        for group in groups:
            wide = done.select("*", *keys_of(group))
            found = [F.col(f"k{j}").isNotNull() & cascades[i].holds(F.col(f"k{j}")) for j, (i, _) in enumerate(group)]
            fits = [
                F.when(hit, F.struct(F.length(f"k{j}").alias("n"), F.col(f"k{j}").alias("rule"), F.lit("block" if i == 0 else "allow").alias("verdict")))
                for j, ((i, _), hit) in enumerate(zip(group, found, strict=True))
                if i < 2
            ]
            own = reduce(lambda a, b: a | b, [hit for (i, _), hit in zip(group, found, strict=True) if i == 2], F.col("own"))
            done = wide.select("page_id", "host", "path", F.array_max(F.array("best", *fits)).alias("best"), own.alias("own"))
            if len(groups) * parts > 1:
                done = scratch.write(done)
    verdict = F.coalesce("best.verdict", F.when(F.col("own"), "block").otherwise("allow"))
    return done.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
