"""Windows and encodings of token sequences (inventory 2.15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.hashing import h60

PAD, BOS, EOS, SHIFT = 0, 1, 2, 3  # fixed values of the byte code


def window_starts(n: Column, width: Column) -> Column:
    """Q2: starts of the prefix, middle and suffix windows, without repeats."""
    return F.array_distinct(F.array(F.lit(0), F.floor((n - width) / 2).cast("int"), n - width))


def policy_start(step: Column, n: Column, width: Column, key: Column) -> Column:
    """Q3: prefix, middle, suffix or a hashed start, by the round modulo 4."""
    room = F.greatest(n - width, F.lit(0))
    kind = F.pmod(step, F.lit(4))
    hashed = F.pmod(h60("window", step, key), room + 1)
    return F.when(kind == 0, 0).when(kind == 1, F.floor(room / 2)).when(kind == 2, room).otherwise(hashed).cast("long")


def byte_ids(text: Column) -> Column:
    """Q1: one id for each UTF-8 byte, SHIFT more than the byte."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + SHIFT)


def byte_text(ids: Column) -> Column:
    """Q1: the text of byte ids; an id outside the code raises."""
    bad = F.exists(ids, lambda i: (i < SHIFT) | (i > SHIFT + 255))
    hexed = F.array_join(F.transform(ids, lambda i: F.lpad(F.hex((i - SHIFT).cast("long")), 2, "0")), "")
    return F.when(bad, F.raise_error(F.lit("an id is no byte")).cast("string")).otherwise(F.decode(F.unhex(hexed), "UTF-8"))


def padded(ids: Column, start: Column, body: int) -> tuple[Column, Column, Column]:
    """Q4: ids, mask and labels of fixed width body + 2: BOS, a slice, EOS, padding; padded labels are -100."""
    part = F.slice(ids, (start + 1).cast("int"), F.lit(body))
    seq = F.concat(F.array(F.lit(BOS)), part, F.array(F.lit(EOS)))
    gap = F.lit(body + 2) - F.size(seq)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(seq)), F.array_repeat(F.lit(0), gap))
    return F.concat(seq, F.array_repeat(F.lit(PAD), gap)), mask, F.concat(seq, F.array_repeat(F.lit(-100), gap))


def rank_features(ranks: Column) -> dict[str, Column]:
    """Q8: of the ranks (from 1) that a text's tokens took: shares of rank 1 and of ranks up to 5, and the mean log rank."""
    n = F.nullif(F.size(ranks), F.lit(0))
    share = lambda k: F.size(F.filter(ranks, lambda x: x <= k)) / n
    return {"top1_rate": share(1), "top5_rate": share(5), "log_rank": F.aggregate(ranks, F.lit(0.0), lambda s, x: s + F.ln(x.cast("double"))) / n}


def context_plan(ids: Column, region: str, room: int, wrapped: bool, width: int) -> list[Column]:
    """Q16: wrapped, selected, scored, input_ids, mask, positions of one condition.

    A region of at most `room` ids (prefix, middle or suffix), between BOS and EOS or bare, padded to `width`.
    Scored are the positions whose next id is known: of a bare region all but the last, of a wrapped one
    each of its ids (from the position before it).
    """
    n = F.size(ids)
    used = F.least(n, F.lit(room))
    start = {"prefix": F.lit(0), "suffix": n - used, "middle": F.floor((n - used) / 2).cast("int")}[region]
    part = F.slice(ids, start + 1, used)
    seq = F.concat(F.array(F.lit(BOS)), part, F.array(F.lit(EOS))) if wrapped else part
    size = used + (2 if wrapped else 0)
    scored = used - (0 if wrapped else 1)
    positions = F.when(scored > 0, F.sequence(F.lit(0), scored - 1)).otherwise(F.array().cast("array<int>"))
    return [
        F.lit(wrapped).alias("wrapped"),
        used.cast("long").alias("selected"),
        scored.cast("long").alias("scored"),
        F.concat(seq, F.array_repeat(F.lit(PAD), F.lit(width) - size)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.lit(width) - size)).alias("mask"),
        positions.alias("positions"),
    ]


def identifier_words(name: Column) -> Column:
    """Words of a snake- or camel-case name; a part without any is a word itself, empty parts are none.

    A word begins with a letter and goes on with small letters and digits, so a run of capitals is a word each.
    """
    words = F.transform(F.split(name, "_"), lambda p: F.struct(p.alias("p"), F.regexp_extract_all(p, F.lit(r"([A-Za-z][a-z0-9]*)"), F.lit(1)).alias("w")))
    return F.flatten(F.transform(words, lambda x: F.when(F.size(x["w"]) > 0, x["w"]).when(x["p"] == "", F.array().cast("array<string>")).otherwise(F.array(x["p"]))))
