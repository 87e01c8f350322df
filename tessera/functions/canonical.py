"""Canonical forms of strings and labels (inventory 2.2)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_text(c: Column) -> Column:
    """Null is empty; trimmed; runs of white space are one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


BASELINE = "Pre-vacc"
# Spellings of the time before vaccination.
BASELINE_WORDS = ("pre-vacc", "prevacc", "pre-vaccination", "prevaccination", "pre", "baseline")


def timepoint(c: Column) -> Column:
    """A canonical day: `Pre-vacc`, an integer as text, or the trimmed input."""
    raw = normal_text(c)
    key = F.replace(F.replace(F.lower(raw), F.lit("_"), F.lit("-")), F.lit(" "), F.lit(""))
    bare = F.regexp_replace(key, "^(day|d)", "")
    value = bare.try_cast("double")
    whole = value.isNotNull() & (value == F.floor(value))
    return F.when(key.isin(*BASELINE_WORDS), F.lit(BASELINE)).when(whole, value.cast("bigint").cast("string")).otherwise(raw)


def day_number(c: Column) -> Column:
    """The canonical day as a number, null for anything else."""
    return timepoint(c).try_cast("double")


def synonym(c: Column, names: Mapping[str, str]) -> Column:
    """The value of a case-insensitive key, else the input."""
    pairs = [x for k, v in sorted(names.items()) for x in (F.lit(k.lower()), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(c))), c) if pairs else c


def strain(c: Column) -> Column:
    """A `_cell` or ` cell` suffix, in any case, becomes `_MDCK`."""
    return F.regexp_replace(normal_text(c), r"(?i)(_|\s+)cell$", "_MDCK")


def component_identity(c: Column) -> Column:
    """P5: a strain without its substrate."""
    return F.regexp_replace(c, r"(?i)[_ ](mdck|egg|cell)$", "")


def material(c: Column) -> Column:
    """The first category whose mark occurs in the letters and digits of the text."""
    key = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    return (
        F.when(key == "", "not_reported")
        .when(key.contains("pbmc"), "PBMC")
        .when(key.contains("wholeblood"), "whole_blood")
        .when(key.contains("bcell"), "B_cell")
        .when(key.contains("blood"), "other_blood")
        .otherwise("other_reported")
    )


def marker_state(c: Column, marker: str) -> Column:
    """The only state of a marker (++, +, -, LO or none), `conflicting` or `not_reported`."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(rf"{marker}(\+\+|\+|-|LO)?(?![0-9])"), F.lit(1)))
    return F.when(F.size(found) == 0, "not_reported").when(F.size(found) > 1, "conflicting").otherwise(F.get(found, 0))


def gate_signature(c: Column) -> Column:
    """Sorted marker tokens, a bar, and what is left of the text."""
    pattern = r"[A-Z0-9]+(?:\+\+|\+|-)"
    text = F.upper(F.coalesce(c, F.lit("")))
    tokens = F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), " ")
    return F.concat_ws("|", tokens, normal_text(F.regexp_replace(text, pattern, "")))


def processing_state(c: Column) -> Column:
    """Fresh, frozen, mixed or not_reported."""
    fresh, frozen = F.lower(c).rlike("fresh"), F.lower(c).rlike("frozen|cryo|thaw")
    return F.when(fresh & frozen, "mixed").when(fresh, "fresh").when(frozen, "frozen").otherwise("not_reported")


def subject_key(subject: Column, participant: Column, *more: Column) -> Column:
    """The subject, else `participant:` and the participant; with more parts before it."""
    own = F.coalesce(F.nullif(F.trim(subject), F.lit("")), F.concat(F.lit("participant:"), participant.cast("string")))
    return F.concat_ws("\u001f", *[m.cast("string") for m in more], own)


def fixed_bin(c: Column, edges: list[float]) -> Column:
    """Number of edges that are at most the value, less one."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= c)) - 1


def length_bucket(n: Column, low: int = 9, high: int = 14) -> Column:
    """floor(log2 n), kept within [low, high]."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.log2(n)).cast("int")))


def hinge(x: Column, knot: float) -> Column:
    """max(x - log2(knot), 0)."""
    import math

    return F.greatest(x - F.lit(math.log2(knot)), F.lit(0.0))


def label(c: Column) -> Column:
    """member/true/1 is 1, non-member/false/0 is 0, anything else raises."""
    key = F.lower(F.trim(c.cast("string")))
    known = F.when(key.isin("member", "true", "1"), 1).when(key.isin("non-member", "nonmember", "false", "0"), 0)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(key, F.lit("null")))).cast("int"))


SENTINELS = ("", "na", "n/a", "nan", "none", "null", "not available", "unknown")  # fixed values


def without_sentinels(c: Column) -> Column:
    """Sentinel strings are null."""
    return F.when(~F.lower(F.trim(c)).isin(*SENTINELS), c)


def truth(c: Column) -> Column:
    """Strings for yes: true, yes, y, 1."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "yes", "y", "1"), F.lit(False))


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow on either side."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def rounded(x: Column, digits: int) -> Column:
    """x to some decimals, halves away from zero, on the binary product as C and DuckDB do; F.round takes the shortest decimal.

    0.285 * 100 is below 28.5, so 0.28 comes out; F.round reads 0.285 as a half and gives 0.29.
    """
    y = F.abs(x) * float(10**digits)
    whole = F.floor(y)
    near = (whole + F.when(y - whole >= 0.5, 1).otherwise(0)) / float(10**digits)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(near * F.signum(x))
