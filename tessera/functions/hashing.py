"""The one deterministic hash that sampling, splitting and resampling use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h60(*parts: Column | str | int) -> Column:
    """A non-negative 60-bit integer: the first 15 hexadecimal digits of the md5 of the parts, joined by `|`.

    Strings are literals; pass columns as Column.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")


def h60_sql(*parts: str) -> str:
    """The same hash as a DuckDB expression over SQL expressions."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"
