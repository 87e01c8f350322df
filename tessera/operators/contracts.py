"""Contracts on tables: each raises ContractError or returns its table (inventory 2.3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a contract; `code` names which."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def require(ok: bool, code: str, detail: str) -> None:
    if not ok:
        raise ContractError(code, detail)


def require_columns(df: DataFrame, columns: list[str], exact: bool = False, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """the columns are there (exact: these, in this order, and no other); none is forbidden."""
    missing = [c for c in columns if c not in df.columns]
    require(not missing, "columns_missing", str(missing))
    require(not exact or df.columns == columns, "columns_differ", str(df.columns))
    leaked = sorted(set(forbidden) & set(df.columns))
    require(not leaked, "columns_forbidden", str(leaked))
    return df


def numeric(df: DataFrame, column: str, allow_missing: bool = False) -> DataFrame:
    """a column as double; a value that was there and can't be read raises."""
    value = F.col(column).try_cast("double")
    lost, null = df.agg(F.count_if(F.col(column).isNotNull() & value.isNull()), F.count_if(F.col(column).isNull())).first()
    require(lost == 0, "not_numeric", f"{lost} values of {column}")
    require(allow_missing or null == 0, "missing", f"{null} values of {column}")
    return df.withColumn(column, value)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def require_finite(df: DataFrame, *columns: str, positive: bool = False) -> DataFrame:
    """all values are finite (and positive)."""
    bad = reduce(lambda a, b: a | b, [~finite(F.col(c)) | (F.col(c) <= 0 if positive else F.lit(False)) for c in columns])
    n = df.agg(F.count_if(bad)).first()[0]
    require(n == 0, "not_positive" if positive else "not_finite", f"{n} rows")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """no key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    require(twice == 0, "not_unique", ", ".join(keys))
    return df


def require_same_keys(a: DataFrame, b: DataFrame, *keys: str) -> None:
    """F8: two tables hold the same keys, as often."""
    x, y = a.select(*keys), b.select(*keys)
    differ = x.exceptAll(y).limit(1).count() + y.exceptAll(x).limit(1).count()
    require(differ == 0, "keys_differ", ", ".join(keys))


def require_balance(df: DataFrame, n: int, *cells: str) -> DataFrame:
    """every cell has n rows."""
    low, high = df.groupBy(*cells).count().agg(F.min("count"), F.max("count")).first()
    require(low == high == n, "not_balanced", f"{low} to {high} rows, not {n}")
    return df


def audit(df: DataFrame, **counts: int) -> DataFrame:
    """`rows` and distinct counts of columns are as expected."""
    aggs = [F.count("*").alias(k) if k == "rows" else F.count_distinct(k).alias(k) for k in counts]
    got = df.agg(*aggs).first().asDict()
    require(got == counts, "audit", f"{got}, not {counts}")
    return df


def aggregate_only(schema, banned: tuple[str, ...], path: str = "") -> None:  # noqa: ANN001
    """no field of a nested schema has a banned name."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StructType):
        for f in schema.fields:
            require(f.name.lower() not in banned, "row_level_field", f"{path}{f.name}")
            aggregate_only(f.dataType, banned, f"{path}{f.name}.")
    elif isinstance(schema, T.ArrayType):
        aggregate_only(schema.elementType, banned, path)
    elif isinstance(schema, T.MapType):
        aggregate_only(schema.valueType, banned, path)


def within(values: dict[str, float], limits: dict[str, float]) -> None:
    """F16: each metric is at most its limit in size; a metric that is missing or not a number raises."""
    import math

    for name, most in limits.items():
        v = values.get(name, math.nan)
        require(abs(v) <= most, "tolerance", f"{name}: {v}, limit {most}")


def same_features(a: DataFrame, b: DataFrame, prefix: str) -> list[str]:
    """both tables have the same feature columns in the same order."""
    x, y = ([c for c in t.columns if c.startswith(prefix)] for t in (a, b))
    require(x == y, "features_differ", f"{x} and {y}")
    return x


# Feature families by the start of the name.
FAMILIES = {"ast_": "syntax", "fim_": "infill", "tok_": "token", "len_": "length", "emb_": "embedding"}


def feature_families(columns: list[str]) -> dict[str, list[str]]:
    """Columns by family; a name of no family raises."""
    out: dict[str, list[str]] = {}
    for c in columns:
        family = next((f for p, f in FAMILIES.items() if c.startswith(p)), None)
        require(family is not None, "feature_family", c)
        out.setdefault(family, []).append(c)
    return out


def closest_feature(columns: list[str], prefix: str, suffix: str, n: int) -> str:
    """The column prefix<k>suffix with k nearest to n; of two, the smaller."""
    found = [int(m) for c in columns if c.startswith(prefix) and c.endswith(suffix) and (m := c[len(prefix) : len(c) - len(suffix) or None]).isdigit()]
    require(bool(found), "feature_missing", f"{prefix}*{suffix}")
    return f"{prefix}{min(found, key=lambda k: (abs(k - n), k))}{suffix}"


def first_available(df: DataFrame, priority: list[str], fallback: Column) -> Column:
    """The first column of a list that the table has, else an expression."""
    return next((F.col(c) for c in priority if c in df.columns), fallback)
