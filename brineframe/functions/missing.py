"""Missing-value rules.

Arrays and frames in this domain use NaN for "missing" and skip it. Spark treats
NaN as a (largest) value, so NaN becomes NULL at ingest and never travels further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INF = float("inf")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column | str) -> Column:
    """NULL for NaN and for +-inf (NaN sorts above inf, so one comparison does both)."""
    c = as_col(c)
    return F.when(F.abs(c) < F.lit(INF), c)


def fill_missing(c: Column | str, value: float | Column = 0.0) -> Column:
    return F.coalesce(as_col(c), value if isinstance(value, Column) else F.lit(value))


def clean_floats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN -> NULL on float columns and on the elements of float arrays."""
    replaced = {}
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        kind = field.dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            replaced[field.name] = null_if_nan(field.name)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            replaced[field.name] = F.transform(field.name, null_if_nan)
    return df.withColumns(replaced) if replaced else df


def all_present(columns: list[str]) -> Column:
    out = F.lit(True)
    for name in columns:
        out = out & F.col(name).isNotNull()
    return out


def count_present(columns: list[str]) -> Column:
    """Row-wise number of non-missing values among ``columns``."""
    out = F.lit(0)
    for name in columns:
        out = out + F.col(name).isNotNull().cast("int")
    return out
