"""Equality and inclusive range filters, which reach the Parquet scan as pushed filters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require


def filter_eq(df: DataFrame, column: str, value: Any, use_index: bool = True) -> DataFrame:
    """Rows whose column equals the value; None finds nulls. Without ``use_index`` the predicate stays above the scan."""
    require(df, column)
    at = F.col(f"`{column}`")
    if use_index:
        return df.where(at.isNull() if value is None else at == F.lit(value))
    # a comparison of structs isn't pushed down
    return df.where(F.struct(at.alias("v")).eqNullSafe(F.struct(F.lit(value).cast(df.schema[column].dataType).alias("v"))))


def filter_between(df: DataFrame, column: str, lower: Any, upper: Any) -> DataFrame:
    """Rows with lower <= column <= upper; ValueError if the bounds are reversed."""
    require(df, column)
    if lower > upper:
        raise ValueError("the lower bound exceeds the upper bound")
    return df.where(F.col(f"`{column}`").between(lower, upper))


def agreement(df: DataFrame, column: str, value: Any) -> DataFrame:
    """One row: whether the pushed and the unpushed form of a filter give the same rows."""
    a, b = filter_eq(df, column, value), filter_eq(df, column, value, use_index=False)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("agree"))


def validate_filter_index(df: DataFrame, column: str, value: Any) -> bool:
    return agreement(df, column, value).first()["agree"]
