"""Inner equi-joins of any two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require


def equi_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, strategy: str | None = None) -> DataFrame:
    """All pairs with equal keys, as ``left.x`` and ``right.x``; null keys match nothing.

    Catalyst picks the physical join unless ``strategy`` names one (``merge``, for instance).
    """
    require(left, left_column)
    require(right, right_column)
    a = left.select(*[F.col(f"`{c}`").alias(f"left.{c}") for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(f"right.{c}") for c in right.columns])
    if strategy:
        a = a.hint(strategy)
    return a.join(b, F.col(f"`left.{left_column}`") == F.col(f"`right.{right_column}`"))


def sort_merge_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str) -> DataFrame:
    """``equi_join`` by sorting and merging both sides, ordered by key."""
    return equi_join(left, right, left_column, right_column, "merge").orderBy(F.col(f"`left.{left_column}`"))


#: Ids up to which they are pushed to the scan as a list.
LISTED = 1000


def fetch_rows(df: DataFrame, ids: list[int], row_id: str = "row_id") -> DataFrame:
    """Rows by their ids in the order asked for, repeats included; the read fails with an index error for an id that isn't there.

    Up to ``LISTED`` ids reach the scan as a filter; more are joined.
    """
    if not ids:
        return df.limit(0)
    asked = df.sparkSession.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "__at long, __id long")
    if len(set(ids)) <= LISTED:
        df = df.where(F.col(row_id).isin(sorted(set(ids))))
        if df.select(row_id).distinct().count() < len(set(ids)):
            raise IndexError("row id out of range")
    elif df.join(asked.select("__id").distinct(), F.col("__id") == F.col(row_id), "left_semi").select(row_id).distinct().count() < len(set(ids)):
        raise IndexError("row id out of range")
    return asked.join(df, F.col("__id") == F.col(row_id)).orderBy("__at").drop("__at", "__id")
