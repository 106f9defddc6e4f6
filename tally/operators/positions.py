"""Row numbers and prefix sums over an explicit order, without one task for all rows.

Rows are dealt by ranges of the order column, as many as the session has shuffle
partitions, and staged in the shared folder with the number of their range, so that
a recomputed partition meets the same ranges. Totals of ranges (one row each) are
accumulated and joined back. Rows that tie are taken in the order of a hash of the
whole row, nulls of the order column come first, and many equal values are spread
over several ranges.

Sums are doubles, added in order within a range and then over ranges; of decimal
columns, or with a ``scale``, they are exact up to the last conversion to double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import require
from ..sources.tables import staged

DIGITS = 38


def summand(df: DataFrame, column: str, scale: int | None) -> Column:
    """What is added of a column: exact decimals where the column has them or a scale is given, else doubles."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{column} isn't numeric")
    if scale is None and isinstance(kind, T.DecimalType):
        scale = kind.scale
    if scale is None and isinstance(kind, T.IntegralType):
        scale = 0
    value = F.col(f"`{column}`")
    return value.cast("double") if scale is None else value.cast(T.DecimalType(DIGITS, scale))


def _accumulated(df: DataFrame, order: str, add: Column, name: str, inclusive: bool, ranges: int | None) -> DataFrame:
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [F.col(f"`{order}`").asc_nulls_first(), F.col("__tie")]
    rows = df.withColumns({"__add": add, "__tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    rows = staged(rows.repartitionByRange(n, *at).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range").orderBy(*at)
    running = F.sum("__add").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    # a range's total is its last running sum, so that sums go on from range to range as they would within one
    whole = F.sum("__add").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.select("__range", whole.alias("__whole"), F.lead(F.lit(1)).over(within).alias("__next")).where(F.col("__next").isNull())
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = last.select("__range", F.coalesce(F.sum("__whole").over(before), F.lit(0)).alias("__before"))
    joined = rows.withColumn("__run", running).join(starts, "__range")
    return joined.withColumn(name, F.col("__before") + F.coalesce("__run", F.lit(0))).drop("__range", "__add", "__tie", "__run", "__before")


def with_row_id(df: DataFrame, order: str, name: str = "row_id", ranges: int | None = None) -> DataFrame:
    """0-based positions in the order of a column."""
    require(df, order)
    return _accumulated(df, order, F.lit(1).cast("long"), name, False, ranges)


def prefix_sum(df: DataFrame, order: str, value: str, name: str = "prefix_sum", scale: int | None = None, ranges: int | None = None) -> DataFrame:
    """Cumulative sums in the order of a column, as doubles; nulls add nothing."""
    require(df, order, value)
    add = summand(df, value, scale)
    return _accumulated(df, order, F.coalesce(add, F.lit(0).cast(add_type(df, value, scale))), name, True, ranges).withColumn(name, F.col(name).cast("double"))


def add_type(df: DataFrame, value: str, scale: int | None) -> T.DataType:
    return df.select(summand(df, value, scale).alias("x")).schema["x"].dataType


def check_range(start: int, stop: int, rows: int) -> None:
    """TypeError, IndexError or ValueError for positions that make no range."""
    if type(start) is not int or type(stop) is not int:
        raise TypeError("positions are integers")
    if start < 0 or stop > rows:
        raise IndexError("range out of bounds")
    if start > stop:
        raise ValueError("the range starts after its end")


def range_total(df: DataFrame, value: str, start: int, stop: int, row_id: str = "row_id", scale: int | None = None) -> DataFrame:
    """One row: range_sum and range_avg of the positions start to stop - 1, read through a pushed filter.

    Sums of doubles depend on the order in which tasks end, in their last bits.
    """
    require(df, value, row_id)
    some = df.where((F.col(row_id) >= start) & (F.col(row_id) < stop))
    total = F.coalesce(F.sum(summand(df, value, scale)).cast("double"), F.lit(0.0))
    return some.agg(total.alias("range_sum"), (total / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("range_avg"))


class PrefixSums:
    """Sums and means of ranges of positions of one column."""

    def __init__(self, df: DataFrame, value: str, row_id: str = "row_id", scale: int | None = None):
        require(df, value, row_id)
        summand(df, value, scale)
        self.df, self.value, self.row_id, self.scale = df, value, row_id, scale
        self.rows = df.count()

    def range_sum(self, start: int, stop: int) -> float:
        check_range(start, stop, self.rows)
        return range_total(self.df, self.value, start, stop, self.row_id, self.scale).first()["range_sum"]

    def range_avg(self, start: int, stop: int) -> float:
        check_range(start, stop, self.rows)
        if start == stop:
            raise ValueError("an empty range has no mean")
        return range_total(self.df, self.value, start, stop, self.row_id, self.scale).first()["range_avg"]
