"""Fixed schemas, and the check of appended rows against a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POSTINGS_IN = T.StructType([T.StructField("idempotency_key", T.StringType()), T.StructField("debit_account", T.StringType()), T.StructField("credit_account", T.StringType()), T.StructField("amount", T.LongType()), T.StructField("transaction_key", T.LongType())])
LEDGER_ENTRIES = T.StructType([T.StructField("transaction_id", T.StringType()), T.StructField("idempotency_key", T.StringType()), T.StructField("entry_type", T.StringType()), T.StructField("account", T.StringType()), T.StructField("amount", T.LongType()), T.StructField("transaction_key", T.LongType())])
GROUP_RESULT = T.StructType([T.StructField("key", T.LongType()), T.StructField("sum", T.DoubleType()), T.StructField("count", T.LongType()), T.StructField("avg", T.DoubleType())])


def require(df: DataFrame, *columns: str) -> None:
    """KeyError for a column that isn't there."""
    for c in columns:
        if c not in df.columns:
            raise KeyError(c)


def conform(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in a table's column order; ValueError unless both have the same set of columns."""
    if not rows.columns:
        raise ValueError("rows need at least one column")
    if set(rows.columns) != set(columns) or len(rows.columns) != len(columns):
        raise ValueError(f"columns {sorted(rows.columns)} differ from the table's {sorted(columns)}")
    return rows.select(*[f"`{c}`" for c in columns])
