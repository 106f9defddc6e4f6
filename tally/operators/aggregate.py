"""Grouped sums, counts and means, aggregated before and after one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require


def exact_sum(column: str, scale: int = 2) -> Column:
    """A double sum of decimals, which doesn't depend on the order of rows."""
    return F.sum(F.col(f"`{column}`").cast(f"decimal(38,{scale})")).cast("double")


def group_by(df: DataFrame, key: str, value: str, scale: int | None = None) -> DataFrame:
    """key, sum, count and avg of the value by key. Nulls are skipped; sums are doubles, exact ones if ``scale`` is given."""
    require(df, key, value)
    v = F.col(f"`{value}`")
    total = F.sum(v.cast("double")) if scale is None else exact_sum(value, scale)
    return df.groupBy(F.col(f"`{key}`").alias("key")).agg(total.alias("sum"), F.count(v).alias("count")).withColumn("avg", F.col("sum") / F.when(F.col("count") > 0, F.col("count")))


def aggregate(df: DataFrame, key: str, function: str, value: str, alias: str | None = None) -> DataFrame:
    """The key and one of SUM, COUNT and AVG, named like ``sum(amount)`` unless an alias is given."""
    require(df, key, value)
    v, name = F.col(f"`{value}`"), function.lower()
    made = {"sum": F.sum(v.cast("double")), "count": F.count(v), "avg": F.avg(v)}
    if name not in made:
        raise ValueError(f"no such aggregate: {function}")
    return df.groupBy(f"`{key}`").agg(made[name].alias(alias or f"{name}({value})"))


def balance(entries: DataFrame) -> DataFrame:
    """One row: debits and credits of ledger entries, 0 where there are none."""
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("entry_type") == kind, F.col("amount"))), F.lit(0)).cast("bigint")
    return entries.agg(side("debit").alias("debits"), side("credit").alias("credits"))


def transaction_count(entries: DataFrame) -> DataFrame:
    """One row: distinct transactions."""
    return entries.agg(F.countDistinct("transaction_id").alias("transactions"))


def transaction_for_key(entries: DataFrame, idempotency_key: str) -> DataFrame:
    """The transaction id of a key; no row if there is none."""
    return entries.where((F.col("idempotency_key") == idempotency_key) & (F.col("entry_type") == "debit")).select("transaction_id")
