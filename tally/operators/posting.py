"""Double-entry postings: idempotent by key, each a debit and a credit from one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(postings: DataFrame) -> Column:
    """Whether a posting can be booked."""
    return F.coalesce((F.col("amount") > 0) & F.col("idempotency_key").isNotNull() & F.col("debit_account").isNotNull() & F.col("credit_account").isNotNull(), F.lit(False))


def rejected(postings: DataFrame) -> DataFrame:
    """The postings that can't be booked."""
    return postings.where(~valid(postings))


def first_per_key(postings: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, aggregated before the shuffle, so that a hot key costs no more than others."""
    rest = [c for c in postings.columns if c not in (key, order)]
    first = postings.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__first"))
    return first.select(key, "__first.*").select(*postings.columns)


def post(postings: DataFrame, order: str, posted: DataFrame | None = None) -> DataFrame:
    """Ledger entries of the first valid posting of each key that isn't among ``posted`` entries."""
    fresh = first_per_key(postings.where(valid(postings)), "idempotency_key", order)
    if posted is not None:
        fresh = fresh.join(posted.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    leg = lambda kind: F.struct(F.lit(kind).alias("entry_type"), F.col(f"{kind}_account").alias("account"))
    legs = fresh.withColumn("leg", F.explode(F.array(leg("debit"), leg("credit"))))
    return legs.select(F.concat(F.lit("tx-"), "idempotency_key").alias("transaction_id"), "idempotency_key", "leg.entry_type", "leg.account", F.col("amount").cast("long").alias("amount"), F.coalesce(F.col("transaction_key").cast("long"), F.lit(0).cast("long")).alias("transaction_key"))


def require_valid(idempotency_key: str, debit_amount: int, credit_amount: int) -> None:
    """ValueError for a posting whose sides differ or aren't positive."""
    if not idempotency_key:
        raise ValueError("a posting needs an idempotency key")
    if debit_amount != credit_amount or debit_amount <= 0:
        raise ValueError("both sides need one positive amount")
