"""Digests of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_digest(df: DataFrame, name: str = "digest") -> DataFrame:
    """The rows with the SHA-256 of their canonical JSON, fields in name order."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: row count and a digest that doesn't depend on order or partitioning.

    Row digests are cut in 32-bit words, which are added up; a list of all rows
    is never gathered.
    """
    words = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = row_digest(df).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"w{k}") for k, w in enumerate(words)])
    return sums.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"w{k}").cast("string") for k in range(8)]), 256).alias("digest"))
