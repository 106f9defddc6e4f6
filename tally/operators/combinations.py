"""Strictly ascending key triples and quadruples with a given sum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(keys: DataFrame, blocks: int, most: int | None = None) -> DataFrame:
    """x < y of all distinct keys, x no more than ``most`` if given, dealt by pairs of blocks so that no side is broadcast."""
    own = keys.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    low = own if most is None else own.where(F.col("k") <= most)
    left = low.select(F.col("k").alias("x"), F.col("own").alias("i"), F.explode(every).alias("j"))
    right = own.select(F.col("k").alias("y"), F.explode(every).alias("i"), F.col("own").alias("j"))
    return left.join(right, ["i", "j"]).where(F.col("x") < F.col("y")).select("x", "y")


def combinations(df: DataFrame, column: str, target: int, arity: int = 3, blocks: int | None = None) -> DataFrame:
    """a < b < c (< d) of the distinct keys that add up to the target; ValueError for other arities.

    All pairs of keys are made, in blocks x blocks parts; quadruples shuffle every pair
    by its sum, of n distinct keys n * n / 2, which the problem itself asks for.
    """
    if arity not in (3, 4):
        raise ValueError("arity is 3 or 4")
    blocks = blocks or max(4, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1)
    keys = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").cast("long").alias("k")).distinct()
    if arity == 3:
        # three ascending keys: the least is at most a third of the target, less one
        some = _pairs(keys, blocks, target // 3 - 1).withColumn("k", F.lit(target) - F.col("x") - F.col("y")).where(F.col("k") > F.col("y"))
        return some.join(keys, "k").select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("k").alias("c"))
    pairs = _pairs(keys, blocks)
    low = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), (F.lit(target) - F.col("x") - F.col("y")).alias("s"))
    high = pairs.select(F.col("x").alias("c"), F.col("y").alias("d"), (F.col("x") + F.col("y")).alias("s"))
    return low.join(high, "s").where(F.col("c") > F.col("b")).select("a", "b", "c", "d")
