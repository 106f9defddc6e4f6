"""Distributed union-find: connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, release


#: Edges up to which a round is one task: it needs no shuffle, where one of many partitions would write more files than rows.
FEW = 50_000


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge up and none down, or none up: then nothing is left to do."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not each.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges ``src``, ``dst`` (of one type).

    Each step takes the least neighbour of every node by a map-side aggregation
    and joins it back, so a node with many neighbours is never gathered. Rounds
    go on until every component is a star; each round's edges are written to the
    shared folder, and what the round before left on disk goes. A table of at most
    ``few`` edges stays in one partition, which all of a round's steps accept as
    dealt; rounds never add edges. Nulls and loops are dropped; an empty table gives
    an empty result.
    """
    # every edge from the larger to the smaller node
    now = cut(edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    release(edges.sparkSession)
    held = (lambda df: df.coalesce(1)) if now.count() <= few else (lambda df: df)
    while not _stars(held(now)):
        both = held(now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        # large star: larger neighbours move to the least one
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = held(both.where(F.col("dst") > F.col("src")).join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())
        # small star: smaller neighbours, and the node itself, move to the least one
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = held(large.join(least, "src")).select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e")).select("e.*").where(F.col("src") != F.col("dst")).distinct()
        gone, now = now, cut(small)
        drop_cut(gone)
        release(edges.sparkSession)
    now = held(now)
    roots = now.select(F.col("dst").alias("node")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
