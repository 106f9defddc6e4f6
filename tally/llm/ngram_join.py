"""Similarity join on word shingles: MinHash LSH forest, then exact verification.

A text's set holds its runs of five words (all its words where it has fewer).
Rows with equal sets are one node. A node has a signature of ``DEEPEST`` symbols
in each of ``TREES`` prefix tries. A trie is its signatures in sorted order: all
are dealt by ranges of (tree, signature) and sorted, and the length of the prefix
that a row shares with the row before it says from which depth on the two are
under one trie node. Each row gives one link, to the first row of that trie node.

Matched prefixes are shortened from ``DEEPEST`` on, a symbol at a time: links of
that depth and deeper join nodes to clusters, and within a cluster every pair of
sets is compared exactly, so a link is lost only if its two sides share no prefix
and no chain of others does. A link of similarity s is found by prefixes of length
d with probability 1 - (1 - s**d)**trees; each found one stands for as many as the
inverse of it. Once the found ones are the share ``RECALL`` of that estimate, no
prefix is shortened further. Only clusters that have grown are compared again.

Clusters over ``block`` nodes are dealt to pairs of blocks, each compared on its
own; no pair is ever written out, only each node's count of links, a count of its
similarities and a spanning forest. Exact counts need all pairs of a cluster: n
nodes cost some n * n / 2 comparisons, and each set is sent to 2 * n / block tasks.
Within a block nodes that agree in all shared shingles and in size are compared
once.

Result: one row per document with class_id (least doc_id of its component of
verified links; copies included) and n_links (documents, other than itself, whose
set is similar). Texts without words, null or empty, have no links and their own
doc_id as class. Equal rows count as copies; a null doc_id is least of none. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, row_key, slices, texts_of
from .components import components
from .wordhash import U, mix, shingle_sets

NGRAM, THRESHOLD = 5, 0.8
TREES, DEEPEST, SHORTEST, RECALL = 32, 8, 3, 0.9995
BLOCK = 1024
#: Keys of texts that are broadcast at most.
FEW = 2_000_000
#: Classes of similarities that are counted, from the threshold to 1.
CLASSES = 20


def found_share(similarity: np.ndarray, trees: int, length: int) -> np.ndarray:
    """The share of the pairs of a similarity that have a prefix in common in some trie."""
    return 1 - (1 - similarity**length) ** trees


def recall_of(counts: list[int], threshold: float, trees: int, length: int) -> float:
    """The estimated recall of prefixes of this length, from found links by class of similarity."""
    counts = np.array(counts, float)
    at = threshold + (1 - threshold) * np.arange(len(counts)) / len(counts)  # a class counts as its lowest similarity
    return float(counts.sum() / (counts / found_share(at, trees, length)).sum()) if counts.sum() else 1.0


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least value of each of the permutations x -> x * factor, in pieces of bounded size."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        np.minimum(out, (factors[:, None] * values[None, at : at + 4096]).min(1), out=out)
    return out


def digest(values: np.ndarray) -> int:
    """A 64-bit hash of a sorted set, signed."""
    place = mix(np.arange(1, len(values) + 1, dtype=np.uint64))
    return int(mix(np.array([(values * (place | U(1))).sum(dtype=np.uint64) + U(len(values))]))[0].astype(np.int64))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def _signatures(ngram: int, trees: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(trees * length)
        for whole in batches:
            for part in slices(whole):
                sets = shingle_sets(texts_of(part), ngram)
                nodes = [digest(s) if len(s) else None for s in sets]
                # a symbol is 16 bits of a value
                paths = [mix(signature(s, factors)).astype(">u2").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(paths, pa.binary())], ["doc_id", "row", "node", "paths"])

    return run


def _matches(length: int, shortest: int):
    """Links of sorted rows (tree, path, node): src, dst and the depth they share; and the first and last row with depth -1 and -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, heads = TaskContext.get().partitionId(), None, np.zeros(length + 1, np.int64)

        def edge(row: tuple, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[2]], pa.int64()), pa.array([part], pa.int64()), pa.array([kind], pa.int32()), pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary())], NAMES)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            paths = batch.column(1).to_pylist()
            symbols = np.frombuffer(b"".join(paths), ">u2").reshape(n, length)
            if before is None:
                yield edge((int(tree[0]), paths[0], int(node[0])), -1)
                tree, symbols, node = np.concatenate([[-1], tree]), np.concatenate([symbols[:1], symbols]), np.concatenate([[0], node])
            else:
                tree, symbols, node = np.concatenate([[before[0]], tree]), np.concatenate([before[1], symbols]), np.concatenate([[before[2]], node])
            same = (tree[1:] == tree[:-1])[:, None] & (symbols[1:] == symbols[:-1])
            shared = np.concatenate([[0], np.logical_and.accumulate(same, 1).sum(1)])
            at, first = np.arange(n + 1), np.empty((length + 1, n + 1), np.int64)
            for d in range(1, length + 1):
                start = np.maximum.accumulate(np.where(shared < d, at, 0))
                first[d] = np.where(start > 0, node[start], heads[d])
                heads[d] = first[d][-1]
            own = np.flatnonzero(shared[1:] >= shortest) + 1
            depth = shared[own]
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(first[depth, own]), pa.array(depth.astype(np.int32)), pa.array(tree[own].astype(np.int32)), pa.nulls(len(own), pa.binary())], NAMES)
            before = (int(tree[-1]), symbols[-1:], int(node[-1]))
        if before is not None:
            yield edge((before[0], before[1].tobytes(), before[2]), -2)

    return run


NAMES = ["src", "dst", "depth", "tree", "path"]


def tries(nodes: DataFrame, trees: int, length: int, shortest: int = SHORTEST) -> DataFrame:
    """src, dst, depth and tree of the links of nodes (node, paths) that are next to each other under a trie node of at least the shortest depth."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = nodes.select("node", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    each = each.select("tree", F.expr(f"substring(paths, {2 * length} * tree + 1, {2 * length})").alias("path"), "node")
    in_order = each.repartitionByRange(n, "tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = cut(in_order.mapInArrow(_matches(length, shortest), "src long, dst long, depth int, tree int, path binary"))
    # where one part ends and the next begins: two rows for each part
    ends = sorted(found.where(F.col("depth") < 0).collect(), key=lambda r: (r.dst, -r.depth))
    first, last = [r for r in ends if r.depth == -1], [r for r in ends if r.depth == -2]

    def shared(a, b) -> int:
        return int(np.logical_and.accumulate(np.frombuffer(a.path, ">u2") == np.frombuffer(b.path, ">u2")).sum()) if a.tree == b.tree else 0

    across = []
    for k in range(1, len(first)):
        if (depth := shared(last[k - 1], first[k])) >= shortest:
            # to the first part under the same trie node, so that one of many parts makes no chain
            j = k - 1
            while j and shared(first[j], last[j]) >= depth and shared(last[j - 1], first[j]) >= depth:
                j -= 1
            across.append((first[k].src, last[j].src, depth, first[k].tree))
    links = found.where(F.col("depth") >= shortest).select("src", "dst", "depth", "tree")
    return links.unionByName(spark.createDataFrame(across, "src long, dst long, depth int, tree int"))


def clustered(links: DataFrame, some: int = 4) -> DataFrame:
    """node and root of the clusters that links (src, dst, tree) make.

    The links of a few tries give most of each cluster; of the others only those
    between different clusters are left for a second time.
    """
    early = cut(components(links.where(F.col("tree") < some).select("src", "dst")))
    at = lambda side: early.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    late = links.where(F.col("tree") >= some).select("src", "dst").distinct().join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    late = cut(late.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst")).where(F.col("src") != F.col("dst")).distinct())
    if late.isEmpty():
        return early
    return cut(components(late.unionByName(early.select(F.col("node").alias("src"), F.col("root").alias("dst")))))


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                sets = shingle_sets(texts_of(part), ngram)
                values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["node", "values"])

    return run


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of each pair of sets."""
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    # sets that agree in what any two share, and in size, are alike to all others
    marks = mix(column.astype(np.uint64) + U(1))
    sums = np.zeros(len(sets), np.uint64)
    np.add.at(sums, owner, marks)
    _, first, kind = np.unique(np.rec.fromarrays([sums, sizes]), return_index=True, return_inverse=True)
    place = np.full(len(sets), -1)
    place[first] = np.arange(len(first))
    own = place[owner] >= 0
    rows, column = place[owner[own]], column[own]
    both = np.zeros((len(first), len(first)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = max(256, (8 << 20) // max(1, len(first)))
    for begin in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        dense = np.zeros((len(first), width), np.float32)
        dense[rows[a:b], column[a:b] - begin] = 1
        both += dense @ dense.T
    size = sizes[first]
    # a kind's own sets share all their shared columns
    np.fill_diagonal(both, np.bincount(rows, minlength=len(first)))
    joint = size[:, None] + size[None, :] - both
    return (both / joint)[np.ix_(kind, kind)]


def _roots(near: np.ndarray) -> np.ndarray:
    """The least position in the component of each position."""
    root = np.arange(len(near))
    while True:
        low = np.where(near, root[None, :], len(near)).min(1)
        low = np.minimum(low, root)[np.minimum(low, root)]
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float):
    def compare(group: list[tuple]) -> list[tuple]:
        """Rows (cluster, node, links, root, classes) of one block or pair of blocks; group: (cluster, side, node, copies, values)."""
        sides = np.array([g[1] for g in group])
        nodes, copies = np.array([g[2] for g in group]), np.array([g[3] for g in group])
        share = similarities([g[4] for g in group])
        near = share >= threshold - 1e-7
        np.fill_diagonal(near, False)
        if sides.any():  # two blocks: only pairs across
            near &= (sides == 1)[:, None] ^ (sides == 1)[None, :]
        links = near @ copies
        root = nodes[_roots(near)]
        out = []
        for i in np.flatnonzero(links).tolist():
            kinds = ((share[i, near[i]] - threshold) / (1 - threshold) * CLASSES + 1e-6).astype(np.int64)
            out.append((group[0][0], int(nodes[i]), int(links[i]), int(root[i]), np.bincount(np.clip(kinds, 0, CLASSES - 1), minlength=CLASSES).tolist()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            lists = batch.column(6)
            flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i, (cluster, one, two, side, node, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if (cluster, one, two) != key:
                    out += compare(group) if len(group) > 1 else []
                    key, group = (cluster, one, two), []
                group.append((cluster, side, node, copies, flat[at[i] : at[i + 1]].copy()))
            yield pack(out)
            out = []
        yield pack(compare(group) if len(group) > 1 else [])

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["cluster", "node", "links", "root", "classes"])

    return run


def compared(clusters: DataFrame, nodes: DataFrame, rows: DataFrame, ngram: int, threshold: float, block: int) -> DataFrame:
    """cluster, node, links, root and classes of the nodes with links to others, from all pairs of each cluster (node, root)."""
    # sets of the clusters' nodes, each once, to blocks or pairs of blocks
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block // 2)).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "root").join(nodes.select("node", "copies", "row"), "node")
    placed = placed.withColumn("blocks", F.when(F.col("blocks") <= 2, F.lit(1)).otherwise(F.col("blocks"))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # texts of the clusters' nodes alone go to a shuffle where their keys are few enough to be sent to all
    keys = cut(placed.select("row").distinct())
    texts = rows.select("row", "text").join(F.broadcast(keys) if keys.count() <= FEW else keys, "row", "left_semi")
    held = placed.select("row", "node").join(texts, "row").select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets(ngram), "node long, values array<long>")
    pairs = placed.select("root", "node", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(F.col("root").alias("cluster"), F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies")
    dealt = pairs.join(held, "node").select("cluster", "one", "two", "side", "node", "copies", "values")
    dealt = dealt.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster", "one", "two").sortWithinPartitions("cluster", "one", "two")
    return cut(dealt.mapInArrow(_compare(threshold), "cluster long, node long, links long, root long, classes array<long>"))


def _found(docs: DataFrame, ngram: int, threshold: float, trees: int, deepest: int, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, row and node of every document; node, copies, class_id, first (the row that stays), root and n_links of every node."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_key("doc_id", "text"))
    signed = cut(rows.select("doc_id", "row", "text").mapInArrow(_signatures(ngram, trees, deepest), "doc_id long, row long, node long, paths binary"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = cut(signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(order).alias("first"), F.min("row").alias("row"), F.first("paths").alias("paths")))
    links = tries(nodes, trees, deepest)
    found = known = None
    for length in range(deepest, SHORTEST - 1, -1):
        clusters = clustered(links.where(F.col("depth") >= length))
        if known is None:
            found = compared(clusters, nodes, rows, ngram, threshold, block)
        else:  # clusters that have not grown stay as they are
            size = lambda c, name: c.groupBy("root").agg(F.count(F.lit(1)).alias(name))
            same = cut(size(clusters, "now").join(size(known, "then"), "root").where(F.col("now") == F.col("then")).select("root"))
            grown = clusters.join(same, "root", "left_anti")
            kept = found.join(same.withColumnRenamed("root", "cluster"), "cluster", "left_semi")
            found = kept.unionByName(compared(grown, nodes, rows, ngram, threshold, block).select(*kept.columns))
            drop_cut(known)
        known = clusters
        counts = found.agg(*[F.coalesce(F.sum(F.col("classes")[k]), F.lit(0)).alias(f"c{k}") for k in range(CLASSES)]).first()
        if recall_of(list(counts), threshold, trees, length) >= recall:
            break
    classes = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = nodes.select("node", "copies", "least", "first").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("first"))
    return signed.select("doc_id", "row", "node"), own.select("node", "copies", "root").join(least, "root").join(links, "node", "left").select("node", "class_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def join(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    signed, known = _found(docs, ngram, threshold, trees, deepest, recall, block)
    return signed.join(known, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The documents without those similar to one kept, with their own columns.

    Of each component one row stays, that of the least doc_id (null after all others),
    then of the least row key; of rows equal in doc_id and text one stays. Rows without
    words all stay. Rows that share a doc_id but not their text are judged on their own.
    """
    signed, known = _found(docs, ngram, threshold, trees, deepest, recall, block)
    own = signed.where(F.col("node").isNotNull()).groupBy("row", "doc_id", "node").agg(F.count(F.lit(1)).alias("rows"))
    own = cut(own.join(known, "node").select(F.col("row").alias("__row"), F.col("doc_id").alias("__doc"), "rows", (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").eqNullSafe(F.col("first"))).alias("stays")))
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    same = lambda told: (F.col("__key") == told["__row"]) & docs["doc_id"].cast("long").eqNullSafe(told["__doc"])
    gone = own.where(~F.col("stays")).select("__row", "__doc")
    rest = docs.withColumn("__key", key)
    rest = rest.join(gone, same(gone), "left_anti")
    again = own.where(F.col("stays") & (F.col("rows") > 1)).select("__row", "__doc")
    if again.isEmpty():
        return rest.drop("__key")
    once = rest.join(again, same(again), "left_semi").dropDuplicates(["__key", "doc_id"])
    return rest.join(again, same(again), "left_anti").unionByName(once).drop("__key")
