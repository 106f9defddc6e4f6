"""Removal of repeated byte strings by deep-shallow sorting of suffixes.

Every byte covered by a string of ``width`` bytes that also starts elsewhere is
removed, as judged on the input; strings never cross documents.

1. Each window of ``width`` bytes has an anchor: the place in it whose hash of
   ``GRAM`` bytes is least (the last one of equals). The anchor depends on the
   window's bytes alone, so equal windows have equal anchors at equal places.
   Windows next to each other mostly share theirs: a document becomes a short
   list of stretches, each one anchor's windows.
2. Stretches whose anchor's hash occurs once hold no repeated window. Stretches
   that are equal as a whole are repeated as a whole. Both are settled by counts,
   which are aggregated before the shuffle.
3. What is left are stretches that share an anchor but differ somewhere: copies
   with changes, and passages in different surroundings. Of each distinct stretch
   the suffixes at all its windows are sorted, along with the others of that
   anchor: by multikey quicksort, eight bytes at a time, to a shallow depth; groups
   that still agree are ordered by blind tries. Suffixes that agree in ``width``
   bytes are repeated windows.

An anchor with over ``GROUP`` distinct stretches is dealt to several sorts: its
windows are parted by the anchor's place in them, ``PART`` places together, and by
the bytes that all windows of a part have in common. Equal windows have both the
same, so parts are sorted on their own. Where over ``CROWD`` stretches share even
these, each window is told by its digest, and digests are counted, aggregated
before the shuffle. So no task ever holds an unbounded group.

Null and empty texts are kept as they are; rows that agree in doc_id and text
repeat each other; texts shorter than ``width`` keep all. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, drop_cut, release, row_key, slices, trimmed
from .wordhash import U, mix, prefix_hash, span_hash

WIDTH, GRAM, SHALLOW, GROUP, PART, CROWD = 400, 32, 32, 256, 16, 50_000
#: Bytes of a document taken at a time when looking for anchors, and windows sorted at a time.
PIECE, SORTED = 4 << 20, 1 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor's hash, hash of the stretch, first window, last window and anchor of each stretch of a document."""
    found = []
    for begin in range(0, len(data) - width + 1, PIECE):
        part = data[begin : begin + PIECE + width - 1]
        sums = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        grams = span_hash(sums, at, at + gram)
        # the hash's upper half decides; of equal ones the last place, within any window shorter than 2**32 - 1
        rank = (grams & ~U(0xFFFFFFFF)) | (U(0xFFFFFFFF) - at.astype(np.uint64))
        anchor = (U(0xFFFFFFFF) - (sliding_least(rank, width - gram + 1) & U(0xFFFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        anchor = anchor[first]
        whole = span_hash(sums, first, last + width) ^ mix((anchor - first).astype(np.uint64) * U(0x10001) + (last - first).astype(np.uint64))
        found.append((grams[anchor], whole, first + begin, last + begin, anchor + begin))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                keys, rows, got = part.column(0).to_pylist(), [], []
                for key, text in zip(keys, bytes_of(part), strict=True):
                    if len(text) >= width:
                        got.append(stretches(np.frombuffer(text, np.uint8), width))
                        rows.append(np.full(len(got[-1][0]), key, np.int64))
                columns = [np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64) for k in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*rows, np.empty(0, np.int64)])), *(pa.array(c.view(np.int64)) for c in columns)], ["row", "anchor", "whole", "first", "last", "place"])

    return run


class BlindTrie:
    """Suffixes in a trie that stores only the depths and bytes at which they part; equal ones share a leaf."""

    def __init__(self, data: bytes, width: int):
        self.data, self.width, self.root = data, width, None

    def _agree(self, a: int, b: int) -> int:
        """How many bytes two suffixes share, up to the width."""
        data, low, high = self.data, 0, self.width
        if data[a : a + high] == data[b : b + high]:
            return high
        while high - low > 1:
            middle = (low + high) // 2
            if data[a + low : a + middle] == data[b + low : b + middle]:
                low = middle
            else:
                high = middle
        return low

    def add(self, suffix: int) -> None:
        """A node is [depth, children by byte]; a leaf is a list of suffixes under depth -1."""
        if self.root is None:
            self.root = [-1, [suffix]]
            return
        data, node = self.data, self.root
        while node[0] >= 0:
            node = node[1].get(data[suffix + node[0]]) or next(iter(node[1].values()))
        shared = self._agree(suffix, node[1][0])
        if shared >= self.width:
            node[1].append(suffix)
            return
        other = node[1][0]
        above, byte, node = None, 0, self.root
        while 0 <= node[0] < shared:
            above, byte = node, data[suffix + node[0]]
            node = node[1][byte]
        leaf = [-1, [suffix]]
        if node[0] == shared:
            node[1][data[suffix + shared]] = leaf
            return
        parted = [shared, {data[other + shared]: node, data[suffix + shared]: leaf}]
        if above is None:
            self.root = parted
        else:
            above[1][byte] = parted

    def groups(self) -> Iterator[list[int]]:
        """Equal suffixes together, in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[1]
            else:
                stack += [child for _, child in sorted(node[1].items(), reverse=True)]


def equal_windows(data: bytes, group: np.ndarray, at: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW) -> list[list[int]]:
    """Positions in ``at`` of windows that are equal within their group, by deep-shallow sorting; single ones are left out."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    eight = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        eight = (eight << U(8)) | raw[k : k + len(eight)]
    order = np.argsort(group, kind="stable")
    key = group[order]
    for depth in range(0, shallow + 1, 8):
        # keep what has neighbours of its own group; then part groups by the next eight bytes
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        many = np.repeat(size > 1, size)
        order = order[many]
        size = size[size > 1]
        key = np.repeat(np.arange(len(size)), size)
        if depth == shallow or not len(order):
            break
        word = eight[at[order] + depth]
        sort = np.lexsort((word, key))
        order, key, word = order[sort], key[sort], word[sort]
        key = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (word[1:] != word[:-1])])) if len(key) else key
    out = []
    places, begin = at[order].tolist(), 0
    order = order.tolist()
    for n in size.tolist() if len(order) else []:
        if n == 2:
            a, b = places[begin], places[begin + 1]
            if data[a + shallow : a + width] == data[b + shallow : b + width]:
                out.append(order[begin : begin + 2])
        else:
            trie, back = BlindTrie(data, width), {}
            for i in range(begin, begin + n):
                trie.add(places[i])
                back.setdefault(places[i], []).append(order[i])
            out += [[i for p in set(same) for i in back[p]] for same in trie.groups() if len(same) > 1]
        begin += n
    return out


CUT_SCHEMA = "key long, hot boolean, anchor long, whole long, base int, shift int, bytes binary"


def _parts(text: bytes, s: dict, width: int) -> Iterator[tuple]:
    """A stretch's bytes, or those of each of its parts with the hash of what the part's windows share."""
    first, last, place = s["first"], s["last"], s["place"]
    if not s["hot"]:
        yield (s["anchor"], False, s["anchor"], s["whole"], 0, place - first, text[first : last + width])
        return
    for low in range((place - last) // PART * PART, place - first + 1, PART):
        begin, end = max(first, place - low - PART + 1), min(last, place - low)
        common = text[place - low : place - low - PART + 1 + width]
        name = hashlib.blake2b(common, digest_size=8, person=low.to_bytes(4, "little"), key=s["anchor"].to_bytes(8, "little", signed=True)).digest()
        yield (int.from_bytes(name, "little", signed=True), True, s["anchor"], s["whole"], begin - first, place - begin, text[begin : end + width])


def _cut_out(width: int):
    """The bytes of stretches from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                out = []
                for text, own in zip(bytes_of(part), part.column(1).to_pylist(), strict=True):
                    for s in own:
                        out += _parts(text, s, width)
                columns = list(zip(*out, strict=True)) or [()] * 7
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "hot", "anchor", "whole", "base", "shift", "bytes"])

    return run


SORT_SCHEMA = "anchor long, whole long, start int, length int"


def _sort(width: int):
    """Ranges of repeated windows of stretches; rows come sorted by key."""

    def settle(held: list[tuple]) -> list[tuple]:
        key, anchor, whole, base, shift, parts = zip(*held, strict=True)
        begin = np.cumsum([0, *map(len, parts)])
        windows = np.array([len(p) - width + 1 for p in parts])
        owner = np.repeat(np.arange(len(held)), windows)
        own = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        _, group = np.unique(np.array(key), return_inverse=True)
        # only windows with their anchor at one place can be equal
        place = np.array(shift)[owner] - own
        marked = np.zeros(len(owner), bool)
        for same in equal_windows(b"".join(parts), group[owner].astype(np.int64) * (2 * width) + place, begin[owner] + own, width):
            marked[same] = True
        # neighbouring windows of one stretch as a range
        hit = np.flatnonzero(marked)
        if not len(hit):
            return []
        firsts = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)]))
        lengths = np.diff(np.concatenate([firsts, [len(hit)]]))
        return [(anchor[owner[i]], whole[owner[i]], base[owner[i]] + int(own[i]), int(n)) for i, n in zip(hit[firsts].tolist(), lengths.tolist(), strict=True)]

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "whole", "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, windows = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:  # one alone repeats nothing
                        held += group
                        windows += sum(len(g[5]) - width + 1 for g in group)
                    group = []
                    if windows > SORTED:
                        yield pack(settle(held))
                        held, windows = [], 0
                group.append(row)
        held += group if len(group) > 1 else []
        yield pack(settle(held) if held else [])

    return run


def _told_by_digest(parts: DataFrame, width: int) -> DataFrame:
    """Repeated windows of parts that are too many for one task."""
    each = parts.select("anchor", "whole", "base", "shift", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - width)).alias("at"))
    each = each.select("anchor", "whole", (F.col("base") + F.col("at")).alias("start"), F.concat(F.sha2(F.expr(f"substring(bytes, at + 1, {width})"), 256), F.lit(":"), (F.col("shift") - F.col("at")).cast("string")).alias("digest"))
    again = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return each.join(again, "digest").select("anchor", "whole", "start", F.lit(1).alias("length"))


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """row (the key of doc_id and text) and spans: the repeated byte ranges of each row that has some, unmerged."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(row_key("doc_id", "text").alias("row"), "text")
    found = cut(rows.mapInArrow(trimmed(_anchors(width)), "row long, anchor long, whole long, first long, last long, place long"))
    kinds = found.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last", "place")).alias("one"))
    kinds = cut(kinds)
    release(spark)
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    # equal as a whole
    full = kinds.where(F.col("n") > 1).select("anchor", "whole", F.lit(0).alias("start"), (F.col("one.last") - F.col("one.first") + 1).cast("int").alias("length"))
    # different stretches of one anchor: one of each is sorted
    mixed = kinds.join(shared, "anchor").select(F.col("one.row").alias("row"), F.struct("anchor", "whole", (F.col("kinds") > GROUP).alias("hot"), F.col("one.place").alias("place"), F.col("one.first").alias("first"), F.col("one.last").alias("last")).alias("s"))
    wanted = mixed.groupBy("row").agg(F.collect_list("s").alias("own"))  # no more than the row's own stretches
    parts = cut(rows.join(wanted, "row").dropDuplicates(["row"]).select("text", "own").mapInArrow(trimmed(_cut_out(width)), CUT_SCHEMA))
    release(spark)
    crowds = parts.where("hot").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key")
    few = parts.join(crowds, "key", "left_anti").select("key", "anchor", "whole", "base", "shift", "bytes")
    sorted_ones = few.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed(_sort(width)), SORT_SCHEMA)
    windows = sorted_ones.unionByName(_told_by_digest(parts.join(crowds, "key", "left_semi"), width))
    # written first, so that nothing but a shuffle stands between both sides and the join, and a common stretch's rows can be split
    ranges = cut(full.unionByName(windows).groupBy("anchor", "whole").agg(F.collect_list(F.struct("start", "length")).alias("ranges")))  # a stretch has few windows
    hits = found.join(ranges, ["anchor", "whole"]).select("row", F.explode("ranges").alias("r"), "first")
    hits = hits.select("row", (F.col("first") + F.col("r.start")).alias("start"), (F.col("first") + F.col("r.start") + F.col("r.length") - 1 + width).alias("end")).distinct()
    spans = cut(hits.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")))  # no more than the row's own windows
    for done in (found, kinds, parts, ranges):
        drop_cut(done)
    release(spark)
    return spans


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted ranges with those that meet joined."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "text"):
            kept, spans = [], []
            for text, own in zip(bytes_of(part), part.column(part.schema.get_field_index("spans")).to_pylist(), strict=True):
                own, at, left = merged(own), 0, []
                for a, b in own:
                    left.append(text[at:a])
                    at = b
                kept.append(b"".join([*left, text[at:]]))
                spans.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in bytes_of(part)], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), part.column(part.schema.get_field_index("marked"))], ["doc_id", "n_bytes", "removed", "kept", "marked"])


def dedup(docs: DataFrame, width: int = WIDTH, marks: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, removed (byte ranges) and kept (the bytes left) of every document; with marks (row, the key of doc_id and text) also marked, 1 or 0."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = own.withColumn("row", row_key("doc_id", "text")).join(repeats(own, width), "row", "left")
    both = both.withColumn("marked", F.lit(0)) if marks is None else both.join(marks.select("row", F.lit(1).alias("marked")), "row", "left")
    out = both.select("doc_id", "spans", "text", F.coalesce("marked", F.lit(0)).alias("marked")).mapInArrow(trimmed(_remove), "doc_id long, n_bytes long, removed array<struct<start long, end long>>, kept binary, marked int")
    return out.drop("marked") if marks is None else out
