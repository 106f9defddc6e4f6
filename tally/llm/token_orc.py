"""Token ids in ORC files.

Documents are dealt by ranges of ``doc_id`` (with the text's hash, so that one
id on many rows can be split), sorted within each file and encoded as they are
written. ``ids`` is an integer column, which ORC stores run-length and
bit-packed; stripes carry row indexes, and Bloom filters on ``doc_id``, so that
a reader skips stripes and row groups by metadata alone and reads the stripes
of a file in parallel. Each row holds the count of ids before it in its file;
files' totals, few numbers, give global positions when read.

Null texts count as empty and give the end id alone. Rows with equal doc_id are
all written, ordered by their text's hash; a null doc_id comes first. An empty
table gives an empty folder with a schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts_of
from .tokens import Encoder

#: Folder of the files' totals, beside them; readers of tables pass over such names.
TOTALS = "_totals"
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, files: int | None = None, stripe_bytes: int = 64 << 20, compression: str = "zstd") -> None:
    """Encode all documents and write them in ascending order of doc_id."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        part, total = TaskContext.get().partitionId(), 0
        for whole in batches:
            for some in slices(whole):
                ids = [x + end for x in encoder.encode(texts_of(some))]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), some.column(0), pa.array(total + ends - counts), pa.array(counts), lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])
                total += int(counts.sum())

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = columns.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    options = {"compression": compression, "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**options).orc(path)
    # a row for each file, so that later readers need not add up what they don't look for
    spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).coalesce(1).write.json(f"{path}/{TOTALS}")


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = spark.read.schema("part int, n long").json(f"{path}/{TOTALS}").collect()  # one row for each file
    before, at = {}, 0
    for part, n in sorted(totals):
        before[part] = at
        at += n
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, part_start long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_in_token_orc(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; row indexes and Bloom filters prune what is read."""
    return read_token_orc(spark, path).where(F.col("doc_id").isin(doc_ids))


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """Adds ids_crc32, over the ids as little-endian unsigned 32-bit integers, in place of ids."""
    from zlib import crc32

    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            flat = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            at = lists.offsets.to_numpy()
            sums = [crc32(flat[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    types = dict(rows.dtypes)
    return rows.select(*kept, "ids").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", ids_crc32 long")
