"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

#: Text of one numpy working set, in bytes; a longer text makes a set of its own.
CHUNK_BYTES = 2 << 20


#: Folders written by this process's operators in the shared folder, oldest first.
_written: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder, which goes with ``drop_cuts_since``."""
    at = f"{shared_dir(spark)}/tally/{uuid.uuid4().hex}"
    _written.append(at)
    return at


def cut(df: DataFrame, level: int = 3) -> DataFrame:
    """Write ``df`` to the shared folder, packed at a level of zstd, and read it back, so that a lost executor costs no recomputation.

    What is returned lives until ``drop_cut`` or ``drop_cuts_since``.
    """
    at = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a result of ``cut`` that nothing will read again."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished jobs, so that Spark removes their shuffle files from the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mark() -> int:
    """A place in the list of cuts, for ``drop_cuts_since``."""
    return len(_written)


def drop_cuts_since(spark: SparkSession, place: int, keep: int = 0) -> None:
    """Delete all cuts made since a mark, but for the last ``keep`` ones; their readers must have run."""
    gone = _written[place : len(_written) - keep]
    for folder in gone:
        delete(spark, folder)
    del _written[place : len(_written) - keep]


def row_key(*cols: str):
    """A 64-bit key of a row's identifying columns; rows that agree in them count as one."""
    return F.xxhash64(*[F.col(c) for c in cols])


def trim() -> None:
    """Give memory that earlier work of this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function over batches that leaves no freed memory with its worker, which later stages use again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return wrapped


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text at most, whole rows each."""
    at = batch.schema.get_field_index(text)
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    yield batch.slice(begin, n - begin)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a batch's texts; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [t or b"" for t in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def sample_keys(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct keys in the order of their hash; the same ones wherever the rows lie."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key)).distinct()
    return keys.orderBy(F.xxhash64(key), key).limit(bound)


def with_columns(df: DataFrame, made: dict[str, str], columns: list[str], make) -> DataFrame:
    """``df`` with the columns ``made`` (type by name); ``make()`` gives a function from a record batch of ``columns`` to arrays.

    Columns of ``df`` whose names clash with the new ones are replaced.
    """
    names = list(made)
    kept = df.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for part in slices(whole, columns[-1]):
                got = work(pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in columns], columns))
                yield pa.RecordBatch.from_arrays([*part.columns, *got], [*part.schema.names, *names])

    return kept.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*kept.dtypes, *made.items()]))
