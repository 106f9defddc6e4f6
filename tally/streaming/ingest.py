"""Streaming ingest of rows and postings, exactly once by checkpoint.

Each micro-batch writes a folder named by its number and overwrites it when a
batch runs again after a failure, so a batch is there once or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import posting
from ..schema import LEDGER_ENTRIES, POSTINGS_IN
from ..sources.tables import exists


def json_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Files of JSON lines as they arrive; malformed records fail the query."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(folder)


def ingest_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of rows to a table; its sink log makes files visible all at once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Entries booked by ``ingest_postings``, or those of earlier batches."""
    if not exists(spark, path):
        return spark.createDataFrame([], LEDGER_ENTRIES)
    entries = spark.read.schema(T.StructType([*LEDGER_ENTRIES.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return (entries if before is None else entries.where(F.col("batch") < before)).drop("batch")


def ingest_postings(stream: DataFrame, path: str, checkpoint: str, rejects: str | None = None, order: str | None = None) -> StreamingQuery:
    """Book a stream of postings: the first of each key, in arrival order, across batches and restarts."""
    spark = stream.sparkSession

    def book(batch: DataFrame, number: int) -> None:
        at = order or "__order"
        batch = batch if order else batch.withColumn(at, F.monotonically_increasing_id())
        entries = posting.post(batch, at, read_ledger(spark, path, number))
        entries.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if rejects:
            posting.rejected(batch).drop("__order").write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return stream.writeStream.foreachBatch(book).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def posting_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Postings from files of JSON lines."""
    return json_stream(spark, folder, POSTINGS_IN)
