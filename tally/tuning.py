"""How many rows a write task may hold: from the measured width of a table's rows and the memory of a task."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes a batch takes besides its rows, and what a batch and a row cost; defaults of the published figures.
BATCH_BYTES, BATCH_COST, ROW_COST = 4096, 1.0, 0.01
#: Bytes of a row's fixed part in Spark's row format, for each column, and of its null bits, up to 64 columns.
SLOT, NULLS = 8, 8
UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def memory_of(rows: int, row_bytes: int, batch_bytes: int = BATCH_BYTES) -> int:
    """Bytes that a batch of so many rows takes."""
    return batch_bytes + rows * row_bytes


def plan_batches(total: int, row_bytes: int, memory: int, *, batch_bytes: int = BATCH_BYTES, most: int | None = None) -> Row:
    """rows (of a batch), batches, peak_bytes and cost of the fewest batches that stay within the memory.

    ValueError where nothing is to be batched, a size is no size, or one row doesn't fit.
    """
    if min(total, row_bytes, memory, 1 if most is None else most) < 1 or batch_bytes < 0:
        raise ValueError(f"sizes and counts are positive: {total} rows of {row_bytes} bytes in {memory}, at most {most} a batch")
    if memory_of(1, row_bytes, batch_bytes) > memory:
        raise ValueError(f"a row of {row_bytes} bytes doesn't fit {memory} bytes of memory")
    rows = min(total, (memory - batch_bytes) // row_bytes, most or total)
    batches = -(-total // rows)
    return Row(rows=rows, batches=batches, peak_bytes=memory_of(rows, row_bytes, batch_bytes), cost=BATCH_COST * batches + ROW_COST * total)


def measure(df: DataFrame) -> Row:
    """rows and row_bytes (the mean width in Spark's row format, rounded up) of a table, in one aggregation."""
    varying = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    own = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in varying), F.lit(NULLS + SLOT * len(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.ceil(F.avg(own)), F.lit(NULLS)).cast("long").alias("row_bytes")).first()


def task_memory(spark: SparkSession) -> int:
    """Bytes of execution memory that one task may count on, from the session's settings."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local[")
    size = re.fullmatch(r"(\d+)([bkmgt]?)b?", conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower())
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    share = float(conf.get("spark.memory.fraction", "0.6")) * (1 - float(conf.get("spark.memory.storageFraction", "0.5")))
    return int(int(size[1]) * UNITS[size[2]] * share / max(1, cores))


def writer_options(df: DataFrame, memory: int | None = None) -> dict[str, str]:
    """Options for writing a table so that a file's rows fit a task's memory; none for an empty one."""
    size = measure(df)
    if not size.rows:
        return {}
    return {"maxRecordsPerFile": str(plan_batches(size.rows, size.row_bytes, memory or task_memory(df.sparkSession)).rows)}
