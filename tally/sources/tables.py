"""Tables on storage: Parquet, and newline-delimited JSON with a declared schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import conform


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Tables of a folder as temporary views."""
    for name in names:
        read_parquet(spark, f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON log, one object a line.

    A file's last line counts only if it has its line end: an append that broke off is
    left out, whatever it holds. Any other line that is no object of the schema, blank
    ones included, fails the read.
    """
    marked = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
    # with a line end each, the lines of a broken file would be a byte longer than the file
    torn = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.max("at").alias("at")).where(F.col("bytes") > F.col("size")).select("file", "at", F.lit(True).alias("torn"))
    parsed = lines.join(torn, ["file", "at"], "left").select("value", "torn", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull() | (F.length(F.trim("value")) == 0)
    checked = F.when(F.col("torn"), F.lit(False)).when(bad, F.raise_error(F.concat(F.lit("malformed record: "), F.substring("value", 1, 80)))).otherwise(F.lit(True))
    return parsed.where(checked).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tally-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what depends on how rows lie is then fixed."""
    at = f"{shared_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class RowTable:
    """An append-only table with a frozen set of columns and a 0-based ``row_id``.

    An append becomes visible as a whole, by the writer's commit. Nothing is
    written before the columns are checked.
    """

    def __init__(self, spark: SparkSession, path: str, cluster_by: str | None = None, bloom: tuple[str, ...] = ()):
        self.spark, self.path, self.cluster_by = spark, path, cluster_by
        self.options = {k: v for c in bloom for k, v in ((f"parquet.bloom.filter.enabled#{c}", "true"),)}

    def _stored(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if exists(self.spark, self.path) else None

    @property
    def columns(self) -> list[str]:
        stored = self._stored()
        return [c for c in stored.columns if c != "row_id"] if stored is not None else []

    @property
    def row_count(self) -> int:
        stored = self._stored()
        return stored.count() if stored is not None else 0

    def rows(self, with_id: bool = False) -> DataFrame:
        stored = self._stored()
        if stored is None:
            raise KeyError("the table has no columns yet")
        return stored if with_id else stored.drop("row_id")

    def append(self, rows: DataFrame) -> None:
        """Add rows; ValueError if their columns differ from the table's. No rows change nothing."""
        stored = self._stored()
        if "row_id" in rows.columns:
            raise ValueError("row_id is assigned by the table")
        rows = conform(rows, [c for c in stored.columns if c != "row_id"] if stored is not None else rows.columns)
        # staged, so that numbering reads each row as it was first computed
        staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        rows.withColumn("__at", F.monotonically_increasing_id()).write.parquet(staging)
        staged = self.spark.read.parquet(staging)
        part = F.shiftright("__at", 33)
        sizes = staged.groupBy(part.alias("p")).agg(F.max("__at").alias("m")).orderBy("p").collect()  # one row for each task
        base = self.row_count
        starts, at = [], base
        for p, m in sizes:
            starts.append((p, at))
            at += m - (p << 33) + 1
        if starts:
            offsets = self.spark.createDataFrame(starts, "p long, start long")
            numbered = staged.join(F.broadcast(offsets), part == F.col("p")).withColumn("row_id", F.col("start") + F.col("__at") - F.shiftleft("p", 33)).drop("p", "start", "__at")
            if self.cluster_by:  # ranges of values by file, sorted, so that statistics prune
                numbered = numbered.repartitionByRange(self.cluster_by).sortWithinPartitions(self.cluster_by)
            numbered.write.mode("append").options(**self.options).parquet(self.path)
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
