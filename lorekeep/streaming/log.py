"""A table as a log of batches: each batch writes a folder of its own, and readers take the newest row of each key.

A batch that is written again (after a failure, or because its end wasn't noted) overwrites its own folder, so nothing is
there twice. Nothing else is rewritten until the log is compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


def write_batch(frame: DataFrame, base: str, batch: int) -> None:
    """The rows of one batch; a second call with the same number replaces the first."""
    frame.write.mode("overwrite").parquet(f"{base}/{BATCH}={batch}")


def read_log(spark: SparkSession, base: str, schema) -> DataFrame:
    """All rows of all batches with their ``batch``; a log without any batch is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn(BATCH, F.lit(None).cast("long"))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(base)


def latest(spark: SparkSession, base: str, schema, keys: list[str], deleted: str | None = None) -> DataFrame:
    """The newest row of each key, without those that are marked as deleted."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
    rows = read_log(spark, base, schema).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", BATCH)
    return rows.where(~F.col(deleted)) if deleted else rows


def compact(spark: SparkSession, base: str, target: str, schema, keys: list[str], deleted: str | None = None) -> None:
    """The newest rows as the first batch of another log, which takes the place of this one when its readers have gone."""
    write_batch(latest(spark, base, schema, keys, deleted), target, 0)
