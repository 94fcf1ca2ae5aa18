"""A watched folder of Markdown files as a table of sections: new and changed files are cut again, sections that are gone are marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators import texts
from lorekeep.streaming import log

SECTIONS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file", "section_key", "heading", "body")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("file_sha256", T.StringType()), T.StructField("deleted", T.BooleanType())]
)


def watched(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``file, text, modified`` of Markdown files that appear or change."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def sections_of(files: DataFrame) -> DataFrame:
    """Rows of ``SECTIONS`` of the newest text of each file."""
    newest = files.groupBy("file").agg(F.max_by("text", "modified").alias("text")).withColumn("doc_id", F.col("file"))
    cut = texts.chunk_markdown(newest.select("doc_id", F.col("file").alias("path"), "text"))
    return cut.join(newest.select("doc_id", F.sha2("text", 256).alias("file_sha256")), "doc_id").select(F.col("doc_id").alias("file"), "section_key", "heading", "body", "tags", "file_sha256", F.lit(False).alias("deleted"))


def changes(current: DataFrame, files: DataFrame) -> DataFrame:
    """What a batch of files changes: the sections of files whose text is another one, and marks for sections that these no longer have."""
    known = current.select("file", F.col("file_sha256").alias("_known")).distinct()
    hashed = files.groupBy("file").agg(F.max_by("text", "modified").alias("text"), F.max("modified").alias("modified"))
    changed = hashed.join(known, "file", "left").where(~F.sha2("text", 256).eqNullSafe(F.col("_known"))).select("file", "text", "modified")
    new = sections_of(changed)
    old = current.join(changed.select("file"), "file", "left_semi").join(new.select("section_key"), "section_key", "left_anti")
    return new.unionByName(old.select(*SECTIONS.names).withColumn("deleted", F.lit(True)))


def absent(current: DataFrame, present: DataFrame) -> DataFrame:
    """Marks for the sections of files that a listing (``file``) no longer has; a file source doesn't tell of them."""
    return current.join(present.select("file"), "file", "left_anti").select(*SECTIONS.names).withColumn("deleted", F.lit(True))


def current_sections(spark: SparkSession, table: str) -> DataFrame:
    return log.latest(spark, table, SECTIONS, ["section_key"], "deleted")


def sync(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 1000):
    """Reads all that has changed since the last call into the table and returns the finished query."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is done again must not see its own first attempt
        before = log.read_log(batch.sparkSession, table, SECTIONS).where(F.col(log.BATCH) < number)
        newest = before.groupBy("section_key").agg(F.max_by(F.struct(*SECTIONS.names), log.BATCH).alias("x")).select("x.*").where("NOT deleted")
        log.write_batch(changes(newest, batch), table, number)

    query = watched(spark, folder, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
