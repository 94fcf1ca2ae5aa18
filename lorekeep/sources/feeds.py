"""Readers and writers of the feeds that the engine exchanges.

All readers are lazy frames with a fixed schema; limits on lines and records are checks that
fail, never cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSFER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "source_key", "content", "source", "namespace")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("metadata", T.StringType()), T.StructField("access_level", T.StringType())]
    + [T.StructField(n, T.TimestampNTZType()) for n in ("created_at", "updated_at", "event_at", "valid_from", "valid_to", "expires_at")]
    + [T.StructField(n, T.StringType()) for n in ("memory_kind", "origin_namespace")]
)
CONVERSATION = "id string, title string, messages array<struct<role:string,text:string,at:string>>"
MOST_LINE_BYTES = 1 << 20


def read_transfer(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited records, gzip or plain, without the manifest line; malformed lines fail."""
    return spark.read.schema(TRANSFER).option("mode", "FAILFAST").json(path).where(F.col("type") != "manifest")


def write_transfer(records: DataFrame, path: str) -> None:
    """One compressed JSON line for each record, and a line of the manifest in a file of its own."""
    spark = records.sparkSession
    lines = records.select(F.to_json(F.struct(*[F.coalesce(F.lit("memory"), "type").alias("type") if c == "type" else F.col(c) for c in records.columns])).alias("value"))
    manifest = lines.agg(F.count("*").alias("records")).select(F.to_json(F.struct(F.lit("manifest").alias("type"), F.lit(1).alias("version"), "records")).alias("value"))
    manifest.unionByName(lines).write.mode("errorifexists").option("compression", "gzip").text(path)
    faults = transfer_faults(spark, path).collect()
    if faults:
        raise ValueError(f"the feed is beyond its limits: {', '.join(f.fault for f in faults)}")


#: Limits of a feed: bytes of a line, records, bytes of all files as they are and unpacked.
MOST_RECORDS, MOST_PACKED_BYTES, MOST_BYTES = 100_000, 64 << 20, 256 << 20


def transfer_faults(spark: SparkSession, path: str) -> DataFrame:
    """``fault, found`` for everything that refuses a feed: an oversized line, too many records or bytes, no manifest or one that states another number."""
    kind = F.get_json_object("value", "$.type")
    found = spark.read.text(path).select(F.octet_length("value").alias("bytes"), kind.alias("kind"), F.get_json_object("value", "$.records").cast("long").alias("stated")).agg(
        F.max("bytes").alias("longest"), F.count_if(F.col("kind") != "manifest").alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("all"), F.count_if(F.col("kind") == "manifest").alias("manifests"), F.max("stated").alias("stated")
    )
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("packed"))
    checks = [("long line", "longest", F.col("longest") > MOST_LINE_BYTES), ("records", "records", F.col("records") > MOST_RECORDS), ("bytes", "all", F.col("all") > MOST_BYTES), ("packed bytes", "packed", F.col("packed") > MOST_PACKED_BYTES),
              ("manifests", "manifests", F.col("manifests") != 1), ("stated records", "stated", F.col("stated").isNull() | (F.col("stated") != F.col("records")))]
    faults = F.array(*[F.when(bad, F.struct(F.lit(name).alias("fault"), F.col(column).cast("long").alias("found"))) for name, column, bad in checks])
    return found.crossJoin(packed).select(F.explode(F.array_compact(faults)).alias("x")).select("x.*")  # one row each


def oversized_lines(spark: SparkSession, path: str, most: int = MOST_LINE_BYTES) -> DataFrame:
    """Lines beyond the limit, which refuse a feed."""
    return spark.read.text(path).select(F.octet_length("value").alias("bytes")).where(F.col("bytes") > most)


def reconcile(records: DataFrame, trailer: DataFrame) -> DataFrame:
    """A stream's records against its trailer: ``origin, stated, found, complete``."""
    found = records.groupBy("source").agg(F.count("*").alias("found")).withColumnRenamed("source", "origin")
    joined = trailer.select("origin", F.col("records").alias("stated")).join(found, "origin", "full")
    return joined.select("origin", F.coalesce("stated", F.lit(0)).alias("stated"), F.coalesce("found", F.lit(0)).alias("found")).withColumn("complete", F.col("stated") == F.col("found"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, turn, role, text`` of exported conversations (a JSON array a file)."""
    files = spark.read.schema(CONVERSATION).option("multiLine", "true").json(path).dropDuplicates(["id"])
    return files.select("id", "title", F.posexplode("messages").alias("turn", "m")).select("id", "title", "turn", "m.role", "m.text")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``path, body`` of HTML files as text: markup removed, entities of spaces and signs resolved."""
    pages = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    body = F.regexp_replace("body", r"(?is)<(script|style)\b.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?i)<(?:br|/p|/div|/li|/h\d)\b[^>]*>", "\n")
    body = F.regexp_replace(body, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return pages.select("path", F.trim(F.regexp_replace(body, r"[ \t]+", " ")).alias("body"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole Markdown files."""
    return spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def browser_page(visits: DataFrame, after_us: int, after_id: int, size: int) -> DataFrame:
    """The next page of browser visits after a cursor of time and id; one more row tells that there is more."""
    later = (F.col("visited_us") > after_us) | ((F.col("visited_us") == after_us) & (F.col("visit_id") > after_id))
    return visits.where(later).orderBy("visited_us", "visit_id").limit(size + 1)


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records (``origin, kind, title, content``) and trailer (``origin, records``) of an archive stream; a stream without its trailer isn't complete."""
    shape = "type string, origin string, kind string, title string, content string, coverage array<struct<origin:string,records:long>>"
    lines = spark.read.schema(shape).option("mode", "FAILFAST").json(path)
    trailer = lines.where("type = 'trailer'").select(F.explode("coverage").alias("x")).select("x.*")
    return lines.where("type = 'record'").select("origin", "kind", "title", "content"), trailer


def append(frame: DataFrame, path: str, by: str | None = None) -> None:
    """Append-only sink of audit and trace rows, partitioned where a column is named."""
    writer = frame.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)
