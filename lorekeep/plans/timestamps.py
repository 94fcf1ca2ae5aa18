"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import timestamps
from lorekeep.session import table


def p3_found(spark, sf_dir):
    return timestamps.instants(table(spark, sf_dir, "media_imports"), table(spark, sf_dir, "media_feeds"))


def p3_by_feed(spark, sf_dir):
    """Imports, instants and span of each feed."""
    rows = timestamps.normalise(table(spark, sf_dir, "media_imports"), table(spark, sf_dir, "media_feeds"))
    return rows.groupBy("feed_id").agg(
        F.count("*").alias("imports"), F.count("utc_us").alias("instants"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us")
    )


QUERIES = {"p3_found": p3_found, "p3_by_feed": p3_by_feed}
ORACLE: dict[str, str] = {}
