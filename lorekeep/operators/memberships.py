"""Which records stand for others, and since when: consolidation applied and taken back, as intervals that are never changed in place but closed.

``memberships`` has ``membership_id, canonical_id, member_id, fingerprint, consolidated_at, deconsolidated_at``; an open interval has no
end. A fingerprint is a digest of what a member says, so that nothing is taken back after the member has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("membership_id", "canonical_id", "member_id", "fingerprint", "consolidated_at", "deconsolidated_at")


def fingerprint(*columns: str) -> Column:
    """Digest of columns in order, each with its length; null and empty differ."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in columns]
    return F.sha2(F.concat_ws(";", *parts), 256)


def open_members(memberships: DataFrame) -> DataFrame:
    return memberships.where(F.col("deconsolidated_at").isNull())


def apply(memberships: DataFrame, clusters: DataFrame, at: str) -> DataFrame:
    """The memberships after clusters (``canonical_id, member_id, fingerprint``) were consolidated at an instant.

    A cluster is refused as a whole if one of its members is part of another record already, or stands for one.
    """
    busy = open_members(memberships)
    taken = busy.select("member_id").unionByName(busy.select(F.col("canonical_id").alias("member_id"))).distinct()
    refused = clusters.join(taken, "member_id", "left_semi").select("canonical_id").distinct()
    new = clusters.join(refused, "canonical_id", "left_anti").distinct()
    key = F.sha2(F.concat_ws(":", "canonical_id", "member_id", F.lit(at)), 256)
    opened = new.select(key.alias("membership_id"), "canonical_id", "member_id", "fingerprint", F.lit(at).cast("timestamp_ntz").alias("consolidated_at"), F.lit(None).cast("timestamp_ntz").alias("deconsolidated_at"))
    return memberships.select(*COLUMNS).unionByName(opened)


def restore(memberships: DataFrame, canonical: DataFrame, current: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The memberships after records (``canonical_id``) were dissolved at an instant, and those refused (``canonical_id``).

    ``current`` (``id, fingerprint``) tells what members say now; if one has changed or gone, its group stays as it is.
    """
    asked = open_members(memberships).join(canonical.select("canonical_id").distinct(), "canonical_id", "left_semi")
    now = current.select(F.col("id").alias("member_id"), F.col("fingerprint").alias("_now"))
    refused = asked.join(now, "member_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_now"))).select("canonical_id").distinct()
    closed = asked.join(refused, "canonical_id", "left_anti").select("membership_id", F.lit(True).alias("_closed"))
    end = F.when(F.col("_closed"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("deconsolidated_at"))
    return memberships.join(closed, "membership_id", "left").withColumn("deconsolidated_at", end).select(*COLUMNS), refused
