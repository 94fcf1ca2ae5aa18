"""Admission under two fixed windows at once; a denied request counts in neither."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(events: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """``event_id, admitted`` for requests of each user in the order of time, then id.

    Both windows are UTC and the longer one is a day, so users and days are independent of
    each other: a task sees one user's one day. Null times and users are never admitted.
    """
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    known = rows.where("user_id IS NOT NULL AND us IS NOT NULL").withColumn("day", F.floor(F.col("us") / 86_400_000_000))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["us", "event_id"])
        minute, in_minute, in_day, out = None, 0, 0, []
        for us in group["us"]:
            if us // 60_000_000 != minute:
                minute, in_minute = us // 60_000_000, 0
            good = in_minute < per_minute and in_day < per_day
            in_minute, in_day = in_minute + good, in_day + good
            out.append(good)
        return pd.DataFrame({"event_id": group["event_id"], "admitted": out})

    decided = known.groupBy("user_id", "day").applyInPandas(run, "event_id long, admitted boolean")
    return decided.unionByName(rows.where("user_id IS NULL OR us IS NULL").select("event_id", F.lit(False).alias("admitted")))
