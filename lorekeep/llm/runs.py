"""Problem 5: runs of equal or near-equal consecutive events, each as one event.

A sequence is the events of one client and service, ordered by time, then id. Each event is
compared with its predecessor through a lag window, changes are flagged, the running sum of
the flags numbers the runs, and runs are aggregated.

This is done in two steps, so that no task ever holds a sequence: windows first run within
slices of ``slice_seconds`` of a sequence, and then over the runs that touch a slice's border,
at most two a slice, to join those that continue. The second window therefore grows with
the time span of the data, not with its rows; a client with a third of all events is spread
over as many tasks as it has slices.

Two events are near-equal if the forms of their titles and artists agree: letter case,
accents, punctuation and spacing are set aside, and so are notes in trailing brackets or
after a spaced dash, and guest credits. If nothing is left of a name that way, its letters
and digits count as they are, then its characters.

Defined results: events without time belong to no sequence; a null client or service is a
value like any other; null, empty and blank artists are the same, and so are such titles;
rows that share ``id`` are one event; a run has at least ``at_least`` events; an empty
table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import checkpointed

_TRAILING = r"(?U)(\s*[(\[{][^)\]}]*[)\]}])+\s*$"
_DASHED = r"(?U)\s[-‐-―]\s.*$"
_GUESTS = r"(?U)\s(feat|ft|featuring)\b.*$"
SLICE_SECONDS = 86_400


@cache
def _plain_letters() -> tuple[str, str]:
    """Precomposed Latin, Greek and Cyrillic letters and those they are built on."""
    pairs = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        form = unicodedata.normalize("NFD", chr(code))
        if form != chr(code) and chr(code).isalpha():
            pairs[chr(code)] = form[0]
    return "".join(pairs), "".join(pairs.values())


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, *_plain_letters()), r"[^\p{L}\p{N}]+", "")


def comparable(name: Column) -> Column:
    """The form in which titles and artists are compared."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    bare = lower
    for pattern in (_TRAILING, _DASHED, _GUESTS, _TRAILING, _DASHED):
        bare = F.regexp_replace(bare, pattern, "")
    forms = [F.nullif(x, F.lit("")) for x in (_letters(bare), _letters(lower), F.regexp_replace(lower, r"(?U)\s+", ""))]
    return F.coalesce(*forms, F.lit(""))


def event_runs(events: DataFrame, at_least: int = 2, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``client_id, service, first_event_id, last_event_id, n_events, duration_ms`` of every longest run."""
    at = F.unix_micros(F.col("played_at").cast("timestamp"))
    title, artist = comparable(F.col("title")), comparable(F.col("artist"))
    rows = (
        events.where(F.col("played_at").isNotNull())
        .select("client_id", "service", "id", at.alias("at"), title.alias("_t"), artist.alias("_a"))
        .select(
            "client_id", "service", "id", "at", F.floor(F.col("at") / (slice_seconds * 1_000_000)).alias("slice"),
            F.xxhash64("_t", F.lit("\x1f"), "_a").alias("k1"), F.xxhash64("_a", F.lit("\x1f"), "_t", F.lit(1)).alias("k2"),
        )
        .repartition("client_id", "service", "slice")
        .dropDuplicates(["client_id", "service", "slice", "id"])
    )
    within = Window.partitionBy("client_id", "service", "slice")
    ordered = within.orderBy("at", "id")
    changed = F.coalesce((F.lag("k1").over(ordered) != F.col("k1")) | (F.lag("k2").over(ordered) != F.col("k2")), F.lit(True))
    numbered = rows.withColumn("run", F.sum(changed.cast("int")).over(ordered))
    place = F.struct("at", "id")
    runs = numbered.groupBy("client_id", "service", "slice", "run").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2")
    )
    runs = runs.withColumn("border", (F.col("run") == 1) | (F.col("run") == F.max("run").over(within)))
    runs = checkpointed(runs.where(F.col("border") | (F.col("n") >= at_least)))
    inner = runs.where(~F.col("border")).select("client_id", "service", "first", "last", "n")
    # runs at the borders of slices continue where a later slice begins as the one before it ends
    sequence = Window.partitionBy("client_id", "service").orderBy("first")
    goes_on = (F.lag("slice").over(sequence) != F.col("slice")) & (F.lag("k1").over(sequence) == F.col("k1")) & (F.lag("k2").over(sequence) == F.col("k2"))
    border = runs.where("border").withColumn("joined", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(sequence))
    outer = border.groupBy("client_id", "service", "joined").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("joined")
    return (
        inner.unionByName(outer)
        .where(F.col("n") >= at_least)
        .select(
            "client_id", "service", F.col("first.id").alias("first_event_id"), F.col("last.id").alias("last_event_id"),
            F.col("n").cast("bigint").alias("n_events"), F.floor((F.col("last.at") - F.col("first.at")) / 1000).alias("duration_ms"),
        )
    )
