"""Problem 3: mixed timestamp notations and time zones, brought to one UTC instant.

The work is done by JVM expressions only: a notation grammar splits each value
into local fields, an explicit zone or offset and a fraction; the offset history
of a feed without a stated zone is estimated by aligning its local times with
the times of ingestion; then local time and history are converted.

Defined results:

* null, blank, placeholder or impossible values give a null instant (``normalise``
  keeps the row, ``instants`` leaves it out);
* a record whose feed is unknown is read as a feed without a stated zone, and so is a feed
  whose zone has no rules; a written zone without rules or offset names no instant;
* repeated local times mean the first occurrence, skipped ones are read with the
  offset before the change (both are what the JVM's zone rules do by default);
* rows that share ``import_id`` are one record; an empty input gives an empty
  result; further columns don't matter, as only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import checkpointed

# Month names of the notations in use (English, German, Spanish, French,
# Portuguese, Italian), folded to lower-case ASCII; a name is matched by its whole form.
MONTHS = {
    1: "jan january januar janner enero ene janvier janv janeiro gennaio gen",
    2: "feb february februar febrero fevrier fevr fev fevereiro febbraio",
    3: "mar march marz maerz mrz marzo mars marco",
    4: "apr april abr abril avr avril aprile",
    5: "may mai mayo maio maggio mag",
    6: "jun june juni junio juin junho giugno giu",
    7: "jul july juli julio juil juillet julho luglio lug",
    8: "aug august ago agosto aout",
    9: "sep sept september septiembre set setiembre septembre setembro settembre",
    10: "oct october okt oktober octubre octobre outubro out ottobre ott",
    11: "nov november noviembre novembre novembro",
    12: "dec december dez dezember dic diciembre decembre dezembro dicembre",
}

# Zone abbreviations and their offsets in minutes. Where one abbreviation has
# several meanings, the feed's own zone decides (see ABBREVIATIONS_BY_REGION).
ABBREVIATIONS = {
    "z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120,
    "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "npt": 345, "jst": 540, "kst": 540,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210,
    "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
    "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "brt": -180, "brst": -120,
}
ABBREVIATIONS_BY_REGION = {
    ("Europe/Dublin", "ist"): 60,
    ("Asia/Jerusalem", "ist"): 120,
    ("Asia/Shanghai", "cst"): 480,
    ("Asia/Manila", "pst"): 480,
}

#: Zones tried for feeds that state none, besides those that other feeds state.
CANDIDATE_ZONES = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney",
    "America/Sao_Paulo", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles",
)

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.? ?m\.?)?"
_ZONE = r"([+−-]\d{2}(?::?\d{2})?|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})"
_WHOLE = rf"(?i)^(.*?\d)(?:(?:t| |, ?| at |, at | um | a las ){_TIME}(?: uhr)?(?: ?{_ZONE})?)?$"
_CTIME = rf"(?i)^(?:[a-z]+\.?,? )?([a-z]+)\.? (\d{{1,2}}) (\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?)(?: {_ZONE})? (\d{{4}})$"
_SPACE = "[\\s   -​  　﻿]+"

_Y_M_D = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"
_Y_DDD = r"^(\d{4})-(\d{3})$"
_N_N_Y = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$"
_D_MON_Y = r"(?i)^(?:\p{L}+\.?,? )?(\d{1,2})(?:st|nd|rd|th|\.)?[ -](?:de )?(\p{L}+)\.?,?[ -](?:de )?(\d{4})$"
_MON_D_Y = r"(?i)^(?:\p{L}+\.?,? )?(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"


def _int(column: Column) -> Column:
    return F.when(column != "", column.try_cast("int"))


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def _fold(column: Column) -> Column:
    return F.translate(F.lower(column), "áàâäãåçéèêëíìîïñóòôöõúùûü", "aaaaaaceeeeiiiinooooouuuu")


def parse(df: DataFrame, value: str, day_first: str) -> DataFrame:
    """Add ``p_epoch`` (microseconds, for values that count from 1970), ``p_local``
    (microseconds of the local time as if it were UTC), ``p_offset`` (minutes east,
    null if none is written), ``p_abbreviation`` and ``p_zone`` (a written zone name)."""
    clean = F.trim(F.regexp_replace(F.col(value), _SPACE, " "))
    out = df.withColumn("_s", clean)
    # what counts from 1970: seconds (with a fraction), milli-, micro- and nanoseconds
    digits = F.regexp_extract("_s", r"^(\d{10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?$", 1)
    fraction = F.regexp_extract("_s", r"^(\d{10})\.(\d+)$", 2)
    seconds = F.substring(digits, 1, 10).cast("bigint")
    below = F.when(F.length(digits) == 10, fraction).otherwise(F.substring(digits, 11, 9))
    micros = F.rpad(F.substring(below, 1, 6), 6, "0").cast("bigint")
    out = out.withColumn("p_epoch", F.when(digits != "", seconds * 1_000_000 + F.coalesce(micros, F.lit(0))))
    # a bracketed zone name at the end; the parts of dates that other forms share
    out = out.withColumn("p_zone", F.nullif(F.regexp_extract("_s", r"\[([A-Za-z][\w/+-]*)\]$", 1), F.lit("")))
    s = F.regexp_replace("_s", r" ?\[[A-Za-z][\w/+-]*\]$", "")
    s = F.regexp_replace(s, _CTIME, "$2 $1 $5 $3 $4")
    s = F.regexp_replace(s, r"(?i)^(\d{4})(\d{2})(\d{2})(?:[t ](\d{2})(\d{2})(\d{2})?(?=$|[^\d:]))", "$1-$2-$3 $4:$5:$6")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(?=$|[t ]\d{1,2}:)", "$1-$2-$3")
    s = F.regexp_replace(s, r"(\d):(?=$|[^\d])", "$1")
    out = out.withColumn("_s", F.trim(s))
    # one match gives all parts of the value, one rewrite gives the kind and parts of its date
    parts = F.split(F.regexp_replace("_s", _WHOLE, "$1\t$2\t$3\t$4\t$5\t$6\t$7"), "\t")
    out = out.withColumn("_p", F.when(F.size(parts) == 7, parts))
    out = out.withColumns({name: F.get("_p", F.lit(i)) for i, name in enumerate(("_d", "_h", "_mi", "_sec", "_f", "_ap", "_z"))})
    out = out.withColumns({"_ap": F.lower("_ap"), "_z": F.lower("_z"), **{name: _int(F.col(name)) for name in ("_h", "_mi", "_sec")}})
    date = F.trim("_d")
    for kind, pattern, order in (("ymd", _Y_M_D, "$1\t$3\t$4"), ("ord", _Y_DDD, "$1\t$2\t0"), ("num", _N_N_Y, "$4\t$1\t$3"), ("mon", _D_MON_Y, "$3\t$2\t$1"), ("mon", _MON_D_Y, "$3\t$1\t$2")):
        date = F.regexp_replace(date, pattern, f"{kind}\t{order}")
    out = out.withColumn("_q", F.split(date, "\t"))
    names = {name: number for number, all_names in MONTHS.items() for name in all_names.split()}
    kind, number, first, second = (F.get("_q", F.lit(i)) for i in range(4))
    by_day = F.coalesce(F.col(day_first), F.lit(False))
    swap = (kind == "num") & by_day
    year = F.when(F.length(number) == 2, F.concat(F.lit("20"), number)).otherwise(number)
    out = out.withColumns(
        {
            "_y": year.try_cast("int"),
            "_m": F.when(kind == "mon", _lookup(names, _fold(first))).when(swap, second.try_cast("int")).otherwise(first.try_cast("int")),
            "_day": F.when(swap, first.try_cast("int")).otherwise(second.try_cast("int")),
            "_ord": kind == "ord",
        }
    )
    last_ordinal = F.dayofyear(F.make_date("_y", F.lit(12), F.lit(31)))
    date = F.coalesce(
        F.to_date(F.when(~F.col("_ord"), F.try_make_timestamp_ntz(F.col("_y"), F.col("_m"), F.col("_day"), F.lit(0), F.lit(0), F.lit(0)))),
        F.when(F.col("_ord") & (F.col("_m") >= 1) & (F.col("_m") <= last_ordinal), F.date_add(F.make_date("_y", F.lit(1), F.lit(1)), F.col("_m") - 1)),
    )
    # the time of day; a mere date gets none here and noon UTC later
    half = F.col("_ap")
    hour = F.when(half == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(half == "p", 12).otherwise(0))
    real = (hour.between(0, 23)) & F.col("_mi").between(0, 59) & F.coalesce(F.col("_sec"), F.lit(0)).between(0, 59)
    of_day = (hour * 3600 + F.col("_mi") * 60 + F.coalesce(F.col("_sec"), F.lit(0))).cast("bigint") * 1_000_000 + F.coalesce(
        F.rpad(F.substring(F.nullif("_f", F.lit("")), 1, 6), 6, "0").cast("bigint"), F.lit(0)
    )
    out = out.withColumn("_days", F.unix_date(date).cast("bigint"))
    # the offset: written as numbers, or as an abbreviation (resolved by the caller)
    number = F.regexp_replace(F.regexp_replace("_z", "−", "-"), "^(?:utc|gmt)(?=[+-])", "")
    sign = F.when(F.substring(number, 1, 1) == "-", -1).otherwise(1)
    hours, minutes = _int(F.regexp_extract(number, r"^[+-](\d{1,2})", 1)), _int(F.regexp_extract(number, r"^[+-]\d{1,2}:?(\d{2})$", 1))
    written = number.rlike("^[+-]")
    offset = sign * (hours * 60 + F.coalesce(minutes, F.lit(0)))
    real_offset = ~written | ((hours <= 18) & (F.coalesce(minutes, F.lit(0)) <= 59))
    no_time = F.col("_h").isNull()
    return out.withColumns(
        {
            "p_date_only": no_time & F.col("_days").isNotNull() & (F.col("_z") == "") & F.col("p_zone").isNull(),
            "p_local": F.when(real & real_offset, F.col("_days") * 86_400_000_000 + of_day),
            "p_offset": F.when(written, offset),
            "p_abbreviation": F.when(~written & (F.col("_z") != ""), F.col("_z")),
        }
    ).drop("_s", "_p", "_q", "_d", "_h", "_mi", "_sec", "_f", "_ap", "_z", "_y", "_m", "_day", "_ord")


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that the JVM has rules for; others would make a conversion fail."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _to_utc(local_us: Column, zone: Column) -> Column:
    """Microseconds UTC of a local time in a zone, by the JVM's rules for gaps and overlaps."""
    as_if = F.timestamp_micros(local_us)
    return F.unix_micros(F.to_utc_timestamp(as_if, zone))


def zone_violations(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each feed and candidate zone, how far its zone-less local times contradict the ingestion.

    A record can't be ingested before it happened. Times are first reduced to one
    row per feed and local hour (offsets are constant within it) that keeps the
    tightest record, so the candidates meet hours, not records, and a feed with a
    third of all records is reduced before the shuffle.
    Columns: ``feed_id, zone, hours, violations, lag_us``.
    """
    bare = parsed.where(F.col("p_local").isNotNull() & F.col("p_offset").isNull() & F.col("p_abbreviation").isNull() & F.col("p_zone").isNull() & F.col("_received_us").isNotNull())
    hour = F.floor(F.col("p_local") / 3_600_000_000)
    tight = bare.groupBy("feed_id", hour.alias("hour")).agg(F.min(F.col("_received_us") - F.col("p_local")).alias("slack_us"))
    tried = tight.join(candidates, "feed_id")
    start = F.col("hour") * 3_600_000_000
    return (
        tried.withColumn("lag", F.col("slack_us") + (start - _to_utc(start, F.col("zone"))))
        .groupBy("feed_id", "zone")
        .agg(F.count("*").alias("hours"), F.count_if(F.col("lag") < 0).alias("violations"), F.sum(F.abs(F.col("lag"))).alias("lag_us"))
    )


def feed_histories(parsed: DataFrame, feeds: DataFrame, default_zone: str = "UTC", override_share: float = 0.2) -> DataFrame:
    """The zone whose offset history each feed follows: ``feed_id, zone``.

    A stated zone is the only candidate of its feed. A feed that states none is
    taken to follow ``default_zone`` unless its records contradict that: if more than
    ``override_share`` of its hours hold a record ingested before it happened, the
    candidate with the fewest violations wins (then the shortest lag, then the name).
    ``parsed`` needs the records of feeds without a stated zone only.
    ``feeds`` is a dimension; it must have one row per feed.
    """
    named = feeds.select("feed_id", "source_timezone").dropDuplicates(["feed_id"])
    stated = named.where(F.col("source_timezone").isNotNull()).select("feed_id", F.col("source_timezone").alias("zone"))
    silent = named.where(F.col("source_timezone").isNull()).select("feed_id")
    # zones that other feeds state are tried too; there are no more of them than zone names
    others = sorted(r[0] for r in stated.select("zone").distinct().collect())
    tried = F.explode(F.array(*[F.lit(z) for z in dict.fromkeys((default_zone, *CANDIDATE_ZONES, *others))]))
    scored = zone_violations(parsed, silent.select("feed_id", tried.alias("zone")))
    ranked = scored.groupBy("feed_id").agg(
        F.min_by("zone", F.struct("violations", "lag_us", "zone")).alias("best"),
        F.max(F.when((F.col("zone") == default_zone) & (F.col("violations") > override_share * F.col("hours")), True)).alias("contradicted"),
    )
    estimated = silent.join(ranked, "feed_id", "left").select("feed_id", F.when(F.col("contradicted"), F.col("best")).otherwise(F.lit(default_zone)).alias("zone"))
    return stated.unionByName(estimated)


def normalise(imports: DataFrame, feeds: DataFrame, default_zone: str = "UTC") -> DataFrame:
    """One row per import: ``import_id, feed_id, utc_us`` (null where no instant is named).

    ``feeds`` is a dimension table. It is joined by an ordinary join: Spark broadcasts
    it while its measured size allows, else both sides meet by ``feed_id``.
    """
    # copies of a row are equal, so the first of each id is any of them
    records = imports.select("import_id", "feed_id", "played_at", F.unix_micros(F.col("received_at").cast("timestamp")).alias("_received_us")).dropDuplicates(["import_id"])
    zones = known_zones(imports.sparkSession)
    feeds = feeds.withColumn("source_timezone", F.when(F.col("source_timezone").isin(zones), F.col("source_timezone")))
    by_feed = feeds.select("feed_id", "source_timezone", "day_first").dropDuplicates(["feed_id"])
    with_feed = records.join(by_feed, "feed_id", "left")
    # read by the estimate and by the conversion, so it is written once
    parsed = checkpointed(parse(with_feed, "played_at", "day_first").drop("played_at", "day_first"))
    histories = feed_histories(parsed.where(F.col("source_timezone").isNull()), feeds, default_zone)
    known = parsed.drop("source_timezone").join(histories, "feed_id", "left").withColumn("zone", F.coalesce("zone", F.lit(default_zone)))
    special = F.lit(None).cast("int")
    for (zone, name), minutes in ABBREVIATIONS_BY_REGION.items():
        special = F.coalesce(special, F.when((F.col("zone") == zone) & (F.col("p_abbreviation") == name), minutes))
    by_name = F.coalesce(special, _lookup(ABBREVIATIONS, F.col("p_abbreviation")))
    offset = F.coalesce("p_offset", by_name)
    unknown = (F.col("p_abbreviation").isNotNull() & by_name.isNull()) | (offset.isNull() & F.col("p_zone").isNotNull() & ~F.col("p_zone").isin(zones))
    utc = (
        F.when(F.col("p_epoch").isNotNull(), F.col("p_epoch"))
        .when(F.col("p_date_only"), F.col("_days") * 86_400_000_000 + 43_200_000_000)
        .when(F.col("p_local").isNull() | unknown, F.lit(None))
        .when(offset.isNotNull(), F.col("p_local") - offset.cast("bigint") * 60_000_000)
        .otherwise(_to_utc(F.col("p_local"), F.coalesce("p_zone", "zone")))
    )
    return known.select("import_id", "feed_id", utc.alias("utc_us"))


def instants(imports: DataFrame, feeds: DataFrame, default_zone: str = "UTC") -> DataFrame:
    """``import_id, utc_us`` of every import that names a real instant."""
    return normalise(imports, feeds, default_zone).where(F.col("utc_us").isNotNull()).select("import_id", "utc_us")
