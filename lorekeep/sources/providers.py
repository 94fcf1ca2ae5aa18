"""Play records of three providers as canonical events, by expressions only.

Every mapper takes a frame with ``item`` (the provider's JSON object) and gives ``EVENT`` columns; what a record lacks is
null. Records that name no title or no time are left out, as the provider's own mapping does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = (
    "service", "source_id", "service_id", "event_type", "title", "artist", "album", "show_title", "season", "episode", "release_year", "genres",
    "duration_ms", "played_ms", "completed", "played_at", "metadata",
)
_KINDS = {"season": "int", "episode": "int", "release_year": "int", "genres": "array<string>", "duration_ms": "int", "played_ms": "int", "completed": "boolean", "played_at": "timestamp_ntz"}

_SPOTIFY = """track struct<id:string,uri:string,name:string,artists:array<struct<id:string,name:string>>,album:struct<id:string,name:string,album_type:string,release_date:string,images:array<struct<url:string>>>,
    duration_ms:int,explicit:boolean,popularity:int,external_urls:struct<spotify:string>,external_ids:struct<isrc:string>>, played_at string, context struct<type:string,uri:string>"""
_PLEX = """ratingKey string, type string, title string, grandparentTitle string, parentTitle string, index int, parentIndex int, year int, duration int, viewedAt long, librarySectionTitle string, thumb string, grandparentThumb string"""
_YTMUSIC = """videoId string, title string, artists array<struct<id:string,name:string>>, album struct<id:string,name:string>, duration string, duration_seconds int, thumbnails array<struct<url:string>>, played string, played_raw string,
    played_precision string, played_bucket string, played_bucket_start string, played_bucket_end string, played_cursor_eligible boolean, feedbackToken string, videoType string, likeStatus string"""


def _event(frame: DataFrame, **columns: Column | None) -> DataFrame:
    return frame.select(*[(columns[c] if columns.get(c) is not None else F.lit(None)).cast(_KINDS.get(c, "string")).alias(c) for c in EVENT])


def _utc(text: Column) -> Column:
    """A written instant with its zone as UTC without one."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")


def _names(people: Column) -> Column:
    """The names of several artists, in order; null if none has one."""
    return F.nullif(F.array_join(F.filter(F.transform(people, lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), ", "), F.lit(""))


def spotify_events(items: DataFrame) -> DataFrame:
    x = items.select(F.from_json("item", _SPOTIFY).alias("x")).select("x.*")
    t = F.col("track")
    metadata = F.to_json(
        F.struct(
            t["id"].alias("track_id"), t["external_urls"]["spotify"].alias("track_url"), t["external_ids"]["isrc"].alias("isrc"), t["explicit"].alias("explicit"), t["popularity"].alias("popularity"), t["album"]["id"].alias("album_id"),
            t["album"]["album_type"].alias("album_type"), F.get(t["album"]["images"], F.lit(0))["url"].alias("album_image"), F.transform(t["artists"], lambda a: a["id"]).alias("artist_ids"),
            F.col("context")["type"].alias("context_type"), F.col("context")["uri"].alias("context_uri"),
        )
    )
    return _event(
        x.where(t["name"].isNotNull() & F.col("played_at").isNotNull()), service=F.lit("spotify"), service_id=t["uri"], event_type=F.lit("play"), title=t["name"], artist=_names(t["artists"]), album=t["album"]["name"],
        release_year=F.nullif(F.regexp_extract(t["album"]["release_date"], r"^(\d{4})", 1), F.lit("")), genres=F.array().cast("array<string>"), duration_ms=t["duration_ms"], played_at=_utc(F.col("played_at")), metadata=metadata,
    )


def plex_events(items: DataFrame) -> DataFrame:
    """``items`` also has ``server_id`` and ``server_name``. Episodes have a show, season and number, tracks an artist and an album, all else a title."""
    x = items.select(F.from_json("item", _PLEX).alias("x"), "server_id", "server_name").select("x.*", "server_id", "server_name")
    x = x.where((F.coalesce("ratingKey", F.lit("")) != "") & (F.coalesce("viewedAt", F.lit(0)) != 0) & (F.coalesce("title", F.lit("")) != ""))
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    metadata = F.to_json(F.struct(F.col("ratingKey").alias("rating_key"), F.col("type").alias("plex_type"), "server_name", "server_id", F.col("librarySectionTitle").alias("library_section"), "thumb", F.col("grandparentThumb").alias("grandparent_thumb")))
    return _event(
        x, service=F.lit("plex"), source_id=F.col("server_id"), service_id=F.concat_ws(":", "server_id", "ratingKey"), event_type=F.when(F.col("type") == "track", "play").otherwise("watch"), title=F.col("title"),
        artist=of("track", F.col("grandparentTitle")), album=of("track", F.col("parentTitle")), show_title=of("episode", F.col("grandparentTitle")), season=of("episode", F.col("parentIndex")), episode=of("episode", F.col("index")),
        release_year=F.col("year"), duration_ms=F.col("duration"), played_ms=F.col("duration"), completed=F.lit(True), played_at=_utc(F.concat(F.date_format(F.timestamp_seconds("viewedAt"), "yyyy-MM-dd HH:mm:ss"), F.lit(""))), metadata=metadata,
    )


def ytmusic_events(items: DataFrame) -> DataFrame:
    x = items.select(F.from_json("item", _YTMUSIC).alias("x")).select("x.*")
    at = _utc(F.col("played"))
    # "3:54" and "1:02:03"; a part that is no number makes no duration
    written = F.aggregate(F.transform(F.split("duration", ":"), lambda p: p.try_cast("int")), F.lit(0), lambda s, p: s * 60 + p)
    seconds = F.nullif(F.coalesce("duration_seconds", written), F.lit(0))
    video = F.col("videoId")
    metadata = F.to_json(
        F.struct(
            video.alias("video_id"), F.concat(F.lit("https://music.youtube.com/watch?v="), video).alias("video_url"), F.col("videoType").alias("video_type"), F.col("album")["id"].alias("album_id"),
            F.filter(F.transform("artists", lambda a: a["id"]), lambda i: i.isNotNull()).alias("artist_ids"), F.get("thumbnails", F.lit(0))["url"].alias("thumbnail"), F.col("likeStatus").alias("like_status"), F.col("feedbackToken").alias("feedback_token"),
            "played_raw", "played_precision", "played_bucket", "played_bucket_start", "played_bucket_end", "played_cursor_eligible",
        )
    )
    return _event(
        x.where((F.coalesce("title", F.lit("")) != "") & at.isNotNull()), service=F.lit("ytmusic"), service_id=video, event_type=F.lit("play"), title=F.col("title"), artist=_names(F.col("artists")), album=F.col("album")["name"],
        genres=F.array().cast("array<string>"), duration_ms=seconds * 1000, played_ms=seconds * 1000, completed=F.lit(True), played_at=at, metadata=metadata,
    )


MAPPERS = {"spotify": spotify_events, "plex": plex_events, "ytmusic": ytmusic_events}
