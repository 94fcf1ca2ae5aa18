"""Aggregations and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.plans.dialect import DUCK, IDENTITY_FIELDS, SPARK, Plans, active, decay, identity, lot, memories, of_content, rank_of
from lorekeep.session import checkpointed, table

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE

_LISTEN = "CAST(coalesce(played_ms, CASE WHEN completed IS TRUE THEN duration_ms ELSE 0 END, 0) AS BIGINT)"


def media(d, columns: str, where: str = "1 = 1") -> str:
    """The listening facts of events, each event once; a caller's filters go into the scan."""
    return f"(SELECT DISTINCT id, {columns}, {_LISTEN} AS listen_ms FROM media_events WHERE {where})"


def media_filter(d, client: str | None = None, service: str | None = None, after: str | None = None, before: str | None = None) -> str:
    """What limits statistics of events: equality of client and service, and a range of time that is closed at both ends."""
    parts = [f"client_id = '{client}'"] * (client is not None) + [f"service = '{service}'"] * (service is not None)
    parts += [f"played_at >= {d.ts(after)}"] * (after is not None) + [f"played_at <= {d.ts(before)}"] * (before is not None)
    return " AND ".join(parts) or "1 = 1"


@plan
def stats_grouping_sets(d):
    """One pass over the records for the total and the counts by namespace, source and session."""
    return f"""SELECT namespace, source, session_id, CAST(grouping(namespace) AS INT) AS all_namespaces, CAST(grouping(source) AS INT) AS all_sources, CAST(grouping(session_id) AS INT) AS all_sessions, count(*) AS n, min(created_at) AS oldest, max(created_at) AS newest
        FROM {memories(d, 'id, namespace, source, session_id, created_at, deleted_at, expires_at')} m WHERE {active(d)}
        GROUP BY GROUPING SETS ((), (namespace), (source), (session_id))"""


@plan
def memory_stats(d):
    return f"""SELECT count(*) AS total, count(DISTINCT session_id) AS documents, count(DISTINCT namespace) AS namespaces, min(created_at) AS oldest, max(created_at) AS newest,
        count(*) FILTER (WHERE embedding_model IS NULL) AS without_vector FROM {memories(d, 'id, namespace, session_id, created_at, deleted_at, expires_at, embedding_model')} m WHERE {active(d)}"""


@plan
def namespace_counts(d):
    return f"SELECT namespace, count(*) AS n FROM {memories(d, 'id, namespace, deleted_at, expires_at')} m WHERE {active(d)} GROUP BY namespace"


def _top(d, names: str, where: str = "1 = 1", k: int = 10) -> str:
    given = " AND ".join(f"{n} IS NOT NULL" for n in names.split(", ") if n != "title")
    given = given if "artist" in names else f"{given} AND artist IS NOT NULL"
    return f"SELECT {names}, count(*) AS plays, CAST(sum(listen_ms) AS BIGINT) AS duration_ms FROM {media(d, names, where)} e WHERE {given} GROUP BY {names} ORDER BY plays DESC, {names} LIMIT {k}"


@plan
def media_stats_totals(d):
    return f"SELECT count(*) AS total_events, CAST(coalesce(sum(listen_ms), 0) AS BIGINT) AS listening_ms FROM {media(d, 'service')} e"


@plan
def media_by_service(d):
    return f"SELECT service, count(*) AS n, CAST(sum(listen_ms) AS BIGINT) AS duration_ms FROM {media(d, 'service')} e GROUP BY service"


@plan
def top_artists(d):
    return _top(d, "artist")


@plan
def top_albums(d):
    return _top(d, "album, artist")


@plan
def top_tracks(d):
    return _top(d, "title, artist")


@plan
def media_daily(d):
    return f"SELECT {d.day('played_at')} AS day, count(*) AS n, CAST(sum(listen_ms) AS BIGINT) AS duration_ms FROM {media(d, 'played_at')} e GROUP BY {d.day('played_at')}"


@plan
def media_stats_filtered(d):
    """Statistics of one service within a range of time, by client: what the six reports above look like under filters."""
    where = media_filter(d, service="spotify", after="2025-11-01 00:00:00", before="2025-11-14 23:59:59")
    return f"""WITH f AS {media(d, 'client_id, title, artist, played_at', where)}
        SELECT client_id, count(*) AS total_events, CAST(sum(listen_ms) AS BIGINT) AS listening_ms, count(DISTINCT artist) AS artists, count(DISTINCT {d.day('played_at')}) AS days FROM f GROUP BY client_id"""


@plan
def top_tracks_filtered(d):
    return _top(d, "title, artist", media_filter(d, service="ytmusic", after="2025-11-01 00:00:00"))


#: The period whose taste is described, the one before it, and where the other windows of it begin.
PERIOD, PREVIOUS, END = "2025-11-01", "2025-10-01", "2025-12-01"
_TRAILING = (("days30", "2025-11-01"), ("days90", "2025-09-02"), ("days365", "2024-12-01"))
TOP = 10
CATEGORIES = ("music", "viewing")


def is_music(artist: str = "artist", service: str = "service") -> str:
    return f"(nullif(trim({artist}), '') IS NOT NULL OR lower({service}) IN ('spotify', 'ytmusic'))"


def category(name: str) -> str:
    """Whether an event counts for a category of taste; a null service is no music service."""
    music = f"coalesce({is_music()}, false)"
    watched = "nullif(trim(show_title), '') IS NOT NULL OR season IS NOT NULL OR episode IS NOT NULL OR lower(event_type) IN ('watch', 'watched', 'view', 'viewed', 'complete', 'completed')"
    return music if name == "music" else f"(NOT {music} AND ({watched}))"


def entity(name: str) -> str:
    return "nullif(trim(artist), '')" if name == "music" else "coalesce(nullif(trim(show_title), ''), nullif(trim(title), ''))"


def _bounds(d) -> list[tuple[str, str, str]]:
    """Name, start and end of six half-open windows."""
    rows = [("period", PERIOD), ("previous", PREVIOUS), *_TRAILING, ("allTime", "0001-01-01")]
    return [(n, d.ts(a + " 00:00:00"), d.ts((PERIOD if n == "previous" else END) + " 00:00:00")) for n, a in rows]


def _windows(d) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{n}' AS win, {lo} AS lo, {hi} AS hi" for n, lo, hi in _bounds(d)) + ")"


def _counts(d, name: str) -> str:
    """Events by window and dimension for one category; every event is one row before anything is counted."""
    precision = d.json("metadata", "played_precision")
    approximate = f"({d.has_key('metadata', 'played_precision')} AND coalesce({precision} NOT IN ('exact', 'instant'), false))"
    return f"""(WITH e AS (SELECT DISTINCT id, service, {entity(name)} AS entity, genres, played_at, {approximate} AS approximate FROM media_events WHERE played_at < {d.ts(END + ' 00:00:00')} AND {category(name)}),
        w AS (SELECT win, id, service, entity, genres, approximate FROM e JOIN {_windows(d)} t ON e.played_at >= t.lo AND e.played_at < t.hi)
        SELECT '{name}' AS category, win, dimension, label, n FROM (
        SELECT win, 'total' AS dimension, 'events' AS label, count(*) AS n FROM w GROUP BY win
        UNION ALL SELECT win, 'service' AS dimension, service AS label, count(*) AS n FROM w GROUP BY win, service
        UNION ALL SELECT win, 'entity' AS dimension, entity AS label, count(*) AS n FROM w WHERE entity IS NOT NULL GROUP BY win, entity
        UNION ALL SELECT win, 'quality' AS dimension, 'missing_entity' AS label, count(*) AS n FROM w WHERE entity IS NULL GROUP BY win
        UNION ALL SELECT win, 'quality' AS dimension, 'approximate_timestamps' AS label, count(*) AS n FROM w WHERE approximate GROUP BY win
        UNION ALL SELECT win, 'genre' AS dimension, g AS label, count(DISTINCT id) AS n FROM w {d.unnest('w.genres', 'x', 'g')} WHERE nullif(trim(g), '') IS NOT NULL GROUP BY win, g) f)"""


def _taste(d) -> str:
    return "(" + " UNION ALL ".join(f"SELECT * FROM {_counts(d, name)} {name}" for name in CATEGORIES) + ")"


def _ranked(d) -> str:
    """The greatest of each window and dimension; totals and warnings are kept whole (two values at most)."""
    return f"""(SELECT category, win, dimension, label, n, pos FROM (SELECT category, win, dimension, label, n, row_number() OVER (PARTITION BY category, win, dimension ORDER BY n DESC, label) AS pos FROM {_taste(d)} c) r WHERE pos <= {TOP})"""


def taste_counts(events: DataFrame) -> DataFrame:
    """``category, win, dimension, label, n``: events are read once; each gives its facts for every window that it lies in, and one aggregation counts them."""
    flag = lambda sql: F.expr(sql)
    approximate = f"coalesce({SPARK.has_key('metadata', 'played_precision')} AND {SPARK.json('metadata', 'played_precision')} NOT IN ('exact', 'instant'), false)"
    kind = F.when(flag(category("music")), "music").when(flag(category("viewing")), "viewing")
    seen = events.where(F.expr(f"played_at < {SPARK.ts(END + ' 00:00:00')}"))
    seen = seen.select("id", "service", "genres", "played_at", kind.alias("category"), flag(entity("music")).alias("_m"), flag(entity("viewing")).alias("_v"), flag(approximate).alias("approximate")).where("category IS NOT NULL").distinct()
    seen = seen.withColumn("entity", F.when(F.col("category") == "music", F.col("_m")).otherwise(F.col("_v")))
    fact = lambda dimension, label: F.named_struct(F.lit("dimension"), F.lit(dimension), F.lit("label"), label)
    own = F.array_compact(F.array(
        fact("total", F.lit("events")), fact("service", F.col("service")), F.when(F.col("entity").isNotNull(), fact("entity", F.col("entity"))),
        F.when(F.col("entity").isNull(), fact("quality", F.lit("missing_entity"))), F.when(F.col("approximate"), fact("quality", F.lit("approximate_timestamps"))),
    ))
    genres = F.transform(F.filter(F.array_distinct(F.coalesce("genres", F.array().cast("array<string>"))), lambda g: F.coalesce(F.trim(g), F.lit("")) != ""), lambda g: fact("genre", g))
    windows = F.filter(F.array(*[F.struct(F.lit(n).alias("win"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi")) for n, lo, hi in _bounds(SPARK)]), lambda w: (F.col("played_at") >= w["lo"]) & (F.col("played_at") < w["hi"]))
    each = seen.select("category", F.explode(windows).alias("w"), F.concat(own, genres).alias("facts")).select("category", "w.win", F.explode("facts").alias("f"))
    return each.groupBy("category", "win", "f.dimension", "f.label").agg(F.count("*").alias("n"))


def taste_windows(spark, sf_dir):
    return taste_counts(table(spark, sf_dir, "media_events"))


plan.direct("taste_windows", taste_windows, f"SELECT category, win, dimension, label, n FROM {_taste(DUCK)} c")


def ranked_taste(spark, sf_dir):
    """The greatest of each window and dimension."""
    order = Window.partitionBy("category", "win", "dimension").orderBy(F.desc("n"), "label")
    return taste_windows(spark, sf_dir).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= TOP)


plan.direct("taste_topn", ranked_taste, f"SELECT category, win, dimension, label, n, pos FROM {_ranked(DUCK)} r")


def _of_ranked(name: str, statement) -> None:
    """A statement over the ranked counts, which are written once in Spark."""

    def query(spark, sf_dir):
        view = f"lorekeep_{name}"
        checkpointed(ranked_taste(spark, sf_dir)).createOrReplaceTempView(view)
        return spark.sql(f"WITH r AS (SELECT * FROM {view})" + statement(SPARK))

    plan.direct(name, query, f"WITH r AS {_ranked(DUCK)}" + statement(DUCK))


def _warnings(d, ranked: str) -> str:
    return f"""(SELECT category, label || ':' || CAST(n AS {d.text}) AS warning FROM {ranked} q WHERE win = 'period' AND dimension = 'quality' AND n > 0
        UNION ALL SELECT category, 'single_service' AS warning FROM {ranked} q WHERE win = 'period' AND dimension = 'service' GROUP BY category HAVING count(*) = 1)"""


# what limits the trust in a period: events without an entity, inexact times, one service only
_of_ranked("taste_warnings", lambda d: f" SELECT category, warning FROM {_warnings(d, 'r')} w")


def clean_label(d, x: str) -> str:
    """Control characters and white space collapsed, at most 200 characters."""
    flat = "trim(" + d.replace(x, "[" + chr(92) + "x00-" + chr(92) + "x20" + chr(92) + "x7f]+", " ") + ")"
    return f"coalesce(nullif(substr({flat}, 1, 200), ''), 'unknown')"


def evidence(d) -> str:
    """The evidence of a category's taste as numbered statements, at most 128: totals, services, entities, genres, wider windows, trends, warnings.

    A trend compares entities that are among the greatest of both periods, if both periods are large enough
    and both the count and the share have changed enough; an entity without an earlier count has no trend.
    """
    label = clean_label(d, "label")
    text = lambda x: f"CAST({x} AS {d.text})"
    thing = "CASE category WHEN 'music' THEN 'artist' ELSE 'title or show' END"
    span = "CASE win WHEN 'days30' THEN 'the trailing 30 days' WHEN 'days90' THEN 'the trailing 90 days' WHEN 'days365' THEN 'the trailing 365 days' ELSE 'all recorded time before the period end' END"
    order = "CASE win WHEN 'days30' THEN 0 WHEN 'days90' THEN 2 WHEN 'days365' THEN 4 ELSE 6 END"
    month = PERIOD[:7]
    return f""", every AS (SELECT k.category, t.win, coalesce(max(r.n), 0) AS n FROM (SELECT 'music' AS category UNION ALL SELECT 'viewing' AS category) k CROSS JOIN {_windows(d)} t
          LEFT JOIN r ON r.category = k.category AND r.win = t.win AND r.dimension = 'total' GROUP BY k.category, t.win),
        moved AS (SELECT a.category, a.label, a.pos, a.n AS now_n, b.n AS old_n, ta.n AS now_total, tb.n AS old_total FROM r a JOIN r b ON b.category = a.category AND b.dimension = 'entity' AND b.label = a.label AND b.win = 'previous'
          JOIN every ta ON ta.category = a.category AND ta.win = 'period' JOIN every tb ON tb.category = a.category AND tb.win = 'previous' WHERE a.dimension = 'entity' AND a.win = 'period' AND ta.n >= 20 AND tb.n >= 20),
        facts AS (
        SELECT category, 'total' AS kind, 0 AS part, 0 AS place, {text('n')} || ' accepted ' || category || ' events occurred in {month}.' AS statement FROM every WHERE win = 'period'
        UNION ALL SELECT category, 'service' AS kind, 1 AS part, pos AS place, {label} || ' contributed ' || {text('n')} || ' accepted events in {month}.' AS statement FROM r WHERE win = 'period' AND dimension = 'service'
        UNION ALL SELECT category, 'entity' AS kind, 2 AS part, pos AS place, {label} || ' had ' || {text('n')} || ' accepted events and is a top ' || {thing} || ' for {month}.' AS statement FROM r WHERE win = 'period' AND dimension = 'entity'
        UNION ALL SELECT category, 'genre' AS kind, 3 AS part, pos AS place, {label} || ' appeared on ' || {text('n')} || ' accepted events in {month}.' AS statement FROM r WHERE win = 'period' AND dimension = 'genre'
        UNION ALL SELECT category, 'context' AS kind, 4 AS part, {order} AS place, {text('n')} || ' accepted ' || category || ' events occurred in ' || {span} || '.' AS statement FROM every WHERE win NOT IN ('period', 'previous')
        UNION ALL SELECT category, 'context' AS kind, 4 AS part, {order} + 1 AS place, {label} || ' was the leading ' || {thing} || ' in ' || {span} || ' with ' || {text('n')} || ' accepted events.' AS statement FROM r WHERE dimension = 'entity' AND pos = 1 AND win NOT IN ('period', 'previous')
        UNION ALL SELECT category, 'trend' AS kind, 5 AS part, pos AS place, {label} || CASE WHEN now_n > old_n THEN ' increased from ' ELSE ' decreased from ' END || {text('old_n')} || ' of ' || {text('old_total')} || ' accepted events in the previous month to ' || {text('now_n')} || ' of ' || {text('now_total')} || ' in {month}.' AS statement
          FROM moved WHERE abs(now_n - old_n) >= 3 AND abs(now_n / CAST(now_total AS DOUBLE) - old_n / CAST(old_total AS DOUBLE)) >= 1e-4
        UNION ALL SELECT category, 'quality' AS kind, 6 AS part, row_number() OVER (PARTITION BY category ORDER BY warning) AS place, 'Quality warning: ' || warning || '.' AS statement FROM {_warnings(d, 'r')} w),
        numbered AS (SELECT category, kind, statement, row_number() OVER (PARTITION BY category ORDER BY part, place) AS pos FROM facts)
        SELECT category, 'E' || {d.lpad('pos', 3)} AS fact, kind, statement FROM numbered WHERE pos <= 128"""


_of_ranked("taste_trends", evidence)


@plan
def agent_activity(d):
    """How many live records of its own client each agent has, without those that another record stands for, and when the last one came."""
    columns = "agent_id, client_id, created_at, deleted_at, expires_at, access_level"
    return f"""WITH agents AS (SELECT DISTINCT agent_id, client_id FROM memories WHERE agent_id IS NOT NULL),
        m AS (SELECT id, agent_id, client_id, created_at FROM {of_content(d, columns)} c WHERE id = canonical_id AND {active(d)} AND {rank_of('access_level')} <= 1)
        SELECT a.agent_id, a.client_id, count(m.id) AS memories, max(m.created_at) AS last_at FROM agents a LEFT JOIN m ON m.agent_id = a.agent_id AND m.client_id = a.client_id GROUP BY a.agent_id, a.client_id"""


def jobs(d) -> str:
    """A queue of jobs, one for each record: stands in for the queue's own table, derived from counters and times."""
    return f"""(SELECT id AS memory_id, session_id AS document_id, created_at AS accepted_at, abs(access_count) % 6 AS attempts, client_id, deleted_at, embedding_model IS NOT NULL AS has_vector,
        CASE abs(access_count) % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'ready' WHEN 3 THEN 'deduplicated' WHEN 4 THEN 'retry_wait' WHEN 5 THEN 'embedding_failed' WHEN 6 THEN 'cancelled' END AS status,
        CASE WHEN abs(access_count) % 8 IN (4, 5, 6) THEN CASE revision % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'transient' ELSE 'input_rejected' END END AS failure_category,
        accessed_at AS next_attempt_at, updated_at AS lease_expires_at, updated_at AS finalized_at, embedding_model IS NOT NULL AS inline_ready, revision % 2 = 1 AS inline_attempted
        FROM {memories(d, 'id, session_id, created_at, access_count, client_id, accessed_at, updated_at, embedding_model, deleted_at, revision')} j)"""


LIVE = "('pending', 'retry_wait', 'processing')"


@plan
def queue_monitor(d):
    """Depth of the live states, and failures of live jobs and of those that ended within the last day."""
    now = d.ts("2026-03-01 00:00:00")
    return f"""WITH j AS {jobs(d)}, live AS (SELECT * FROM j WHERE status IN {LIVE}),
        failures AS (SELECT failure_category FROM live WHERE failure_category IS NOT NULL UNION ALL SELECT failure_category FROM j WHERE status IN ('embedding_failed', 'cancelled') AND failure_category IS NOT NULL AND finalized_at >= {d.plus(now, '-1', 'DAY')})
        SELECT 'depth' AS measure, status AS label, count(*) AS n FROM live GROUP BY status UNION ALL SELECT 'failures' AS measure, failure_category AS label, count(*) AS n FROM failures GROUP BY failure_category"""


@plan
def queue_waiting(d):
    """How long the oldest live job waits, when the next retry is due and how many documents are pending."""
    return f"""SELECT ({d.us(d.ts('2026-03-01 00:00:00'))} - {d.us('min(accepted_at)')}) / 1e6 AS oldest_pending_age_seconds, min(CASE WHEN status = 'retry_wait' THEN next_attempt_at END) AS next_retry_at, count(DISTINCT document_id) AS pending_documents
        FROM {jobs(d)} j WHERE status IN {LIVE}"""


@plan
def queue_history(d):
    """Depth of all states, attempts, and how many of the tried inline jobs were ready at once."""
    return f"""WITH j AS {jobs(d)} SELECT 'depth' AS measure, status AS label, count(*) AS n, CAST(NULL AS DOUBLE) AS rate FROM j WHERE status IS NOT NULL GROUP BY status
        UNION ALL SELECT 'attempts' AS measure, CAST(attempts AS {d.text}) AS label, count(*) AS n, CAST(NULL AS DOUBLE) AS rate FROM j GROUP BY attempts
        UNION ALL SELECT 'inline' AS measure, CAST(NULL AS {d.text}) AS label, count(*) AS n, round(count(CASE WHEN inline_ready THEN 1 END) / CAST(nullif(count(CASE WHEN inline_attempted THEN 1 END), 0) AS DOUBLE), 6) AS rate FROM j"""


def document_states(d, jobs_: str) -> str:
    """States of documents from the states of their parts; a part without a job that has a vector is ready."""
    return f"""WITH c AS (SELECT document_id, accepted_at, CASE WHEN deleted_at IS NOT NULL OR status = 'cancelled' THEN 'cancelled' WHEN status = 'embedding_failed' THEN 'failed' WHEN status IN ('ready', 'deduplicated') OR (status IS NULL AND has_vector) THEN 'ready' ELSE 'queued' END AS state
          FROM {jobs_} j WHERE document_id IS NOT NULL),
        n AS (SELECT document_id, count(*) AS chunk_count, count(CASE WHEN state = 'ready' THEN 1 END) AS ready, count(CASE WHEN state = 'queued' THEN 1 END) AS queued, count(CASE WHEN state = 'failed' THEN 1 END) AS failed, count(CASE WHEN state = 'cancelled' THEN 1 END) AS cancelled, min(CASE WHEN state = 'queued' THEN accepted_at END) AS oldest_queued_at FROM c GROUP BY document_id)
        SELECT document_id, chunk_count, ready, queued, failed, cancelled, oldest_queued_at, CASE WHEN ready = chunk_count THEN 'ready' WHEN queued = 0 AND failed > 0 THEN 'embedding_failed' ELSE 'queued' END AS state FROM n"""


@plan
def document_state(d):
    return document_states(d, jobs(d))


#: The embedding identity in use.
_CURRENT = "embedding_provider = 'fernwood' AND embedding_model = 'meadow-base' AND embedding_dimensions = 128"


@plan
def embedding_census(d):
    return f"""SELECT namespace, embedding_provider, embedding_model, embedding_dimensions, count(*) AS n
        FROM {memories(d, 'id, namespace, embedding_provider, embedding_model, embedding_dimensions, deleted_at, expires_at')} m WHERE {active(d)} GROUP BY namespace, embedding_provider, embedding_model, embedding_dimensions ORDER BY namespace, embedding_provider NULLS FIRST, embedding_model NULLS FIRST, embedding_dimensions NULLS FIRST"""


@plan
def embedding_retirement(d):
    """Whether all other identities can be given up: no live record is of another or of an unknown one."""
    unknown = "coalesce(embedding_provider, '') = '' OR coalesce(embedding_model, '') = '' OR coalesce(embedding_dimensions, 0) = 0"
    return f"""SELECT count(CASE WHEN {unknown} THEN 1 END) AS unknown_count, count(CASE WHEN {_CURRENT} THEN 1 END) AS current_count, count(CASE WHEN NOT ({unknown}) AND NOT ({_CURRENT}) THEN 1 END) AS legacy_count,
        count(CASE WHEN {_CURRENT} THEN 1 END) = count(*) AS retirement_ready FROM {memories(d, 'id, embedding_provider, embedding_model, embedding_dimensions, deleted_at, expires_at')} m WHERE {active(d)}"""


@plan
def coverage_status(d):
    return f"""SELECT namespace, CASE WHEN embedding_model IS NULL THEN 'missing' WHEN embedding_model = 'meadow-base' AND embedding_provider = 'fernwood' THEN 'current' ELSE 'other_space' END AS category, count(*) AS n
        FROM {memories(d, 'id, namespace, embedding_model, embedding_provider, deleted_at, expires_at')} m WHERE {active(d)} GROUP BY 1, 2"""


@plan
def subscription_summary(d):
    """Namespaces and deliveries of each subscription; both fan out, so each is reduced to one row before they meet.

    A key stands for a subscription, and its records for deliveries of their job's state.
    """
    n = lambda states: f"count(CASE WHEN status IN ({states}) THEN 1 END)"
    return f"""WITH s AS (SELECT DISTINCT id FROM api_keys), ns AS (SELECT id, {d.listagg('ns', ',', 'ns')} AS namespaces FROM (SELECT DISTINCT k.id, ns FROM api_keys k {d.unnest('k.namespaces', 'n', 'ns')}) x WHERE ns IS NOT NULL GROUP BY id),
        dl AS (SELECT client_id, {n("'pending', 'processing', 'retry_wait'")} AS pending, {n("'ready', 'deduplicated'")} AS delivered, {n("'embedding_failed'")} AS dead, {n("'cancelled'")} AS cancelled FROM {jobs(d)} j GROUP BY client_id)
        SELECT s.id, coalesce(ns.namespaces, '') AS namespaces, coalesce(pending, 0) AS pending, coalesce(delivered, 0) AS delivered, coalesce(dead, 0) AS dead, coalesce(cancelled, 0) AS cancelled FROM s LEFT JOIN ns ON ns.id = s.id LEFT JOIN dl ON dl.client_id = s.id"""


@plan
def archive_status(d):
    return f"""SELECT source, count(*) AS records, count(CASE WHEN embedding_model IS NOT NULL THEN 1 END) AS embedded, count(CASE WHEN deleted_at IS NOT NULL THEN 1 END) AS deleted, count(CASE WHEN content IS NULL THEN 1 END) AS empty,
        coalesce(bool_or({d.json('metadata', 'importance')} = '5'), false) AS has_priority, count(DISTINCT {d.json('metadata', 'importance')}) AS importances FROM {memories(d, 'id, source, embedding_model, deleted_at, content, metadata')} m GROUP BY source"""


@plan
def chunk_count_drift(d):
    """Sessions whose stated number of parts (their greatest revision) is not the number they have."""
    return f"""WITH c AS (SELECT session_id, count(CASE WHEN deleted_at IS NULL THEN 1 END) AS active_chunks, count(CASE WHEN deleted_at IS NOT NULL THEN 1 END) AS deleted_chunks, max(revision) AS stated FROM {memories(d, 'id, session_id, deleted_at, revision')} m WHERE session_id IS NOT NULL GROUP BY session_id)
        SELECT session_id, active_chunks, deleted_chunks, stated FROM c WHERE active_chunks IS DISTINCT FROM stated"""


@plan
def decay_summary(d):
    """Count, range, mean and upper median of the decayed relevance by namespace; the median is the one at floor(n / 2).

    Scores are counted in narrow steps first; only those of the step that holds the median are put in order.
    """
    return f"""WITH r AS (SELECT id, namespace, score, CAST(floor(score * 1e4) AS BIGINT) AS step FROM (SELECT id, namespace, {decay(d)} AS score FROM {memories(d, 'id, namespace, relevance_base_score, decay_rate, accessed_at, access_count, deleted_at, expires_at')} m WHERE {active(d)}) x),
        steps AS (SELECT namespace, step, count(*) AS k, coalesce(sum(count(*)) OVER (PARTITION BY namespace ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r GROUP BY namespace, step),
        total AS (SELECT namespace, count(*) AS n, min(score) AS least, max(score) AS most, avg(score) AS mean FROM r GROUP BY namespace),
        wanted AS (SELECT s.namespace, s.step, floor(t.n / 2) - s.before + 1 AS pos FROM steps s JOIN total t ON t.namespace = s.namespace WHERE s.before <= floor(t.n / 2) AND floor(t.n / 2) < s.before + s.k),
        o AS (SELECT r.namespace, r.score, w.pos, row_number() OVER (PARTITION BY r.namespace, r.step ORDER BY r.score, r.id) AS nth FROM r JOIN wanted w ON w.namespace = r.namespace AND w.step = r.step)
        SELECT t.namespace, t.n, round(t.least, 6) AS least, round(t.most, 6) AS most, round(t.mean, 6) AS mean, round(o.score, 6) AS median FROM total t JOIN o ON o.namespace = t.namespace AND o.nth = o.pos"""


@plan
def decay_ready(d):
    return f"SELECT count(*) AS active_rows, count(CASE WHEN relevance_base_score IS NULL THEN 1 END) AS without_base, count(CASE WHEN relevance_base_score IS NULL THEN 1 END) = 0 AS ready FROM {memories(d, 'id, relevance_base_score, deleted_at, expires_at')} m WHERE {active(d)}"


@plan
def monthly_spend(d):
    return f"SELECT {d.month('created_at')} AS month, client_id, CAST(sum(abs(access_count) * 150) AS BIGINT) AS micro_usd FROM {memories(d, 'id, client_id, created_at, access_count')} m GROUP BY 1, 2"


def duplicate_groups(d, k: int = 200) -> str:
    """Different events of one identity at one time: the first groups by time, rows that were delivered twice count once."""
    return f"""WITH e AS (SELECT DISTINCT id, client_id, service, played_at, created_at, {identity(d)} AS identity FROM (SELECT DISTINCT id, client_id, service, service_id, played_at, created_at, {', '.join(IDENTITY_FIELDS)} FROM media_events WHERE client_id IS NOT NULL) x),
        g AS (SELECT client_id, service, played_at, identity, count(*) AS group_size, min(created_at) AS first_seen FROM e GROUP BY client_id, service, played_at, identity HAVING count(*) > 1)
        SELECT client_id, service, played_at, identity, group_size, first_seen FROM g ORDER BY played_at NULLS FIRST, client_id, service, identity LIMIT {k}"""


@plan
def event_duplicates(d):
    return duplicate_groups(d)


@plan
def backfill_preview(d):
    return f"""SELECT count(*) AS n, CAST(coalesce(sum({d.bytes('m.content')}), 0) AS BIGINT) AS bytes, CAST(ceil(coalesce(sum({d.bytes('m.content')}), 0) / 4e0) AS BIGINT) AS tokens
        FROM {memories(d, 'id, content, deleted_at, expires_at')} m LEFT JOIN (SELECT DISTINCT memory_id FROM memory_entities) q ON q.memory_id = m.id WHERE q.memory_id IS NULL AND {active(d, 'm.')}"""


@plan
def graph_index_status(d):
    return f"""SELECT count(*) AS records, count(q.memory_id) AS indexed, count(CASE WHEN q.memory_id IS NULL AND {active(d, 'm.')} THEN 1 END) AS waiting FROM {memories(d, 'id, deleted_at, expires_at')} m LEFT JOIN (SELECT DISTINCT memory_id FROM memory_entities) q ON q.memory_id = m.id"""


@plan
def ordered_digest(d):
    """Order-sensitive digest of each namespace: of the digests of slices of slices of the order of ids, so that no list grows beyond a 65,536th of a namespace."""
    return f"""WITH s AS (SELECT namespace, substr(id, 1, 4) AS slice, {d.sha(d.listagg("id || ':' || revision", ',', 'id'))} AS h FROM {memories(d, 'id, namespace, revision')} m GROUP BY namespace, substr(id, 1, 4)),
        t AS (SELECT namespace, substr(slice, 1, 2) AS part, {d.sha(d.listagg('h', ',', 'slice'))} AS h FROM s GROUP BY namespace, substr(slice, 1, 2))
        SELECT namespace, {d.sha(d.listagg('h', ',', 'part'))} AS digest FROM t GROUP BY namespace"""


@plan
def shrink_guard(d):
    """An origin of at least a hundred records may not fall below nine tenths."""
    return f"""WITH o AS (SELECT source, count(*) AS old_n, count(CASE WHEN deleted_at IS NULL AND {lot(d, 8)} <> 0 THEN 1 END) AS new_n FROM {memories(d, 'id, source, deleted_at')} m GROUP BY source)
        SELECT source, old_n, new_n, old_n >= 100 AND new_n < old_n * 9e-1 AS refused FROM o"""


@plan
def purge_preview(d):
    return f"""WITH old AS (SELECT id, namespace FROM {memories(d, 'id, namespace, deleted_at')} m WHERE deleted_at <= {d.ts('2026-01-30 00:00:00')}),
        refs AS (SELECT memory_id, count(*) AS refs FROM memory_entities GROUP BY memory_id)
        SELECT old.id, old.namespace, coalesce(r.refs, 0) AS refs, coalesce(r.refs, 0) = 0 AS purgeable FROM old LEFT JOIN refs r ON r.memory_id = old.id"""


@plan
def validity_audit(d):
    from lorekeep.plans.visibility import series

    return f"""WITH s AS {series(d)} SELECT count(CASE WHEN valid_to < valid_from THEN 1 END) AS negative, count(CASE WHEN valid_from < created_at THEN 1 END) AS early, count(CASE WHEN revision < 1 THEN 1 END) AS bad_revision,
        count(CASE WHEN valid_to IS NOT NULL AND successor_id IS NULL THEN 1 END) AS no_successor, (SELECT count(*) FROM (SELECT supersedes_id FROM s WHERE supersedes_id IS NOT NULL GROUP BY supersedes_id HAVING count(*) > 1) x) AS forks FROM s"""
