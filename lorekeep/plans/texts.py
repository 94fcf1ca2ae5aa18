"""Text processing, provider records and rendering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lorekeep.operators import texts
from lorekeep.plans.dialect import Plans, memories, run
from lorekeep.session import table
from lorekeep.sources import providers

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE

_docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")

plan.direct("chunk_documents", lambda s, p: texts.chunk_documents(_docs(s, p)))
plan.direct(
    "chunks_rejoined",
    lambda s, p: texts.chunk_documents(_docs(s, p)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))), lambda x: x["chunk"]), "").alias("text"), (F.max(F.octet_length("chunk")) <= 2000).alias("within")),
    "SELECT doc_id, text, true AS within FROM documents WHERE text <> ''",
)
plan.direct("chunk_plan", lambda s, p: texts.chunk_plan(_docs(s, p)))
plan.direct(
    "chunk_plan_coverage",
    lambda s, p: texts.chunk_plan(_docs(s, p)).groupBy("doc_id").agg(F.min("core_start").alias("first_byte"), F.max("core_end").alias("bytes"), F.sum(F.col("core_end") - F.col("core_start")).alias("covered")),
    "SELECT doc_id, CAST(0 AS BIGINT) AS first_byte, CAST(strlen(text) AS BIGINT) AS bytes, CAST(strlen(text) AS BIGINT) AS covered FROM documents WHERE text IS NOT NULL",
)


def chunk_contiguity(spark, sf_dir):
    """Plans as they would be stored, held against their texts."""
    docs = _docs(spark, sf_dir)
    return texts.plan_faults(texts.chunk_plan(docs), docs).selectExpr("doc_id", "gaps + out_of_order + wrong_digests AS faults", "complete", "bytes")


plan.direct("chunk_contiguity", chunk_contiguity, "SELECT doc_id, CAST(0 AS BIGINT) AS faults, true AS complete, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")


def chunk_faults(spark, sf_dir):
    """The same for plans of which every document has lost its second part, where it has one."""
    docs = _docs(spark, sf_dir)
    return texts.plan_faults(texts.chunk_plan(docs).where("ordinal <> 1"), docs)


plan.direct("chunk_faults", chunk_faults)
plan.direct("chunk_markdown", lambda s, p: texts.chunk_markdown(_docs(s, p).where("doc_kind = 'markdown'").select("doc_id", F.concat("source", F.lit(".md")).alias("path"), "text")))
plan.direct("text_cover_rank", lambda s, p: texts.cover_rank(_docs(s, p), "cabinets warnings"))

_CUT = "string_split_regex(regexp_replace(text, '(?m)^(User|Assistant): ', chr(1) || '\\1: ', 'g'), chr(1))"
_TURNS = f"""(SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS turn, lower(regexp_extract(part, '^(User|Assistant): ', 1)) AS role, trim(regexp_replace(part, '^(User|Assistant): ', ''), ' ' || chr(10) || chr(13)) AS said
    FROM (SELECT doc_id, source AS title, unnest({_CUT}) AS part, generate_subscripts({_CUT}, 1) AS n FROM documents WHERE regexp_matches(text, '(?m)^User: ')) x WHERE regexp_matches(part, '^(User|Assistant): '))"""
_PAIRS = f"""(SELECT doc_id, title, turn, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS pair, said AS question, answer FROM (SELECT *, lead(role) OVER (PARTITION BY doc_id ORDER BY turn) AS next_role, lead(said) OVER (PARTITION BY doc_id ORDER BY turn) AS answer FROM {_TURNS} t) u WHERE role = 'user' AND next_role = 'assistant')"""

plan.direct("import_conversations", lambda s, p: texts.turns(_docs(s, p)), f"SELECT doc_id, title, CAST(turn AS INT) AS turn, role, said FROM {_TURNS} t")
plan.direct(
    "conversation_pairs", lambda s, p: texts.pairs_of_turns(texts.turns(_docs(s, p))).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(F.length("question")).alias("asked")),
    f"SELECT doc_id, count(*) AS pairs, CAST(sum(length(question)) AS BIGINT) AS asked FROM {_PAIRS} p GROUP BY doc_id",
)
plan.direct("conversation_chunks", lambda s, p: texts.conversation_chunks(texts.turns(_docs(s, p))), f"""WITH r AS (SELECT doc_id, pair, '[' || coalesce(nullif(title, ''), 'Untitled') || ']' || chr(10) || chr(10) AS head, 'User: ' || question || chr(10) || 'Assistant: ' || answer AS said FROM {_PAIRS} p),
    w AS (SELECT doc_id, sum(length(said) + 2) - 2 + max(length(head)) AS n FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n <= 4000 THEN 0 ELSE CAST(floor(pair / 5) AS BIGINT) END AS chunk, substr(max(head) || string_agg(said, chr(10) || chr(10) ORDER BY pair), 1, 4000) AS body FROM r JOIN w USING (doc_id) GROUP BY 1, 2""")  # fmt: skip
_TRIVIAL = ", ".join(f"'{x}'" for x in texts.TRIVIAL)
plan.direct("qa_pairs", lambda s, p: texts.question_pairs(texts.turns(_docs(s, p))), f"""SELECT doc_id, CAST(turn AS INT) AS turn, substr('Q: ' || question || chr(10) || chr(10) || 'A: ' || answer, 1, 4000) AS content FROM {_PAIRS} p
    WHERE trim(question) <> '' AND length(answer) >= 50 AND regexp_replace(lower(trim(question, ' ' || chr(9) || chr(13) || chr(10))), '[.!?,]', '', 'g') NOT IN ({_TRIVIAL})""")  # fmt: skip

#: Words that are no tags.
_STOP = (
    "a an the and or for in on to of with is are was were be been being how what why when where which that this from by at it its not but if do does did "
    "has have had can could will would should may might"
).split()


@plan
def name_tags(d):
    """Up to eight words of a source's name as tags: of more than two letters, without stop words."""
    cut = d.replace("lower(source)", "[^a-z0-9" + chr(92) + "s-]", "")
    if d.name == "spark":
        return f"SELECT DISTINCT source, array_join(slice(filter(split({cut}, '[\\\\s-]+'), x -> length(x) > 2 AND NOT array_contains({d.values_in(_STOP)}, x)), 1, 8), ',') AS tags FROM documents WHERE source IS NOT NULL"
    return f"SELECT DISTINCT source, array_to_string(list_filter(string_split_regex({cut}, '[\\s-]+'), lambda x: length(x) > 2 AND NOT list_contains({d.values_in(_STOP)}, x))[1:8], ',') AS tags FROM documents WHERE source IS NOT NULL"


#: Markup and what it becomes in plain text, in this order.
_MARKUP = (
    ("<h[1-6][^>]*>", "\n### "), ("</h[1-6]>", "\n"), ("<li[^>]*>", "\n- "), ("</li>", ""), ("<p[^>]*>", "\n"), ("</p>", "\n"), ("<br *\\/?>", "\n"), ("<blockquote[^>]*>", "\n> "), ("</blockquote>", "\n"),
    ("<code[^>]*>", "`"), ("</code>", "`"), ("<pre[^>]*>", "\n```\n"), ("</pre>", "\n```\n"), ("<hr *\\/?>", "\n---\n"), ("</?strong[^>]*>", "**"), ("</?em[^>]*>", "*"), ("<[^>]+>", ""),
    ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "''"), ("&emsp;", "  "), ("\n\n\n+", "\n\n"),
)


@plan
def html_to_text(d):
    body = "text"
    for pattern, by in _MARKUP:
        body = d.replace(body, "(?i)" + pattern, by)
    return f"SELECT doc_id, trim({body}, ' ' || chr(10)) AS body FROM documents WHERE doc_kind = 'html'" if d.name != "spark" else f"SELECT doc_id, btrim({body}, concat(' ', chr(10))) AS body FROM documents WHERE doc_kind = 'html'"


@plan
def entity_normalize(d):
    """Mentions in one form with enough confidence, at most fifty of a record."""
    form = "lower(trim(" + d.replace("mention", "[ ]+", " ") + "))"
    return f"""WITH x AS (SELECT DISTINCT memory_id, entity_id, {form} AS name, confidence FROM memory_entities WHERE confidence >= 5e-1), r AS (SELECT memory_id, entity_id, name, row_number() OVER (PARTITION BY memory_id ORDER BY confidence DESC, name, entity_id) AS pos FROM x WHERE name <> '' AND length(name) <= 256)
        SELECT memory_id, entity_id, name, pos FROM r WHERE pos <= 50"""


def entity_extraction(spark, sf_dir):
    """Links as raw extractions: validated, in compatibility form, aliases without repeats."""
    links = table(spark, sf_dir, "memory_entities").distinct()
    people = table(spark, sf_dir, "entities").select(F.col("id").alias("entity_id"), "entity_type", "display_name")
    contents = F.lit(None).cast("string")  # links aren't derived from contents here, so mentions can't be held against them
    return texts.extracted_entities(links.join(people, "entity_id").select("memory_id", "entity_type", "display_name", "mention", "aliases", "confidence", contents.alias("content")))


_TIDY = "trim(regexp_replace({}, '[\\s]+', ' ', 'g'))"
plan.direct("entity_extraction", entity_extraction, f"""WITH l AS (SELECT DISTINCT memory_id, entity_id, mention, aliases, confidence, namespace FROM memory_entities), r AS (SELECT l.memory_id, e.entity_type, {_TIDY.format('e.display_name')} AS display_name, coalesce(list_transform(list_filter(l.aliases, lambda a: a IS NOT NULL), lambda a: {_TIDY.format('a')}), []) AS al, l.confidence
      FROM l JOIN entities e ON e.id = l.entity_id WHERE l.confidence >= 0.5 AND e.entity_type IN ('person', 'project', 'tool', 'place')),
    n AS (SELECT *, lower(display_name) AS name, count(*) OVER (PARTITION BY memory_id, entity_type, lower(display_name)) AS times FROM r),
    g AS (SELECT *, bool_or(display_name = '' OR length(display_name) > 256 OR times > 1) OVER (PARTITION BY memory_id) AS refused, list_transform(al, lambda a: lower(a)) AS low FROM n),
    o AS (SELECT memory_id, entity_type, name AS normalized_name, display_name, list_filter(al, lambda a, i: a <> '' AND lower(a) <> name AND list_position(low, lower(a)) = i) AS aliases, confidence, row_number() OVER (PARTITION BY memory_id ORDER BY confidence DESC, name, entity_type) AS pos FROM g WHERE NOT refused)
    SELECT * FROM o WHERE pos <= 50""")  # fmt: skip


@plan
def taste_render(d):
    """The five best artists of each service as one line."""
    return f"""WITH c AS (SELECT service, artist, count(*) AS n FROM (SELECT DISTINCT id, service, artist FROM media_events WHERE nullif(trim(artist), '') IS NOT NULL) e GROUP BY service, artist), r AS (SELECT service, artist, n, row_number() OVER (PARTITION BY service ORDER BY n DESC, artist) AS pos FROM c)
        SELECT service, {d.listagg("artist || ' (' || CAST(n AS " + d.text + ") || ')'", '; ', 'pos')} AS line FROM r WHERE pos <= 5 GROUP BY service"""


_MEDIA = "SELECT DISTINCT id, service, event_type, title, artist, album, show_title, season, episode, release_year, genres, played_at, completed, duration_ms, played_ms, metadata FROM media_events"
_KIND = "CASE WHEN lower(trim(service)) = 'plex' AND plex_type = 'track' THEN 'music' WHEN lower(trim(service)) = 'plex' AND plex_type = 'episode' THEN 'tv' WHEN lower(trim(service)) = 'plex' AND plex_type = 'movie' THEN 'movie' WHEN nullif(artist, '') IS NOT NULL THEN 'music' WHEN nullif(show_title, '') IS NOT NULL OR season IS NOT NULL OR episode IS NOT NULL THEN 'tv' WHEN lower(trim(service)) IN ('spotify', 'ytmusic') AND lower(trim(event_type)) = 'play' THEN 'music' ELSE 'unknown' END"


def _typed(d) -> str:
    """Events with the type that their provider's metadata states."""
    return f"(SELECT *, lower(trim({d.json('metadata', 'plex_type')})) AS plex_type FROM ({_MEDIA}) m)"


@plan
def media_kind(d):
    return f"SELECT id, {_KIND} AS kind FROM {_typed(d)} e"


@plan
def media_summary(d):
    """One sentence for each event."""
    day = f"CAST({d.day('played_at')} AS {d.text})"
    ends = "CASE WHEN completed IS TRUE THEN ' Completed.' WHEN completed IS FALSE THEN ' Did not finish.' ELSE '' END"
    part = f"CASE WHEN season IS NOT NULL AND episode IS NOT NULL THEN ' S' || {d.lpad('CAST(season AS INT)', 2)} || 'E' || {d.lpad('CAST(episode AS INT)', 2)} ELSE '' END"
    genres = f"CASE WHEN {d.size('genres')} > 0 THEN ' Genres: ' || {d.join('genres', ', ')} || '.' ELSE '' END"
    return f"""SELECT id, CASE WHEN nullif(artist, '') IS NOT NULL THEN 'Listened to "' || title || '" by ' || artist || CASE WHEN nullif(album, '') IS NOT NULL THEN ' from "' || album || '"' ELSE '' END || ' on ' || {day} || ' via ' || service || '.' || {genres}
        WHEN nullif(show_title, '') IS NOT NULL THEN 'Watched ' || show_title || {part} || ' "' || title || '" on ' || {day} || ' via ' || service || '.' || {ends} || {genres}
        ELSE 'Watched "' || title || '"' || CASE WHEN coalesce(release_year, 0) <> 0 THEN ' (' || CAST(CAST(release_year AS INT) AS {d.text}) || ')' ELSE '' END || ' on ' || {day} || ' via ' || service || '.' || {ends} || {genres} END AS summary FROM ({_MEDIA}) e WHERE played_at IS NOT NULL"""


@plan
def media_tags(d):
    """Tags of each event: source, type, kind, and its genres unless they name another kind."""
    return f"""WITH b AS (SELECT id, service, event_type, {_KIND} AS kind, completed, genres FROM {_typed(d)} e)
        SELECT id, 'media' AS tag FROM b UNION SELECT id, service AS tag FROM b UNION SELECT id, event_type AS tag FROM b UNION SELECT id, kind AS tag FROM b UNION SELECT id, 'completed' AS tag FROM b WHERE completed IS TRUE
        UNION SELECT id, lower(trim(g)) AS tag FROM b {d.unnest('b.genres', 'x', 'g')} WHERE trim(g) <> '' AND (lower(trim(g)) NOT IN ('music', 'tv', 'movie', 'unknown') OR lower(trim(g)) = kind)"""


def canonical_events(spark, sf_dir):
    """Provider records in one shape. Events of each provider are first written as the provider would, and then mapped."""
    rows = run(spark, sf_dir, "SELECT DISTINCT id, lower(trim(service)) AS service, source_id, title, artist, album, show_title, season, episode, release_year, duration_ms, played_at FROM media_events WHERE title IS NOT NULL AND played_at IS NOT NULL")
    iso = F.concat(F.date_format("played_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    artist = F.array(F.struct(F.col("artist").alias("name")))
    track = F.struct(F.col("id").alias("uri"), F.col("title").alias("name"), artist.alias("artists"), F.struct(F.col("album").alias("name"), F.concat(F.lpad("release_year", 4, "0"), F.lit("-01-01")).alias("release_date")).alias("album"), "duration_ms")
    items = {
        "spotify": F.struct(track.alias("track"), iso.alias("played_at")),
        "plex": F.struct(
            F.col("id").alias("ratingKey"), F.when(F.col("show_title").isNotNull(), "episode").otherwise("movie").alias("type"), "title", F.col("show_title").alias("grandparentTitle"), F.col("season").alias("parentIndex"), F.col("episode").alias("index"),
            F.col("release_year").alias("year"), F.col("duration_ms").alias("duration"), F.unix_seconds(F.col("played_at").cast("timestamp")).alias("viewedAt"),
        ),
        "ytmusic": F.struct(F.col("id").alias("videoId"), "title", artist.alias("artists"), F.struct(F.col("album").alias("name")).alias("album"), F.floor(F.col("duration_ms") / 1000).alias("duration_seconds"), iso.alias("played")),
    }
    mapped = [providers.MAPPERS[name](rows.where(F.col("service") == name).select(F.to_json(item).alias("item"), F.col("source_id").alias("server_id"), F.lit("s").alias("server_name"))) for name, item in items.items()]
    return mapped[0].unionByName(mapped[1]).unionByName(mapped[2]).drop("genres", "metadata")


plan.direct("canonical_events", canonical_events, """WITH e AS (SELECT DISTINCT id, lower(trim(service)) AS service, source_id, title, artist, album, show_title, season, episode, release_year, duration_ms, played_at FROM media_events WHERE title IS NOT NULL AND played_at IS NOT NULL)
    SELECT 'spotify' AS service, NULL AS source_id, id AS service_id, 'play' AS event_type, title, nullif(artist, '') AS artist, album, NULL AS show_title, NULL AS season, NULL AS episode, release_year, duration_ms, NULL AS played_ms, CAST(NULL AS BOOLEAN) AS completed, date_trunc('milliseconds', played_at) AS played_at FROM e WHERE service = 'spotify'
    UNION ALL SELECT 'plex', source_id, CASE WHEN source_id IS NULL THEN id ELSE source_id || ':' || id END, 'watch', title, NULL, NULL, show_title, CASE WHEN show_title IS NOT NULL THEN season END, CASE WHEN show_title IS NOT NULL THEN episode END, release_year, duration_ms, duration_ms, true, date_trunc('second', played_at) FROM e WHERE service = 'plex' AND title <> ''
    UNION ALL SELECT 'ytmusic', NULL, id, 'play', title, nullif(artist, ''), album, NULL, NULL, NULL, NULL, nullif(duration_ms // 1000, 0) * 1000, nullif(duration_ms // 1000, 0) * 1000, true, date_trunc('milliseconds', played_at) FROM e WHERE service = 'ytmusic' AND title <> ''""")  # fmt: skip


@plan
def credential_scan(d):
    return f"""SELECT id FROM {memories(d, 'id, content')} m WHERE {d.matches('content', '(?i)-----BEGIN [A-Z ]*PRIVATE KEY|password[ ]*[:=]|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}')}"""


def url_sanitize(spark, sf_dir):
    """Addresses within contents, reduced to what may be kept."""
    urls = table(spark, sf_dir, "memories").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(https?://[^\s\"<>]+)"), F.lit(1))).alias("url")).distinct()
    return urls.select("id", "url", texts.sanitised(F.col("url")).alias("kept"))


plan.direct("url_sanitize", url_sanitize, rf"""WITH u AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '(https?://[^\s"<>]+)')) AS url FROM memories),
    h AS (SELECT id, url, lower(regexp_extract(url, '{texts._HOST}', 1)) AS scheme, lower(regexp_replace(regexp_extract(url, '{texts._HOST}', 2), '\.$', '')) AS host FROM u),
    l AS (SELECT *, string_split(host, '.') AS l FROM h), d AS (SELECT *, array_to_string(l[-2:], '.') IN ({', '.join(f"'{x}'" for x in texts.TWO_LABELS)}) AS two FROM l)
    SELECT id, url, CASE WHEN regexp_matches(host, '^$|^localhost$|\.(?:localhost|local)$|^[^.]*$|^[0-9.]+$|[^a-z0-9.\x{{80}}-\x{{10FFFF}}_-]|\.\.|^\.') THEN NULL WHEN two AND len(l) >= 3 THEN scheme || '://' || array_to_string(l[-3:], '.') WHEN NOT two THEN scheme || '://' || array_to_string(l[-2:], '.') END AS kept FROM d""")  # fmt: skip


def fuzzy_time(spark, sf_dir):
    """What labels of a history page mean at a fixed instant; labels come from the age of each event."""
    events = table(spark, sf_dir, "media_events").where("played_at IS NOT NULL").select("id", "played_at").distinct()
    days = F.datediff(F.lit("2025-11-22").cast("date"), F.to_date("played_at"))
    label = F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days, F.lit(" days ago"))).when(days < 14, "Last week").otherwise(F.date_format("played_at", "MMMM"))
    return texts.fuzzy_times(events.select("id", label.alias("label")), "label", dt.datetime(2025, 11, 22, 9, 30))


plan.direct("fuzzy_time", fuzzy_time, """WITH e AS (SELECT DISTINCT id, CAST(played_at AS DATE) AS day, DATE '2025-11-22' - CAST(played_at AS DATE) AS n FROM media_events WHERE played_at IS NOT NULL),
    l AS (SELECT id, n, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n < 7 THEN n || ' days ago' WHEN n < 14 THEN 'Last week' ELSE strftime(day, '%B') END AS label, CASE WHEN n < 7 THEN 'day' WHEN n < 14 THEN 'week' ELSE 'month' END AS precision,
      CASE WHEN n < 7 THEN TIMESTAMP '2025-11-22' - to_days(CAST(n AS INT)) WHEN n < 14 THEN date_trunc('week', TIMESTAMP '2025-11-15') ELSE CAST(date_trunc('month', day) AS TIMESTAMP) END AS start_at FROM e)
    SELECT id, label, start_at + CASE precision WHEN 'day' THEN INTERVAL 12 HOUR WHEN 'week' THEN INTERVAL 60 HOUR ELSE INTERVAL 348 HOUR END AS at, start_at, start_at + CASE precision WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END AS end_at, precision FROM l""")  # fmt: skip
plan.direct("content_identity_nfkc", lambda s, p: table(s, p, "memories").where("content IS NOT NULL").select("id", texts.identity_hash(F.col("content")).alias("identity")).distinct())
#: The keys of these values are few and in order, so that only blanks have to go.
plan.direct(
    "canonical_metadata_hash", lambda s, p: table(s, p, "memories").select("id", texts.canonical_json_hash(F.col("metadata")).alias("digest")).distinct(),
    "SELECT DISTINCT id, sha256(replace(replace(metadata, ': ', ':'), ', ', ',')) AS digest FROM memories",
)


def session_facts(spark, sf_dir):
    """Facts of a session by their identity: what is the same in compatibility form, white space and case set aside, counts once."""
    rows = table(spark, sf_dir, "memories").where("session_id IS NOT NULL AND content IS NOT NULL").select("session_id", "id", texts.identity_hash(F.col("content")).alias("identity")).distinct()
    return rows.groupBy("session_id", "identity").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


plan.direct("session_facts", session_facts)
