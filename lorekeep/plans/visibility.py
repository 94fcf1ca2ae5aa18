"""Scans, scope and lifecycle filters."""

from __future__ import annotations

from lorekeep.plans.dialect import DUCK, SPARK, Plans, active, ceiling_of, lot, memories, of_content, rank_of, run
from lorekeep.sources import feeds

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE

_CURRENT_FROM = "id, namespace, source, memory_kind, source_key, client_id, valid_from, created_at, deleted_at, expires_at, access_level, revision"


def series(d) -> str:
    """Records with the validity that their successors give them: one series per client, namespace, source and kind."""
    w = "PARTITION BY client_id, namespace, source, memory_kind ORDER BY valid_from, id"
    return f"""(SELECT {_CURRENT_FROM}, lead(valid_from) OVER ({w}) AS valid_to, lead(id) OVER ({w}) AS successor_id, lag(id) OVER ({w}) AS supersedes_id
        FROM {memories(d, _CURRENT_FROM)} s WHERE valid_from IS NOT NULL
        UNION ALL SELECT {_CURRENT_FROM}, CAST(NULL AS {"TIMESTAMP_NTZ" if d.name == "spark" else "TIMESTAMP"}) AS valid_to, CAST(NULL AS {d.text}) AS successor_id, CAST(NULL AS {d.text}) AS supersedes_id
        FROM {memories(d, _CURRENT_FROM)} s WHERE valid_from IS NULL)"""


@plan
def scan_memories(d):
    return f"SELECT id, namespace, source, created_at, {d.size('tags')} AS n_tags FROM {memories(d, 'id, namespace, source, created_at, tags')} m"


@plan
def scan_media_events(d):
    return "SELECT DISTINCT id, service, event_type, title, artist, played_at FROM media_events"


@plan
def scan_media_imports(d):
    return "SELECT DISTINCT import_id, feed_id, service, played_at, received_at FROM media_imports"


@plan
def scan_media_feeds(d):
    return "SELECT feed_id, service, client_id, coalesce(source_timezone, 'UTC') AS zone, day_first FROM media_feeds"


@plan
def scan_entities(d):
    return "SELECT id, namespace, entity_type, normalized_name, display_name FROM entities"


@plan
def scan_memory_entities(d):
    return f"SELECT DISTINCT memory_id, entity_id, mention, {d.size('aliases')} AS n_aliases, confidence FROM memory_entities"


@plan
def scan_api_keys(d):
    return f"SELECT id, lower(trim(client_name)) AS client_name, {d.join('namespaces', ',')} AS namespaces, {d.join('permissions', ',')} AS permissions, max_access_level, enabled, expires_at FROM api_keys"


@plan
def scan_documents(d):
    return f"SELECT doc_id, lower(trim(lang)) AS lang, source, doc_kind, {d.bytes('text')} AS bytes, created_at FROM documents"


@plan
def recall_by_id(d):
    """Lookup by id through the alias of an exact copy: a content's least id is canonical within a namespace."""
    return f"""SELECT m.id, m.canonical_id, t.namespace FROM {of_content(d)} m JOIN {memories(d, 'id, namespace, deleted_at, expires_at')} t ON t.id = m.canonical_id WHERE {active(d, 't.')}"""


@plan
def recall_document(d):
    """All visible parts of a session in order."""
    return f"""SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS chunk_index
        FROM {memories(d, 'id, session_id, created_at, deleted_at, expires_at')} m WHERE session_id IS NOT NULL AND {active(d)}"""


@plan
def export_feed(d):
    """Transfer records of one namespace with their canonical fields and origin."""
    return f"""SELECT id, coalesce(source_key, 'export:' || id) AS source_key, source, namespace, coalesce(access_level, 'normal') AS access_level, created_at, updated_at,
        event_at, memory_kind, valid_from, expires_at, {d.join('tags', ',')} AS tags, {d.sha("coalesce(content, '')")} AS content_hash, o.instance AS origin_instance
        FROM {memories(d, 'id, content, source_key, source, namespace, access_level, created_at, updated_at, event_at, memory_kind, valid_from, expires_at, deleted_at, tags')} m
        CROSS JOIN (SELECT 'instance-1' AS instance) o WHERE namespace = 'work' AND {active(d)}"""


@plan
def export_keyset(d):
    """A page after a cursor of time and id; one more row than the page tells that there is more."""
    return f"""WITH page AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS n FROM (
          SELECT id, created_at FROM {memories(d, 'id, created_at, deleted_at, expires_at')} m
          WHERE {active(d)} AND (created_at > {d.ts('2025-01-01 00:00:00')} OR (created_at = {d.ts('2025-01-01 00:00:00')} AND id > '8'))
          ORDER BY created_at, id LIMIT 101) p)
        SELECT id, created_at, n, (SELECT count(*) > 100 FROM page) AS has_more FROM page WHERE n <= 100"""


@plan
def keyset_page(d):
    return f"""SELECT event_id, ts, user_id FROM events WHERE ts > {d.ts('2024-01-10 00:00:00')} OR (ts = {d.ts('2024-01-10 00:00:00')} AND event_id > 5) ORDER BY ts, event_id LIMIT 500"""


@plan
def snapshot_coverage(d):
    """Per origin: records, chunks and whether any content is missing."""
    return f"""SELECT source AS origin, count(*) AS records, count(content) AS with_content, count(DISTINCT namespace) AS namespaces,
        CASE WHEN count(content) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM {memories(d, 'id, source, namespace, content')} m GROUP BY source"""


def snapshot_reconcile(spark, sf_dir):
    """An archive's records against its trailer, which states one record more than there is for every third origin."""
    records = run(spark, sf_dir, f"SELECT source FROM {memories(SPARK, 'id, source')} m")
    trailer = run(spark, sf_dir, f"SELECT source AS origin, count(*) + CASE WHEN {lot(SPARK, 3, 'source')} = 0 THEN 1 ELSE 0 END AS records FROM {memories(SPARK, 'id, source')} m GROUP BY source")
    return feeds.reconcile(records, trailer)


plan.direct("snapshot_reconcile", snapshot_reconcile, f"SELECT source AS origin, count(*) + CASE WHEN {lot(DUCK, 3, 'source')} = 0 THEN 1 ELSE 0 END AS stated, count(*) AS found, {lot(DUCK, 3, 'source')} <> 0 AS complete FROM {memories(DUCK, 'id, source')} m GROUP BY source")


@plan
def file_sync_diff(d):
    """Two states of a watched folder by path and hash: what is new, changed, removed or the same. Both states come from all documents."""
    return f"""WITH f AS (SELECT doc_id, text, {lot(d, 6, 'doc_id')} AS kind FROM documents), old_files AS (SELECT doc_id, {d.sha("coalesce(text, '')")} AS h FROM f WHERE kind <> 0),
        new_files AS (SELECT doc_id, {d.sha("CASE WHEN kind = 1 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END")} AS h FROM f WHERE kind <> 2)
        SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.h = n.h THEN 'skip' ELSE 'update' END AS action
        FROM old_files o FULL OUTER JOIN new_files n ON o.doc_id = n.doc_id"""


#: What keys ask for: nothing, or a few namespaces of which some may not be theirs.
_REQUESTS = {"all": [], "some": ["work", "my-life", "nowhere"]}


@plan
def scope_filter(d):
    """What each enabled key sees: the requested namespaces that it may see, or all of them but the private archive, which must be asked for."""
    asked = " UNION ALL ".join(f"SELECT '{name}' AS request, {d.values_in(x) if x else ('array()' if d.name == 'spark' else '[]')} AS wanted" for name, x in [("some", _REQUESTS["some"])])
    return f"""WITH keys AS (SELECT k.id AS key_id, ns FROM api_keys k {d.unnest('k.namespaces', 'n', 'ns')} WHERE k.enabled), r AS ({asked}),
        scope AS (SELECT key_id, 'all' AS request, ns FROM keys WHERE ns <> 'my-life' UNION ALL SELECT key_id, request, ns FROM keys JOIN r ON array_contains(r.wanted, keys.ns)),
        counts AS (SELECT namespace, count(*) AS n FROM {memories(d, 'id, namespace')} m GROUP BY namespace)
        SELECT key_id, request, CAST(sum(n) AS BIGINT) AS visible FROM scope JOIN counts ON counts.namespace = scope.ns GROUP BY key_id, request"""


@plan
def access_ceiling(d):
    return f"""SELECT k.id AS key_id, count(*) AS visible FROM api_keys k JOIN {memories(d, 'id, client_id, access_level')} m
        ON m.client_id = k.id AND {rank_of('m.access_level')} <= {ceiling_of('k.max_access_level')} GROUP BY k.id"""


@plan
def active_rows(d):
    return f"SELECT id, namespace FROM {memories(d, 'id, namespace, deleted_at, expires_at')} m WHERE {active(d)}"


@plan
def current_rows(d):
    return f"SELECT id, namespace FROM {series(d)} m WHERE {active(d)} AND valid_to IS NULL AND (valid_from IS NULL OR valid_from <= {d.ts('2026-03-01 00:00:00')})"


@plan
def eligible_parents(d):
    return f"""SELECT id FROM {series(d)} m WHERE {active(d)} AND (valid_to IS NULL OR valid_to > {d.ts('2026-03-01 00:00:00')}) AND (valid_from IS NULL OR valid_from <= {d.ts('2026-03-01 00:00:00')})"""


@plan
def valid_at(d):
    """What was valid at an instant, without what was part of another record then: a copy is, from when it appears until it is deleted."""
    at = d.ts("2025-09-01 00:00:00")
    return f"""WITH s AS {series(d)},
        parts AS (SELECT id AS member_id, created_at AS consolidated_at, deleted_at AS deconsolidated_at FROM {of_content(d, 'created_at, deleted_at')} c WHERE id <> canonical_id)
        SELECT s.id FROM s WHERE s.deleted_at IS NULL AND (s.valid_from IS NULL OR s.valid_from <= {at}) AND (s.valid_to IS NULL OR s.valid_to > {at})
          AND NOT EXISTS (SELECT 1 FROM parts c WHERE c.member_id = s.id AND c.consolidated_at <= {at} AND (c.deconsolidated_at IS NULL OR c.deconsolidated_at > {at}))"""


@plan
def tags_all(d):
    return f"SELECT id FROM {memories(d, 'id, tags')} m WHERE {d.contains_all('tags', ['index', 'index'])}"


@plan
def json_filter(d):
    return f"SELECT id, {d.json('metadata', 'importance')} AS importance FROM {memories(d, 'id, metadata')} m WHERE {d.json('metadata', 'importance')} IN ('3', '4', '5')"


@plan
def json_key_present(d):
    return f"SELECT id, {d.has_key('metadata', 'importance')} AS present FROM {memories(d, 'id, metadata')} m"


@plan
def event_range(d):
    """An upper bound given as a date covers that day."""
    return f"SELECT id, event_at FROM {memories(d, 'id, event_at')} m WHERE event_at >= {d.ts('2025-01-01 00:00:00')} AND event_at < {d.ts('2025-07-01 00:00:00')}"


@plan
def search_filters(d):
    return f"""SELECT id FROM {memories(d, 'id, source, created_at')} m WHERE source = 'chat' AND created_at >= {d.ts('2025-01-01 00:00:00')} AND created_at <= {d.ts('2026-01-01 00:00:00')}"""


@plan
def browse_state(d):
    now = d.ts("2026-03-01 00:00:00")
    return f"""SELECT id, CASE WHEN expires_at IS NOT NULL AND expires_at <= {now} THEN 'expired' WHEN valid_to IS NOT NULL THEN 'superseded' ELSE 'active' END AS state
        FROM {series(d)} m WHERE deleted_at IS NULL"""


@plan
def forget_select(d):
    """Selection to forget: all conditions hold, the bound in time is exclusive; more than a hundred are refused by the caller."""
    return f"""SELECT id FROM {memories(d, 'id, namespace, tags, created_at, deleted_at')} m
        WHERE namespace = 'media' AND created_at < {d.ts('2025-06-01 00:00:00')} AND deleted_at IS NULL AND {d.contains_all('tags', ['index'])} ORDER BY id LIMIT 101"""


@plan
def with_provenance(d):
    return f"""SELECT m.id, k.client_name, m.agent_id, coalesce(k.id = 'd781233f-e51f-4247-a064-adf73948f288', false) AS same_key_as_requester
        FROM {memories(d, 'id, client_id, agent_id')} m LEFT JOIN api_keys k ON m.client_id = k.id"""


@plan
def supersession_links(d):
    """Predecessor and successor, each only if it may be seen."""
    return f"""WITH s AS {series(d)}, seen AS (SELECT id FROM s WHERE {active(d)} AND {rank_of('access_level')} <= 1)
        SELECT s.id, p.id AS predecessor_id, n.id AS successor_id FROM s LEFT JOIN seen p ON p.id = s.supersedes_id LEFT JOIN seen n ON n.id = s.successor_id"""


@plan
def valid_keys(d):
    return f"SELECT id, lower(trim(client_name)) AS client_name FROM api_keys WHERE enabled AND (expires_at IS NULL OR expires_at > {d.ts('2026-03-01 00:00:00')})"
