"""Idempotent writes, histories, snapshots, queues and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import admission, merges, nearpairs
from lorekeep.plans.dialect import DUCK, SPARK, Plans, active, cosine, fiftieth, identity, lot, memories, of_content, run
from lorekeep.plans.retrieval import IDENTITY, usable
from lorekeep.plans.statistics import jobs
from lorekeep.session import table

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE


@plan
def accepted_keys(d):
    return "SELECT service_id AS k FROM media_events WHERE nullif(trim(service_id), '') IS NOT NULL UNION SELECT event_key AS k FROM media_events"


def events(d, where: str = "1 = 1") -> str:
    """Events with their effective identity, each once."""
    return f"(SELECT DISTINCT id, client_id, service, coalesce(nullif(trim(source_id), ''), 'default') AS source_id, event_key, title, played_at, created_at, metadata, service_id, {identity(d)} AS ident FROM media_events WHERE {where})"


@plan
def event_identity(d):
    return f"SELECT DISTINCT id, {identity(d)} AS identity FROM media_events"


#: Events before this instant are stored, later ones arrive as a batch.
_ARRIVAL = "2025-11-01 00:00:00"


@plan
def event_upsert(d):
    """First of a batch wins; a batch's event is skipped if a stored one has its key or its identity at its time."""
    at = d.ts(_ARRIVAL)
    by_key, by_ident = "client_id, service, source_id, event_key", "client_id, service, source_id, played_at, ident"
    on = lambda alias, cols: " AND ".join(f"{alias}.{c} IS NOT DISTINCT FROM b.{c}" if c == "played_at" else f"{alias}.{c} = b.{c}" for c in cols.split(", "))
    return f"""WITH e AS {events(d)}, old AS (SELECT * FROM e WHERE created_at < {at}), k AS (SELECT DISTINCT {by_key} FROM old), i AS (SELECT DISTINCT {by_ident} FROM old),
        batch AS (SELECT *, row_number() OVER (PARTITION BY {by_key} ORDER BY created_at, id) AS nth_key, row_number() OVER (PARTITION BY {by_ident} ORDER BY created_at, id) AS nth_ident FROM e WHERE created_at >= {at})
        SELECT b.id, CASE WHEN k.event_key IS NOT NULL OR i.ident IS NOT NULL THEN 'stored' WHEN b.nth_key > 1 OR b.nth_ident > 1 THEN 'repeated' ELSE 'inserted' END AS outcome
        FROM batch b LEFT JOIN k ON {on('k', by_key)} LEFT JOIN i ON {on('i', by_ident)}"""


@plan
def bucket_suppress(d):
    """An inexact event is skipped if a stored one of its identity, without a stated bucket, lies in its bucket [start, end).

    An event that states no device stands for an inexact one; its bucket is its day.
    """
    day = d.day("played_at")
    return f"""WITH e AS (SELECT DISTINCT id, client_id, service, source_id, service_id, played_at, {d.has_key('metadata', 'device')} AS exact FROM {events(d, 'played_at IS NOT NULL')} x),
        n AS (SELECT id, client_id, service, source_id, service_id, CAST({day} AS {'TIMESTAMP_NTZ' if d.name == 'spark' else 'TIMESTAMP'}) AS bucket_start, {d.plus(f"CAST({day} AS {'TIMESTAMP_NTZ' if d.name == 'spark' else 'TIMESTAMP'})", '1', 'DAY')} AS bucket_end FROM e WHERE NOT exact AND nullif(trim(service_id), '') IS NOT NULL),
        o AS (SELECT client_id, service, source_id, service_id, played_at, {day} AS day FROM e WHERE exact),
        hit AS (SELECT DISTINCT n.id FROM n JOIN o ON o.client_id = n.client_id AND o.service = n.service AND o.source_id = n.source_id AND o.service_id = n.service_id AND o.day = {d.day('n.bucket_start')} AND o.played_at >= n.bucket_start AND o.played_at < n.bucket_end)
        SELECT n.id, hit.id IS NOT NULL AS suppressed FROM n LEFT JOIN hit ON hit.id = n.id"""


@plan
def upsert_preview(d):
    return f"""WITH e AS (SELECT DISTINCT id, client_id, service, source_id, event_key, title, played_at, created_at FROM media_events), o AS (SELECT * FROM e WHERE created_at < {d.ts('2025-11-01 00:00:00')}), n AS (SELECT * FROM e WHERE created_at >= {d.ts('2025-11-01 00:00:00')}),
        k AS (SELECT DISTINCT client_id, service, source_id, event_key FROM o), l AS (SELECT DISTINCT client_id, service, title, {d.day('played_at')} AS day FROM o WHERE played_at IS NOT NULL)
        SELECT n.id, CASE WHEN k.event_key IS NOT NULL THEN 'tuple_conflict' WHEN l.title IS NOT NULL THEN 'possible_legacy_duplicate' ELSE 'would_insert' END AS class
        FROM n LEFT JOIN k ON k.client_id = n.client_id AND k.service = n.service AND k.source_id = n.source_id AND k.event_key = n.event_key LEFT JOIN l ON l.client_id = n.client_id AND l.service = n.service AND l.title = n.title AND l.day = {d.day('n.played_at')}"""


def _keyed(spark, sf_dir):
    """Records with a source key, and a batch that holds each of them again (some changed) and a new one beside some."""
    cols = "id, client_id, source_key, content, namespace, deleted_at, superseded_at, updated_at"
    stored = run(spark, sf_dir, f"""SELECT {cols} FROM (SELECT *, lead(updated_at) OVER (PARTITION BY client_id, source_key ORDER BY created_at, id) AS superseded_at, row_number() OVER (PARTITION BY client_id, source_key ORDER BY created_at, id) AS nth
        FROM {memories(SPARK, 'id, client_id, source_key, content, namespace, deleted_at, created_at, updated_at')} m WHERE source_key IS NOT NULL) k WHERE nth = 1""")
    kinds = F.expr(lot(SPARK, 3))
    same = stored.select("client_id", "source_key", F.when(kinds == 0, F.concat(F.coalesce("content", F.lit("")), F.lit("!"))).otherwise(F.col("content")).alias("content"), "namespace", "updated_at")
    new = stored.where(kinds == 1).select("client_id", F.concat("source_key", F.lit("/new")).alias("source_key"), "content", "namespace", "updated_at")
    return stored, same.unionByName(new)


def keyed_merge(spark, sf_dir):
    """Upsert by client and source key; deleted and superseded records are not written over."""
    stored, batch = _keyed(spark, sf_dir)
    merged = merges.upsert(stored, batch, ["client_id", "source_key"])
    return merged.select("client_id", "source_key", "id", "action", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h"))


_KEYED = f"""k AS (SELECT * FROM (SELECT *, lead(updated_at) OVER (PARTITION BY client_id, source_key ORDER BY created_at, id) AS superseded_at, row_number() OVER (PARTITION BY client_id, source_key ORDER BY created_at, id) AS nth
    FROM {memories(DUCK, 'id, client_id, source_key, content, namespace, deleted_at, created_at, updated_at')} m WHERE source_key IS NOT NULL) x WHERE nth = 1)"""
plan.direct("keyed_merge", keyed_merge, f"""WITH {_KEYED} SELECT client_id, source_key, id, CASE WHEN client_id IS NULL THEN NULL WHEN deleted_at IS NULL AND superseded_at IS NULL THEN 'update' ELSE 'guarded' END AS action,
      sha256(coalesce(content, '') || CASE WHEN client_id IS NOT NULL AND deleted_at IS NULL AND superseded_at IS NULL AND {lot(DUCK, 3)} = 0 THEN '!' ELSE '' END) AS h FROM k
    UNION ALL SELECT client_id, source_key || '/new', NULL, 'insert', sha256(coalesce(content, '')) FROM k WHERE {lot(DUCK, 3)} = 1
    UNION ALL SELECT client_id, source_key, NULL, 'insert', sha256(coalesce(content, '') || CASE WHEN {lot(DUCK, 3)} = 0 THEN '!' ELSE '' END) FROM k WHERE client_id IS NULL""")  # fmt: skip


@plan
def scd2_series(d):
    """Validity of every version: it ends where the next begins, and must begin after the one before."""
    w = "PARTITION BY client_id, namespace, source, memory_kind ORDER BY valid_from, id"
    return f"""SELECT id, valid_from, lead(valid_from) OVER ({w}) AS valid_to, lag(id) OVER ({w}) AS supersedes_id, row_number() OVER ({w}) AS version FROM {memories(d, 'id, client_id, namespace, source, memory_kind, valid_from')} m WHERE valid_from IS NOT NULL"""


def patch_merge(spark, sf_dir):
    """What a patch names replaces, the rest stays; only the expected revision of a record that isn't deleted is patched. Every record gets a patch."""
    cols = "id, tags, access_level, metadata, revision, deleted_at"
    stored = run(spark, sf_dir, f"SELECT {cols} FROM {memories(SPARK, cols)} m")
    kind = F.expr(lot(SPARK, 4))
    patches = stored.select(
        "id", F.when(kind == 3, F.col("revision") - 1).otherwise(F.col("revision")).alias("expected_revision"),
        F.when(kind == 0, F.array(F.lit("access_level"))).when(kind == 1, F.array(F.lit("tags"), F.lit("metadata"))).otherwise(F.array(F.lit("metadata"))).alias("present"),
        F.lit("sensitive").alias("access_level"), F.array(F.lit("patched")).alias("tags"), F.lit(None).cast("string").alias("metadata"),
    )
    done = merges.patch(stored, patches, ["tags", "access_level", "metadata"])
    return done.select("id", F.array_join("tags", ",").alias("tags"), "access_level", "metadata", "revision", "outcome")


_L4 = lot(DUCK, 4)
plan.direct("patch_merge", patch_merge, f"""WITH m AS {memories(DUCK, 'id, tags, access_level, metadata, revision, deleted_at')}, g AS (SELECT *, {_L4} AS kind, {_L4} <> 3 AND deleted_at IS NULL AS good FROM m WHERE revision IS NOT NULL)
    SELECT id, array_to_string(CASE WHEN good AND kind = 1 THEN ['patched'] ELSE tags END, ',') AS tags, CASE WHEN good AND kind = 0 THEN 'sensitive' ELSE access_level END AS access_level, CASE WHEN good AND kind IN (1, 2) THEN NULL ELSE metadata END AS metadata,
      CAST(revision + CASE WHEN good THEN 1 ELSE 0 END AS INT) AS revision, CASE WHEN good THEN 'patched' ELSE 'conflict' END AS outcome FROM g""")  # fmt: skip


@plan
def forget_cascade(d):
    """Deleting a copy also deletes the record that stands for it."""
    return f"""WITH c AS (SELECT id, canonical_id FROM {of_content(d)} o WHERE namespace = 'finance') SELECT id FROM c UNION SELECT canonical_id AS id FROM c"""


def agent_merge(spark, sf_dir):
    """Registrations of agents: values that are given replace, the rest stays, settings are merged key by key."""
    rows = run(spark, sf_dir, "SELECT user_id, event_type, min(ts) AS first_at, max(ts) AS last_at, min_by(props, struct(ts, event_id)) AS first_props, max_by(props, struct(ts, event_id)) AS last_props FROM events GROUP BY user_id, event_type")
    stored = rows.where("user_id % 5 <> 4").select("user_id", "event_type", F.lit("old").alias("model"), F.to_json(F.struct(F.get_json_object("first_props", "$.k").alias("k"), F.lit("kept").alias("first"))).alias("metadata"), F.col("first_at").alias("last_seen_at"))
    model = F.when(F.col("user_id") % 2 == 0, "new")
    incoming = rows.select("user_id", "event_type", model.alias("model"), F.to_json(F.struct(F.get_json_object("last_props", "$.k").alias("k"), F.lit("added").alias("last"))).alias("metadata"), F.col("last_at").alias("last_seen_at"))
    done = merges.register(stored, incoming, ["user_id", "event_type"])
    return done.select("user_id", "event_type", "model", *[F.get_json_object("metadata", f"$.{k}").alias(f"m_{k}") for k in ("k", "first", "last")], "last_seen_at")


plan.direct("agent_merge", agent_merge, """WITH r AS (SELECT user_id, event_type, max(ts) AS last_at, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id, event_type)
    SELECT user_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'new' WHEN user_id % 5 <> 4 THEN 'old' END AS model, json_extract_string(props, '$.k') AS m_k, CASE WHEN user_id % 5 <> 4 THEN 'kept' END AS m_first, 'added' AS m_last, last_at AS last_seen_at FROM r""")  # fmt: skip


@plan
def import_classify(d):
    """What an import does with each record of a feed: denied, skipped (same digest), conflicted or inserted; the feed holds every record, some changed, some under a new key."""
    return f"""WITH m AS (SELECT id, client_id, source_key, namespace, {d.sha("coalesce(content, '')")} AS h, {lot(d, 3)} AS kind FROM {memories(d, 'id, client_id, source_key, namespace, content')} x WHERE source_key IS NOT NULL),
        feed AS (SELECT client_id, namespace, CASE WHEN kind = 1 THEN h || 'x' ELSE h END AS h, CASE WHEN kind = 2 THEN source_key || '/2' ELSE source_key END AS new_key FROM m),
        k AS (SELECT client_id, source_key, min(h) AS h FROM m GROUP BY client_id, source_key)
        SELECT CASE WHEN a.id IS NULL OR NOT array_contains(a.namespaces, f.namespace) THEN 'denied' WHEN k.source_key IS NULL THEN 'inserted' WHEN k.h = f.h THEN 'skipped' ELSE 'conflicted' END AS outcome, count(*) AS n
        FROM feed f LEFT JOIN api_keys a ON a.id = f.client_id AND a.enabled LEFT JOIN k ON k.client_id = f.client_id AND k.source_key = f.new_key GROUP BY 1"""


_SNAPSHOT = "id, content, source, event_at, metadata, tags"


def snapshot_equivalence(spark, sf_dir):
    """Whether a record is the same in two snapshots, null-safe and whatever two of its paths say; a vector is kept only with its content."""
    stored = run(spark, sf_dir, f"SELECT {_SNAPSHOT} FROM {memories(SPARK, _SNAPSHOT)} m")
    kind = F.expr(lot(SPARK, 4))
    later = stored.withColumns({
        "content": F.when(kind == 0, F.upper("content")).otherwise(F.col("content")), "event_at": F.when(kind == 1, F.lit(None)).otherwise(F.col("event_at")),
        "metadata": F.when((kind == 2) & F.col("metadata").isNotNull(), merges.merge_objects(F.col("metadata"), F.lit('{"snapshot": {"id": 2, "as_of": "x"}}'))).otherwise(F.col("metadata")),
    })
    return merges.snapshot_compare(stored, later, ["id"], ["content", "source", "event_at", "metadata", "tags"], ("snapshot.id", "snapshot.as_of", "snapshot"))


plan.direct("snapshot_equivalence", snapshot_equivalence, f"""WITH m AS (SELECT *, {_L4} AS kind FROM {memories(DUCK, _SNAPSHOT)} m)
    SELECT id, NOT (kind = 0 AND coalesce(upper(content) <> content, false)) AND NOT (kind = 1 AND event_at IS NOT NULL) AS same, NOT (kind = 0 AND coalesce(upper(content) <> content, false)) AS keep_vector FROM m""")  # fmt: skip


@plan
def snapshot_prune(d):
    """Records of the old generation that the new one doesn't hold."""
    return f"""WITH m AS {memories(d, 'id, source, created_at')}, n AS (SELECT id FROM m WHERE {lot(d, 16)} <> 0) SELECT m.id, m.source FROM m LEFT JOIN n ON n.id = m.id WHERE n.id IS NULL"""


@plan
def ttl_purge(d):
    """What expired by namespace, and the one audit row of the purge (a null namespace) with the batches it takes."""
    return f"""WITH x AS (SELECT namespace, count(*) AS purged, min(expires_at) AS oldest FROM {memories(d, 'id, namespace, expires_at')} m WHERE expires_at <= {d.ts('2026-03-01 00:00:00')} GROUP BY namespace)
        SELECT 'namespace' AS entry, namespace, purged, oldest, CAST(NULL AS BIGINT) AS batches FROM x UNION ALL SELECT 'audit' AS entry, CAST(NULL AS {d.text}) AS namespace, CAST(coalesce(sum(purged), 0) AS BIGINT) AS purged, min(oldest) AS oldest, CAST(ceil(coalesce(sum(purged), 0) / 5e1) AS BIGINT) AS batches FROM x"""


#: The most standing queries that one record is delivered to; one more is reported as cut.
MOST_MATCHES = 100
LEAST = 0.8
_STANDING = "client_id, namespace, session_id, created_at, threshold, exclude_self, live, shown"


def _standing(d) -> str:
    """Records with the threshold and the self-exclusion that they have as standing queries of their owner."""
    once = "" if d.name == "spark" else "DISTINCT "  # where pairs are made, rows that were delivered twice are one anyway
    return f"""SELECT {once}id, embedding, {', '.join(IDENTITY)}, client_id, namespace, session_id, created_at, 8e-1 + (revision % 3) * 5e-2 AS threshold, revision % 2 = 1 AS exclude_self,
        {active(d)} AS live, {active(d)} AND coalesce(access_level, 'normal') = 'normal' AS shown FROM memories m WHERE {usable(d)}"""


def _received(near: str) -> str:
    """What an enabled key's standing queries receive: records of its own namespaces, at or above their threshold, on request not its own."""
    return f"""(SELECT x.a_id AS subscription_id, x.b_id AS memory_id, x.b_session_id AS session_id, x.b_namespace AS namespace, x.a_created_at AS since, x.b_created_at AS created_at, x.sim FROM {near} x JOIN api_keys k ON k.id = x.a_client_id
        WHERE k.enabled AND array_contains(k.namespaces, x.b_namespace) AND x.a_live AND x.b_shown AND x.sim >= x.a_threshold AND (NOT x.a_exclude_self OR x.b_client_id <> x.a_client_id))"""


def _near_standing() -> str:
    names = ["id", *_STANDING.split(", ")]
    both = ", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in names)
    sim = f"round({cosine(DUCK, 'a.embedding', 'b.embedding')}, 12)"
    return f"(WITH r AS ({_standing(DUCK)}) SELECT {both}, {sim} AS sim FROM (SELECT * FROM r WHERE {fiftieth(DUCK)}) a JOIN r b ON {' AND '.join(f'a.{c} = b.{c}' for c in IDENTITY)} AND a.id <> b.id WHERE {sim} >= {LEAST})"


def _matched(name: str, sql: str) -> None:
    """A query over what standing queries receive, in both engines."""

    def query(spark, sf_dir):
        view = f"lorekeep_standing_{name}"
        rows = run(spark, sf_dir, f"SELECT id, embedding, {', '.join(IDENTITY)}, {_STANDING} FROM ({_standing(SPARK)}) s WHERE live OR {fiftieth(SPARK)}")
        nearpairs.near_pairs(rows, IDENTITY, LEAST, fiftieth(SPARK)).createOrReplaceTempView(view)
        return run(spark, sf_dir, sql.format(received=_received(view), pending=_pending(SPARK), sessions=_sessions(SPARK)))

    plan.direct(name, query, sql.format(received=_received(_near_standing()), pending=_pending(DUCK), sessions=_sessions(DUCK)))


def _pending(d) -> str:
    """When the first standing query without a vector began to wait, by owner, namespace and self-exclusion (at most one row each)."""
    return f"""(SELECT k.id AS owner, ns AS namespace, exclude_self, min(created_at) AS since FROM (SELECT DISTINCT id, client_id, created_at, revision % 2 = 1 AS exclude_self FROM memories m WHERE embedding IS NULL AND {active(d)} AND {fiftieth(d)}) s
        JOIN (SELECT k.id, ns FROM api_keys k {d.unnest('k.namespaces', 'n', 'ns')} WHERE k.enabled) k ON k.id = s.client_id GROUP BY k.id, ns, exclude_self)"""


def _sessions(d) -> str:
    return f"""(SELECT session_id, min(namespace) AS namespace, min(client_id) AS client_id, max(created_at) AS inserted_at FROM {memories(d, 'id, session_id, namespace, client_id, created_at, deleted_at, expires_at')} m WHERE session_id IS NOT NULL AND {active(d)} GROUP BY session_id)"""


# the hundred standing queries that come closest to a record, which is when it is delivered to them
_matched("subscription_match", f"""WITH r AS (SELECT subscription_id, memory_id, sim, row_number() OVER (PARTITION BY memory_id ORDER BY sim DESC, subscription_id) AS pos FROM {{received}} x) SELECT subscription_id, memory_id, round(sim, 6) AS sim, pos FROM r WHERE pos <= {MOST_MATCHES}""")

# records that more standing queries match than are delivered to
_matched("subscription_truncated", f"SELECT memory_id, namespace, count(*) AS n, count(*) > {MOST_MATCHES} AS truncated FROM {{received}} x GROUP BY memory_id, namespace")

# parts match for their session, which counts once with its best part and only for older queries; a session waits while an older query that could receive it has no vector
_matched("subscription_match_chunks", f"""WITH waiting AS (SELECT DISTINCT s.session_id FROM {{sessions}} s JOIN {{pending}} p ON p.namespace = s.namespace AND p.since < s.inserted_at AND (NOT p.exclude_self OR p.owner <> s.client_id)),
        best AS (SELECT x.subscription_id, x.session_id, max(x.sim) AS sim FROM {{received}} x JOIN {{sessions}} s ON s.session_id = x.session_id AND x.since < s.inserted_at LEFT JOIN waiting w ON w.session_id = x.session_id WHERE w.session_id IS NULL GROUP BY x.subscription_id, x.session_id),
        r AS (SELECT subscription_id, session_id, sim, row_number() OVER (PARTITION BY session_id ORDER BY sim DESC, subscription_id) AS pos FROM best)
        SELECT subscription_id, session_id, round(sim, 6) AS sim, pos FROM r WHERE pos <= {MOST_MATCHES}""")  # fmt: skip


@plan
def claimable_jobs(d):
    at = d.ts("2026-01-01 00:00:00")
    return f"""SELECT memory_id, status, attempts FROM {jobs(d)} j WHERE attempts < 5 AND (status = 'pending' OR (status = 'retry_wait' AND (next_attempt_at IS NULL OR next_attempt_at <= {at})) OR (status = 'processing' AND lease_expires_at <= {at})) ORDER BY coalesce(next_attempt_at, accepted_at), memory_id LIMIT 500"""


@plan
def claim_batch(d):
    """The oldest open job brings the other jobs of its session."""
    return f"""WITH o AS (SELECT memory_id, document_id, accepted_at FROM {jobs(d)} j WHERE status = 'pending' AND document_id IS NOT NULL), seed AS (SELECT document_id FROM o ORDER BY accepted_at, memory_id LIMIT 1)
        SELECT o.memory_id, o.document_id FROM o JOIN seed ON seed.document_id = o.document_id ORDER BY o.accepted_at, o.memory_id LIMIT 16"""


#: How a provider's answer is classed; anything else passes over.
_FAILURES = "CASE WHEN code IN (55, 57, 40) THEN 'db_contention' WHEN code = 429 THEN 'rate_limited' WHEN code IN (401, 403) THEN 'provider_auth' WHEN code IN (400, 404, 413, 422) THEN 'input_rejected' ELSE 'transient' END"


@plan
def job_transition(d):
    """What a job becomes: ready at once, or by the class of its failure waiting again, pending again or failed for good.

    Rejected input ends a job; a provider's refusal never does; the first contention in a row costs no attempt. The answer's
    code is derived from the record's counter.
    """
    code = "CASE attempts WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 WHEN 3 THEN 413 WHEN 4 THEN 40 ELSE 500 END"
    return f"""WITH j AS (SELECT memory_id, status, attempts, inline_ready, inline_attempted, {code} AS code FROM {jobs(d)} j), c AS (SELECT *, {_FAILURES} AS class FROM j)
        SELECT memory_id, status, attempts, class, CASE WHEN status IN ('pending', 'retry_wait') THEN 'processing' WHEN status <> 'processing' THEN status WHEN inline_ready AND code = 429 THEN 'ready' WHEN class = 'db_contention' AND inline_attempted THEN 'pending' WHEN class = 'db_contention' THEN 'retry_wait'
          WHEN class = 'input_rejected' OR (class <> 'provider_auth' AND attempts >= 5) THEN 'embedding_failed' ELSE 'retry_wait' END AS next_status, CASE WHEN status = 'processing' AND class = 'db_contention' AND NOT inline_attempted THEN greatest(0, attempts - 1) ELSE attempts END AS next_attempts FROM c"""


def ladder(attempts: str, asked: str = "NULL") -> str:
    """Seconds until the next attempt: a step of the ladder by the attempts made, or longer if the other side asked for that; at most half a day."""
    return f"CAST(least(43200, greatest(CASE greatest(least({attempts}, 5), 1) WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 1800 WHEN 4 THEN 7200 ELSE 43200 END, coalesce({asked}, 0))) AS BIGINT)"


def doubling(attempts: str) -> str:
    return f"CAST(least(3600, 15 * power(2, {attempts})) AS BIGINT)"


@plan
def retry_schedule(d):
    """The ladder of waits without jitter, and the doubling one."""
    return f"SELECT memory_id, attempts, {ladder('attempts')} AS ladder_s, {ladder('attempts', 'asked_s')} AS asked_ladder_s, {doubling('attempts')} AS doubling_s FROM (SELECT memory_id, attempts, CASE WHEN attempts = 2 THEN 900 END AS asked_s FROM {jobs(d)} j WHERE status = 'retry_wait') r"


@plan
def rate_windows(d):
    return f"SELECT user_id, {d.minute('ts')} AS minute, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY user_id, {d.minute('ts')}"


@plan
def rate_cleanup(d):
    """Counters that are older than the retention: minutes by their instant, days by their date."""
    now, days = d.ts("2024-01-25 12:00:00"), 14
    return f"""SELECT 'minute' AS counter, user_id, count(DISTINCT {d.minute('ts')}) AS removed FROM events WHERE {d.minute('ts')} < {d.plus(now, f'-{days}', 'DAY')} GROUP BY user_id
        UNION ALL SELECT 'day' AS counter, user_id, count(DISTINCT {d.day('ts')}) AS removed FROM events WHERE {d.day('ts')} < {d.day(d.plus(now, f'-{days}', 'DAY'))} GROUP BY user_id"""


def rate_admission(spark, sf_dir):
    return admission.admit(table(spark, sf_dir, "events"), per_minute=1, per_day=20)


#: With one request a minute, the first of each minute are admitted until the day has its twenty.
plan.direct("rate_admission", rate_admission, """WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS pos, dense_rank() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY date_trunc('minute', ts)) AS nth FROM events)
    SELECT event_id, coalesce(user_id IS NOT NULL AND ts IS NOT NULL AND pos = 1 AND nth <= 20, false) AS admitted FROM r""")  # fmt: skip


@plan
def rate_admission_minute(d):
    """With one limit the first of each window are admitted, which a window function tells."""
    return f"""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, {d.minute('ts')} ORDER BY ts, event_id) AS pos FROM events) SELECT event_id, pos <= 1 AS admitted FROM r"""


@plan
def cursor_advance(d):
    """Pages of a connector: where each begins and ends; an end must lie beyond the one before.

    Events are numbered within their day, and days by what came before them, so no task numbers all events of a service.
    """
    return f"""WITH e AS (SELECT service, {d.day('played_at')} AS day, played_at, id FROM (SELECT DISTINCT service, played_at, id FROM media_events WHERE played_at IS NOT NULL) x),
        days AS (SELECT service, day, coalesce(sum(n) OVER (PARTITION BY service ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT service, day, count(*) AS n FROM e GROUP BY service, day) c),
        p AS (SELECT service, CAST(floor((before + pos - 1) / 50e0) AS BIGINT) AS page, max(played_at) AS cursor_at, count(*) AS n FROM (SELECT e.service, e.day, e.played_at, row_number() OVER (PARTITION BY e.service, e.day ORDER BY e.played_at, e.id) AS pos FROM e) r JOIN days USING (service, day) GROUP BY 1, 2)
        SELECT service, page, cursor_at, n, coalesce(cursor_at > lag(cursor_at) OVER (PARTITION BY service ORDER BY page), true) AS advanced FROM p"""


@plan
def connector_watermark(d):
    """The latest time among eligible events of a source; others don't move it."""
    return "SELECT service, client_id, max(CASE WHEN completed IS TRUE THEN played_at END) AS watermark, count(*) AS events FROM (SELECT DISTINCT id, service, client_id, completed, played_at FROM media_events) e GROUP BY service, client_id"


@plan
def latest_per_key(d):
    return "SELECT user_id, event_type, max(ts) AS ts, max_by(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type"


@plan
def rollup_pending(d):
    """Oldest events that no record stands for."""
    return "SELECT id, service, title, played_at FROM (SELECT DISTINCT id, service, title, played_at, memory_id FROM media_events) e WHERE memory_id IS NULL AND played_at IS NOT NULL ORDER BY played_at, id LIMIT 50"


@plan
def event_stream_counts(d):
    return f"SELECT event_type, {d.day('ts')} AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type, {d.day('ts')}"


def month_bounds(label: str) -> tuple[str, str]:
    """First day of a calendar month ``YYYY-MM`` and of the next."""
    year, month = map(int, label.split("-"))
    if not 1 <= month <= 12 or len(label) != 7:
        raise ValueError("a month is written YYYY-MM")
    return f"{year:04d}-{month:02d}-01 00:00:00", f"{year + month // 12:04d}-{month % 12 + 1:02d}-01 00:00:00"


def local_month(spark, sf_dir, label: str = "2026-03"):
    """Where a calendar month begins and ends in the zone of each feed, as instants of UTC, and its first instant as that zone writes it."""
    begins, ends = (f"CAST(to_utc_timestamp(TIMESTAMP '{t}', zone) AS TIMESTAMP_NTZ)" for t in month_bounds(label))
    return run(spark, sf_dir, f"""SELECT feed_id, {begins} AS month_start, {ends} AS month_end, date_format(from_utc_timestamp({begins}, zone), 'MMM d, yyyy') AS written FROM (SELECT feed_id, coalesce(source_timezone, 'UTC') AS zone FROM media_feeds) f""")


_BEGINS, _ENDS = (f"timezone('UTC', timezone(zone, TIMESTAMP '{t}'))" for t in month_bounds("2026-03"))
plan.direct("local_month", local_month, f"SELECT feed_id, {_BEGINS} AS month_start, {_ENDS} AS month_end, 'Mar 1, 2026' AS written FROM (SELECT feed_id, coalesce(source_timezone, 'UTC') AS zone FROM media_feeds) f")
