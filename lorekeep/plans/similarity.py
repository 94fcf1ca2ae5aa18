"""Similarity joins, duplicates and clusters of the reference's own kind, windows and graphs (2.6, 2.7).

Pairs are only formed within an equality block (namespace, level, embedding identity), never
across the table. Spark finds them with matrix products over parts of a block; the SQL
counterparts join the block with itself, which small tables allow.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import chunks, clustering, graph, nearpairs
from lorekeep.plans.dialect import DUCK, SPARK, Plans, active, cosine, decay, memories, of_content, rank_of, run
from lorekeep.plans.retrieval import IDENTITY, SPACE, usable
from lorekeep.plans.visibility import series
from lorekeep.session import checkpointed, table

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE

_NOW = "2026-03-01 00:00:00"
#: Parts of documents and episodes are no duplicates of a record.
_WHOLE = "coalesce(memory_kind, '') NOT IN ('document_chunk', 'episode_chunk')"
#: Cosines that count as a duplicate, as worth a contradiction check, and as the same insight.
DUPLICATE, CONTRADICTION, CONSOLIDATION = 0.95, 0.85, 0.92


def current(d) -> str:
    """Neither superseded nor not yet valid, nor a copy that another record of its content stands for."""
    return f"(valid_to IS NULL AND (valid_from IS NULL OR valid_from <= {d.ts(_NOW)}) AND NOT consolidated)"


def records(d) -> str:
    """Live records with a usable vector and with what decides who may take part; vectors aren't shuffled to find out that a row was delivered twice.

    A record without a source key belongs to no series, so nothing supersedes it.
    ``duplicates`` may be the target of a store-time duplicate, ``insights`` take part in consolidation and
    ``claims`` can be contradicted.
    """
    narrow = f"id, namespace, access_level, memory_kind, source_key, {d.sha('content')} AS h, valid_from, expires_at, created_at, {decay(d)} AS relevance"
    return f"""(WITH once AS (SELECT DISTINCT {narrow} FROM memories m WHERE {active(d)}), s AS (SELECT id, valid_to FROM {series(d)} v WHERE source_key IS NOT NULL),
        c AS (SELECT namespace, h, min(id) AS canonical_id FROM once WHERE h IS NOT NULL AND source_key IS NULL GROUP BY namespace, h),
        m AS (SELECT once.*, s.valid_to, source_key IS NULL AND coalesce(c.canonical_id <> once.id, false) AS consolidated FROM once LEFT JOIN s ON s.id = once.id LEFT JOIN c ON c.namespace = once.namespace AND c.h = once.h),
        v AS (SELECT id, embedding, {', '.join(IDENTITY)} FROM memories x WHERE {usable(d)} AND {active(d)})
        SELECT m.id, m.namespace, coalesce(m.access_level, 'normal') AS level, v.embedding, {', '.join('v.' + c for c in IDENTITY)}, m.created_at, m.relevance,
          m.source_key IS NULL AND m.expires_at IS NULL AND {current(d)} AND {_WHOLE} AS duplicates,
          m.access_level = 'normal' AND m.memory_kind = 'semantic' AND {current(d)} AND m.source_key IS NULL AS insights,
          m.access_level = 'normal' AND m.memory_kind = 'semantic' AND {current(d)} AS claims FROM m JOIN v ON v.id = m.id)"""


_BLOCK = ["namespace", "level", *IDENTITY]


def near(spark, sf_dir, least: float, columns: str, only: str = "true", asks: str = "true"):
    """``a_<column>, b_<column>, sim`` of near records of a namespace, level and identity, in both directions."""
    rows = run(spark, sf_dir, f"SELECT id, embedding, {', '.join(_BLOCK)}, {columns} FROM {records(SPARK)} r WHERE {only}")
    return nearpairs.near_pairs(rows, _BLOCK, least, asks)


def near_sql(least: float, columns: str, only: str = "true") -> str:
    """The same as a join of each block with itself."""
    names = ["id", *columns.split(", ")]
    sim = f"round({cosine(DUCK, 'a.embedding', 'b.embedding')}, 12)"
    both = ", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in names)
    return f"""(WITH r AS (SELECT DISTINCT * FROM {records(DUCK)} r WHERE {only}) SELECT a.namespace, {both}, {sim} AS sim FROM r a JOIN r b ON {' AND '.join(f'b.{c} = a.{c}' for c in _BLOCK)} AND b.id <> a.id WHERE {sim} >= {least})"""


def _pairs(name: str, sql: str, least: float, columns: str, only: str = "true") -> None:
    """A query over near pairs, in both engines."""

    def query(spark, sf_dir):
        near(spark, sf_dir, least, columns, only).createOrReplaceTempView(f"lorekeep_near_{name}")
        return spark.sql(sql.format(near=f"lorekeep_near_{name}"))

    query.__name__ = name
    globals()[name] = query
    plan.direct(name, query, sql.format(near=near_sql(least, columns, only)))


# the stored record that an incoming one repeats: the most similar, then the most relevant, then the oldest
_pairs("nearest_duplicate", """WITH p AS (SELECT a_id, b_id, sim, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_relevance DESC, b_created_at, b_id) AS pos FROM {near} p WHERE b_duplicates)
        SELECT a_id, b_id, round(sim, 6) AS sim FROM p WHERE pos = 1""", DUPLICATE, "duplicates, relevance, created_at")  # fmt: skip

# the five claims that come closest to a record of any kind
_pairs("contradiction_candidates", """WITH p AS (SELECT a_id, b_id, sim, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) AS pos FROM {near} p WHERE b_claims)
        SELECT a_id, b_id, round(sim, 6) AS sim, pos FROM p WHERE pos <= 5""", CONTRADICTION, "claims")  # fmt: skip

# neighbours that come after their anchor in order; the anchor itself is the first of at most 21
_pairs("similar_pairs", """WITH p AS (SELECT a_id, b_id, sim, 1 + row_number() OVER (PARTITION BY a_id ORDER BY b_created_at, b_id) AS pos FROM {near} p WHERE b_created_at > a_created_at OR (b_created_at = a_created_at AND b_id > a_id))
        SELECT a_id, b_id, round(sim, 6) AS sim, pos FROM p WHERE pos <= 21""", CONSOLIDATION, "created_at", "insights")  # fmt: skip

_pairs("pairwise_sim", "SELECT namespace, a_id, b_id, round(sim, 6) AS sim FROM {near} p WHERE a_id < b_id", CONSOLIDATION, "created_at", "insights")


def _session_chunks(spark, sf_dir):
    """Records of a session as the parts of a document: parents, their manifests and their chunks, from the input tables."""
    rows = run(spark, sf_dir, f"""SELECT session_id, id, content, embedding, access_level, namespace, revision, created_at, {active(SPARK)} AS live, {usable(SPARK)} AND {SPACE} AS has_vector
        FROM {memories(SPARK, 'session_id, id, content, embedding, embedding_provider, embedding_model, embedding_dimensions, access_level, namespace, revision, created_at, deleted_at, expires_at')} m WHERE session_id IS NOT NULL""")
    return chunks.from_parts(rows.where("live"), "session_id")


def chunk_duplicate(spark, sf_dir):
    """Documents that repeat another: one chunk each and near enough, or the same source."""
    parents, manifests, parts = _session_chunks(spark, sf_dir)
    return chunks.duplicates(parents, manifests, parts, DUPLICATE)


_PARTS = f"""parts AS (SELECT session_id, id, namespace, coalesce(content, '') AS content, embedding, {active(DUCK)} AS live, {usable(DUCK)} AND {SPACE} AS has_vector, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS ordinal
        FROM {memories(DUCK, 'session_id, id, content, namespace, embedding, embedding_provider, embedding_model, embedding_dimensions, created_at, deleted_at, expires_at')} m WHERE session_id IS NOT NULL AND {active(DUCK)}),
        docs AS (SELECT session_id AS id, min(namespace) AS namespace, count(*) AS chunk_count, bool_and(coalesce(has_vector, false)) AS complete, {DUCK.sha("string_agg(content, chr(10) ORDER BY ordinal)")} AS source_sha256 FROM parts GROUP BY session_id)"""
plan.direct("chunk_duplicate", chunk_duplicate, f"""WITH {_PARTS}, ok AS (SELECT * FROM docs WHERE complete), v AS (SELECT k.id, k.namespace, k.chunk_count, k.source_sha256, p.embedding FROM ok k JOIN parts p ON p.session_id = k.id)
        SELECT a.id AS a_id, b.id AS b_id, round(max({cosine(DUCK, 'a.embedding', 'b.embedding')}), 6) AS sim FROM v a JOIN v b ON b.namespace = a.namespace AND a.id <> b.id AND ((a.chunk_count = 1 AND b.chunk_count = 1) OR a.source_sha256 = b.source_sha256)
        GROUP BY a.id, b.id HAVING round(max({cosine(DUCK, 'a.embedding', 'b.embedding')}), 12) >= {DUPLICATE}""")  # fmt: skip


@plan
def tag_union(d):
    """Tags of a record and of its exact copy in order of first sight."""
    return f"""WITH m AS {memories(d, 'id, namespace, content, tags')}, c AS (SELECT namespace, content, min(id) AS first_id FROM m WHERE content IS NOT NULL GROUP BY namespace, content HAVING count(*) > 1)
        SELECT m.id, {d.union_tags('k.tags', 'm.tags')} AS tags FROM c JOIN m k ON k.id = c.first_id JOIN m ON m.namespace = c.namespace AND m.content = c.content AND m.id <> c.first_id"""


@plan
def anchors_page(d):
    """The next anchors of consolidation after a cursor of time and id."""
    at = d.ts("2025-06-01 00:00:00")
    return f"SELECT DISTINCT id, created_at FROM {records(d)} m WHERE insights AND (created_at > {at} OR (created_at = {at} AND id > '0')) ORDER BY created_at, id LIMIT 200"


@plan
def embedding_readiness(d):
    """How many live records could be consolidated, and how many have an unknown or another embedding identity."""
    unknown = "embedding IS NULL OR embedding_provider IS NULL OR embedding_model IS NULL OR embedding_dimensions IS NULL"
    return f"""SELECT namespace, count(*) AS records, count(CASE WHEN embedding IS NOT NULL AND {SPACE} THEN 1 END) AS eligible, count(CASE WHEN {unknown} THEN 1 END) AS unknown, count(CASE WHEN NOT ({unknown}) AND NOT ({SPACE}) THEN 1 END) AS foreign_space
        FROM {memories(d, 'id, namespace, embedding, embedding_provider, embedding_model, embedding_dimensions, access_level, memory_kind, source_key, deleted_at, expires_at')} m WHERE {active(d)} AND access_level = 'normal' AND memory_kind = 'semantic' AND source_key IS NULL GROUP BY namespace"""


@plan
def cluster_key(d):
    """A key of every group of copies that doesn't depend on their order: a digest of their ids with their fingerprints under a policy."""
    member = f"lower(id) || ':' || {d.sha("coalesce(tags, '') || '|' || CAST(revision AS " + d.text + ")")}"
    return f"""WITH m AS (SELECT DISTINCT id, namespace, {d.sha('content')} AS h, {d.join('tags', ',')} AS tags, revision FROM memories WHERE content IS NOT NULL), g AS (SELECT namespace, h, count(*) AS n FROM m GROUP BY namespace, h HAVING count(*) BETWEEN 2 AND 20),
        k AS (SELECT m.namespace, m.h, max(g.n) AS n, {d.listagg(member, chr(10), member)} AS members FROM m JOIN g ON g.namespace = m.namespace AND g.h = m.h GROUP BY m.namespace, m.h)
        SELECT namespace, n, 'memory-consolidation:v1:' || {d.sha("'policy' || chr(10) || members")} AS source_key FROM k"""


@plan
def canonical_tags(d):
    """At most 99 different tags in order, and the mark of a consolidated record, put in order with them."""
    mark = "'consolidated'"
    if d.name == "spark":
        tags = f"array_sort(array_union(slice(array_sort(array_remove(array_distinct(tags), {mark})), 1, 99), array({mark})))"
    else:
        tags = f"list_sort(list_append(list_sort(list_filter(list_distinct(tags), lambda x: x <> {mark}))[1:99], {mark}))"
    return f"SELECT id, {d.join(tags, ',')} AS tags FROM {memories(d, 'id, tags')} m WHERE tags IS NOT NULL"


@plan
def membership_intervals(d):
    """Copies belong to the least id of their content from when they appear until they are deleted."""
    return f"""SELECT canonical_id, id AS member_id, created_at AS consolidated_at, deleted_at AS deconsolidated_at FROM {of_content(d, 'created_at, deleted_at')} c WHERE id <> canonical_id"""


@plan
def content_identity(d):
    """Identity of a content: white space and case set aside."""
    return f"SELECT namespace, {d.sha('lower(trim(' + d.replace('content', '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+', ' ') + '))')} AS identity, count(*) AS n, min(id) AS first_id FROM {memories(d, 'id, namespace, content')} m WHERE content IS NOT NULL GROUP BY 1, 2"


def _insight_pairs(spark, sf_dir):
    return checkpointed(near(spark, sf_dir, CONSOLIDATION, "created_at", "insights").where("a_id < b_id").selectExpr("namespace", "a_id", "b_id", "a_created_at", "b_created_at", "sim"))


def complete_link_clusters(spark, sf_dir):
    return clustering.complete_link(_insight_pairs(spark, sf_dir))


plan.direct("complete_link_clusters", complete_link_clusters)


def cluster_violations(spark, sf_dir):
    """Clusters of which some pair is below the threshold: there must be none, whatever number of clusters there is."""
    similar = _insight_pairs(spark, sf_dir)
    return clustering.violations(clustering.complete_link(similar), similar)


plan.direct("cluster_violations", cluster_violations, "SELECT CAST(0 AS BIGINT) AS violations")


@plan
def reflection_sample(d):
    """Recent and active records, interleaved, each once. Each ranking is limited by itself, so no task passes on more than its own first twenty."""
    first = lambda key, k: f"SELECT id, namespace, {k} AS k FROM (SELECT id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY {key} DESC, id) AS n FROM m) r WHERE n <= 20"
    return f"""WITH m AS (SELECT id, namespace, created_at, access_count FROM {memories(d, 'id, namespace, created_at, access_count, deleted_at, expires_at')} x WHERE {active(d)}),
        u AS ({first('created_at', '2 * n - 1')} UNION ALL {first('access_count', '2 * n')}),
        o AS (SELECT id, namespace, min(k) AS k FROM u GROUP BY id, namespace), p AS (SELECT id, namespace, k, row_number() OVER (PARTITION BY namespace ORDER BY k, id) AS pos FROM o)
        SELECT namespace, id, k, pos FROM p WHERE pos <= 30"""


def within_budget(rows: str, slice_: str, order: str, n: str, most: int) -> str:
    """``namespace, id, upto`` of rows in order while the running sum of ``n`` stays within the budget.

    Sums of slices of the order tell which slices can hold such rows; only these are summed row by row, each in its own task.
    """
    ahead = "" if "DESC" not in order else " DESC"
    return f"""WITH r AS (SELECT *, {slice_} AS slice FROM {rows}), t AS (SELECT namespace, slice, coalesce(sum(sum({n})) OVER (PARTITION BY namespace ORDER BY slice{ahead} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r GROUP BY namespace, slice),
        p AS (SELECT r.namespace, r.id, CAST(t.before + sum(r.{n}) OVER (PARTITION BY r.namespace, r.slice ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r JOIN t ON t.namespace = r.namespace AND t.slice = r.slice WHERE t.before <= {most})
        SELECT namespace, id, upto FROM p WHERE upto <= {most}"""


@plan
def byte_budget_page(d):
    """Records of each namespace in order of id while their bytes stay within the budget."""
    rows = f"(SELECT DISTINCT id, namespace, least(coalesce({d.bytes('content')}, 0), 1048576) AS n FROM memories)"
    return within_budget(rows + " m", "substr(id, 1, 3)", "r.id", "n", 30_000)


@plan
def browse_page(d):
    """Best of each namespace first, then of all: third page of twenty by access count."""
    return f"""WITH r AS (SELECT id, namespace, access_count, row_number() OVER (PARTITION BY namespace ORDER BY access_count DESC, id DESC) AS pos FROM {memories(d, 'id, namespace, access_count, deleted_at, expires_at')} m WHERE {active(d)})
        SELECT id, namespace, access_count FROM r WHERE pos <= 60 ORDER BY access_count DESC, id DESC LIMIT 20 OFFSET 40"""


@plan
def list_page(d):
    return f"SELECT id, created_at FROM {memories(d, 'id, created_at, deleted_at, expires_at')} m WHERE {active(d)} ORDER BY created_at DESC, id LIMIT 20 OFFSET 20"


@plan
def prompt_budget(d):
    """Taken in order, newest first, until the first record that would exceed the cap; nothing after it."""
    rows = f"(SELECT DISTINCT id, namespace, created_at, coalesce({d.bytes('content')}, 0) + 64 AS n FROM memories WHERE deleted_at IS NULL AND created_at IS NOT NULL)"
    return within_budget(rows + " m", d.day("created_at"), "r.created_at DESC, r.id", "n", 20_000)


@plan
def series_predecessor(d):
    return f"""WITH r AS (SELECT client_id, source, id, valid_from, row_number() OVER (PARTITION BY client_id, source ORDER BY valid_from DESC NULLS LAST, id) AS pos FROM {memories(d, 'id, client_id, source, valid_from, deleted_at')} m WHERE deleted_at IS NULL) SELECT client_id, source, id, valid_from FROM r WHERE pos = 1"""


@plan
def orphan_files(d):
    """Parts of the first hundred sessions of which some part was deleted."""
    return f"""WITH m AS {memories(d, 'id, session_id, deleted_at')}, g AS (SELECT session_id FROM m WHERE session_id IS NOT NULL GROUP BY session_id HAVING count(deleted_at) > 0 ORDER BY session_id LIMIT 101)
        SELECT m.session_id, m.id FROM m JOIN g ON g.session_id = m.session_id"""


@plan
def authorized_deliveries(d):
    """Links of records to people that an enabled key may read."""
    return f"""SELECT m.id, k.id AS key_id, e.entity_type, count(*) AS links FROM {memories(d, 'id, namespace, client_id')} m JOIN (SELECT DISTINCT memory_id, entity_id FROM memory_entities) l ON l.memory_id = m.id JOIN entities e ON e.id = l.entity_id
        JOIN api_keys k ON k.id = m.client_id WHERE k.enabled AND array_contains(k.namespaces, m.namespace) GROUP BY m.id, k.id, e.entity_type"""


@plan
def trace_list(d):
    return f"SELECT e.event_id, e.event_type, k.client_name FROM events e LEFT JOIN (SELECT client_name, row_number() OVER (ORDER BY id) AS n FROM api_keys) k ON k.n = e.user_id"


@plan
def visible_entities(d):
    """Entities with a link to a record that may be seen."""
    return f"""SELECT e.id, e.namespace, e.entity_type FROM entities e WHERE EXISTS (SELECT 1 FROM memory_entities l JOIN {memories(d, 'id, deleted_at, expires_at')} m ON m.id = l.memory_id WHERE l.entity_id = e.id AND {active(d, 'm.')})"""


@plan
def genre_counts(d):
    return f"SELECT lower(trim(g)) AS genre, count(DISTINCT id) AS n FROM (SELECT DISTINCT id, genres FROM media_events) e {d.unnest('e.genres', 'x', 'g')} WHERE trim(g) <> '' GROUP BY 1"


#: Whom the named graph queries ask for, in its normal form.
ASKED = "karim"


def _links(spark, sf_dir):
    """Links whose record may be seen, with the aliases that were found for them."""
    seen = run(spark, sf_dir, f"SELECT DISTINCT id AS memory_id FROM memories m WHERE {active(SPARK)} AND {rank_of('access_level')} <= 1")
    return table(spark, sf_dir, "memory_entities").join(seen, "memory_id", "left_semi")


def _named(spark, sf_dir) -> str:
    """A name that has several links: the one that the most entities share, then the first."""
    top = run(spark, sf_dir, "SELECT normalized_name FROM entities GROUP BY normalized_name ORDER BY count(*) DESC, normalized_name LIMIT 1").first()
    return top[0] if top else ASKED


_NAMED_SQL = "(SELECT normalized_name FROM entities GROUP BY normalized_name ORDER BY count(*) DESC, normalized_name LIMIT 1)"


def graph_seeds(spark, sf_dir):
    """Entities of a name, or with an alias of that form, that a visible record links to."""
    return graph.seeds(table(spark, sf_dir, "entities"), _links(spark, sf_dir), _named(spark, sf_dir)).orderBy("namespace", "entity_type", "normalized_name", "id").limit(100)


_SEEN = f"(SELECT DISTINCT id AS memory_id FROM memories m WHERE {active(DUCK)} AND {rank_of('access_level')} <= 1)"
_LINKS = f"links AS (SELECT DISTINCT l.memory_id, l.entity_id FROM memory_entities l JOIN {_SEEN} s ON s.memory_id = l.memory_id)"
_ORDER = "namespace, entity_type, normalized_name, id"
_SEEDS = rf"""{_LINKS}, al AS (SELECT DISTINCT entity_id FROM (SELECT l.entity_id, lower(trim(regexp_replace(unnest(l.aliases), '\s+', ' ', 'g'))) AS alias FROM memory_entities l JOIN {_SEEN} s ON s.memory_id = l.memory_id) a WHERE alias = {_NAMED_SQL}),
    s AS (SELECT id, namespace, entity_type, normalized_name FROM entities e WHERE id IN (SELECT entity_id FROM links) AND (normalized_name = {_NAMED_SQL} OR id IN (SELECT entity_id FROM al)) ORDER BY {_ORDER} LIMIT 100)"""
plan.direct("graph_seeds", graph_seeds, f"WITH {_SEEDS} SELECT id, namespace, entity_type, normalized_name FROM s")


def _graph(spark, sf_dir):
    links, entities = _links(spark, sf_dir).select("memory_id", "entity_id").distinct(), table(spark, sf_dir, "entities")
    return links, graph.bounded_walk(graph.seeds(entities, _links(spark, sf_dir), _named(spark, sf_dir)), links, entities, depth=2)


plan.direct("graph_bfs", lambda spark, sf_dir: _graph(spark, sf_dir)[1].select("id", "depth", "truncated"))
_STEP = "SELECT DISTINCT e.id, e.namespace, e.entity_type, e.normalized_name FROM {0} f JOIN links a ON a.entity_id = f.id JOIN links b ON b.memory_id = a.memory_id JOIN entities e ON e.id = b.entity_id WHERE e.id NOT IN (SELECT id FROM s){1}"
_DEPTHS = f"""WITH {_SEEDS}, n0 AS (SELECT count(*) AS n FROM s), one_all AS ({_STEP.format('s', '')}),
    one AS (SELECT id, namespace, entity_type, normalized_name FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pos FROM one_all) x, n0 WHERE pos <= 100 - n0.n), n1 AS (SELECT n0.n + (SELECT count(*) FROM one) AS n FROM n0),
    two_all AS ({_STEP.format('one', ' AND e.id NOT IN (SELECT id FROM one)')}),
    two AS (SELECT id FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pos FROM two_all) x, n1 WHERE pos <= 100 - n1.n),
    walked AS (SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two),
    cut AS (SELECT (SELECT count(*) FROM one_all) > (SELECT count(*) FROM one) OR (SELECT count(*) FROM two_all) > (SELECT count(*) FROM two) AS truncated)"""
ORACLE["graph_bfs"] = _DEPTHS + " SELECT id, CAST(depth AS INTEGER) AS depth, truncated FROM walked, cut"


def graph_memories(spark, sf_dir):
    """Records that link to the entities that were reached, oldest first; one more than the bound tells that there are more."""
    links, walked = _graph(spark, sf_dir)
    found = links.join(F.broadcast(walked.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi").select(F.col("memory_id").alias("id")).distinct()
    return table(spark, sf_dir, "memories").select("id", "created_at").join(found, "id", "left_semi").distinct().orderBy("created_at", "id").limit(501)


plan.direct("graph_memories", graph_memories, _DEPTHS + " SELECT DISTINCT m.id, m.created_at FROM links l JOIN memories m ON m.id = l.memory_id WHERE l.entity_id IN (SELECT id FROM walked) ORDER BY m.created_at, m.id LIMIT 501")


def graph_edges(spark, sf_dir):
    """Links between the entities and the records of the two queries above."""
    links, walked = _graph(spark, sf_dir)
    kept = graph_memories(spark, sf_dir).limit(500).select(F.col("id").alias("memory_id"))
    between = links.join(F.broadcast(walked.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi").join(F.broadcast(kept), "memory_id", "left_semi")
    return between.select("entity_id", "memory_id").orderBy("memory_id", "entity_id").limit(1001)


plan.direct("graph_edges", graph_edges, _DEPTHS + ", kept AS (SELECT DISTINCT m.id, m.created_at FROM links l JOIN memories m ON m.id = l.memory_id WHERE l.entity_id IN (SELECT id FROM walked) ORDER BY m.created_at, m.id LIMIT 500) SELECT entity_id, memory_id FROM links WHERE entity_id IN (SELECT id FROM walked) AND memory_id IN (SELECT id FROM kept) ORDER BY memory_id, entity_id LIMIT 1001")


def ancestor_chain(spark, sf_dir):
    """All predecessors of each record within its series, by doubling the distance walked each round."""
    links = run(spark, sf_dir, f"SELECT id, supersedes_id FROM {series(SPARK)} s WHERE supersedes_id IS NOT NULL")
    return graph.chain_depth(links)


plan.direct("ancestor_chain", ancestor_chain, f"""WITH s AS {series(DUCK)} SELECT id, count(*) OVER (PARTITION BY client_id, namespace, source, memory_kind ORDER BY valid_from, id) - 1 AS depth,
    first_value(id) OVER (PARTITION BY client_id, namespace, source, memory_kind ORDER BY valid_from, id) AS root FROM s WHERE valid_from IS NOT NULL QUALIFY depth > 0""")


@plan
def agent_parent(d):
    """One hop up a self-reference: the agent of the same client with the next smaller name."""
    return f"""WITH a AS (SELECT DISTINCT client_id, agent_id FROM memories WHERE agent_id IS NOT NULL), p AS (SELECT client_id, agent_id, lag(agent_id) OVER (PARTITION BY client_id ORDER BY agent_id) AS parent_id FROM a)
        SELECT c.client_id, c.agent_id, q.agent_id AS parent FROM p c LEFT JOIN p q ON q.client_id = c.client_id AND q.agent_id = c.parent_id"""
