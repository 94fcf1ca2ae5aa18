"""Ranked retrieval: vectors, text, decay, fusion, as calls of the search entry with fixed requests.

The SQL counterparts are statements of their own, written against the definitions and not generated from the search's plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep import search
from lorekeep.operators import chunks, nearpairs
from lorekeep.plans.dialect import DUCK, SPARK, Plans, active, cosine, decay, fiftieth, memories, rank_of, run
from lorekeep.session import checkpointed, table

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE

TERMS = ["ticket", "vault"]
SPACE = "embedding_provider = 'fernwood' AND embedding_model = 'meadow-base' AND embedding_dimensions = 128"
OTHER_SPACE = "embedding_provider = 'fernwood' AND embedding_model = 'brook-mini' AND embedding_dimensions = 64"
IDENTITY = ["embedding_provider", "embedding_model", "embedding_dimensions"]
_COLUMNS = "id, namespace, content, embedding, embedding_provider, embedding_model, embedding_dimensions, access_level, deleted_at, expires_at, relevance_base_score, decay_rate, accessed_at, access_count, source, created_at"
BASE, MINI = search.Space("fernwood", "meadow-base", 128), search.Space("fernwood", "brook-mini", 64)


def usable(d) -> str:
    return f"{d.size('embedding')} = embedding_dimensions AND {d.dot('embedding', 'embedding')} > 0 AND {d.dot('embedding', 'embedding')} < 1e300"


def visible(d, where: str = "1 = 1", columns: str = _COLUMNS) -> str:
    return f"(SELECT {columns} FROM {memories(d, columns)} v WHERE {active(d)} AND {rank_of('access_level')} <= 1 AND {where})"


def probe(d, space: str = SPACE) -> str:
    """The vector of the least visible id of a space stands for the query."""
    return f"(SELECT embedding AS qv FROM memories WHERE {space} AND {usable_q(d, space)} ORDER BY id LIMIT 1)"


def usable_q(d, space: str) -> str:
    return usable(d).replace("embedding_dimensions", space.rsplit("= ", 1)[1])


def vectors(d, space: str = SPACE, where: str = "1 = 1", k: int = 50) -> str:
    return f"(SELECT m.id, {cosine(d, 'm.embedding', 'q.qv')} AS sim FROM {visible(d, space + ' AND ' + usable(d) + ' AND ' + where)} m, {probe(d, space)} q ORDER BY sim DESC, m.id LIMIT {k})"


def text_scores(d, where: str = "1 = 1") -> str:
    """Records that hold all terms, by the share of their words that are terms."""
    return f"""(SELECT id, {d.count_in('t', TERMS)} / CAST(greatest({d.size('t')}, 1) AS DOUBLE) AS score FROM (SELECT id, {d.tokens('content')} AS t FROM {visible(d, 'content IS NOT NULL AND ' + where)} x) y
        WHERE {d.distinct_in('t', TERMS)} = {len(TERMS)})"""


def _searched(d) -> str:
    once = "" if d.name == "spark" else "DISTINCT "  # where pairs are made, rows that were delivered twice are one anyway
    return f"SELECT {once}id, embedding, {', '.join(IDENTITY)} FROM memories m WHERE {active(d)} AND {rank_of('access_level')} <= 1 AND {usable(d)}"


def vector_topk(spark, sf_dir):
    """The ten nearest of every query's own space; about every fiftieth record, by a digest of its id, is a query, against all."""
    rows = run(spark, sf_dir, _searched(SPARK))
    return nearpairs.near_top(rows, IDENTITY, 10, fiftieth(SPARK)).select(F.col("a_id").alias("query_id"), F.col("b_id").alias("id"), F.round("sim", 6).alias("sim"), "pos")


def _vector_topk_sql() -> str:
    sim = f"round({cosine(DUCK, 'm.embedding', 'q.embedding')}, 12)"
    return f"""WITH r AS ({_searched(DUCK)}), s AS (SELECT q.id AS query_id, m.id, {sim} AS sim, row_number() OVER (PARTITION BY q.id ORDER BY {sim} DESC, m.id) AS pos FROM r m JOIN (SELECT * FROM r WHERE {fiftieth(DUCK)}) q ON {' AND '.join(f'm.{c} = q.{c}' for c in IDENTITY)} AND m.id <> q.id)
        SELECT query_id, id, round(sim, 6) AS sim, pos FROM s WHERE pos <= 10"""


plan.direct("vector_topk", vector_topk, _vector_topk_sql())


def records(spark, sf_dir, *more: str):
    return table(spark, sf_dir, "memories").select(*_COLUMNS.split(", "), *more)


def _vector(spark, sf_dir, space: str) -> list[float]:
    """One vector, which a caller would bring along; the first direction if there is none."""
    found = run(spark, sf_dir, f"SELECT qv FROM {probe(SPARK, space)} p").first()
    return found["qv"] if found else [1.0] + [0.0] * (int(space.rsplit("= ", 1)[1]) - 1)


def request(spark, sf_dir, mini: bool = False, **more) -> search.Request:
    """The fixed request of the named queries: two words and a vector, all namespaces, up to sensitive records."""
    vectors = {BASE: _vector(spark, sf_dir, SPACE)} | ({MINI: _vector(spark, sf_dir, OTHER_SPACE)} if mini else {})
    return search.Request(**{"text": " ".join(TERMS), "vectors": vectors, "allowed": None, "ceiling": "sensitive", **more})


def vector_multi_space(spark, sf_dir):
    asked = request(spark, sf_dir, mini=True)
    visible = search.eligible(records(spark, sf_dir), asked)
    found = [search.vector_candidates(visible, s, v, 50).select(F.lit(name).alias("space"), "id", F.round("sim", 6).alias("sim")) for (s, v), name in zip(asked.vectors.items(), ("base", "mini"))]
    return found[0].unionByName(found[1])


plan.direct("vector_multi_space", vector_multi_space, f"SELECT 'base' AS space, id, round(sim, 6) AS sim FROM {vectors(DUCK)} a UNION ALL SELECT 'mini' AS space, id, round(sim, 6) AS sim FROM {vectors(DUCK, OTHER_SPACE)} b")


def text_topk(spark, sf_dir):
    """Best twenty by text among those that the vectors did not find."""
    asked = request(spark, sf_dir)
    visible = search.eligible(records(spark, sf_dir), asked)
    near = search.vector_candidates(visible, BASE, asked.vectors[BASE], 50)
    return search.text_candidates(visible, asked.text, 20, search.share_of_terms, near).select("id", F.round("score", 6).alias("score"))


plan.direct("text_topk", text_topk, f"WITH v AS {vectors(DUCK)}, t AS {text_scores(DUCK)} SELECT t.id, round(t.score, 6) AS score FROM t LEFT JOIN v ON v.id = t.id WHERE v.id IS NULL ORDER BY t.score DESC, t.id LIMIT 20")


def fts_candidates(spark, sf_dir):
    """The bounded text entry: at most a hundred, in the order of rank and id."""
    asked = request(spark, sf_dir)
    return search.bounded_text_search(search.eligible(records(spark, sf_dir), asked), asked.text, 1000, scorer=search.share_of_terms).select("id", F.round("score", 6).alias("score"))


plan.direct("fts_candidates", fts_candidates, f"SELECT id, round(score, 6) AS score FROM {text_scores(DUCK)} t ORDER BY t.score DESC, id LIMIT 100")


@plan
def relevance_decay(d):
    return f"SELECT id, round({decay(d)}, 6) AS relevance FROM {memories(d, 'id, relevance_base_score, decay_rate, accessed_at, access_count')} m"


def hybrid(d, where: str = "1 = 1", k: int = 20, threshold: str = "3e-1", demotion: str = "1e0") -> str:
    return f"""(WITH v AS {vectors(d, SPACE, where)}, t AS {text_scores(d, where)},
        more AS (SELECT t.id FROM t LEFT JOIN v ON v.id = t.id WHERE v.id IS NULL ORDER BY t.score DESC, t.id LIMIT 20),
        c AS (SELECT id FROM v UNION ALL SELECT id FROM more),
        s AS (SELECT c.id, coalesce(v.sim, 0e0) AS sim, coalesce(t.score, 0e0) AS score FROM c LEFT JOIN v ON v.id = c.id LEFT JOIN t ON t.id = c.id),
        r AS (SELECT id, source, {decay(d)} AS relevance FROM {memories(d, 'id, source, relevance_base_score, decay_rate, accessed_at, access_count')} x)
        SELECT s.id, round(s.sim, 6) AS sim, round(s.score, 6) AS text_score, round((3e-1 * s.sim + 7e-1 * s.score + CASE WHEN s.score > 0 THEN 2e0 ELSE 0e0 END) * least(r.relevance, 2e0) * {demotion}, 6) AS final_score
        FROM s JOIN r ON r.id = s.id WHERE s.sim >= {threshold} OR s.score > 0 ORDER BY final_score DESC, s.id LIMIT {k})"""


def _rounded(found):
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("sim", "text_score", "final_score")])


def _ranked(name: str, oracle: str, frame=lambda s, p: records(s, p), **more) -> None:
    def query(spark, sf_dir):
        return _rounded(search.rank(frame(spark, sf_dir), request(spark, sf_dir, **more), search.share_of_terms))

    query.__name__ = name
    globals()[name] = query
    plan.direct(name, query, f"SELECT id, sim, text_score, final_score FROM {oracle} h")


# vector candidates and text-only candidates, ranked together by similarity, text and decayed relevance
_ranked("hybrid_search", hybrid(DUCK))

_SUPERSEDED = "PARTITION BY client_id, source_key ORDER BY created_at, id"


def versioned(d) -> str:
    """Records with the instant at which the next one of their client and source key took their place."""
    kind = "TIMESTAMP_NTZ" if d.name == "spark" else "TIMESTAMP"
    return f"(SELECT id, CASE WHEN source_key IS NOT NULL THEN lead(created_at) OVER ({_SUPERSEDED}) END AS superseded_at, CAST(NULL AS {kind}) AS nothing FROM {memories(d, 'id, client_id, source_key, created_at')} x)"


def _with_versions(spark, sf_dir):
    return records(spark, sf_dir).join(run(spark, sf_dir, f"SELECT id, superseded_at FROM {versioned(SPARK)} v"), "id")


def _demoted_sql() -> str:
    d = DUCK
    pools = []
    for where in ("superseded_at IS NULL", "superseded_at IS NOT NULL"):
        pools.append(f"SELECT * FROM (SELECT DISTINCT m.id, {cosine(d, 'm.embedding', 'q.qv')} AS sim FROM {visible(d, SPACE + ' AND ' + usable(d))} m JOIN k ON k.id = m.id AND {where}, {probe(d)} q ORDER BY sim DESC, m.id LIMIT 50) x")
    more = [f"SELECT * FROM (SELECT t.id FROM t JOIN k ON k.id = t.id AND {where} LEFT JOIN v ON v.id = t.id WHERE v.id IS NULL ORDER BY t.score DESC, t.id LIMIT 20) x" for where in ("superseded_at IS NULL", "superseded_at IS NOT NULL")]
    return f"""(WITH k AS {versioned(d)}, v AS ({pools[0]} UNION ALL {pools[1]}), t AS {text_scores(d)}, c AS (SELECT id FROM v UNION ALL {more[0]} UNION ALL {more[1]}),
        s AS (SELECT c.id, coalesce(v.sim, 0e0) AS sim, coalesce(t.score, 0e0) AS score FROM c LEFT JOIN v ON v.id = c.id LEFT JOIN t ON t.id = c.id),
        r AS (SELECT id, {decay(d)} AS relevance FROM {memories(d, 'id, relevance_base_score, decay_rate, accessed_at, access_count')} x)
        SELECT s.id, round(s.sim, 6) AS sim, round(s.score, 6) AS text_score, round((3e-1 * s.sim + 7e-1 * s.score + CASE WHEN s.score > 0 THEN 2e0 ELSE 0e0 END) * least(r.relevance, 2e0) * CASE WHEN k.superseded_at IS NOT NULL THEN 25e-2 ELSE 1e0 END, 6) AS final_score
        FROM s JOIN r ON r.id = s.id JOIN k ON k.id = s.id WHERE s.sim >= 3e-1 OR s.score > 0 ORDER BY final_score DESC, s.id LIMIT 20)"""


# the same with superseded records at a quarter, drawn from a pool of their own
_ranked("hybrid_demoted", _demoted_sql(), _with_versions, superseded_factor=0.25)
_MEDIA = "namespace = 'media' AND event_at >= TIMESTAMP '2025-01-01 00:00:00' AND event_at < TIMESTAMP '2026-01-01 00:00:00'"
# the same in the namespace of media, within a range of event time whose upper bound is a date
_ranked("media_search", hybrid(DUCK, where="namespace = 'media' AND id IN (SELECT id FROM memories WHERE " + _MEDIA + ")"), lambda s, p: records(s, p, "event_at"), requested=("media",), filters=search.Filters(event_after="2025-01-01 00:00:00", event_before="2025-12-31"))


def access_boost(spark, sf_dir):
    """Access events of what a search returned, and the counts that they lead to."""
    found = search.access_events(search.rank(records(spark, sf_dir), request(spark, sf_dir), search.share_of_terms), "2026-03-01 00:00:00")
    return table(spark, sf_dir, "memories").select("id", "access_count").join(F.broadcast(found), "id").dropDuplicates(["id"]).selectExpr("id", "access_count + times AS access_count", "accessed_at")


plan.direct("access_boost", access_boost, f"SELECT m.id, m.access_count + 1 AS access_count, {DUCK.ts('2026-03-01 00:00:00')} AS accessed_at FROM {memories(DUCK, 'id, access_count')} m JOIN {hybrid(DUCK)} h ON h.id = m.id")


def _sessions(spark, sf_dir):
    """Sessions as documents whose records are their chunks: parents and whether they are complete, and the vectors of their chunks.

    What decides completeness is narrow and read once; vectors are read where they are scored, and those of rows that
    were delivered twice change no maximum.
    """
    narrow = run(spark, sf_dir, f"SELECT DISTINCT session_id, id, CAST(NULL AS STRING) AS content, namespace, created_at, CAST(NULL AS ARRAY<FLOAT>) AS embedding, coalesce({usable(SPARK)} AND {SPACE}, false) AS has_vector FROM memories m WHERE {active(SPARK)} AND {rank_of('access_level')} <= 1 AND session_id IS NOT NULL")
    whole = checkpointed(chunks.complete_parents(*chunks.from_parts(narrow, "session_id")).drop("source_sha256"))
    return whole, run(spark, sf_dir, f"SELECT session_id AS parent_id, embedding FROM memories m WHERE {active(SPARK)} AND {rank_of('access_level')} <= 1 AND session_id IS NOT NULL AND {SPACE} AND {usable(SPARK)}")


def chunk_max_search(spark, sf_dir):
    """Chunks are scored exactly; a parent counts with its best chunk. Parents that aren't complete are left out before the scope is asked for."""
    whole, parts = _sessions(spark, sf_dir)
    asked = spark.createDataFrame([("q", _vector(spark, sf_dir, SPACE))], "query_id string, vector array<float>")
    return chunks.parent_scores(asked, whole.where("complete"), parts).select("parent_id", F.round("similarity", 6).alias("sim"), "pos")


_PARTS = f"(SELECT DISTINCT session_id, id, embedding, coalesce({usable(DUCK)} AND {SPACE}, false) AS has_vector FROM memories m WHERE {active(DUCK)} AND {rank_of('access_level')} <= 1 AND session_id IS NOT NULL)"
plan.direct("chunk_max_search", chunk_max_search, f"""WITH p AS {_PARTS}, ok AS (SELECT session_id FROM p GROUP BY session_id HAVING bool_and(has_vector)), s AS (SELECT session_id, max({cosine(DUCK, 'p.embedding', 'q.qv')}) AS sim FROM p JOIN ok USING (session_id), {probe(DUCK)} q GROUP BY session_id),
    r AS (SELECT session_id AS parent_id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, session_id) AS pos FROM s) SELECT * FROM r WHERE pos <= 50""")  # fmt: skip


def scope_ready(spark, sf_dir):
    """Which scopes have all parents complete; one that isn't closes the scope."""
    return chunks.scope_ready(_sessions(spark, sf_dir)[0], ["namespace"])


plan.direct("scope_ready", scope_ready, f"""WITH p AS (SELECT DISTINCT session_id, id, namespace, coalesce({usable(DUCK)} AND {SPACE}, false) AS has_vector FROM memories m WHERE {active(DUCK)} AND {rank_of('access_level')} <= 1 AND session_id IS NOT NULL),
    s AS (SELECT session_id, min(namespace) AS namespace, bool_and(has_vector) AS complete FROM p GROUP BY session_id) SELECT namespace, bool_and(complete) AS ready FROM s GROUP BY namespace""")  # fmt: skip


def rrf_fusion(spark, sf_dir):
    """Reciprocal ranks of two providers, summed by reference; records go before others on ties."""
    from pyspark.sql import Window

    asked = request(spark, sf_dir)
    visible = search.eligible(records(spark, sf_dir), asked)
    near = search.vector_candidates(visible, BASE, asked.vectors[BASE], 50)  # fifty rows each, so one task numbers them
    found = search.text_candidates(visible, asked.text, 50, search.share_of_terms)
    numbered = [f.select("id", F.row_number().over(Window.orderBy(F.desc(c), "id")).alias("pos")) for f, c in ((near, "sim"), (found, "score"))]
    return search.fuse(numbered, 30).select("id", F.round("score", 9).alias("score"), "provider")


plan.direct("rrf_fusion", rrf_fusion, f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS pos FROM {vectors(DUCK)} v), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS pos FROM (SELECT id, score FROM {text_scores(DUCK)} z ORDER BY score DESC, id LIMIT 50) t),
    u AS (SELECT id, pos, 0 AS provider FROM a UNION ALL SELECT id, pos, 1 AS provider FROM b)
    SELECT id, round(sum(1e0 / (60 + pos)), 9) AS score, min(provider) AS provider FROM u GROUP BY id ORDER BY sum(1e0 / (60 + pos)) DESC, provider, id LIMIT 30""")  # fmt: skip


def summaries_in_order(spark, sf_dir):
    """Summaries of a list of ids in the order of the list; the list has fifty ids."""
    from pyspark.sql import Window

    asked = request(spark, sf_dir)
    near = search.vector_candidates(search.eligible(records(spark, sf_dir), asked), BASE, asked.vectors[BASE], 50)
    listed = near.select("id", F.row_number().over(Window.orderBy(F.desc("sim"), "id")).alias("pos"))
    rows = table(spark, sf_dir, "memories").select("id", F.coalesce("content", F.lit("")).alias("content"), "source", "namespace", "created_at", "access_level")
    return rows.join(F.broadcast(listed), "id").dropDuplicates(["id"])


plan.direct("summaries_in_order", summaries_in_order, f"""WITH w AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS pos FROM {vectors(DUCK)} v) SELECT w.pos, m.id, coalesce(m.content, '') AS content, m.source, m.namespace, m.created_at, m.access_level
    FROM w JOIN {memories(DUCK, 'id, content, source, namespace, created_at, access_level')} m ON m.id = w.id""")  # fmt: skip
