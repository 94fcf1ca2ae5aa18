"""Retrieval evaluation: every fiftieth vector is a judged query over the vector table; relevant means the same label.

Two spaces are compared where a measure needs two: the vectors as they are, and the same vectors without their last
dimensions, which stand for those of another model of the same length.
"""

from __future__ import annotations

from lorekeep.operators import evaluation
from lorekeep.plans.dialect import DUCK, SPARK, Plans, cosine, memories, run

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE

_ASKED = "vec_id % 50 = 0"
#: Every tenth query is for diagnosis only and isn't scored.
_DIAGNOSTIC = "(qid / 50) % 10 = 9"
_KEPT = 56


def other(d) -> str:
    """The vector in the other space."""
    return f"transform(embedding, (x, i) -> IF(i < {_KEPT}, x, 0F))" if d.name == "spark" else f"list_transform(embedding, lambda x, i: CASE WHEN i <= {_KEPT} THEN x ELSE 0 END)"


#: Parts of the table that a query meets one by one; both sides shuffle, as the queries grow with the table.
_BLOCKS = 64


def every_query(d, rows: str, but: str = "m.vec_id <> q.vec_id") -> str:
    """Rows ``m`` against the queries ``q``: each query goes to every block of the table."""
    if d.name != "spark":
        return f"{rows} m JOIN (SELECT * FROM {rows} x WHERE {_ASKED}) q ON {but}"
    return f"(SELECT *, pmod(vec_id, {_BLOCKS}) AS in_block FROM {rows} y) m JOIN (SELECT *, explode(sequence(0, {_BLOCKS} - 1)) AS in_block FROM {rows} x WHERE {_ASKED}) q ON m.in_block = q.in_block AND {but}"


def ranked(d, k: int = 10) -> str:
    """The ten nearest of each query; no more than these leave a task."""
    return f"""(SELECT qid, label, vec_id, other, sim, pos FROM (SELECT q.vec_id AS qid, q.label, m.vec_id, m.label AS other, {cosine(d, 'm.embedding', 'q.embedding')} AS sim,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {cosine(d, 'm.embedding', 'q.embedding')} DESC, m.vec_id) AS pos FROM {every_query(d, '(SELECT vec_id, label, embedding FROM embeddings)')}) r WHERE pos <= {k})"""


def cases(d) -> str:
    """Hits, first rank and number of judged vectors of each query; of those for diagnosis only that they were asked."""
    n = "(SELECT label, count(*) AS n FROM embeddings GROUP BY label)"
    return f"""(SELECT r.qid, CAST({_DIAGNOSTIC.replace('qid', 'r.qid').replace('r.qid / 50', 'floor(r.qid / 50e0)')} AS BOOLEAN) AS diagnostic, count(CASE WHEN r.label = r.other THEN 1 END) AS hits, min(CASE WHEN r.label = r.other THEN r.pos END) AS first_rank, max(j.n) - 1 AS relevant
        FROM {ranked(d)} r JOIN {n} j ON j.label = r.label GROUP BY r.qid HAVING max(j.n) > 1)"""


@plan
def eval_case_metrics(d):
    scored = lambda x: f"CASE WHEN NOT diagnostic THEN {x} END"
    return f"""SELECT qid, diagnostic, {scored('hits')} AS hits, {scored('first_rank')} AS first_rank, {scored('round(hits / CAST(relevant AS DOUBLE), 6)')} AS recall, {scored('round(coalesce(1e0 / first_rank, 0e0), 6)')} AS reciprocal_rank,
        {scored('first_rank IS NOT NULL')} AS hit FROM {cases(d)} c"""


@plan
def eval_summary(d):
    """Averages over the scored queries, each of which counts the same."""
    mean = lambda x: f"round(coalesce(avg(CASE WHEN NOT diagnostic THEN {x} END), 0e0), 6)"
    return f"""SELECT count(CASE WHEN NOT diagnostic THEN 1 END) AS evaluated, count(CASE WHEN diagnostic THEN 1 END) AS diagnostic, {mean('hits / CAST(relevant AS DOUBLE)')} AS recall, {mean('coalesce(1e0 / first_rank, 0e0)')} AS mrr,
        {mean('CASE WHEN first_rank IS NOT NULL THEN 1e0 ELSE 0e0 END')} AS hit_rate FROM {cases(d)} c"""


_FILTERED = "source = 'chat' AND created_at >= {a} AND created_at <= {b} AND deleted_at IS NULL"


def eval_resolve(spark, sf_dir):
    """Judgements by source key and by id against the records that a case's filters admit: missing, resolved or ambiguous."""
    rows = run(spark, sf_dir, f"SELECT id, source_key FROM {memories(SPARK, 'id, source_key, source, created_at, deleted_at')} m WHERE {_FILTERED.format(a=SPARK.ts('2025-01-01 00:00:00'), b=SPARK.ts('2026-01-01 00:00:00'))}")
    by_key = run(spark, sf_dir, "SELECT DISTINCT 'keys' AS case_id, source_key, CAST(NULL AS STRING) AS id FROM memories WHERE source_key IS NOT NULL")
    by_id = run(spark, sf_dir, "SELECT DISTINCT 'ids' AS case_id, CAST(NULL AS STRING) AS source_key, id FROM memories")
    return evaluation.resolve(by_key.unionByName(by_id), rows).select("case_id", "label", "found", "state")


plan.direct("eval_resolve", eval_resolve, f"""WITH m AS (SELECT id, source_key FROM {memories(DUCK, 'id, source_key, source, created_at, deleted_at')} m WHERE {_FILTERED.format(a=DUCK.ts('2025-01-01 00:00:00'), b=DUCK.ts('2026-01-01 00:00:00'))}),
    j AS (SELECT DISTINCT 'keys' AS case_id, source_key, NULL AS id FROM memories WHERE source_key IS NOT NULL UNION ALL SELECT DISTINCT 'ids', NULL, id FROM memories)
    SELECT j.case_id, coalesce(j.source_key, j.id) AS label, count(m.id) AS found, CASE count(m.id) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM j LEFT JOIN m ON m.source_key = j.source_key OR m.id = j.id GROUP BY ALL""")  # fmt: skip


def two_spaces(d) -> str:
    """Every query against every other vector in both spaces."""
    e = f"(SELECT vec_id, label, embedding AS a, {other(d)} AS b FROM embeddings)"
    return f"""(SELECT q.vec_id AS qid, m.vec_id, m.label = q.label AS relevant, {cosine(d, 'm.a', 'q.a')} AS sim_a, {cosine(d, 'm.b', 'q.b')} AS sim_b FROM {every_query(d, e)})"""


@plan
def rank_inversions(d):
    """How often the other space turns round a pair of one of a query's ten nearest and any vector after it; gaps up to the tolerance don't count."""
    return f"""WITH s AS {two_spaces(d)}, top AS (SELECT * FROM (SELECT qid, vec_id, sim_a, sim_b, row_number() OVER (PARTITION BY qid ORDER BY sim_a DESC, vec_id) AS pos FROM s) r WHERE pos <= 10)
        SELECT a.qid, count(*) AS pairs, count(CASE WHEN a.sim_b < b.sim_b THEN 1 END) AS inversions FROM top a JOIN s b ON b.qid = a.qid AND a.sim_a - b.sim_a > 5e-3 GROUP BY a.qid"""


@plan
def space_compat(d):
    """Whether two spaces can stand for each other: cosines of the same input, and the nearest vector of each query within and across the spaces."""
    e = f"(SELECT vec_id, embedding AS a, {other(d)} AS b FROM embeddings)"
    best = lambda m, q: f"row_number() OVER (PARTITION BY q.vec_id ORDER BY {cosine(d, m, q)} DESC, m.vec_id)"
    return f"""WITH e AS {e}, same AS (SELECT count(*) AS comparisons, min({cosine(d, 'a', 'b')}) AS least, avg({cosine(d, 'a', 'b')}) AS mean FROM e),
        r AS (SELECT q.vec_id AS qid, m.vec_id, {best('m.a', 'q.a')} AS aa, {best('m.b', 'q.b')} AS bb, {best('m.a', 'q.b')} AS ba, {best('m.b', 'q.a')} AS ab FROM {every_query(d, 'e', 'm.vec_id % 50 <> 0')}),
        t AS (SELECT qid, max(CASE WHEN aa = 1 THEN vec_id END) AS aa, max(CASE WHEN bb = 1 THEN vec_id END) AS bb, max(CASE WHEN ba = 1 THEN vec_id END) AS ba, max(CASE WHEN ab = 1 THEN vec_id END) AS ab FROM r WHERE aa = 1 OR bb = 1 OR ba = 1 OR ab = 1 GROUP BY qid),
        g AS (SELECT count(*) AS queries, avg(CASE WHEN aa = bb THEN 1e0 ELSE 0e0 END) AS top_one, avg(CASE WHEN ba = aa THEN 1e0 ELSE 0e0 END) AS other_queries, avg(CASE WHEN ab = bb THEN 1e0 ELSE 0e0 END) AS other_documents FROM t)
        SELECT comparisons, queries, round(least, 6) AS least_cosine, round(mean, 6) AS mean_cosine, round(top_one, 6) AS top_one, round(other_queries, 6) AS other_queries, round(other_documents, 6) AS other_documents,
          least >= 97e-2 AND mean >= 985e-3 AND top_one >= 8e-1 AND other_queries >= 8e-1 AND other_documents >= 8e-1 AS accepted FROM same, g"""


@plan
def pilot_gates(d):
    """The gates of a change to the other space: recall and reciprocal rank, regression, misses that are new, critical or at a boundary, and hard negatives.

    Every second query is critical and every third is at a boundary; every fifth is a hard negative, whose forbidden
    vector is the nearest one of another label.
    """
    return f"""WITH s AS {two_spaces(d)}, p AS (SELECT qid, vec_id, relevant, row_number() OVER (PARTITION BY qid ORDER BY sim_a DESC, vec_id) AS pos_a, row_number() OVER (PARTITION BY qid ORDER BY sim_b DESC, vec_id) AS pos_b FROM s),
        f AS (SELECT qid, min(CASE WHEN NOT relevant THEN pos_a END) AS nearest_wrong FROM p GROUP BY qid),
        c AS (SELECT p.qid, count(CASE WHEN relevant THEN 1 END) AS expected, count(CASE WHEN relevant AND pos_a <= 10 THEN 1 END) AS found_a, count(CASE WHEN relevant AND pos_b <= 10 THEN 1 END) AS found_b, min(CASE WHEN relevant THEN pos_a END) AS first_a, min(CASE WHEN relevant THEN pos_b END) AS first_b,
          max(CASE WHEN NOT relevant AND pos_a = nearest_wrong THEN pos_b END) AS forbidden_b FROM p JOIN f ON f.qid = p.qid GROUP BY p.qid),
        m AS (SELECT avg(found_a / CAST(expected AS DOUBLE)) AS recall_a, avg(found_b / CAST(expected AS DOUBLE)) AS recall_b, avg(CASE WHEN first_b <= 10 THEN 1e0 / first_b ELSE 0e0 END) AS mrr_b,
          count(CASE WHEN found_b < expected AND found_a = expected THEN 1 END) AS target_only_misses, count(CASE WHEN found_b < expected AND qid % 100 = 0 THEN 1 END) AS critical_misses, count(CASE WHEN found_b < expected AND qid % 150 = 0 THEN 1 END) AS boundary_misses,
          count(CASE WHEN qid % 250 = 0 AND forbidden_b < first_b THEN 1 END) AS hard_negatives FROM c WHERE expected > 0)
        SELECT round(recall_b, 6) AS recall, round(mrr_b, 6) AS mrr, round(recall_a - recall_b, 6) AS regression, target_only_misses, critical_misses, boundary_misses, hard_negatives,
          recall_b >= 9e-1 AND mrr_b >= 75e-2 AND recall_a - recall_b <= 5e-2 AND target_only_misses <= 2 AND critical_misses = 0 AND boundary_misses = 0 AND hard_negatives = 0 AS passed FROM m"""
