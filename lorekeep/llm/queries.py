"""Queries of the problems of this folder, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.llm import knn, lookalike, mixing, neardup, personal, runs, tokens
from lorekeep.session import table


def p1_found(spark, sf_dir):
    return personal.found_items(table(spark, sf_dir, "memories"), table(spark, sf_dir, "entities"))


def p1_redacted(spark, sf_dir):
    return personal.redacted(table(spark, sf_dir, "memories"), table(spark, sf_dir, "entities"))


def p2_found(spark, sf_dir):
    return knn.found_pairs(table(spark, sf_dir, "memories"))


def p2_neighbours(spark, sf_dir):
    return knn.neighbours(table(spark, sf_dir, "memories"))


def p4_found(spark, sf_dir):
    return neardup.found_pairs(table(spark, sf_dir, "memories"))


def p4_groups(spark, sf_dir):
    return neardup.groups(table(spark, sf_dir, "memories"))


def p5_found(spark, sf_dir):
    return runs.event_runs(table(spark, sf_dir, "media_events")).select("first_event_id", "last_event_id", "n_events", "duration_ms")


def p5_by_service(spark, sf_dir):
    """How many events each service would keep, and how many it has."""
    events = table(spark, sf_dir, "media_events")
    every = runs.event_runs(events, at_least=1)
    return every.groupBy("service").agg(F.count("*").alias("runs"), F.sum("n_events").alias("events"), F.max("n_events").alias("longest_run"))


_COMPARABLE = r"""
    coalesce(nullif(regexp_replace(strip_accents(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')),
        '([\s\xA0]*[(\[{{][^)\]}}]*[)\]}}])+[\s\xA0]*$', ''), '[\s\xA0][-\x{{2010}}-\x{{2015}}][\s\xA0].*$', ''), '[\s\xA0](feat|ft|featuring)\b.*$', ''),
        '([\s\xA0]*[(\[{{][^)\]}}]*[)\]}}])+[\s\xA0]*$', ''), '[\s\xA0][-\x{{2010}}-\x{{2015}}][\s\xA0].*$', '')),
        '[^\p{{L}}\p{{N}}]+', '', 'g'), ''),
      nullif(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}]+', '', 'g'), ''),
      regexp_replace(lower(coalesce({0}, '')), '[\s\xA0]+', '', 'g'))
"""

_RUNS = f"""
WITH events AS (
  SELECT DISTINCT client_id, service, id, played_at, {_COMPARABLE.format("title")} AS t, {_COMPARABLE.format("artist")} AS a
  FROM media_events WHERE played_at IS NOT NULL),
flagged AS (
  SELECT *, CASE WHEN lag(t) OVER w = t AND lag(a) OVER w = a THEN 0 ELSE 1 END AS changed
  FROM events WINDOW w AS (PARTITION BY client_id, service ORDER BY played_at, id)),
numbered AS (
  SELECT *, sum(changed) OVER (PARTITION BY client_id, service ORDER BY played_at, id ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
runs AS (
  SELECT client_id, service, run, arg_min(id, struct_pack(p := played_at, i := id)) AS first_event_id,
    arg_max(id, struct_pack(p := played_at, i := id)) AS last_event_id, count(*) AS n_events,
    CAST(floor((epoch_us(max(played_at)) - epoch_us(min(played_at))) / 1000) AS BIGINT) AS duration_ms
  FROM numbered GROUP BY ALL)
"""


#: Exact pairs: every common three-word sequence of two contents is counted. Copies of a text are linked to its least id.
_PAIRS = r"""
WITH m AS (SELECT DISTINCT id, namespace, content FROM memories WHERE content IS NOT NULL),
w AS (SELECT id, namespace, content, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM m),
t AS (SELECT DISTINCT id, namespace, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM t a JOIN t b ON b.s = a.s AND b.namespace IS NOT DISTINCT FROM a.namespace AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE shared >= 0.5 * (x.n + y.n - shared)),
least AS (SELECT namespace, content, min(id) AS least FROM w WHERE len(w) >= 3 GROUP BY namespace, content)
SELECT a AS memory_id_a, b AS memory_id_b FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b JOIN least l ON l.namespace IS NOT DISTINCT FROM x.namespace AND l.content = x.content
WHERE x.content <> y.content OR l.least = a
"""

#: Groups: contents with one set of sequences are a class; classes that are similar are linked, and linked ones are one group.
_GROUPS = r"""
WITH RECURSIVE m AS (SELECT DISTINCT id, namespace, content FROM memories WHERE content IS NOT NULL),
w AS (SELECT id, namespace, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM m),
t AS (SELECT id, namespace, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 3),
k AS (SELECT min(id) AS class, namespace, s, len(s) AS n FROM t GROUP BY namespace, s),
e AS (SELECT class, namespace, n, unnest(s) AS x FROM k),
c AS (SELECT a.class AS a, b.class AS b, max(a.n) AS na, max(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON b.x = a.x AND b.namespace IS NOT DISTINCT FROM a.namespace AND a.class <> b.class GROUP BY 1, 2),
p AS (SELECT a, b FROM c WHERE shared >= 0.5 * (na + nb - shared)),
r(a, b) AS (SELECT class, class FROM k UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
g AS (SELECT a, min(b) AS least FROM r GROUP BY a), f AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT t.id AS memory_id, g.least AS group_id, coalesce(f.links, 0) AS links FROM t JOIN k ON k.namespace IS NOT DISTINCT FROM t.namespace AND k.s = t.s JOIN g ON g.a = k.class LEFT JOIN f ON f.a = k.class
"""

_NEAREST = """
WITH m AS (SELECT DISTINCT id, embedding, hash(embedding_provider, embedding_model, embedding_dimensions) AS space, embedding_provider AS p, embedding_model AS q, embedding_dimensions AS d FROM memories
  WHERE len(embedding) = embedding_dimensions AND embedding_provider IS NOT NULL AND embedding_model IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT id, p, q, d, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM m),
s AS (SELECT a.id AS memory_id, b.id AS neighbour_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) AS similarity FROM v a JOIN v b ON b.p = a.p AND b.q = a.q AND b.d = a.d AND b.id <> a.id),
r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY similarity DESC, neighbour_id) AS rank FROM s WHERE similarity >= 0.8)
"""


def p6_ids(spark, sf_dir):
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def p6_decoded(spark, sf_dir):
    """Every text, encoded and decoded again."""
    return tokens.decode_documents(tokens.encode_documents(table(spark, sf_dir, "documents")))


def p7_mix(spark, sf_dir):
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    return mixing.mix_documents(sized, table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir):
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    return mixing.mix_shares(sized, table(spark, sf_dir, "mix_targets"))


def p8_found(spark, sf_dir):
    return lookalike.found_pairs(table(spark, sf_dir, "documents"))


def p8_canonical(spark, sf_dir):
    return lookalike.canonical_texts(table(spark, sf_dir, "documents"))


def p8_classes(spark, sf_dir):
    return lookalike.document_classes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_by_service": p5_by_service, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_canonical": p8_canonical, "p8_classes": p8_classes}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _NEAREST + "SELECT DISTINCT least(memory_id, neighbour_id) AS memory_id_a, greatest(memory_id, neighbour_id) AS memory_id_b FROM r WHERE rank <= 10",
        "p4_found": _PAIRS,
        "p4_groups": _GROUPS,
        "p5_found": _RUNS + "SELECT first_event_id, last_event_id, n_events, duration_ms FROM runs WHERE n_events >= 2",
        "p5_by_service": _RUNS + "SELECT service, count(*) AS runs, CAST(sum(n_events) AS BIGINT) AS events, max(n_events) AS longest_run FROM runs GROUP BY service",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
