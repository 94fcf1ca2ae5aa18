"""Ranked retrieval for a caller: a request goes in, a lazy frame of ranked records comes out.

A record is any row with ``id``, ``content``, ``namespace`` and whatever else a request asks for; lifecycle columns that a
frame lacks (``superseded_at``, ``valid_to``, ``consolidated_into_id``, ...) count as null. Rows that were delivered
twice may be in the frame: candidates are ranked while they are scanned, by dense ranks that repeated rows
share, so only the few that are left are made unique. No whole row is shuffled to find out that it is there once.

Defined results: a blank query has no text candidates; a request without vectors is a text search; records without
a usable vector are no vector candidates; a null content matches no text; an empty scope gives no rows; ties go by id.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import stem
from lorekeep.operators import texts

LEVELS = {"normal": 0, "sensitive": 1, "secret": 2}
#: The private archive is searched on request only.
ON_REQUEST = "my-life"
MOST_QUERY_BYTES = 8_192
MOST_TEXT_CANDIDATES = 100


@dataclass(frozen=True)
class Ranking:
    """Weights and limits of the ranking; refused if they aren't finite, negative, both weights are zero or a limit is outside 1 to 1000."""

    vector_weight: float = 0.3
    text_weight: float = 0.7
    text_bonus: float = 2.0
    relevance_cap: float = 2.0
    vector_candidates: int = 50
    text_candidates: int = 20
    most_results: int = 50

    def __post_init__(self) -> None:
        for name in ("vector_weight", "text_weight", "text_bonus", "relevance_cap"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) >= 0):
                raise ValueError(f"{name} must be finite and not negative")
        if self.vector_weight + self.text_weight <= 0 or self.relevance_cap <= 0:
            raise ValueError("one weight and the relevance cap must be greater than zero")
        for name in ("vector_candidates", "text_candidates", "most_results"):
            if not (isinstance(getattr(self, name), int) and 1 <= getattr(self, name) <= 1000):
                raise ValueError(f"{name} must be from 1 to 1000")


@dataclass(frozen=True)
class Space:
    """The identity of an embedding; vectors of different spaces never compare."""

    provider: str
    model: str
    dimensions: int


@dataclass(frozen=True)
class Filters:
    """All conditions hold; within a list of services or event types one does."""

    tags: tuple[str, ...] = ()
    services: tuple[str, ...] = ()
    event_types: tuple[str, ...] = ()
    event_after: str | None = None
    event_before: str | None = None
    source: str | None = None
    created_after: str | None = None
    created_before: str | None = None
    valid_at: str | None = None


@dataclass(frozen=True)
class Request:
    """What a caller asks: a text, vectors of that text by space, and the scope in which it may look (None: everywhere)."""

    text: str = ""
    vectors: dict[Space, list[float]] = field(default_factory=dict)
    allowed: tuple[str, ...] | None = ()
    requested: tuple[str, ...] = ()
    ceiling: str = "normal"
    filters: Filters = Filters()
    threshold: float = 0.3
    limit: int = 20
    as_of: str = "2026-03-01 00:00:00"
    superseded_factor: float | None = None
    ranking: Ranking = Ranking()


def scope(requested: Iterable[str], allowed: Iterable[str], on_request: str | None = ON_REQUEST) -> list[str]:
    """The namespaces to look in: those requested that are allowed, or all allowed but the one that must be asked for."""
    wanted = list(requested)
    return [n for n in wanted if n in set(allowed)] if wanted else [n for n in allowed if n != on_request]


def have(frame: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in frame.columns else F.lit(None).cast(kind)


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def upper_bound(column: Column, text: str) -> Column:
    """A mere date as an upper bound covers that day, an instant covers itself."""
    if len(text.strip()) == 10:
        return column < instant(str(dt.date.fromisoformat(text.strip()) + dt.timedelta(days=1)))
    return column <= instant(text)


def access_rank(level: Column) -> Column:
    known = reduce(lambda c, x: c.when(F.coalesce(level, F.lit("normal")) == x[0], x[1]), list(LEVELS.items())[1:], F.when(F.coalesce(level, F.lit("normal")) == "normal", 0))
    return known.otherwise(len(LEVELS))


def eligible(memories: DataFrame, request: Request, memberships: DataFrame | None = None) -> DataFrame:
    """The records that a request may see, by scope, level, lifecycle and filters; filters on columns reach the scan.

    At an instant of the past, ``memberships`` (``member_id, consolidated_at, deconsolidated_at``) tells what was part of
    another record then; without an instant ``consolidated_into_id`` does.
    """
    where, now = request.filters, instant(request.as_of)
    if request.allowed is None:
        inside = F.col("namespace").isin(list(request.requested)) if request.requested else F.col("namespace").isNotNull()
    else:
        inside = F.col("namespace").isin(scope(request.requested, request.allowed))
    kept = memories.where(inside & (access_rank(have(memories, "access_level")) <= LEVELS.get(request.ceiling, -1)))
    kept = kept.where(have(memories, "deleted_at").isNull() & (have(memories, "expires_at", "timestamp_ntz").isNull() | (have(memories, "expires_at", "timestamp_ntz") > now)))
    if where.tags:
        kept = kept.where(F.size(F.array_except(F.array(*map(F.lit, where.tags)), "tags")) == 0)
    for key, values in (("service", where.services), ("event_type", where.event_types)):
        if values:
            kept = kept.where(F.get_json_object("metadata", f"$.{key}").isin(list(values)))
    if where.event_after:
        kept = kept.where(F.col("event_at") >= instant(where.event_after))
    if where.event_before:
        kept = kept.where(upper_bound(F.col("event_at"), where.event_before))
    if where.source:
        kept = kept.where(F.col("source") == where.source)
    if where.created_after:
        kept = kept.where(F.col("created_at") >= instant(where.created_after))
    if where.created_before:
        kept = kept.where(F.col("created_at") <= instant(where.created_before))
    if not where.valid_at:
        return kept.where(have(memories, "consolidated_into_id").isNull())
    at = instant(where.valid_at)
    kept = kept.where((F.col("valid_from") <= at) & (have(memories, "valid_to", "timestamp_ntz").isNull() | (have(memories, "valid_to", "timestamp_ntz") > at)))
    if memberships is None:
        return kept
    then = memberships.where((F.col("consolidated_at") <= at) & (F.col("deconsolidated_at").isNull() | (F.col("deconsolidated_at") > at)))
    return kept.join(then.select(F.col("member_id").alias("id")), "id", "left_anti")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def in_space(space: Space) -> Column:
    """Rows with a usable vector of a space."""
    same = (F.col("embedding_provider") == space.provider) & (F.col("embedding_model") == space.model) & (F.col("embedding_dimensions") == space.dimensions)
    length = dot(F.col("embedding"), F.col("embedding"))
    return same & (F.size("embedding") == space.dimensions) & (length > 0) & (length < 1e300)


def space_present(visible: DataFrame, space: Space) -> bool:
    """Whether a space has any record in scope, so that a query for it is worth its embedding; one row decides."""
    return not visible.where(in_space(space)).select("id").limit(1).isEmpty()


def first_of(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k different ids of each pool. Repeated rows share a dense rank, and no task passes on more than its own first k ranks."""
    ranked = frame.withColumn("_n", F.dense_rank().over(Window.partitionBy("pool").orderBy(*order, "id")))
    return ranked.where(F.col("_n") <= k).drop("_n").distinct()


def pool(frame: DataFrame) -> Column:
    """Current and superseded records are drawn from separate pools."""
    return have(frame, "superseded_at", "timestamp_ntz").isNotNull().alias("pool")


def vector_candidates(visible: DataFrame, space: Space, vector: list[float], k: int) -> DataFrame:
    """``id, pool, sim``: the k records of each pool that are most similar to a vector of their space."""
    norm = math.sqrt(math.fsum(float(x) * float(x) for x in vector))
    if len(vector) != space.dimensions or not (0 < norm < math.inf):
        raise ValueError("the query's vector must be finite, of some length and of its space's dimensions")
    query = F.expr(f"array({', '.join(f'{float(x)!r}D' for x in vector)})")  # parsed at once, not value by value
    sim = dot(F.col("embedding"), query) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.lit(norm))
    return first_of(visible.where(in_space(space)).select("id", pool(visible), sim.alias("sim")), k, F.desc("sim"))


def words(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit("([a-z0-9]+)"), F.lit(1))


def share_of_terms(content: Column, query: str) -> Column:
    """The share of a text's words that are words of the query, if it holds all of them; else 0."""
    terms = sorted(set(query.lower().split()))
    wanted = F.array(*map(F.lit, terms))
    found = words(content)
    score = F.size(F.filter(found, lambda x: F.array_contains(wanted, x))) / F.greatest(F.size(found), F.lit(1))
    return F.when(F.size(F.array_intersect(wanted, found)) == len(terms), score).otherwise(0.0)


def cover_density(content: Column, query: str) -> Column:
    """Stemmed cover density; only texts that have a word with the beginning of every stem are scored outside the JVM."""
    return F.when(may_match(content, query), texts.cover_score(F.when(may_match(content, query), content), query)).otherwise(0.0)


def may_match(content: Column, query: str) -> Column:
    stems = {stem(w) for w in _query_words(query)}
    return reduce(lambda c, s: c & content.rlike(rf"(?i)\b{s.rstrip('ie') or s}"), sorted(stems), content.isNotNull())


def _query_words(query: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if w]


Scorer = Callable[[Column, str], Column]


def text_candidates(visible: DataFrame, query: str, k: int, scorer: Scorer = cover_density, but: DataFrame | None = None) -> DataFrame:
    """``id, pool, score``: the k records of each pool that match a text best, without those of ``but`` (a bounded frame of ids)."""
    found = visible.where(F.col("content").isNotNull() & may_match(F.col("content"), query) if _query_words(query) else F.lit(False))
    scored = found.select("id", pool(visible), scorer(F.col("content"), query).alias("score")).where("score > 0")
    if but is not None:
        scored = scored.join(F.broadcast(but.select("id")), "id", "left_anti")
    return first_of(scored, k, F.desc("score"))


def bounded_text_search(visible: DataFrame, query: str, limit: int, superseded: bool = False, scorer: Scorer = cover_density) -> DataFrame:
    """``id, score``: the text entry for callers: at most a hundred rows, no blank or oversized query, superseded records on request."""
    k = max(0, min(limit, MOST_TEXT_CANDIDATES))
    if len(query.encode()) > MOST_QUERY_BYTES:
        raise ValueError(f"a query has at most {MOST_QUERY_BYTES} bytes")
    found = text_candidates(visible if superseded else visible.where(~pool(visible)), query, max(k, 1), scorer)
    return found.orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def relevance(now: Column, frame: DataFrame) -> Column:
    """Decayed base relevance and a bounded bonus for accesses."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (us(now) - us(F.coalesce(have(frame, "accessed_at", "timestamp_ntz"), now))) / 8.64e10
    fading = F.exp(-F.coalesce(have(frame, "decay_rate", "double"), F.lit(0.01)) * F.greatest(F.lit(0.0), age))
    bonus = F.least(F.greatest(F.coalesce(have(frame, "access_count", "int"), F.lit(0)) * 0.1, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(have(frame, "relevance_base_score", "double"), F.lit(1.0)) * fading + bonus


def rank(memories: DataFrame, request: Request, scorer: Scorer = cover_density, memberships: DataFrame | None = None, by_chunks: DataFrame | None = None) -> DataFrame:
    """``id, sim, text_score, relevance, final_score`` of the records that answer a request, best first.

    Candidates are the nearest records of each of the request's spaces and of ``by_chunks`` (``parent_id, similarity``, from
    chunk retrieval), and the best by text among the others. A text score counts for all of them; a candidate needs a
    similarity at the threshold or a text score.
    """
    weights = request.ranking
    visible = eligible(memories, request, memberships)
    none = visible.select("id", pool(visible), F.lit(0.0).alias("sim")).limit(0)
    near = [vector_candidates(visible, space, vector, weights.vector_candidates) for space, vector in request.vectors.items()]
    if by_chunks is not None:
        near.append(by_chunks.select(F.col("parent_id").alias("id"), F.lit(False).alias("pool"), F.col("similarity").alias("sim")))
    by_vector = reduce(DataFrame.unionByName, near, none).groupBy("id").agg(F.max("sim").alias("sim"))
    by_text = text_candidates(visible, request.text, weights.text_candidates, scorer, by_vector)
    # at most the sum of all candidate limits for each pool, so it is sent to the tasks that scan the records
    candidates = by_vector.unionByName(by_text.select("id", F.lit(None).cast("double").alias("sim")))
    columns = [c for c in ("content", "superseded_at", "accessed_at", "decay_rate", "access_count", "relevance_base_score") if c in visible.columns]
    rows = visible.select("id", *columns).join(F.broadcast(candidates), "id").dropDuplicates(["id"])
    matched = F.coalesce(scorer(F.col("content"), request.text), F.lit(0.0)) if _query_words(request.text) else F.lit(0.0)
    scored = rows.select("id", F.coalesce("sim", F.lit(0.0)).alias("sim"), matched.alias("text_score"), relevance(instant(request.as_of), rows).alias("relevance"), pool(rows))
    demoted = F.when(F.col("pool"), request.superseded_factor).otherwise(1.0) if request.superseded_factor is not None and not request.filters.valid_at else F.lit(1.0)
    final = (weights.vector_weight * F.col("sim") + weights.text_weight * F.col("text_score") + F.when(F.col("text_score") > 0, weights.text_bonus).otherwise(0.0)) * F.least("relevance", F.lit(weights.relevance_cap)) * demoted
    kept = scored.where((F.col("sim") >= request.threshold) | (F.col("text_score") > 0)).select("id", "sim", "text_score", "relevance", final.alias("final_score"))
    return kept.orderBy(F.desc("final_score"), "id").limit(min(request.limit, weights.most_results))


def access_events(results: DataFrame, at: str) -> DataFrame:
    """``id, accessed_at, times`` of what a search has returned; applied to the records by a merge of its own, never while reading."""
    return results.select("id", instant(at).alias("accessed_at"), F.lit(1).alias("times"))


def fuse(providers: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """``id, score, provider``: reciprocal ranks (``id, pos``) of several providers, summed; on ties the earlier provider goes first."""
    tagged = [p.select("id", F.lit(1.0) / (constant + F.col("pos")), F.lit(i)).toDF("id", "part", "provider") for i, p in enumerate(providers)]
    summed = reduce(DataFrame.unionByName, tagged).groupBy("id").agg(F.sum("part").alias("score"), F.min("provider").alias("provider"))
    return summed.orderBy(F.desc("score"), "provider", "id").limit(k)
