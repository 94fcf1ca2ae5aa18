"""Retrieval and duplicates over chunks: parents with a current manifest, their chunks' vectors, the best chunk counts.

Frames: ``parents`` (``id, namespace, revision``), ``manifests`` (``parent_id, source_revision, chunk_count, source_sha256,
is_current``) and ``chunks`` (``parent_id, ordinal, embedding``). Vectors have one length; a chunk without a vector makes its
parent incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import nearpairs

#: Up to so many parents and chunks every chunk is scored for its parent; beyond that only the nearest chunks are.
EXACT_PARENTS, EXACT_CHUNKS, NEAREST_CHUNKS = 10_000, 50_000, 1_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def from_parts(rows: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents, manifests and chunks of records that are parts of a document (``id, content, namespace, created_at, embedding, has_vector``)."""
    ordered = rows.where(F.col(document).isNotNull()).withColumn("ordinal", F.row_number().over(Window.partitionBy(document).orderBy("created_at", "id")) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "\n")
    documents = ordered.groupBy(F.col(document).alias("id")).agg(F.min("namespace").alias("namespace"), F.count("*").alias("chunk_count"), F.sha2(text, 256).alias("source_sha256"))
    parents = documents.select("id", "namespace", F.lit(0).alias("revision"))
    manifests = documents.select(F.col("id").alias("parent_id"), F.lit(0).alias("source_revision"), "chunk_count", "source_sha256", F.lit(True).alias("is_current"))
    return parents, manifests, ordered.where("has_vector").select(F.col(document).alias("parent_id"), "ordinal", "embedding")


def complete_parents(parents: DataFrame, manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """The parents' rows with ``chunk_count``, ``source_sha256`` and ``complete``: a current manifest of the same revision whose chunks are all there."""
    have = chunks.groupBy("parent_id").agg(F.count("*").alias("_n"), F.min("ordinal").alias("_first"), F.max("ordinal").alias("_last"))
    joined = parents.join(manifests.where("is_current").withColumnRenamed("parent_id", "id"), "id", "left").join(have.withColumnRenamed("parent_id", "id"), "id", "left")
    whole = (F.col("source_revision") == F.col("revision")) & (F.col("_n") == F.col("chunk_count")) & (F.col("_first") == 0) & (F.col("_last") == F.col("chunk_count") - 1)
    return joined.select(*parents.columns, "chunk_count", "source_sha256", F.coalesce(whole, F.lit(False)).alias("complete"))


def scope_ready(completed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``*by, ready``: whether every parent of a scope is complete; one that isn't closes the whole scope. An empty scope is ready."""
    if by:
        return completed.groupBy(*by).agg(F.bool_and("complete").alias("ready"))
    return completed.agg(F.coalesce(F.bool_and("complete"), F.lit(True)).alias("ready"))


def exact_suffices(completed: DataFrame) -> bool:
    """Whether all chunks of a scope may be scored; only as many parents are counted as it takes to know."""
    size = completed.select("chunk_count").limit(EXACT_PARENTS + 1).agg(F.count("*").alias("parents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")).first()
    return size.parents <= EXACT_PARENTS and size.chunks <= EXACT_CHUNKS


def parent_scores(queries: DataFrame, completed: DataFrame, chunks: DataFrame, k: int = 50, least: float | None = None, exact: bool | None = None) -> DataFrame:
    """``query_id, parent_id, similarity, pos``: the k parents whose best chunk is most similar to any vector of a query.

    ``queries`` has ``query_id, vector``, one row for each vector of a query; it is the small side. If any parent of the
    scope is incomplete there is no result. Beyond the limits of exact scoring only the nearest chunks of a query
    count, as ``exact`` states or the scope's size tells. Ties go by parent.
    """
    if exact is None:
        exact = exact_suffices(completed)
    ready = scope_ready(completed)
    eligible = completed.where("complete").crossJoin(ready).where("ready").select(F.col("id").alias("parent_id"))  # one row of readiness
    scored = chunks.join(eligible, "parent_id", "left_semi").crossJoin(F.broadcast(queries)).select("query_id", "parent_id", cosine(F.col("embedding"), F.col("vector")).alias("similarity"))
    if not exact:
        head = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "parent_id")
        scored = scored.withColumn("_n", F.row_number().over(head)).where(F.col("_n") <= NEAREST_CHUNKS).drop("_n")
    best = scored.groupBy("query_id", "parent_id").agg(F.max("similarity").alias("similarity"))
    best = best.where(F.col("similarity") >= least) if least is not None else best
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "parent_id")
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def duplicates(parents: DataFrame, manifests: DataFrame, chunks: DataFrame, least: float) -> DataFrame:
    """``a_id, b_id, sim``: parents of a namespace that repeat another one.

    A near chunk proves nothing about the rest of two documents, so both must have one chunk only, or the same source.
    Incomplete parents take no part.
    """
    whole = complete_parents(parents, manifests, chunks).where("complete")
    vectors = whole.join(chunks.withColumnRenamed("parent_id", "id"), "id")
    single = vectors.where("chunk_count = 1").select("id", "namespace", "embedding")
    near = nearpairs.near_pairs(single, ["namespace"], least).select("a_id", "b_id", "sim")
    # the same source: their chunks meet by its digest, never across documents of other sources
    again = vectors.where("chunk_count > 1").select("id", "namespace", "embedding", "source_sha256")
    same = nearpairs.near_pairs(again, ["namespace", "source_sha256"], least).select("a_id", "b_id", "sim").groupBy("a_id", "b_id").agg(F.max("sim").alias("sim")).where("a_id <> b_id")
    return near.unionByName(same).select("a_id", "b_id", F.round("sim", 6).alias("sim"))
