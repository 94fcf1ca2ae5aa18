"""Problem 2: for every vector the k most similar vectors of its own embedding identity.

Vectors of one identity are spread over shards of about ``SHARD`` vectors by their nearest
centre; centres are fitted on a sample (sixteen vectors for each centre, at least 16,384, at most
``SAMPLE``, all identities together). Every shard gets a hierarchical navigable small-world graph over all its
vectors, stored as flat neighbour arrays (``smallworld``). Each vector is searched in the
``PROBES`` shards whose centres are nearest to it, and the shards' results are merged.

A centre that attracts more than ``MOST_SHARD`` vectors is split into as many shards as it
needs; queries for it then visit all of them. A shard that more than ``MOST_VISITORS`` vectors
visit is searched in as many tasks as that takes, each with the shard's graph and its own
visitors. So no task holds an unbounded shard or unbounded visitors, and nothing is dropped. Equal vectors are one class, indexed once, so a group of copies costs
no more than one vector; each member of it gets the class's result without itself.

Defined results: a vector takes no part if it is null, all zero, of another length than its
stated dimensions, has a null or non-finite element, or a null in its identity; cosines are
rounded to six decimals, those below ``least`` don't count, equal ones go by the smaller
id; a row may have fewer than k. Rows that share ``id`` are one record, an empty table
gives an empty result and further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.smallworld import SmallWorld
from lorekeep.session import checkpointed

SHARD = 2_048
MOST_SHARD = 32_768
MOST_VISITORS = 131_072
SAMPLE = 262_144
PROBES = 3
LINKS = 16
WIDTH = 20
IDENTITY = ("embedding_provider", "embedding_model", "embedding_dimensions")


def usable(memories: DataFrame) -> DataFrame:
    """``id, identity, class_id, embedding`` of every record whose vector can be compared."""
    vector = F.col("embedding").cast("array<float>")
    good = (
        (F.size("embedding") == F.col("embedding_dimensions"))
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    kept = memories.select("id", *IDENTITY, vector.alias("embedding")).dropna(subset=["id", *IDENTITY, "embedding"]).where(good)
    keyed = kept.withColumn("identity", F.xxhash64(*IDENTITY)).withColumn("class_id", F.xxhash64("identity", "embedding"))
    return keyed.select("id", "identity", "class_id", "embedding")  # an id may still be there twice


def _unit(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix of unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def fit_centres(rows: DataFrame, sizes_of: DataFrame, shard: int = SHARD, sample: int = SAMPLE, rounds: int = 8) -> dict[int, np.ndarray]:
    """Centres of every identity with more than one shard's vectors, by spherical k-means on a bounded sample.

    ``sizes_of`` has the identity of every class. Counts come back for identities of more than a shard only.
    """
    sizes = {r["identity"]: r["n"] for r in sizes_of.groupBy("identity").agg(F.count("*").alias("n")).where(F.col("n") > shard).collect()}
    if not sizes:
        return {}
    total = sum(sizes.values())
    wanted = min(sample, max(16_384, 16 * total // shard))
    share = min(1.0, wanted / total)
    large = rows.where(F.col("identity").isin(list(sizes)) & (F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)))
    drawn = large.select("identity", "class_id", "embedding").dropDuplicates(["class_id"]).limit(2 * wanted).toArrow()
    out = {}
    of = drawn.column("identity").to_numpy()
    for identity, n in sizes.items():
        rows = drawn.filter(pa.array(of == identity)).column("embedding").combine_chunks()
        if not len(rows):
            continue
        x = _unit(rows).astype(np.float32)
        k = min(-(-n // shard), max(1, len(x) // 8))
        centres = x[np.random.default_rng(5).permutation(len(x))[:k]]
        for _ in range(rounds):
            nearest = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, x)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-9), centres).astype(np.float32)
        out[identity] = centres
    return out


def _route(centres: dict[int, np.ndarray], probes: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            identities = batch.column("identity").to_numpy()
            nearest = [[0]] * len(batch)
            for identity in np.unique(identities):
                at = np.nonzero(identities == identity)[0]
                if identity in centres:
                    sims = _unit(batch.column("embedding").take(pa.array(at))) @ centres[identity].T
                    best = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                    for i, row in zip(at, best):
                        nearest[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("identity"), batch.column("embedding"), pa.array(nearest, pa.list_(pa.int32()))], ["class_id", "identity", "embedding", "cells"])

    return route


def _search(k: int, least: float, links: int, width: int):
    def search(table: pa.Table) -> pa.Table:
        x = _unit(table.column("embedding").combine_chunks())
        classes = table.column("class_id").to_numpy()
        stored, asks = (np.nonzero(table.column(c).to_numpy())[0] for c in ("stored", "asks"))
        names = ["class_id", "other", "similarity"]
        if not len(stored) or not len(asks):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        graph = SmallWorld(x[stored], links, width)
        ids, sims = graph.search(x[asks], min(k + 2, len(stored)))
        row, col = np.nonzero((ids >= 0) & (sims >= least - 1e-3))
        other, row = stored[ids[row, col]], asks[row]
        exact = np.round(np.einsum("ij,ij->i", x[row], x[other]), 6)
        keep = (exact >= least) & (classes[row] != classes[other])
        return pa.table([pa.array(classes[row[keep]]), pa.array(classes[other[keep]]), pa.array(exact[keep])], names)

    return search


def similar_classes(
    rows: DataFrame, members: DataFrame, k: int = 10, least: float = 0.8, shard: int = SHARD, probes: int = PROBES, sample: int = SAMPLE,
    most_shard: int = MOST_SHARD, most_visitors: int = MOST_VISITORS,
) -> DataFrame:
    """``class_id, other, similarity`` of each class's nearest classes."""
    centres = fit_centres(rows, members.select("identity", "class_id").distinct(), shard, sample)
    kinds = rows.select("class_id", "identity", "embedding").dropDuplicates(["class_id"])
    routed = checkpointed(kinds.mapInArrow(_route(centres, probes), "class_id long, identity long, embedding array<float>, cells array<int>"))
    # cells that are far too large become several shards, those with far too many visitors are searched by several tasks;
    # there is at most one row here for every ``MOST_SHARD`` vectors
    visited = routed.select("identity", F.posexplode("cells").alias("place", "cell")).groupBy("identity", "cell").agg(F.count_if(F.col("place") == 0).alias("n"), F.count("*").alias("v"))
    sizes = visited.where((F.col("n") > most_shard) | (F.col("v") > most_visitors)).select(
        "identity", "cell", F.greatest(F.lit(1), F.ceil(F.col("n") / most_shard)).cast("int").alias("parts"), F.ceil(F.col("v") / most_visitors).cast("int").alias("tasks")
    )
    cells = routed.select("class_id", "identity", "embedding", F.posexplode("cells").alias("place", "cell")).join(F.broadcast(sizes), ["identity", "cell"], "left").fillna(1, ["parts", "tasks"])
    drawn = lambda seed, n: F.pmod(F.xxhash64("class_id", F.lit(seed)), F.col(n)).cast("int")
    # a vector asks every part in one of the tasks, and is stored in one part of its nearest cell, for every task
    cells = cells.withColumns({"part": F.when(F.col("place") == 0, drawn(9, "parts")).otherwise(-1), "task": drawn(11, "tasks")})
    grid = F.expr("""array_union(transform(sequence(0, parts - 1), p -> struct(task AS t, p AS p)),
        CASE WHEN part >= 0 THEN transform(sequence(0, tasks - 1), t -> struct(t AS t, part AS p)) ELSE array() END)""")
    visits = cells.withColumn("at", F.explode(grid)).select(
        "class_id", "embedding", (F.col("at.p") == F.col("part")).alias("stored"), (F.col("at.t") == F.col("task")).alias("asks"), F.xxhash64("identity", "cell", "at.p", "at.t").alias("shard")
    )
    return visits.groupBy("shard").applyInArrow(_drop_shard(_search(k, least, LINKS, WIDTH)), "class_id long, other long, similarity double")


def _drop_shard(search):
    def run(table: pa.Table) -> pa.Table:
        return search(table.select(["class_id", "embedding", "stored", "asks"]))

    return run


def neighbours(memories: DataFrame, k: int = 10, least: float = 0.8, **sizes) -> DataFrame:
    """``memory_id, neighbour_id, similarity, rank`` (1 to k) of every usable record that has any."""
    rows = usable(memories)
    keyed = checkpointed(rows.select("id", "identity", "class_id").distinct())
    links = checkpointed(similar_classes(rows, keyed, k, least, **sizes))
    # a class gives at most its k + 1 smallest ids: none of the others can be among anybody's k nearest
    members = keyed.select("class_id", "id")
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).where(F.col("_n") <= k + 1).select(F.col("class_id").alias("other"), F.col("id").alias("neighbour_id"))
    itself = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id", F.col("class_id").alias("other"), F.lit(1.0).alias("similarity"))
    offered = links.unionByName(itself).join(first, "other")
    best = Window.partitionBy("class_id").orderBy(F.desc("similarity"), "neighbour_id")
    lists = offered.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    lists = lists.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("_n", "neighbour_id", "similarity"))).alias("list"))  # at most k + 1
    each = members.join(lists, "class_id").select("id", F.slice(F.filter("list", lambda x: x["neighbour_id"] != F.col("id")), 1, k).alias("list"))
    return each.select(F.col("id").alias("memory_id"), F.posexplode("list").alias("_p", "x")).select("memory_id", F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.similarity").alias("similarity"), (F.col("_p") + 1).alias("rank"))


def found_pairs(memories: DataFrame, k: int = 10, least: float = 0.8, **sizes) -> DataFrame:
    """``memory_id_a, memory_id_b`` (a < b), one of which is among the k nearest of the other."""
    near = neighbours(memories, k, least, **sizes)
    return near.select(F.least("memory_id", "neighbour_id").alias("memory_id_a"), F.greatest("memory_id", "neighbour_id").alias("memory_id_b")).distinct()
