"""The shards of problem 2 as a table, so that graphs are built once and searched by any number of later queries.

An index is three folders under one path: ``shards`` (a row for each shard: the flat arrays of its graph), ``centres``
(which shard a vector is routed to) and ``members`` (the records of each distinct vector). Every usable record is in
it; only the centres are fitted on a sample.

Defined results: as in ``knn``; a query whose space isn't in the index, or whose vector can't be compared, has no rows;
an empty index gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm import knn
from lorekeep.llm.smallworld import SmallWorld
from lorekeep.session import checkpointed

_SHARD = "identity long, cell int, part int, class_ids array<long>, vectors binary, top binary, layers array<binary>"


@dataclass(frozen=True)
class Index:
    shards: DataFrame
    centres: DataFrame
    members: DataFrame


def _build(links: int, width: int):
    def build(table: pa.Table) -> pa.Table:
        x = knn._unit(table.column("embedding").combine_chunks())
        vectors, top, layers = SmallWorld(x, links, width).arrays()
        key = [table.column(c).slice(0, 1) for c in ("identity", "cell", "part")]
        ids = pa.array([table.column("class_id").to_pylist()], pa.list_(pa.int64()))
        blobs = [pa.array([vectors.tobytes()], pa.binary()), pa.array([top.tobytes()], pa.binary()), pa.array([[layer.tobytes() for layer in layers]], pa.list_(pa.binary()))]
        return pa.table([*key, ids, *blobs], ["identity", "cell", "part", "class_ids", "vectors", "top", "layers"])

    return build


def build_index(memories: DataFrame, shard: int = knn.SHARD, sample: int = knn.SAMPLE, most_shard: int = knn.MOST_SHARD) -> Index:
    """The index of all usable records (lazy, but for the fit of the centres)."""
    rows = knn.usable(memories)
    members = checkpointed(rows.select("id", "identity", "class_id").distinct())
    fitted = knn.fit_centres(rows, members.select("identity", "class_id").distinct(), shard, sample)
    kinds = rows.select("class_id", "identity", "embedding").dropDuplicates(["class_id"])
    routed = checkpointed(kinds.mapInArrow(knn._route(fitted, 1), "class_id long, identity long, embedding array<float>, cells array<int>").select("class_id", "identity", "embedding", F.get("cells", F.lit(0)).alias("cell")))
    # one row for every ``most_shard`` vectors at most
    sizes = routed.groupBy("identity", "cell").agg(F.count("*").alias("n")).where(F.col("n") > most_shard).select("identity", "cell", F.ceil(F.col("n") / most_shard).cast("int").alias("parts"))
    placed = routed.join(F.broadcast(sizes), ["identity", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(9)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    shards = placed.groupBy("identity", "cell", "part").applyInArrow(_build(knn.LINKS, knn.WIDTH), _SHARD)
    spark = memories.sparkSession
    centres = [(int(identity), i, [float(v) for v in row]) for identity, all_rows in fitted.items() for i, row in enumerate(all_rows)]
    return Index(shards, spark.createDataFrame(centres, "identity long, cell int, centre array<float>"), members.select("class_id", "id"))


def write_index(index: Index, path: str) -> None:
    for name in ("shards", "centres", "members"):
        getattr(index, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("shards", "centres", "members")))


def _search(k: int, least: float):
    def search(visits: pa.Table, shards: pa.Table) -> pa.Table:
        names = ["query_id", "class_id", "similarity"]
        found: list[list] = [[], [], []]
        for shard in shards.to_pylist() if len(visits) else []:
            ids = np.array(shard["class_ids"], np.int64)
            x = np.frombuffer(shard["vectors"], np.float32).reshape(len(ids), -1)
            layers = [np.frombuffer(b, np.int32).reshape(len(ids), -1) for b in shard["layers"]]
            q = knn._unit(visits.column("embedding").combine_chunks())
            nodes, sims = SmallWorld.of_arrays(x, np.frombuffer(shard["top"], np.int32), layers, knn.WIDTH).search(q, min(k + 1, len(ids)))
            row, col = np.nonzero((nodes >= 0) & (sims >= least - 1e-3))
            exact = np.round(np.einsum("ij,ij->i", q[row], x[nodes[row, col]].astype(np.float64)), 6)
            keep = exact >= least
            query = visits.column("query_id").to_numpy(zero_copy_only=False)
            for out, values in zip(found, (query[row[keep]], ids[nodes[row[keep], col[keep]]], exact[keep])):
                out.append(values)
        flat = [np.concatenate(c) if c else np.array([]) for c in found]
        return pa.table([pa.array(flat[0], pa.string()), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))], names)

    return search


def search_index(index: Index, queries: DataFrame, k: int = 10, least: float = 0.8, probes: int = knn.PROBES, most_visitors: int = knn.MOST_VISITORS) -> DataFrame:
    """``query_id, memory_id, similarity, rank`` of the k most similar records of each query (``id``, ``embedding`` and its identity).

    A query that is a record of the index finds itself first. Queries meet the shards that they are routed to, never the table of vectors.
    """
    asked = knn.usable(queries).dropDuplicates(["id"]).select("id", "identity", "class_id", "embedding")
    # as many centres as the fit's sample allows
    centres: dict[int, list] = {}
    for r in index.centres.orderBy("identity", "cell").collect():
        centres.setdefault(r["identity"], []).append(r["centre"])
    fitted = {i: np.array(c, np.float32) for i, c in centres.items()}
    keyed = asked.select(F.xxhash64("id").alias("class_id"), "identity", "embedding")
    named = asked.select(F.xxhash64("id").alias("class_id"), F.col("id").alias("query_id"))
    routed = keyed.mapInArrow(knn._route(fitted, probes), "class_id long, identity long, embedding array<float>, cells array<int>").join(named, "class_id")
    cells = routed.select("query_id", "identity", "embedding", F.explode("cells").alias("cell"))
    visits = checkpointed(cells.join(index.shards.select("identity", "cell", "part"), ["identity", "cell"]))
    key = ["identity", "cell", "part"]
    tasks = visits.groupBy(*key).agg(F.ceil(F.count("*") / most_visitors).cast("int").alias("tasks"))
    shards = index.shards.join(tasks, key).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    placed = visits.join(tasks, key).withColumn("task", F.pmod(F.xxhash64("query_id", F.lit(11)), F.col("tasks")).cast("int")).select("query_id", "embedding", *key, "task")
    met = placed.groupBy(*key, "task").cogroup(shards.drop("tasks").groupBy(*key, "task")).applyInArrow(_search(k, least), "query_id string, class_id long, similarity double")
    # of equal vectors the k smallest ids suffice for anybody's k nearest
    first = index.members.withColumn("_n", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).where(F.col("_n") <= k).select("class_id", F.col("id").alias("memory_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "memory_id")
    ranked = met.join(first, "class_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "memory_id", "similarity", "rank")
