"""Bounded walks over the entity graph and chains of predecessors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import checkpointed


MOST_ENTITIES = 100
_ORDER = ("namespace", "entity_type", "normalized_name", "id")


def normal_name(name: Column) -> Column:
    """White space collapsed, lower case: the form in which names and aliases are equal."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def seeds(entities: DataFrame, links: DataFrame, name: str, entity_type: str | None = None) -> DataFrame:
    """``id, namespace, entity_type, normalized_name`` of the entities of a normal name or alias that visible ``links``
    (``memory_id, entity_id, aliases``) point at."""
    found = links.groupBy(F.col("entity_id").alias("id")).agg(F.max(F.coalesce(F.exists("aliases", lambda a: normal_name(a) == name), F.lit(False))).alias("_alias"))
    named = entities.select(*_ORDER).join(found, "id").where((F.col("normalized_name") == name) | F.col("_alias"))
    return (named.where(F.col("entity_type") == entity_type) if entity_type else named).select(*_ORDER)


def bounded_walk(seeds: DataFrame, links: DataFrame, entities: DataFrame, depth: int = 3, most: int = MOST_ENTITIES) -> DataFrame:
    """``id, depth, truncated`` of the entities within ``depth`` steps of the seeds, at most ``most`` in all.

    Two entities are one step apart if a visible record links to both. The driver holds the entities that were reached,
    which ``most`` bounds, so each step is one query whose frontier is a list of ids that reaches the scan of the links.
    What a step reaches is taken in the order of namespace, type, name and id; ``truncated`` tells that something
    was left out.
    """
    first = lambda frame, k: [r["id"] for r in frame.orderBy(*_ORDER).limit(k + 1).select("id").collect()]
    reached = first(seeds.select(*_ORDER), most)
    truncated = len(reached) > most
    frontier = reached[:most]
    walked = {i: 0 for i in frontier}
    for step in range(1, depth + 1):
        left = most - len(walked)
        if not frontier:
            break
        records = links.where(F.col("entity_id").isin(frontier)).select("memory_id").distinct()
        others = links.where(~F.col("entity_id").isin(list(walked))).join(records, "memory_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
        reached = first(others.join(entities.select(*_ORDER), "id"), left)
        truncated = truncated or len(reached) > left
        frontier = reached[:left]
        walked |= {i: step for i in frontier}
    return links.sparkSession.createDataFrame([(i, d, truncated) for i, d in walked.items()], "id string, depth int, truncated boolean")


def chain_depth(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id, depth, root``: steps to the end of each chain of ``id, supersedes_id``, by pointer doubling.

    After n rounds every pointer spans up to 2^n steps, so long chains need few rounds. A
    cycle never ends and is refused after ``most_rounds``.
    """
    walk = checkpointed(links.select("id", F.col("supersedes_id").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    for _ in range(most_rounds):
        further = walk.select(F.col("id").alias("root"), F.col("root").alias("next_root"), F.col("depth").alias("more"))
        walk = checkpointed(walk.join(further, "root", "left").select("id", F.coalesce("next_root", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next_root").isNotNull().alias("moved")))
        if walk.where("moved").isEmpty():
            return walk.select("id", "depth", "root")
        walk = walk.drop("moved")
    raise RuntimeError("a chain of predecessors has a cycle")
