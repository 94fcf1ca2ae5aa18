"""Greedy complete-link clusters over a graph of similar pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import checkpointed

MOST = 20


def cluster_of(anchor: str, later: list[str], near: dict[str, set[str]], most: int = MOST) -> tuple[list[str], bool]:
    """The anchor and, in order, each later neighbour that is near all members so far; with more than ``most`` members it is oversized."""
    members = [anchor]
    for x in later:
        if all(x in near[y] for y in members):
            members.append(x)
            if len(members) > most:
                return members, True
    return members, False


def greedy(pairs: pd.DataFrame, order: dict[str, tuple], most: int = MOST) -> list[list[str]]:
    """Clusters of anchors in order. An anchor looks at its first ``most`` later neighbours; a member of a cluster is no
    anchor any more, but may still be a neighbour. Oversized clusters are left out and use up nobody."""
    near: dict[str, set[str]] = {}
    for a, b in zip(pairs["a_id"], pairs["b_id"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    used: set[str] = set()
    out = []
    for anchor in sorted(near, key=lambda x: order[x]):
        if anchor in used:
            continue
        later = sorted((x for x in near[anchor] if order[x] > order[anchor]), key=lambda x: order[x])[:most]
        members, oversized = cluster_of(anchor, later, near, most)
        if len(members) >= 2 and not oversized:
            used.update(members)
            out.append(members)
    return out


def _connected(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component`` by least labels; each round is written to the checkpoint folder.

    A round takes the least label among neighbours and then follows labels once more, so rounds
    grow with the logarithm of the longest path.
    """
    edges = checkpointed(pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other")).unionByName(pairs.select(F.col("b_id").alias("id"), F.col("a_id").alias("other"))))
    labels = checkpointed(edges.groupBy("id").agg(F.least(F.first("id"), F.min("other")).alias("label")))
    for _ in range(most_rounds):
        heard = edges.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("theirs"))
        near = labels.join(heard, "id").select("id", F.col("label").alias("before"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = checkpointed(near.join(jump, "label").select("id", "before", F.least("label", "further").alias("label")))
        labels = moved.select("id", "label")
        if moved.where("before <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def complete_link(pairs: DataFrame) -> DataFrame:
    """``namespace, cluster_id, id`` from pairs at or above the threshold (``namespace, a_id, b_id, a_created_at, b_created_at``).

    The greedy pass is sequential by definition, so it runs per connected component of the
    pair graph, which is what its result can depend on; components are small where the
    threshold is high. Empty input gives an empty result.
    """
    parts = _connected(pairs)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    placed = pairs.join(parts.select(F.col("id").alias("a_id"), "component"), "a_id")
    placed = placed.select("component", "namespace", "a_id", "b_id", us("a_created_at").alias("a_at"), us("b_created_at").alias("b_at"))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        order = {i: (t, i) for i, t in zip(group["a_id"], group["a_at"])} | {i: (t, i) for i, t in zip(group["b_id"], group["b_at"])}
        rows = [(group["namespace"].iloc[0], members[0], x) for members in greedy(group, order) for x in members]
        return pd.DataFrame(rows, columns=["namespace", "cluster_id", "id"], dtype=object)

    return placed.groupBy("component").applyInPandas(cluster, "namespace string, cluster_id string, id string")


def violations(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """``violations``: pairs of one cluster that are not among the similar pairs."""
    a, b = clusters.select("cluster_id", F.col("id").alias("a_id")), clusters.select("cluster_id", F.col("id").alias("b_id"))
    inside = a.join(b, "cluster_id").where("a_id < b_id")
    return inside.join(pairs.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").agg(F.count("*").alias("violations"))
