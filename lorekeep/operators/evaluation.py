"""Judgements, case metrics and the comparison of two reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(judgments: DataFrame, records: DataFrame, strict: bool = False) -> DataFrame:
    """``case_id, label, found, state, id`` of each judgement (``case_id, source_key, id``, one of the two given).

    ``records`` (``id, source_key``) are those that the case's filters and scope admit, each once. A source key that
    several of them have is ambiguous, and so is a record that a case judges twice; with ``strict`` either raises
    when the result is read. ``id`` is the record of a resolved judgement.
    """
    by_key = judgments.where(F.col("source_key").isNotNull()).select("case_id", "source_key").distinct()
    by_id = judgments.where(F.col("source_key").isNull() & F.col("id").isNotNull()).select("case_id", "id").distinct()
    keyed = by_key.join(records.select("source_key", F.col("id").alias("hit")), "source_key", "left").select("case_id", F.col("source_key").alias("label"), "hit")
    named = by_id.join(records.select("id", F.col("id").alias("hit")), "id", "left").select("case_id", F.col("id").alias("label"), "hit")
    grouped = keyed.unionByName(named).groupBy("case_id", "label").agg(F.count("hit").alias("found"), F.min("hit").alias("hit"))
    state = F.when(F.col("found") == 0, "missing").when(F.col("found") == 1, "resolved").otherwise("ambiguous")
    out = grouped.select("case_id", "label", "found", state.alias("state"), F.when(F.col("found") == 1, F.col("hit")).alias("id"))
    if not strict:
        return out
    twice = (F.col("state") == "resolved") & (F.count("id").over(Window.partitionBy("case_id", "id")) > 1)
    refused = F.when((F.col("state") == "ambiguous") | twice, F.raise_error(F.concat(F.lit("ambiguous judgement "), "label", F.lit(" of case "), "case_id"))).otherwise(F.col("state"))
    return out.withColumn("state", refused)


def case_metrics(results: DataFrame, relevant: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """``case_id, recall, reciprocal_rank, hit, first_rank`` of every judged case.

    ``results`` has ``case_id, id, pos`` (positions from 1), ``relevant`` the resolved ``case_id, id`` and ``judged``
    ``case_id, n_judged, diagnostic``: recall is divided by all that was judged relevant, found in the store or
    not. A diagnostic case has no metrics.
    """
    top = results.where(F.col("pos") <= k).join(relevant.select("case_id", "id").distinct(), ["case_id", "id"])
    hits = top.groupBy("case_id").agg(F.count("*").alias("_hits"), F.min("pos").alias("_first"))
    joined = judged.join(hits, "case_id", "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    scored = lambda x: F.when(~F.col("diagnostic"), x)
    return joined.select(
        "case_id", scored(F.col("_hits") / F.col("n_judged")).alias("recall"), scored(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0))).alias("reciprocal_rank"),
        scored(F.col("_hits") > 0).alias("hit"), scored(F.col("_first")).alias("first_rank"),
    )


def stable_hash(value) -> str:
    """Digest of a value as JSON with its keys in order."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


#: What two reports must share for their metrics to be comparable, and what a difference is called.
COMPARABLE = {
    "schema": "report schema major", "dataset_hash": "dataset hash", "ranking_hash": "ranking config", "config_hash": "query/filter/k/threshold config",
    "as_of": "as_of", "database": "database label", "search_width": "ef_search", "provider": "embedding provider", "model": "embedding model",
    "dimensions": "embedding dimensions", "profile": "embedding profile",
}


def baseline_mismatches(current: dict, baseline: dict) -> list[str]:
    """What makes a report incomparable with its baseline; empty if nothing does."""
    return [name for key, name in COMPARABLE.items() if current.get(key) != baseline.get(key)]
