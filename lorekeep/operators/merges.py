"""Writes as merges of an incoming frame into a stored one.

A merge gives the frame that holds afterwards, or what happened to each incoming row; nothing is changed in place.
Keys are compared by equality; an incoming row with a null key is inserted. Rows delivered twice must be made one before.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.texts import each


def not_guarded(stored: DataFrame) -> Column:
    """Records that may be written over: neither deleted, superseded nor part of another one, as far as the frame tells."""
    names = [c for c in ("deleted_at", "superseded_at", "consolidated_into_id") if c in stored.columns]
    return F.expr(" AND ".join(f"{c} IS NULL" for c in names) or "true")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], guard: Column | None = None, keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """The stored frame after an upsert by key, with ``action``: ``insert``, ``update``, ``guarded`` or null for rows that nothing came for.

    An incoming row replaces every column that both frames have but the keys and ``keep``; a guarded row stays as it is.
    """
    allowed = (not_guarded(stored) if guard is None else guard).alias("_free")
    old = stored.select("*", allowed, F.lit(True).alias("_old"))
    new = incoming.select(*[F.col(c).alias(f"_n_{c}") for c in incoming.columns], F.lit(True).alias("_new"))
    met = old.join(new, [old[k] == new[f"_n_{k}"] for k in keys], "full")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), None).when(F.col("_free"), "update").otherwise("guarded")
    met = met.withColumn("action", action)

    def merged(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(c)
        replaced = (F.col("action") == "update") & F.lit(c not in (*keys, *keep))
        return F.when((F.col("action") == "insert") | replaced, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)

    return met.select(*[merged(c) for c in stored.columns], "action")


def without_stale(stored: DataFrame, incoming: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """The stored rows that stay when the incoming ones are all that a group (a file) has now; groups that nothing came for stay whole."""
    groups = incoming.select(group).distinct().withColumn("_came", F.lit(True))
    present = incoming.select(group, *keys).distinct().withColumn("_present", F.lit(True))
    seen = stored.join(groups, group, "left").join(present, [group, *keys], "left")
    return seen.where("_came IS NULL OR _present").select(*stored.columns)


def insert_new(stored: DataFrame, incoming: DataFrame, identities: list[list[str]], order: list[str]) -> DataFrame:
    """The incoming rows with ``outcome``: ``stored``, ``repeated`` or ``inserted``.

    A row is stored already if any of its identities is; of a batch the first row of each identity in ``order``
    wins. Parts of an identity that are null are equal.
    """
    out = incoming
    for i, identity in enumerate(identities):
        known = stored.select(*[F.col(c).alias(f"_s_{c}") for c in identity]).distinct().withColumn(f"_known{i}", F.lit(True))
        out = out.withColumn(f"_nth{i}", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)))
        out = out.join(known, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in identity], "left").drop(*[f"_s_{c}" for c in identity])
    any_of = lambda f: F.greatest(*[f(i) for i in range(len(identities))]) if len(identities) > 1 else f(0)
    known = any_of(lambda i: F.coalesce(F.col(f"_known{i}"), F.lit(False)))
    again = any_of(lambda i: F.col(f"_nth{i}") > 1)
    return out.select(*incoming.columns, F.when(known, "stored").when(again, "repeated").otherwise("inserted").alias("outcome"))


def patch(stored: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """The stored frame after patches (``id, expected_revision, present`` and the patched columns), with ``outcome``.

    A column that ``present`` names is replaced as a whole, also by null; any other stays. A patch of another revision or
    of a guarded record is a ``conflict`` and changes nothing; ``patched`` rows have the next revision.
    """
    new = patches.select("id", "expected_revision", "present", *[F.col(c).alias(f"_n_{c}") for c in columns])
    met = stored.withColumn("_free", not_guarded(stored)).join(new, "id", "left")
    good = F.col("_free") & (F.col("revision") == F.col("expected_revision"))
    met = met.withColumn("outcome", F.when(F.col("expected_revision").isNull(), None).when(good, "patched").otherwise("conflict"))
    done = F.coalesce(F.col("outcome") == "patched", F.lit(False))

    def patched(c: str) -> Column:
        if c == "revision":
            return (F.col("revision") + done.cast("int")).alias("revision")
        if c not in columns:
            return F.col(c)
        return F.when(done & F.array_contains("present", c), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)

    return met.select(*[patched(c) for c in stored.columns], "outcome")


def merge_objects(old: Column, new: Column) -> Column:
    """The keys of two JSON objects; where both have one, the new value counts. What is null or no object counts as empty."""
    shape = "map<string,variant>"
    parsed = [F.coalesce(F.from_json(x, shape), F.from_json(F.lit("{}"), shape)) for x in (old, new)]
    kept = F.map_filter(parsed[0], lambda k, _: ~F.map_contains_key(parsed[1], k))
    return F.to_json(F.map_concat(kept, parsed[1]))


def register(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The stored frame after registrations: a value that is given replaces, one that isn't stays, ``metadata`` is merged by key and ``last_seen_at`` is the later one."""
    old = stored.select("*", F.lit(True).alias("_old"))
    new = incoming.select(*[F.col(c).alias(f"_n_{c}") for c in incoming.columns])
    met = old.join(new, [F.col(k) == F.col(f"_n_{k}") for k in keys], "full")

    def merged(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(c)
        if c == "metadata":
            return F.when(F.col("_old").isNull(), F.col("_n_metadata")).when(F.col(f"_n_{keys[0]}").isNull(), F.col("metadata")).otherwise(merge_objects(F.col("metadata"), F.col("_n_metadata"))).alias(c)
        if c == "last_seen_at":
            return F.greatest(F.col(c), F.col(f"_n_{c}")).alias(c)
        return F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c)

    return met.select(*[merged(c) for c in stored.columns])


def without_paths(value: Column, *paths: str) -> Column:
    """A JSON value with its keys in order and without the given paths (``a.b``); null for what is no JSON."""

    def drop(text: str) -> str | None:
        try:
            parsed = json.loads(text)
        except ValueError:
            return None
        for path in paths:
            *parents, last = path.split(".")
            inner = parsed
            for name in parents:
                inner = inner.get(name) if isinstance(inner, dict) else None
            if isinstance(inner, dict):
                inner.pop(last, None)
        return json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return each(drop, "string")(value)


def snapshot_compare(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, same, keep_vector`` of rows that both have: null-safe equality of all columns, ``metadata`` without the ignored paths; a vector is kept with its content."""
    new = incoming.select(*[F.col(c).alias(f"_n_{c}") for c in (*keys, *columns)])
    met = stored.join(new, [F.col(k) == F.col(f"_n_{k}") for k in keys])
    shown = lambda c: without_paths(F.col(c), *ignored) if c.endswith("metadata") else F.col(c)
    equal = F.lit(True)
    for c in columns:
        equal = equal & shown(c).eqNullSafe(shown(f"_n_{c}"))
    return met.select(*keys, equal.alias("same"), F.col("content").eqNullSafe(F.col("_n_content")).alias("keep_vector"))
