"""Where models and receivers meet the engine: a caller's step goes in, what it gives is checked row by row.

A step is a function from a frame to a frame; nothing here knows a provider. What breaks the contract raises when it
is read, so a wrong answer never gets stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import keyed_digest
from lorekeep.operators.texts import each
from lorekeep.search import Space, dot

Step = Callable[[DataFrame], DataFrame]


def _checked(value: Column, good: Column, what: str, key: Column) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(key.cast("string"), F.lit("?")))))


def generate(rows: DataFrame, step: Step, schema: str, most_bytes: int = 64 << 10, key: str = "id") -> DataFrame:
    """``rows`` with ``output``: the answers of a generation step (``key, answer`` as JSON) in a strict shape.

    An answer that is too long, isn't of the shape or has a field missing refuses its row; a row without an answer has null.
    """
    answers = step(rows).select(key, F.col("answer").alias("_answer"))
    parsed = F.from_json("_answer", schema, {"mode": "PERMISSIVE"})
    joined = rows.join(answers, key, "left").withColumn("_parsed", parsed)
    fields = [f.name for f in joined.schema["_parsed"].dataType.fields]
    whole = F.lit(True)
    for name in fields:
        whole = whole & F.col(f"_parsed.{name}").isNotNull()
    good = F.col("_answer").isNull() | ((F.octet_length("_answer") <= most_bytes) & F.coalesce(whole, F.lit(False)))
    return joined.select(*rows.columns, _checked(F.when(F.col("_answer").isNotNull(), F.col("_parsed")), good, "answer out of shape", F.col(key)).alias("output"))


def embed(rows: DataFrame, step: Step, space: Space, unit: bool = False, key: str = "id") -> DataFrame:
    """``rows`` with ``embedding`` and its identity: vectors of an embedding step (``key, vector``) of the space's dimensions, finite and of some length (of length one, where asked)."""
    vectors = step(rows).select(key, F.col("vector").cast("array<float>").alias("_v"))
    norm = F.sqrt(dot(F.col("_v"), F.col("_v")))
    good = (F.size("_v") == space.dimensions) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0)
    good = good & (F.abs(norm - 1) <= 1e-5) if unit else good
    joined = rows.join(vectors, key)
    vector = _checked(F.col("_v"), F.coalesce(good, F.lit(False)), "vector out of contract", F.col(key))
    return joined.select(*rows.columns, vector.alias("embedding"), F.lit(space.provider).alias("embedding_provider"), F.lit(space.model).alias("embedding_model"), F.lit(space.dimensions).alias("embedding_dimensions"))


def deliveries(matches: DataFrame, secret: bytes, version: int = 1) -> DataFrame:
    """``delivery_key, payload, signature`` of matches (``subscription_id, memory_id, namespace, similarity``): what a receiver would get.

    The key is the same for the same match, so a delivery that is repeated can be told; sending is left to the caller.
    """
    payload = F.to_json(F.struct("subscription_id", "memory_id", "namespace", F.lit(version).alias("event_version"), F.round("similarity", 6).alias("similarity")))
    keyed = matches.select(F.concat_ws(":", "subscription_id", "memory_id", F.lit(str(version))).alias("delivery_key"), payload.alias("payload"))
    return keyed.dropDuplicates(["delivery_key"]).withColumn("signature", F.concat(F.lit("sha256="), each(lambda v: keyed_digest(secret, v), "string")("payload")))
