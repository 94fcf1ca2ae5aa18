"""Problem 7: documents selected and repeated so that each source has its target share.

Sizes are tokens of a public tokenizer. Every document gets a hash-random key; within its
source the documents are ordered by that key (then ``doc_id``). Running token sums come
from distributed prefix sums: keys fall into ``buckets`` equal ranges, each source has one
total per range, the totals are summed up per source (at most ``buckets`` rows of it), and
only then are documents summed within their range. A source with a third of all documents
is therefore spread over all ranges.

A source's budget is its weight's share of the mix's size. Whole passes over the source are
taken while they fit, and one last pass is cut where the budget is met: a document belongs
to it if at least half of the document lies within what is left, so the source misses its
budget by at most half a document.

Defined results: weights are relative within a mix (their sum must be positive, else the
mix selects nothing); null or negative weights count as zero; a source may give at most
``max_repeats`` times its tokens (null means once), so a mix whose repeats can't fill
falls short, which ``mix_shares`` reports - nothing else is taken instead. Null, empty and
blank-source documents: a document without tokens or without source is never selected.
Sources without documents and with zero weight are reported with zero tokens. Rows of one
``mix_name`` and ``source`` that repeat are one target. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.tokens import token_counts
from lorekeep.session import checkpointed

#: Documents of a range, and the least number of ranges.
PER_RANGE, LEAST_RANGES = 50_000, 64


def ranges_for(sized: DataFrame) -> int:
    """How many ranges of keys a corpus takes; the driver learns one count."""
    return max(LEAST_RANGES, -(-sized.count() // PER_RANGE))


def sized_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, source, tokens`` of every document; written once, as several steps read it."""
    sources = documents.groupBy("doc_id").agg(F.max("source").alias("source"))
    return checkpointed(token_counts(documents, tokenizer).join(sources, "doc_id"))


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: its target share, budget, whole passes and the cut of the last pass."""
    # the totals per source are aggregated before anything else sees them
    by_source = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    corpus = by_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("all_tokens"))
    clean = targets.groupBy("mix_name", "source").agg(
        F.max(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"),
        F.max("size_ratio").alias("size_ratio"),
    )
    mix = Window.partitionBy("mix_name")  # as many rows as the mix has sources
    share = F.coalesce(F.try_divide("weight", F.sum("weight").over(mix)), F.lit(0.0))
    out = clean.withColumn("target_share", share).join(by_source, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    # one row of totals, as a scalar
    out = out.withColumn("_one", F.lit(1)).join(corpus.withColumn("_one", F.lit(1)), "_one").drop("_one")
    wanted = F.col("target_share") * F.coalesce("size_ratio", F.lit(0.0)) * F.col("all_tokens")
    out = out.withColumn("target_tokens", wanted)
    given = F.least("target_tokens", (F.col("source_tokens") * F.col("max_repeats")).cast("double"))
    out = out.withColumn("budget", given)
    passes = F.coalesce(F.floor(F.try_divide("budget", "source_tokens")), F.lit(0))
    return out.withColumn("passes", passes.cast("int")).withColumn("left_over", F.col("budget") - F.col("passes") * F.col("source_tokens"))


def running_tokens(sized: DataFrame, buckets: int | None = None, seed: int = 7) -> DataFrame:
    """``doc_id, source, tokens, before``: tokens of the source that come before the document in random order."""
    buckets = buckets or ranges_for(sized)
    keyed = sized.where((F.col("tokens") > 0) & F.col("source").isNotNull()).withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    width = 2**64 // buckets
    keyed = keyed.withColumn("bucket", F.floor(F.col("key") / F.lit(float(width))).cast("int"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "bucket", F.coalesce(F.sum("bucket_tokens").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("upto", F.sum("tokens").over(within))
    return summed.join(starts, ["source", "bucket"]).select("doc_id", "source", "tokens", (F.col("start") + F.col("upto") - F.col("tokens")).alias("before"))


def mix_documents(sized: DataFrame, targets: DataFrame, buckets: int | None = None, seed: int = 7) -> DataFrame:
    """``mix_name, doc_id, source, tokens, copies`` of every selected document."""
    plan = budgets(sized, targets).select("mix_name", "source", "passes", "left_over", "max_repeats").where("passes > 0 or left_over > 0")
    placed = running_tokens(sized, buckets, seed).join(plan, "source")
    again = F.when((F.col("passes") < F.col("max_repeats")) & (F.col("before") + F.col("tokens") / 2 <= F.col("left_over")), 1).otherwise(0)
    return placed.withColumn("copies", F.col("passes") + again).where("copies > 0").select("mix_name", "doc_id", "source", "tokens", "copies")


def mix_shares(sized: DataFrame, targets: DataFrame, buckets: int | None = None, seed: int = 7) -> DataFrame:
    """For every mix and source the target and the share really reached."""
    reached = mix_documents(sized, targets, buckets, seed).groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").cast("bigint").alias("documents"))
    planned = budgets(sized, targets).join(reached, ["mix_name", "source"], "left")
    mix = Window.partitionBy("mix_name")
    tokens = F.coalesce("mix_tokens", F.lit(0))
    return planned.select(
        "mix_name", "source", "target_share", "target_tokens", "source_tokens", "max_repeats", tokens.alias("mix_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce(F.try_divide(tokens.cast("double"), F.sum(tokens).over(mix)), F.lit(0.0)).alias("share"),
    )
