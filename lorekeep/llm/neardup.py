"""Problem 4: records of one namespace that share most of their content.

The similarity of two contents is the share of their distinct three-word sequences that
both have. Contents with the same set of sequences form one class, which is compared once.
Every class has a fingerprint of ``SYMBOLS`` minhash symbols of one byte, two of which agree
with the probability of the similarity. The fingerprint is cut into blocks of ``BLOCK`` symbols.
By the pigeonhole principle a pair that differs in fewer symbols than there are blocks
shares one. At the threshold itself pairs differ in more; they share a block with a probability
of 99.4 %, at 0.55 of 99.9 %, above 0.6 of practically one. (A guarantee at 0.5 would take
blocks of one symbol, which nearly all pairs share.) Classes are joined on blocks; pairs so
met are verified by the Hamming distance of the fingerprints that were joined (five standard
deviations of room for a pair at the threshold), and then on the word sequences of their texts.

A block key is a row of its own, so a block that many share is split like any skewed join
key; nothing is collected by block. Joins of block rows are told to sort and merge: the
planner takes an array for one element, so the side that it holds for small is not.
Copies of a text never meet each other: they are linked to the least id of their text.

Defined results: contents that are null, blank or of fewer than three words have no
sequences and no pairs; null is a namespace like any other; rows that share ``id`` are one
record; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import checkpointed

WORDS = 3
THRESHOLD = 0.5
BLOCK = 4
BLOCKS = 80
SYMBOLS = BLOCK * BLOCKS


def word_list(content: Column) -> Column:
    """The longest runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(content), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def sequences(found: Column, words: int = WORDS) -> Column:
    """Hashes of the distinct sequences of so many words of a list, in order; empty for short lists.

    The list must be a column of its own, or it would be made again for each of its words.
    """
    starts = F.when(F.size(found) >= words, F.sequence(F.lit(0), F.size(found) - words)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.hash(*[F.get(found, i + k) for k in range(words)]))
    return F.array_sort(F.array_distinct(hashes))


def spelt_sequences(found: Column, words: int = WORDS) -> Column:
    """The distinct sequences themselves; words hold letters and digits only, so a space keeps them apart."""
    starts = F.when(F.size(found) >= words, F.sequence(F.lit(0), F.size(found) - words)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(found, i + k) for k in range(words)])))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    draw = np.random.default_rng(20240501)
    factors = draw.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = draw.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
    for batch in batches:
        lists = batch.column("sequences")
        if not len(lists):
            continue
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        n = len(lists)
        symbols = np.empty((n, SYMBOLS), np.uint8)
        starts, values = offsets[:-1] - offsets[0], values[offsets[0] : offsets[-1]]
        for k in range(SYMBOLS):  # over the symbols, each for all rows of the batch at once
            hashed = values * factors[k] + terms[k]
            least = np.minimum.reduceat(hashed ^ (hashed >> np.uint64(31)), starts)
            symbols[:, k] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
        blocks = symbols.view(np.int32)  # four symbols of one byte make a block
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, blocks.size + 1, BLOCKS, dtype=np.int32)), pa.array(blocks.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("space"), batch.column("id"), cells], ["class_id", "space", "id", "blocks"])


def classes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``id, text_key, class_id``) and fingerprints (``class_id, space, id, blocks``; ``space`` is the namespace's key, ``id`` one member)."""
    space = F.xxhash64(F.col("namespace").isNull(), "namespace")
    cut = memories.select("id", space.alias("space"), F.xxhash64(space, "content").alias("text_key"), word_list(F.col("content")).alias("words")).where(F.size("words") >= WORDS)
    keyed = cut.select("id", "space", "text_key", sequences(F.col("words")).alias("sequences"))
    keyed = keyed.select("id", "text_key", "space", F.xxhash64("space", "sequences").alias("class_id"), "sequences")
    # made twice from the source, which moves less than writing contents or sequences of every row
    members = checkpointed(keyed.select("id", "text_key", "class_id").distinct())
    kinds = keyed.select("class_id", "space", "id", "sequences").dropDuplicates(["class_id"])
    return members, checkpointed(kinds.mapInArrow(_fingerprints, "class_id long, space long, id string, blocks array<int>"))


def merged(x: DataFrame, y: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sort and merge, whatever size the planner expects of arrays."""
    return x.hint("merge").join(y.hint("merge"), on, how)


def met_classes(printed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, id_a, id_b`` of different classes that share a block and whose fingerprints are near enough, a < b."""
    # a key holds the namespace, the number of the block and the block
    rows = printed.select("class_id", "space", F.posexplode("blocks").alias("block", "key")).select("class_id", F.xxhash64("space", "block", "key").alias("key"))
    met = merged(rows.alias("x"), rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.class_id") < F.col("y.class_id")))
    pairs = met.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    end = lambda side: printed.select(F.col("class_id").alias(side), F.col("id").alias(f"id_{side}"), F.col("blocks").alias(f"blocks_{side}"))
    # counted as a long of 32 bits, as the count extends the sign
    apart = lambda i: F.get("blocks_a", F.lit(i)).bitwiseXOR(F.get("blocks_b", F.lit(i))).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    distance = sum((F.bit_count(apart(i)) for i in range(BLOCKS)), F.lit(0))
    near = merged(merged(pairs, end("a"), "a"), end("b"), "b").where(distance <= furthest_bits(threshold))
    return near.select("a", "b", "id_a", "id_b")


def similar_classes(printed: DataFrame, memories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity`` of every pair of different classes at or above the threshold, a < b."""
    near = checkpointed(met_classes(printed, threshold))
    # the words themselves decide; only contents of the classes that have met are read again
    wanted = near.select(F.col("id_a").alias("id")).unionByName(near.select(F.col("id_b").alias("id"))).distinct()
    words = memories.select("id", "content").join(wanted, "id", "left_semi").dropDuplicates(["id"]).select("id", word_list(F.col("content")).alias("words"))
    sets = words.select("id", spelt_sequences(F.col("words")).alias("set"))
    both = merged(merged(near, sets.select(F.col("id").alias("id_a"), F.col("set").alias("set_a")), "id_a"), sets.select(F.col("id").alias("id_b"), F.col("set").alias("set_b")), "id_b")
    both = both.select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    return both.select("a", "b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold)


def furthest_bits(threshold: float) -> float:
    """The most bits in which fingerprints of a pair at the threshold differ: five standard deviations above the mean.

    A symbol that differs differs in half of its eight bits on the average, with a variance of two.
    """
    differ = SYMBOLS * (1 - threshold)
    return 4 * differ + 5 * (16 * differ * threshold + 2 * differ) ** 0.5


def _parts(memories: DataFrame, threshold: float):
    members, printed = classes(memories)
    return members, checkpointed(similar_classes(printed, memories, threshold).select("a", "b"))


def found_pairs(memories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``memory_id_a, memory_id_b`` (a < b) of every pair of different texts at or above the threshold.

    Exact copies of a text are linked to the least id of their text.
    """
    members, links = _parts(memories, threshold)
    texts = members.groupBy("class_id", "text_key").agg(F.min("id").alias("least"))
    copies = members.join(texts, ["class_id", "text_key"]).where("id <> least").select(F.col("least").alias("x"), F.col("id").alias("y"))
    # texts of one class differ in what isn't a word; they meet as texts, then each brings its copies
    same = texts.select("class_id", F.col("text_key").alias("t")).join(texts.select("class_id", F.col("text_key").alias("u")), "class_id").where("t < u").select("t", "u")
    across = links.join(texts.select(F.col("class_id").alias("a"), F.col("text_key").alias("t")), "a").join(texts.select(F.col("class_id").alias("b"), F.col("text_key").alias("u")), "b").select("t", "u")
    copies_of = members.select("text_key", "id")
    apart = (
        same.unionByName(across)
        .join(copies_of.select(F.col("text_key").alias("t"), F.col("id").alias("x")), "t")
        .join(copies_of.select(F.col("text_key").alias("u"), F.col("id").alias("y")), "u")
        .select("x", "y")
    )
    return copies.unionByName(apart).select(F.least("x", "y").alias("memory_id_a"), F.greatest("x", "y").alias("memory_id_b"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label``: the least node that each node is connected with.

    Every round takes the least label among neighbours and then follows labels once more, so
    the number of rounds grows with the logarithm of the longest path. Labels are written to
    the checkpoint folder after each round; the driver sees one number a round.
    """
    both = checkpointed(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        near = labels.join(heard, "node", "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("theirs", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = checkpointed(near.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("before <> label").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def groups(memories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``memory_id, group_id, links``: every record with sequences, its group and how many classes it is similar to.

    ``group_id`` is the least id of the group; a record without any similar one is a group of its own.
    """
    members, links = _parts(memories, threshold)
    ends = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    joined = members.join(components(links).withColumnRenamed("node", "class_id"), "class_id", "left").join(ends, "class_id", "left")
    joined = joined.select("id", F.coalesce("label", "class_id").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    least = joined.groupBy("label").agg(F.min("id").alias("group_id"))
    return joined.join(least, "label").select(F.col("id").alias("memory_id"), "group_id", "links")
