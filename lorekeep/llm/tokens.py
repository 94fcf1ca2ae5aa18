"""Problem 6: token ids of every text by a public tokenizer.

The texts are cut into pre-tokens by the JVM. Every *distinct* pre-token of the
corpus is found by one aggregation (partial in each task, so a word that is a third
of all words crosses the network once per task), encoded once, and its ids are joined
back to the places where it occurs, which are put together again in order.

The dictionary that is joined back comes in two tiers. The head is the at most
``head_words`` most frequent words: it is bounded by that parameter, whatever the size of
the corpus, and travels with the tasks, so the words that make up most occurrences (and all
the skew) never shuffle. All other words, each of which is rare, meet their ids in an ordinary
shuffle join on the word. Both are put together by position in whole Arrow batches.

Defined results: null and empty texts give an empty list; every row of the input gives
one row with its ``doc_id``; rows with equal ``doc_id`` are one document (the greatest of
their texts, should they differ). Where a text has code points that the JVM's Unicode
tables don't know, the run of characters around them up to the next white space is one
piece, so newer characters can't be cut otherwise than the tokenizer does; the rest of the
text is cut as ever. Further columns don't matter.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import checkpointed

#: Fixed value: the public pattern that cuts a text into pre-tokens; (?U) gives white space its Unicode meaning.
PRETOKENS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Folder of the vocabulary files, on every executor.
VOCABULARIES = os.environ.get("LOREKEEP_TOKENIZERS", "/opt/tokenizers")
#: Bound of the broadcast part of the dictionary.
HEAD_WORDS = 16_384
#: Characters that the newest tables know and the JVM's don't: unassigned ones.
_UNKNOWN = r"\p{Cn}"
#: A run without white space around such a character stays whole; the tokenizer cuts it when it encodes it.
_AROUND_UNKNOWN = PRETOKENS.replace("(?U)", r"(?U) ?[^\s\p{Cn}]*\p{Cn}\S*|")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> str:
    return os.path.join(folder, f"{name}.json")


def encode_column(column: Column, path: str) -> Column:
    """Ids of each string of a column (Arrow batches)."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for texts in batches:
            yield pd.Series([e.ids for e in tokenizer.encode_batch(texts.tolist(), add_special_tokens=False)], index=texts.index)

    return encode(column)


def pretokens(text: Column) -> Column:
    """The text cut into pre-tokens; their concatenation is the text."""
    return F.when(text.rlike(_UNKNOWN), F.regexp_extract_all(text, F.lit(_AROUND_UNKNOWN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PRETOKENS), F.lit(0)))


def _put_together(head: list[tuple[str, list[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids of each document from its words, the head of the dictionary and the rare words' ids by position, a batch at a time."""
    words, ids = pa.array([w for w, _ in head], pa.string()), [np.array(v, np.int32) for _, v in head]
    head_length = np.array([len(v) for v in ids], np.int64)
    head_start, head_flat = np.cumsum(head_length) - head_length, np.concatenate([*ids, np.empty(0, np.int32)])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column("words")), 0), np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            place = pc.index_in(batch.column("words").flatten(), value_set=words)
            known = np.asarray(place.is_valid())
            place = np.asarray(place.fill_null(0), np.int64)
            # what isn't in the head comes by its position in the document
            rare_counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column("pos")), 0), np.int64)
            rare_at = np.asarray(batch.column("pos").flatten(), np.int64) + np.repeat(first[:-1], rare_counts)
            rare = batch.column("v").flatten()
            rare_length = np.asarray(pc.list_value_length(rare), np.int64)
            rare_flat = np.asarray(rare.flatten(), np.int32)
            if len(rare_at) != (~known).sum() or known[rare_at].any():
                raise RuntimeError("words of a document and their ids don't match")
            length, start = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
            if len(head):
                length[known], start[known] = head_length[place[known]], head_start[place[known]]
            length[rare_at], start[rare_at] = rare_length, len(head_flat) + np.cumsum(rare_length) - rare_length
            ends = np.concatenate([[0], np.cumsum(length)])
            taken = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
            out = np.concatenate([head_flat, rare_flat])[taken]
            lists = pa.ListArray.from_arrays(pa.array(ends[first].astype(np.int32)), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return put_together


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, head_words: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, ids`` of every document."""
    docs = documents.groupBy("doc_id").agg(F.max("text").alias("text"))  # also brings each document to its partition
    words = documents.select(F.explode(pretokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    encoded = checkpointed(counts.select("word", "n", encode_column(F.col("word"), vocabulary_path(name, folder)).alias("v")))
    # the head is bounded by its parameter, whatever the corpus; it travels with the tasks
    head = [(r["word"], r["v"]) for r in encoded.orderBy(F.desc("n"), "word").limit(head_words).collect()]
    places = docs.select("doc_id", F.posexplode(pretokens(F.col("text"))).alias("pos", "word"))
    frequent = documents.sparkSession.createDataFrame([(w,) for w, _ in head], "word string")
    rest = places.join(F.broadcast(frequent), "word", "left_anti")
    rare = rest.join(encoded.select("word", "v"), "word").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("rare"))
    # documents are already where they belong; their words are cut after the join, so the join moves texts
    met = docs.join(rare, "doc_id", "left").select("doc_id", pretokens(F.col("text")).alias("words"), F.col("rare.pos").alias("pos"), F.col("rare.v").alias("v"))
    return met.mapInArrow(_put_together(head), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``doc_id, tokens``: the length of each document in tokens.

    Each distinct pre-token is encoded once; only its length is joined back, and
    lengths are summed per document before anything shuffles by document.
    """
    words = documents.select(F.explode(pretokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    lengths = checkpointed(counts.select("word", "n", F.size(encode_column(F.col("word"), vocabulary_path(name, folder))).alias("m")))
    head = lengths.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).select(F.col("word").alias("head_word"), "m")
    docs = documents.groupBy("doc_id").agg(F.max("text").alias("text"))
    places = docs.select("doc_id", F.explode_outer(pretokens(F.col("text"))).alias("word"))
    known = places.join(F.broadcast(head), F.col("word") == F.col("head_word"), "left")
    frequent = known.groupBy("doc_id").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("tokens"))
    rest = known.where(F.col("word").isNotNull() & F.col("m").isNull()).groupBy("doc_id", "word").agg(F.count("*").alias("k"))
    rare = rest.join(lengths.select("word", "m"), "word").groupBy("doc_id").agg(F.sum(F.col("k") * F.col("m")).alias("rare"))
    return frequent.join(rare, "doc_id", "left").select("doc_id", (F.col("tokens") + F.coalesce("rare", F.lit(0))).cast("bigint").alias("tokens"))


def token_bytes(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``id, piece``: the bytes of every token as hexadecimal digits; as many rows as the vocabulary."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        rows = [(int(rank), base64.b64decode(piece).hex()) for piece, rank in map(bytes.split, lines)]
    return spark.createDataFrame(rows, "id int, piece string")


def decode_documents(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``: the tokens' bytes, joined and read as UTF-8.

    The token-byte table has one row per token of the vocabulary, which bounds the broadcast.
    """
    table = token_bytes(encoded.sparkSession, name, folder)
    places = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    pieces = places.join(F.broadcast(table), "id", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("l"))
    digits = F.array_join(F.transform("l", lambda x: x["piece"]), "")
    return pieces.select("doc_id", F.decode(F.unhex(digits), "UTF-8").alias("text"))
