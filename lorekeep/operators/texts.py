"""Frames of text: chunks, sections, conversations, feeds of providers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T


def each(function: Callable, kind: str):
    """An Arrow UDF that applies a function to every value that isn't null."""

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([None if v is None else function(v) for v in values], index=values.index, dtype=object)

    return apply


def chunk_documents(documents: DataFrame, most_bytes: int = 2000) -> DataFrame:
    """``doc_id, chunk_index, chunk``; null and empty texts have no chunks."""
    chunks = each(lambda v: T.lossless_chunks(v, most_bytes), "array<string>")
    return documents.select("doc_id", F.posexplode(chunks("text")).alias("chunk_index", "chunk"))


def chunk_plan(documents: DataFrame, count: Callable[[str], int] | None = None) -> DataFrame:
    """``doc_id, ordinal, core_start, core_end, tokens, chunk_sha256`` by bytes of the text; null texts have no plan, empty ones one empty part.

    ``count`` is a tokenizer's count, which travels to the tasks; words are counted if none is given.
    """
    plan = each(lambda v: [dict(zip(("core_start", "core_end", "tokens", "chunk_sha256"), x)) for x in T.token_plan(v, count=count)], "array<struct<core_start:long,core_end:long,tokens:int,chunk_sha256:string>>")
    return documents.select("doc_id", F.posexplode(plan("text")).alias("ordinal", "x")).select("doc_id", "ordinal", "x.*")


def plan_faults(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, chunks, bytes, gaps, out_of_order, wrong_digests, complete``: stored plans held against their texts.

    A part must begin where the one before it ended, ordinals must count from 0, and its digest must be that of the
    text's bytes there. A document without a plan isn't complete.
    """
    within = Window.partitionBy("doc_id").orderBy("ordinal")
    cut = plan.join(documents.select("doc_id", F.encode("text", "UTF-8").alias("_raw")), "doc_id")
    real = F.sha2(F.substring("_raw", F.col("core_start").cast("int") + 1, (F.col("core_end") - F.col("core_start")).cast("int")), 256)
    checked = cut.select(
        "doc_id", "core_end", (F.col("core_start") != F.coalesce(F.lag("core_end").over(within), F.lit(0))).alias("_gap"),
        (F.col("ordinal") != F.row_number().over(within) - 1).alias("_order"), (F.col("chunk_sha256") != real).alias("_wrong"),
    )
    found = checked.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("core_end").alias("bytes"), F.count_if("_gap").alias("gaps"), F.count_if("_order").alias("out_of_order"), F.count_if("_wrong").alias("wrong_digests"))
    joined = documents.where(F.col("text").isNotNull()).select("doc_id", F.octet_length("text").alias("_size")).join(found, "doc_id", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chunks", "bytes", "gaps", "out_of_order", "wrong_digests")]
    whole = (F.col("bytes") == F.col("_size")) & (F.col("gaps") + F.col("out_of_order") + F.col("wrong_digests") == 0)
    return joined.select("doc_id", *numbers, F.coalesce(whole, F.lit(False)).alias("complete"))


def chunk_markdown(documents: DataFrame) -> DataFrame:
    """``doc_id, ordinal, section_key, heading, body, tags`` of the sections of each text (``doc_id, path, text``)."""
    fields = ("section_key", "heading", "body", "tags")

    @F.pandas_udf("array<struct<section_key:string,heading:string,body:string,tags:array<string>>>")
    def sections(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(fields, x)) for x in T.markdown_sections(t, p or "")] for t, p in zip(texts, paths)], index=texts.index, dtype=object)

    return documents.select("doc_id", F.posexplode(sections("text", "path")).alias("ordinal", "x")).select("doc_id", "ordinal", "x.*")


def turns(documents: DataFrame) -> DataFrame:
    """``doc_id, title, turn, role, said`` of texts written as a conversation; the source is the title."""
    parts = F.split("text", r"(?m)^(?=(?:User|Assistant): )")
    each = documents.where(F.col("text").rlike(r"(?m)^User: ")).select("doc_id", F.col("source").alias("title"), F.posexplode(F.filter(parts, lambda x: x.rlike(r"^(?:User|Assistant): "))).alias("turn", "part"))
    return each.select("doc_id", "title", "turn", F.lower(F.regexp_extract("part", r"^(User|Assistant): ", 1)).alias("role"), F.btrim(F.regexp_replace("part", r"^(?:User|Assistant): ", ""), F.lit(" \n\r")).alias("said"))


def cover_score(content: Column, query: str) -> Column:
    """Stemmed cover density of a text, null for null."""
    return each(lambda v: T.cover_density(v, query), "double")(content)


def cover_rank(documents: DataFrame, query: str, k: int = 100) -> DataFrame:
    """``doc_id, rank`` of the k best texts by stemmed cover density; ties go by id."""
    return documents.where(F.col("text").isNotNull()).select("doc_id", cover_score(F.col("text"), query).alias("rank")).where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(k)


def pairs_of_turns(turns: DataFrame) -> DataFrame:
    """``doc_id, title, pair, question, answer`` of turns (``doc_id, title, turn, role, said``): a question and the answer right after it, numbered from 0."""
    after = Window.partitionBy("doc_id").orderBy("turn")
    next_turn = turns.withColumn("_role", F.lead("role").over(after)).withColumn("answer", F.lead("said").over(after))
    asked = next_turn.where((F.col("role") == "user") & (F.col("_role") == "assistant"))
    return asked.select("doc_id", "title", "turn", (F.row_number().over(after) - 1).alias("pair"), F.col("said").alias("question"), "answer")


def conversation_chunks(turns: DataFrame, most: int = 4000, group: int = 5) -> DataFrame:
    """``doc_id, chunk, body``: a conversation in one piece if it is short enough, else groups of pairs, each cut at ``most`` characters.

    A pair is cut before it is collected, so no list grows beyond what a piece can show and a task's memory is bounded by pairs of ``most``.
    """
    pair = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), "answer")
    head = F.concat(F.lit("["), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), F.lit("]\n\n"))
    rows = pairs_of_turns(turns).select("doc_id", "pair", head.alias("head"), pair.alias("said"))
    whole = rows.groupBy("doc_id").agg((F.sum(F.length("said") + 2) - 2 + F.max(F.length("head"))).alias("length"))
    placed = rows.join(whole, "doc_id").withColumn("chunk", F.when(F.col("length") <= most, 0).otherwise(F.floor(F.col("pair") / group)).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair", F.substring("said", 1, most).alias("said")))), lambda x: x["said"]), "\n\n")
    return placed.groupBy("doc_id", "chunk").agg(F.substring(F.concat(F.max("head"), joined), 1, most).alias("body"))


#: Messages that ask for nothing, without their punctuation.
TRIVIAL = "yes, no, ok, okay, thanks, thank you, yep, nope, sure, got it, cool, nice, great, right, correct, exactly, agreed, perfect".split(", ")


def is_trivial(question: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(question, F.lit(" \t\r\n"))), "[.!?,]", "").isin(TRIVIAL)


def question_pairs(turns: DataFrame, least_answer: int = 50, most: int = 4000) -> DataFrame:
    """``doc_id, turn, content`` of pairs whose question asks something and whose answer has some length."""
    kept = pairs_of_turns(turns).where((F.trim("question") != "") & ~is_trivial(F.col("question")) & (F.length("answer") >= least_answer))
    return kept.select("doc_id", "turn", F.substring(F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer"), 1, most).alias("content"))


def fuzzy_times(labels: DataFrame, column: str, now: dt.datetime) -> DataFrame:
    """The frame with ``at``, ``start_at``, ``end_at`` (UTC) and ``precision`` of each label, null where it isn't understood."""

    def resolve(value: str):
        found = T.fuzzy_time(value, now)
        return [*(x.isoformat(" ") for x in found[:3]), found[3]] if found else None

    span = labels.withColumn("_span", each(resolve, "array<string>")(F.col(column)))
    times = [F.get("_span", F.lit(i)).cast("timestamp_ntz").alias(name) for i, name in enumerate(("at", "start_at", "end_at"))]
    return span.select(*labels.columns, *times, F.get("_span", F.lit(3)).alias("precision"))


#: Public suffixes of two labels that are common. There is no full list here, so others are taken to have one label.
TWO_LABELS = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp co.nz com.br com.mx co.in co.za com.cn com.tr".split()
_HOST = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@\[\]]+)"


def sanitised(url: Column, keep_path: bool = False) -> Column:
    """The scheme and registrable domain of a public web address, on request its whole host and path; null for private or unusable ones and for numbers."""
    scheme, host = F.lower(F.regexp_extract(url, _HOST, 1)), F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 2), r"\.$", ""))
    private = host.rlike(r"^$|^localhost$|\.(?:localhost|local)$|^[^.]*$|^[0-9.]+$|[^a-z0-9.\x{80}-\x{10FFFF}_-]|\.\.|^\.")
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    two = last(2).isin(TWO_LABELS)
    domain = F.when(two & (F.size(labels) >= 3), last(3)).when(~two, last(2))
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"(?i)^https?://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    kept = F.concat(scheme, F.lit("://"), host, path) if keep_path else F.concat(scheme, F.lit("://"), domain)
    return F.when(~private & domain.isNotNull(), kept)


def identity_hash(content: Column) -> Column:
    """Digest of the compatibility form of a text."""
    return F.sha2(each(T.identity_form, "string")(content), 256)


def canonical_json_hash(value: Column) -> Column:
    return each(T.canonical_hash, "string")(value)


ENTITY_TYPES = ("person", "project", "tool", "place")
MOST_NAME, MOST_ENTITIES, LEAST_CONFIDENCE = 256, 50, 0.5


def extracted_entities(found: DataFrame) -> DataFrame:
    """``memory_id, entity_type, normalized_name, display_name, aliases, confidence, pos`` of raw extractions
    (``memory_id, entity_type, display_name, mention, aliases, confidence, content``).

    Unknown types and unsure guesses are left out. Names come in compatibility form with white space collapsed, aliases
    without those that repeat the name or each other. A name that is blank or too long, a mention that the content
    doesn't hold and a name that is given twice refuse a record's whole extraction; at most fifty are kept.
    """
    clean = each(lambda v: T.without_controls(v), "string")
    many = each(lambda v: [T.without_controls(x) for x in v if x is not None], "array<string>")
    sure = found.where(F.col("entity_type").isin(*ENTITY_TYPES) & (F.col("confidence") >= LEAST_CONFIDENCE))
    named = sure.withColumn("display_name", clean("display_name")).withColumn("aliases", many(F.coalesce("aliases", F.array().cast("array<string>"))))
    named = named.withColumn("normalized_name", F.lower("display_name"))
    lower = F.transform("aliases", F.lower)
    first = lambda x, i: (F.trim(x) != "") & (F.lower(x) != F.col("normalized_name")) & (F.array_position(lower, F.lower(x)) == i + 1)
    named = named.withColumn("aliases", F.filter("aliases", first))
    own = Window.partitionBy("memory_id")
    bad = (F.coalesce("display_name", F.lit("")) == "") | (F.length("display_name") > MOST_NAME) | F.exists("aliases", lambda x: F.length(x) > MOST_NAME)
    bad = bad | (F.col("content").isNotNull() & ~F.contains("content", "mention")) | (F.count("*").over(Window.partitionBy("memory_id", "entity_type", "normalized_name")) > 1)
    judged = named.withColumn("_bad", F.coalesce(bad, F.lit(True))).withColumn("_refused", F.bool_or("_bad").over(own)).where(~F.col("_refused"))
    order = own.orderBy(F.desc("confidence"), "normalized_name", "entity_type")
    numbered = judged.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= MOST_ENTITIES)
    return numbered.select("memory_id", "entity_type", "normalized_name", "display_name", "aliases", "confidence", "pos")
