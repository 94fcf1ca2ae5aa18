"""One relational statement, two engines: the few expressions that are spelt differently.

A plan is a function of a dialect that returns a SELECT. Spark runs it over the input tables
(Catalyst prunes columns and pushes filters as for any query), and the same relational
statement in the other dialect is what its result is checked against.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.session import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings memories media_events "
    "media_imports media_feeds entities memory_entities api_keys mix_targets"
).split()

#: The instant at which lifecycle columns are judged.
AS_OF = "TIMESTAMP_NTZ '2026-03-01 00:00:00'"


class Spark:
    name = "spark"

    def ts(self, text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'"

    def json(self, column: str, key: str) -> str:
        return f"get_json_object({column}, '$.{key}')"

    def has_key(self, column: str, key: str) -> str:
        return f"coalesce(array_contains(json_object_keys({column}), '{key}'), false)"

    def us(self, x: str) -> str:
        return f"unix_micros(CAST({x} AS TIMESTAMP))"

    def unnest(self, x: str, alias: str, value: str) -> str:
        return f"LATERAL VIEW explode({x}) {alias} AS {value}"

    def size(self, x: str) -> str:
        return f"coalesce(array_size({x}), 0)"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        escaped = pattern.replace("\\", "\\\\")
        return f"regexp_replace({x}, '{escaped}', '{by}')"

    def matches(self, x: str, pattern: str) -> str:
        escaped = pattern.replace("\\", "\\\\")
        return f"({x} RLIKE '{escaped}')"

    def tokens(self, x: str) -> str:
        return f"regexp_extract_all(lower({x}), '([a-z0-9]+)', 1)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})"

    def listagg(self, x: str, separator: str, order: str) -> str:
        return f"listagg({x}, '{separator}') WITHIN GROUP (ORDER BY {order})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"

    def day(self, x: str) -> str:
        return f"CAST({x} AS DATE)"

    def minute(self, x: str) -> str:
        return f"CAST(date_trunc('MINUTE', {x}) AS TIMESTAMP_NTZ)"

    def month(self, x: str) -> str:
        return f"CAST(date_trunc('MONTH', {x}) AS TIMESTAMP_NTZ)"

    def plus(self, x: str, n: str, unit: str) -> str:
        return f"timestampadd({unit}, {n}, {x})"

    def values_in(self, items: list[str]) -> str:
        return "array(" + ", ".join(f"'{x}'" for x in items) + ")"

    def contains_all(self, column: str, items: list[str]) -> str:
        return f"size(array_except({self.values_in(items)}, {column})) = 0"

    def union_tags(self, a: str, b: str) -> str:
        return f"array_join(array_distinct(concat({a}, {b})), ',')"

    def sorted_distinct(self, a: str) -> str:
        return f"array_join(array_sort(array_distinct({a})), ',')"

    def lpad(self, x: str, n: int) -> str:
        return f"lpad(CAST({x} AS STRING), {n}, '0')"

    def join(self, array: str, separator: str) -> str:
        return f"array_join({array}, '{separator}')"

    def count_in(self, array: str, items: list[str]) -> str:
        return f"coalesce(array_size(filter({array}, x -> array_contains({self.values_in(items)}, x))), 0)"

    def distinct_in(self, array: str, items: list[str]) -> str:
        return f"coalesce(array_size(array_intersect({self.values_in(items)}, {array})), 0)"

    def first_per(self, x: str, order: str) -> str:
        return f"min_by({x}, {order})"

    text = "STRING"


class Duck(Spark):
    name = "duckdb"

    def ts(self, text):
        return f"TIMESTAMP '{text}'"

    def json(self, column, key):
        return f"json_extract_string({column}, '$.{key}')"

    def has_key(self, column, key):
        return f"coalesce(list_contains(json_keys({column}), '{key}'), false)"

    def us(self, x):
        return f"epoch_us({x})"

    def unnest(self, x, alias, value):
        return f", unnest({x}) AS {alias}({value})"

    def size(self, x):
        return f"coalesce(len({x}), 0)"

    def replace(self, x, pattern, by=""):
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def tokens(self, x):
        return f"regexp_extract_all(lower({x}), '([a-z0-9]+)', 1)"

    def sha(self, x):
        return f"sha256({x})"

    def bytes(self, x):
        return f"strlen({x})"

    def listagg(self, x, separator, order):
        return f"string_agg({x}, '{separator}' ORDER BY {order})"

    def dot(self, a, b):
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def minute(self, x):
        return f"date_trunc('minute', {x})"

    def month(self, x):
        return f"CAST(date_trunc('month', {x}) AS TIMESTAMP)"

    def plus(self, x, n, unit):
        return f"{x} + to_{unit.lower()}s(CAST({n} AS BIGINT))"

    def values_in(self, items):
        return "[" + ", ".join(f"'{x}'" for x in items) + "]"

    def contains_all(self, column, items):
        return f"list_has_all({column}, {self.values_in(items)})"

    def union_tags(self, a, b):
        both = f"list_concat({a}, {b})"
        return f"array_to_string(list_filter({both}, lambda x, i: list_position({both}, x) = i), ',')"

    def sorted_distinct(self, a):
        return f"array_to_string(list_sort(list_distinct({a})), ',')"

    def lpad(self, x, n):
        return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"

    def join(self, array, separator):
        return f"array_to_string({array}, '{separator}')"

    def count_in(self, array, items):
        return f"coalesce(len(list_filter({array}, lambda x: list_contains({self.values_in(items)}, x))), 0)"

    def distinct_in(self, array, items):
        return f"coalesce(len(list_intersect({self.values_in(items)}, {array})), 0)"

    def first_per(self, x, order):
        return f"arg_min({x}, {order})"

    text = "VARCHAR"


SPARK, DUCK = Spark(), Duck()


def cosine(d: Spark, a: str, b: str) -> str:
    return f"({d.dot(a, b)} / (sqrt({d.dot(a, a)}) * sqrt({d.dot(b, b)})))"


def rank_of(column: str) -> str:
    """Rank of an access level: null is normal, unknown ranks above every ceiling."""
    return f"(CASE coalesce({column}, 'normal') WHEN 'normal' THEN 0 WHEN 'sensitive' THEN 1 WHEN 'secret' THEN 2 ELSE 3 END)"


def ceiling_of(column: str) -> str:
    """Rank of a key's ceiling: unknown and null see nothing."""
    return f"(CASE {column} WHEN 'normal' THEN 0 WHEN 'sensitive' THEN 1 WHEN 'secret' THEN 2 ELSE -1 END)"


def active(d: Spark, m: str = "", as_of: str = "2026-03-01 00:00:00") -> str:
    """Neither deleted nor expired; an expiry at the instant itself is past."""
    return f"({m}deleted_at IS NULL AND ({m}expires_at IS NULL OR {m}expires_at > {d.ts(as_of)}))"


#: What identifies an event without an id of its provider, in this order.
IDENTITY_FIELDS = ("event_type", "title", "artist", "album", "show_title", "season", "episode", "release_year", "duration_ms")


def identity(d: Spark) -> str:
    """The provider's id if there is one, else a digest of a tuple whose parts state their length; null and empty differ."""
    x = lambda c: f"CAST({c} AS {d.text})"
    part = lambda c: f"CASE WHEN {c} IS NULL THEN 'N;' ELSE 'V' || CAST({d.bytes(x(c))} AS {d.text}) || ':' || {x(c)} || ';' END"
    return f"CASE WHEN nullif(trim(service_id), '') IS NOT NULL THEN 'id:' || service_id ELSE 'fallback:v1:' || {d.sha(chr(39) + 'v1;' + chr(39) + ' || ' + ' || '.join(part(f) for f in IDENTITY_FIELDS))} END"


def fiftieth(d: Spark) -> str:
    """About every fiftieth record, by a digest of its id: the query set of searches, and the standing queries."""
    return "CAST(conv(substr(sha2(id, 256), 1, 8), 16, 10) AS BIGINT) % 50 = 0" if d.name == "spark" else "CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 50 = 0"


def memories(d: Spark, columns: str) -> str:
    """The records, each once; only the named columns are read."""
    return f"(SELECT DISTINCT {columns} FROM memories)"


def lot(d: Spark, n: int, column: str = "id") -> str:
    """The class of a record in a derived batch, by a digest of its id: unchanged, changed, new or left out."""
    return f"CAST(conv(substr(sha2(CAST({column} AS STRING), 256), 9, 8), 16, 10) AS BIGINT) % {n}" if d.name == "spark" else f"CAST('0x' || substr(sha256(CAST({column} AS VARCHAR)), 9, 8) AS BIGINT) % {n}"


def canonical(d: Spark, more: str = "id") -> str:
    """``namespace, h, canonical_id``: the least id of each content of a namespace, by the content's digest, which is aggregated in each task first."""
    return f"(SELECT namespace, {d.sha('content')} AS h, min(id) AS canonical_id FROM memories WHERE content IS NOT NULL GROUP BY namespace, {d.sha('content')})"


def of_content(d: Spark, columns: str = "") -> str:
    """Records with the record that stands for their content; without content they stand for themselves."""
    more = f", {columns}" if columns else ""
    renamed = "".join(f", x.{c}" for c in columns.split(", ") if c)
    return f"""(SELECT x.id, x.namespace{renamed}, coalesce(c.canonical_id, x.id) AS canonical_id FROM (SELECT DISTINCT id, namespace, {d.sha('content')} AS h{more} FROM memories) x LEFT JOIN {canonical(d)} c ON c.h = x.h AND c.namespace = x.namespace)"""


def decay(d: Spark, as_of: str = "2026-03-01 00:00:00") -> str:
    """Relevance at an instant: decayed base plus a bounded bonus for access."""
    age = f"(({d.us(d.ts(as_of))} - {d.us(f'coalesce(accessed_at, {d.ts(as_of)})')}) / 8.64e10)"
    return (
        f"(coalesce(relevance_base_score, 1e0) * exp(-coalesce(decay_rate, 1e-2) * greatest(0e0, {age})) "
        f"+ least(greatest(coalesce(access_count, 0) * 1e-1, 0e0), 1e0))"
    )


class Plans:
    """Collects the plans of a module."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def __call__(self, plan: Callable[[Spark], str]) -> Callable[[Spark], str]:
        name = plan.__name__
        self.QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, plan(SPARK))
        self.ORACLE[name] = plan(DUCK)
        return plan

    def direct(self, name: str, query: Callable, oracle: str | None = None) -> None:
        """A query that is written with DataFrames."""
        self.QUERIES[name] = query
        if oracle is not None:
            self.ORACLE[name] = oracle


_READ = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a statement over the input tables that it names; views of the caller keep their names."""
    for name in {m[2] for m in _READ.finditer(sql)}:
        table(spark, sf_dir, name).createOrReplaceTempView(f"lorekeep_{name}")
    return spark.sql(_READ.sub(r"\1 lorekeep_\2", sql))
