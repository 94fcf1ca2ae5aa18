import datetime as dt
import hashlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import admission, clustering, graph
from lorekeep.operators import texts as O


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab #\n\r é😀", max_size=400), st.integers(8, 60))
def test_chunks_lose_nothing(value, most):
    chunks = T.lossless_chunks(value, most)
    assert "".join(chunks) == value
    assert all(0 < len(c.encode()) <= most for c in chunks)


def test_chunk_boundaries():
    assert T.lossless_chunks("a\n \n \nb", 5) == ["a\n \n ", "\nb"]  # the blank run of six bytes is cut like any long segment
    assert T.lossless_chunks("one\n#\ttwo\n#three", 8) == ["one\n", "#\ttwo\n#t", "hree"]  # a heading needs a blank
    assert T.lossless_chunks("a\n \n\nb", 5) == ["a\n \n\n", "b"] and T.lossless_chunks("one\n#\ttwo\n", 6) == ["one\n", "#\ttwo\n"]
    assert T.lossless_chunks("", 5) == [] and T.lossless_chunks("éé", 3) == ["é", "é"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a b c", "word " * 40, "\n\n", "\r\n \r\n", "x"]), max_size=12).map("".join))
def test_plan_covers(value):
    parts = T.token_plan(value, 16, 4)
    raw = value.encode()
    assert b"".join(raw[a:b] for a, b, _, _ in parts) == raw and parts
    assert all(hashlib.sha256(raw[a:b]).hexdigest() == h and n <= 16 for a, b, n, h in parts)


def test_plan_of_a_tokenizer():
    letters = lambda x: sum(c.isalpha() for c in x)
    assert [(a, b, n) for a, b, n, _ in T.token_plan("ab\n\ncd\n\nef", 4, 2, letters)] == [(0, 8, 4), (8, 10, 2)]  # the short last paragraph stays alone
    assert [n for _, _, n, _ in T.token_plan("abcdefgh", 3, 1, letters)] == [2, 2, 2, 2]
    assert T.token_plan("") == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]
    with pytest.raises(ValueError):
        T.token_plan("a", 0, 0, letters)


def test_stored_plans_are_held_against_texts(spark):
    texts = "first paragraph of words\n\n" * 200
    docs = spark.createDataFrame([(1, texts), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    plan = O.chunk_plan(docs, count=lambda x: len(x) // 4)
    assert {r.doc_id: r.complete for r in O.plan_faults(plan, docs).collect()} == {1: True, 2: True, 4: True}
    broken = {r.doc_id: r for r in O.plan_faults(plan.where("ordinal <> 1"), docs).collect()}
    assert broken[1].gaps == 1 and broken[1].out_of_order > 0 and not broken[1].complete and broken[2].complete
    wrong = {r.doc_id: r for r in O.plan_faults(plan.withColumn("chunk_sha256", F.lit("x")), docs).collect()}
    assert wrong[2].wrong_digests == 1 and not wrong[2].complete
    assert not O.plan_faults(plan.where("doc_id <> 2"), docs).where("doc_id = 2").first().complete


def test_markdown_keys_stay():
    text = "---\ntags: [x, 'y z']\n---\nan introduction\n## One\nsome body\n## One\nother body\n## Short\nabc\n"
    key, heading, body, tags = zip(*T.markdown_sections(text, "notes/a.md"))
    assert key[:2] == ("file-sync:notes/a.md:(preamble)", "file-sync:notes/a.md:## One") and key[2].startswith("file-sync:v2:") and len(key) == 3
    assert heading == ("(preamble)", "## One", "## One") and body[1] == "## One\nsome body" and set(map(tuple, tags)) == {("x", "y z")}
    long = "## Two\n" + "lead paragraph\n### A\n" + "a" * 2000 + "\n### A\nbbbbb\n### B\nccc\n"
    assert [h for _, h, _, _ in T.markdown_sections(long)] == ["## Two", "## Two > ### A", "## Two > ### A"]
    assert T.markdown_sections("no heading")[0][1] == "(root)" and T.markdown_sections("short") == []


def test_fuzzy_times():
    now = dt.datetime(2024, 3, 31, 9, 30)
    at = lambda x, when=now: T.fuzzy_time(x, when) and T.fuzzy_time(x, when)[0]
    assert at("Today", dt.datetime(2026, 3, 1, 5)) == dt.datetime(2026, 3, 1, 12)
    assert at("1 month ago") == at("last month") == dt.datetime(2024, 2, 15, 12)
    assert at("5 hours ago") == dt.datetime(2024, 3, 31, 4) and at("2 weeks ago") == dt.datetime(2024, 3, 13, 12)
    assert at("this week") == dt.datetime(2024, 3, 27, 12) and at("May") == dt.datetime(2023, 5, 15, 12) and at("2019") == dt.datetime(2019, 7, 2, 12)
    assert T.fuzzy_time("last week", now)[1:] == (dt.datetime(2024, 3, 18), dt.datetime(2024, 3, 25), "week")
    assert T.fuzzy_time("2024-03-01T10:00:00+02:00", now) == (dt.datetime(2024, 3, 1, 8),) * 3 + ("instant",)
    assert T.fuzzy_time("sometime", now) is T.fuzzy_time("9999 years ago", now) is T.fuzzy_time("0000", now) is None


def test_urls(spark):
    cases = {
        "https://a.b.example.co.uk/x?q=1": "https://example.co.uk", "HTTPS://www.Example.org/x": "https://example.org", "http://u:p@news.example.org:80/": "http://example.org", "http://localhost/": None, "http://10.0.0.1/": None,
        "http://8.8.8.8/": None, "ftp://x.org": None, "nothing": None, "http://a.local": None, "http://co.uk/": None, "http://[::1]/": None,
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.kept for r in frame.select("url", O.sanitised(F.col("url")).alias("kept")).collect()} == cases
    assert frame.where("url LIKE '%co.uk/x%'").select(O.sanitised(F.col("url"), True)).first()[0] == "https://a.b.example.co.uk/x"


def test_small_functions():
    assert T.without_controls("ｆｕｌｌ\x00\n  wide ", 6) == "full w" and T.is_storable("é") and not T.is_storable("a\0") and not T.is_storable("\ud800")
    assert T.keyed_digest(b"k", "x") != T.keyed_digest(b"l", "x")
    assert T.projected([3.0, 4.0, 9.0], 3, 2) == [0.6, 0.8] and T.projected([0.0, 0.0, 1.0], 3, 2) is None and T.projected([1.0], 3, 2) is None


def test_conversations(spark):
    turns = [("c", "T", i, r, s) for i, (r, s) in enumerate([("user", "hi"), ("user", "q1"), ("assistant", "a1"), ("assistant", "more"), ("user", "Thanks!"), ("assistant", "b" * 60)])]
    turns += [("long", None, 2 * i + j, r, f"{r}{i} " + "x" * 500) for i in range(7) for j, r in enumerate(("user", "assistant"))]
    frame = spark.createDataFrame(turns, "doc_id string, title string, turn int, role string, said string")
    chunks = {(r.doc_id, r.chunk): r.body for r in O.conversation_chunks(frame).collect()}
    assert chunks["c", 0].startswith("[T]\n\nUser: q1\nAssistant: a1\n\nUser: Thanks!") and set(chunks) == {("c", 0), ("long", 0), ("long", 1)}
    assert len(chunks["long", 0]) == 4000 and chunks["long", 0].startswith("[Untitled]\n\nUser: user0") and chunks["long", 1].startswith("[Untitled]\n\nUser: user5")
    pairs = {(r.doc_id, r.turn) for r in O.question_pairs(frame).collect()}
    assert pairs == {("long", 2 * i) for i in range(7)}  # a short answer and a trivial question are left out


def test_extracted_entities(spark):
    rows = [("m1", "person", "Ｚoe  Q", "Zoe", ["zoe q", "Z Q", "z  q", ""], 0.9, "Zoe is here"), ("m1", "thing", "x", "x", None, 0.9, None), ("m1", "tool", "y", "y", None, 0.4, None), ("m2", "tool", "t", "absent", None, 0.9, "other"), ("m3", "tool", "t", "t", None, 0.9, None), ("m3", "tool", "T ", "t", None, 0.8, None)]
    frame = spark.createDataFrame(rows, "memory_id string, entity_type string, display_name string, mention string, aliases array<string>, confidence double, content string")
    assert [(r.memory_id, r.normalized_name, r.display_name, r.aliases) for r in O.extracted_entities(frame).collect()] == [("m1", "zoe q", "Zoe Q", ["Z Q"])]


def test_cover_density_prefers_near_terms():
    near, far = T.cover_density("the vaults of tickets", "ticket vault"), T.cover_density("vault " + "x " * 20 + "ticket", "ticket vault")
    assert near > far > 0 == T.cover_density("vault only", "ticket vault") == T.cover_density("x", "")


def test_greedy_clusters():
    pairs = pd.DataFrame([("a", "b"), ("a", "c")], columns=["a_id", "b_id"])
    order = {x: (0, x) for x in "abc"}
    assert clustering.greedy(pairs, order) == [["a", "b"]]  # c isn't near b; it isn't used up but has no later neighbour
    chain = pd.DataFrame([("a", "b"), ("b", "c"), ("c", "d")], columns=["a_id", "b_id"])
    assert clustering.greedy(chain, {x: (0, x) for x in "abcd"}) == [["a", "b"], ["c", "d"]]
    ids = [f"m{i:02d}" for i in range(21)]
    full = pd.DataFrame([(x, y) for x in ids for y in ids if x < y], columns=["a_id", "b_id"])
    assert clustering.greedy(full, {x: (0, x) for x in ids}) == [ids[1:]]  # the twenty-first member makes the first anchor's cluster oversized


def test_walk_and_chain(spark):
    links = spark.createDataFrame([("m1", "a", ["Big  A"]), ("m1", "b", None), ("m2", "b", None), ("m2", "c", None), ("m3", "c", None), ("m3", "d", None)], "memory_id string, entity_id string, aliases array<string>")
    entities = spark.createDataFrame([(x, "n", "tool", f"name {x}") for x in "abcdz"], "id string, namespace string, entity_type string, normalized_name string")
    assert [r.id for r in graph.seeds(entities, links, "big a").collect()] == ["a"] == [r.id for r in graph.seeds(entities, links, "name a").collect()]
    assert graph.seeds(entities, links, "name z").count() == 0 == graph.seeds(entities, links, "name a", "place").count()
    start = graph.seeds(entities, links, "name a")
    assert {(r.id, r.depth, r.truncated) for r in graph.bounded_walk(start, links, entities, 2).collect()} == {("a", 0, False), ("b", 1, False), ("c", 2, False)}
    cut = graph.bounded_walk(start, links, entities, 3, most=2).collect()
    assert {(r.id, r.truncated) for r in cut} == {("a", True), ("b", True)}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, 130)], "id string, supersedes_id string")
    deepest = graph.chain_depth(chain).orderBy("depth", ascending=False).first()
    assert (deepest.id, deepest.depth, deepest.root) == ("n129", 129, "n000")


def test_admission_counts_only_admitted(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(i, 1, t + dt.timedelta(seconds=20 * i)) for i in range(9)] + [(99, None, t)]
    got = {r.event_id: r.admitted for r in admission.admit(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz"), 1, 2).collect()}
    assert sorted(i for i, good in got.items() if good) == [0, 3]
    assert got[99] is False
