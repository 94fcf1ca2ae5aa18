"""Exports of conversations as frames: trees of messages, pairs of messages, pages of cells, session logs.

A record that can't be used fails the read with what is wrong, unless its format says that such records are passed over.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.texts import each

MOST_CONVERSATION_BYTES = 16 << 20
_FILE = re.compile(r"conversations(?:-(\d+))?\.json")


def discover(spark: SparkSession, folder: str) -> list[str]:
    """The export's files of a folder in the order of their numbers, the one without a number first; none is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    found = {}
    for status in files:
        name = status.getPath().getName()
        if status.isFile() and (match := _FILE.fullmatch(name)):
            found[int(match[1]) if match[1] else -1, name] = status.getPath().toString()
    if not found:
        raise FileNotFoundError(f"no conversations.json or conversations-<number>.json in {folder}")
    return [found[k] for k in sorted(found)]


def walk(mapping: str) -> list[dict]:
    """Messages of users and assistants along the first children of a tree of messages, from the node without a parent."""
    nodes = json.loads(mapping)
    at = next((i for i, node in nodes.items() if node.get("parent") is None), None)
    turns, seen = [], set()
    while at is not None and at in nodes and at not in seen:
        seen.add(at)
        node = nodes[at]
        message = node.get("message") or {}
        role = (message.get("author") or {}).get("role")
        parts = (message.get("content") or {}).get("parts") or []
        text = "\n".join(p for p in parts if isinstance(p, str)).strip()
        if role in ("user", "assistant") and text:
            turns.append({"role": role, "said": text, "at": message.get("create_time")})
        at = next(iter(node.get("children") or []), None)
    return turns


def read_chat_export(spark: SparkSession, files: list[str], most_bytes: int = MOST_CONVERSATION_BYTES) -> DataFrame:
    """``doc_id, title, created, turn, role, said, at`` of exported trees of messages; a conversation in two files counts once, one that is too large fails."""
    rows = spark.read.schema("conversation_id string, title string, create_time double, mapping string").option("multiLine", "true").option("mode", "FAILFAST").json(files)
    size = F.octet_length("mapping")
    checked = F.when(size > most_bytes, F.raise_error(F.concat(F.lit("conversation of more than the allowed bytes: "), F.coalesce("conversation_id", F.lit("?"))))).otherwise(F.col("mapping"))
    turns = each(walk, "array<struct<role:string,said:string,at:double>>")(checked)
    once = rows.where(F.col("mapping").isNotNull()).dropDuplicates(["conversation_id"])
    return once.select(F.col("conversation_id").alias("doc_id"), "title", F.col("create_time").alias("created"), F.posexplode(turns).alias("turn", "x")).select("doc_id", "title", "created", "turn", "x.*")


def read_pair_export(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, title, turn, role, said, message_id, at`` of exported lists of messages (``human`` and ``assistant``), whose text may come in blocks."""
    shape = "uuid string, name string, created_at string, chat_messages array<struct<uuid:string,sender:string,text:string,created_at:string,content:array<struct<type:string,text:string>>>>"
    rows = spark.read.schema(shape).option("multiLine", "true").option("mode", "FAILFAST").json(path).dropDuplicates(["uuid"])
    x = F.col("m")
    blocks = F.array_join(F.transform(F.filter(x["content"], lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    said = F.when(F.coalesce(x["text"], F.lit("")) != "", x["text"]).otherwise(F.coalesce(blocks, F.lit("")))
    role = F.when(x["sender"] == "human", "user").otherwise(x["sender"])
    turns = rows.select("uuid", "name", F.posexplode("chat_messages").alias("turn", "m"))
    return turns.select(F.col("uuid").alias("doc_id"), F.col("name").alias("title"), "turn", role.alias("role"), said.alias("said"), x["uuid"].alias("message_id"), x["created_at"].alias("at"))


def paragraph_pieces(text: str, most: int = 1000, least: int = 20) -> list[str]:
    """Paragraphs of more than a few characters, packed while they fit."""
    pieces: list[str] = []
    for paragraph in (p for p in re.split(r"\n\n+", text) if len(p.strip()) > least):
        if pieces and len(pieces[-1]) + len(paragraph) <= most:
            pieces[-1] += f"\n\n{paragraph}"
        else:
            pieces.append(paragraph)
    return [p.strip() for p in pieces if p.strip()]


# Month names and named offsets of the pages' times.
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
_OFFSETS = {"Z": 0, "UTC": 0, "GMT": 0, "NZST": 720, "NZDT": 780}
_STAMP = re.compile(r"([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4}),\s+(\d{1,2}):(\d{2}):(\d{2})\s+(AM|PM)\s+(\S+)")


def page_instant(text: str) -> dt.datetime | None:
    """A time such as "Mar 3, 2025, 4:05:06 PM UTC+02:00" in UTC; None for any other form, month, clock, date or zone."""
    match = _STAMP.fullmatch(text.strip().replace(" ", " ").replace("\xa0", " "))
    if not match or match[1] not in _MONTHS:
        return None
    zone = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{2})(?::?(\d{2}))?", match[8])
    if match[8] in _OFFSETS:
        minutes = _OFFSETS[match[8]]
    elif zone and int(zone[3] or 0) <= 59 and int(zone[2]) * 60 + int(zone[3] or 0) <= 14 * 60:
        minutes = int(zone[1] + "1") * (int(zone[2]) * 60 + int(zone[3] or 0))
    else:
        return None
    hour = int(match[4])
    if not 1 <= hour <= 12:
        return None
    try:
        local = dt.datetime(int(match[3]), _MONTHS[match[1]], int(match[2]), hour % 12 + 12 * (match[7] == "PM"), int(match[5]), int(match[6]))
    except ValueError:
        return None
    return local - dt.timedelta(minutes=minutes)


# What tags become in plain text.
_BEFORE = {**{f"h{i}": "\n### " for i in range(1, 7)}, "li": "\n- ", "p": "\n", "br": "\n", "blockquote": "\n> ", "code": "`", "pre": "\n```\n", "hr": "\n---\n", "strong": "**", "em": "*"}
_AFTER = {**{f"h{i}": "\n" for i in range(1, 7)}, "p": "\n", "blockquote": "\n", "code": "`", "pre": "\n```\n", "strong": "**", "em": "*"}


class _Cells(HTMLParser):
    """The content cell of each outer cell, as parts between line breaks, in plain text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list[str]] = []
        self.depth, self.outer, self.inner, self.taken = 0, None, None, False

    def handle_starttag(self, tag, attrs):
        names = (dict(attrs).get("class") or "").split()
        if tag == "div":
            self.depth += 1
            if self.outer is None and "outer-cell" in names:
                self.outer, self.taken = self.depth, False
            elif self.outer is not None and self.inner is None and not self.taken and {"content-cell", "mdl-cell--6-col"} <= set(names):
                self.inner = self.depth
                self.taken = True
                self.cells.append([""])
        elif self.inner is not None:
            if tag == "br":
                self.cells[-1].append("")
            else:
                self.cells[-1][-1] += _BEFORE.get(tag, "")

    def handle_endtag(self, tag):
        if tag == "div":
            if self.inner == self.depth:
                self.inner = None
            if self.outer == self.depth:
                self.outer = None
            self.depth -= 1
        elif self.inner is not None:
            self.cells[-1][-1] += _AFTER.get(tag, "")

    def handle_data(self, data):
        if self.inner is not None:
            self.cells[-1][-1] += data


def page_cells(page: str) -> list[dict]:
    """``content, at, source_key, failure`` of the prompts of a page; a cell without a usable time or answer says why it is left out."""
    parser = _Cells()
    parser.feed(page)
    tidy = lambda x: re.sub(r"\n{3,}", "\n\n", html.unescape(x).replace("\xa0", " ")).strip()
    out = []
    for parts in parser.cells:
        if not parts[0].replace("\xa0", " ").lstrip().startswith("Prompted "):
            continue
        prompt = re.sub(r"^Prompted\s*", "", tidy(parts[0])).strip()
        where = next((i for i in range(1, min(len(parts), 5)) if page_instant(tidy(parts[i]))), None)
        answer = tidy("\n".join(parts[where + 1 :])) if where else ""
        if where is None or not prompt or len(answer) < 50:
            out.append({"content": None, "at": None, "source_key": None, "failure": "time" if where is None else "text"})
            continue
        at = page_instant(tidy(parts[where])).isoformat(timespec="milliseconds") + "Z"
        content = f"Q: {prompt}\n\nA: {answer}"[:4000]
        out.append({"content": content, "at": at, "source_key": "gemini-conv:v2:" + hashlib.sha256(f"v2\0{content}\0{at}".encode()).hexdigest(), "failure": None})
    return out


def read_pages_of_cells(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, content, at, source_key, failure`` of the prompts of exported pages."""
    cells = each(page_cells, "array<struct<content:string,at:string,source_key:string,failure:string>>")
    pages = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), "value")
    return pages.select("path", F.posexplode(cells("value")).alias("n", "x")).select("path", "n", "x.*")


def read_session_messages(spark: SparkSession, path: str, start: str, end: str, most: int = 1500) -> DataFrame:
    """``path, at, role, said`` of the messages of session logs (JSON lines) within [start, end); lines that are no message are passed over.

    Longer messages are cut and say so. A message whose time has no zone or can't be read is left out.
    """
    shape = "type string, timestamp string, message struct<role:string,content:string>"
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.from_json("value", shape).alias("x")).select("path", "x.*").where("type = 'message'")
    blocks = F.from_json("message.content", "array<struct<type:string,text:string>>")
    text = F.when(F.col("message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")).otherwise(F.col("message.content"))
    zoned = F.when(F.col("timestamp").rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), F.to_utc_timestamp(F.try_to_timestamp("timestamp"), F.current_timezone()).cast("timestamp_ntz"))
    said = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    kept = rows.where(F.col("message.role").isin("user", "assistant")).select("path", zoned.alias("at"), F.col("message.role").alias("role"), text.alias("text"))
    kept = kept.where((F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") < F.lit(end).cast("timestamp_ntz")) & (F.trim("text") != ""))
    return kept.select("path", "at", "role", said.alias("said"))


def memory_key(channel: str, start: str, end: str, index: int, memory: dict) -> str:
    """A key that stays the same for the same channel, window, place and memory."""
    digest = hashlib.sha256(json.dumps(memory, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return f"discord-sweep:v1:{channel}:{start}:{end}:{index}:{digest}"
