"""Text pieces that have no built-in: chunkers, stems, cover density, fuzzy times.

All are plain functions of one value, wrapped as Arrow UDFs where a frame needs them.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import hmac
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

#: A segment begins after two or more line ends with nothing but blanks between them, and at a heading.
_BOUNDARY = re.compile(r"(?:\r?\n[ \t]*){2,}|^(?=#{1,6}[ \t])", re.M)


def lossless_chunks(text: str, most_bytes: int = 2000) -> list[str]:
    """Pieces that join to the text again, cut at blank lines and headings, each within the bytes; longer segments are cut by code point."""
    cuts = sorted({0, len(text), *(m.end() for m in _BOUNDARY.finditer(text))})
    out: list[str] = []
    held, room = "", most_bytes
    for segment in (text[a:b] for a, b in zip(cuts, cuts[1:])):
        size = len(segment.encode())
        if size > room:  # doesn't fit: what is held ends here, and the segment is spread over as many pieces as it takes
            out.append(held)
            *full, segment = _by_bytes(segment, most_bytes)
            out += full
            held, room, size = "", most_bytes, len(segment.encode())
        held, room = held + segment, room - size
    return [x for x in (*out, held) if x]


def _by_bytes(text: str, most: int) -> list[str]:
    """Pieces of at most so many bytes of UTF-8, none of which splits a code point."""
    raw, out, at = text.encode(), [], 0
    while len(raw) - at > most:
        end = at + most
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode())
        at = end
    return [*out, raw[at:].decode()]


#: White space within a blank line, of any kind but line ends.
_INNER = r"[^\S\r\n]"
_PARAGRAPH_END = re.compile(rf"(?:\r\n|\r|\n)(?:{_INNER}*(?:\r\n|\r|\n))+")


def token_plan(text: str, most: int = 256, tail: int = 64, count: Callable[[str], int] | None = None) -> list[tuple[int, int, int, str]]:
    """Parts by byte offsets: paragraphs are packed while their tokens fit, long ones are halved, a short last paragraph stays alone.

    Gives (start, end, tokens, sha256) of each part; the parts cover the text. ``count`` is the tokenizer's count and
    counts words if none is given. A packed part is counted as a whole, as tokens may join across paragraphs.
    """
    count = count or (lambda x: len(x.split()))
    ends = [m.end() for m in _PARAGRAPH_END.finditer(text)]
    marks = [0, *ends] + ([len(text)] if not ends or ends[-1] < len(text) else [])
    paragraphs = list(zip(marks, marks[1:])) or [(0, 0)]
    last = paragraphs[-1]
    alone = len(paragraphs) > 1 and text[slice(*last)].strip() != "" and count(text[slice(*last)]) <= tail
    spans: list[tuple[int, int]] = []
    open_span: tuple[int, int] | None = None
    for span in paragraphs:
        if open_span and not (alone and span == last) and count(text[open_span[0] : span[1]]) <= most:
            open_span = (open_span[0], span[1])
            continue
        if open_span:
            spans.append(open_span)
            open_span = None
        if count(text[slice(*span)]) > most:
            spans.extend(_halves(text, span, most, count))
        else:
            open_span = span
    if open_span:
        spans.append(open_span)
    out, at = [], 0
    for a, b in spans:
        raw = text[a:b].encode()
        out.append((at, at + len(raw), count(text[a:b]), hashlib.sha256(raw).hexdigest()))
        at += len(raw)
    return out


def _halves(text: str, span: tuple[int, int], most: int, count: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    a, b = span
    if count(text[a:b]) <= most:
        yield span
    elif b - a < 2:
        raise ValueError("one character has more tokens than a part may have")
    else:
        middle = a + (b - a) // 2
        yield from _halves(text, (a, middle), most, count)
        yield from _halves(text, (middle, b), most, count)


def frontmatter(text: str) -> tuple[list[str], str]:
    """The tags that a document states at its head, and what follows it."""
    head = re.match(r"---\r?\n(.*?)^---(?:\r?\n|\Z)", text, re.S | re.M)
    if not head:
        return [], text
    stated = re.search(r"tags:\s*\[([^\]]*)\]", head[1])
    tags = [re.sub(r"^['\"]|['\"]$", "", t.strip()) for t in stated[1].split(",")] if stated else []
    return [t for t in tags if t], text[head.end() :]


def section_key(path: str, heading: str, nth: int, sub: str | None = None, sub_nth: int | None = None) -> str:
    """Key of a section. The first of its name has a readable one, later ones a digest of a framed tuple that no heading can imitate."""
    if nth == 1 and sub_nth in (None, 1):
        return f"file-sync:{path}:{heading}" + (f":{sub}" if sub is not None else "")
    frame = lambda x: b"\0" * 5 if x is None else b"\1" + len(x.encode()).to_bytes(4, "big") + x.encode()
    fields = (path, heading, str(nth), sub, None if sub_nth is None else str(sub_nth))
    return "file-sync:v2:" + hashlib.sha256(b"file-sync-key\0v2\0" + b"".join(map(frame, fields))).hexdigest()


def _under(body: str, marks: str) -> tuple[str, list[tuple[str, int, str]]]:
    """What comes before the first heading of a level, and (heading, its occurrence, text) of each section under one."""
    before, *rest = re.split(rf"^({marks} [^\r\n]+)(?=\r?$)", body, flags=re.M)
    seen: Counter[str] = Counter()
    sections = []
    for heading, content in zip(rest[::2], rest[1::2]):
        heading = heading.strip()
        seen[heading] += 1
        sections.append((heading, seen[heading], content.strip()))
    return before.strip(), sections


def markdown_sections(text: str, path: str = "", most: int = 2000) -> list[tuple[str, str, str, list[str]]]:
    """(key, heading, body, tags) of the sections under second-level headings; long ones are split at third level.

    Text before the first heading counts from ten characters, the text of a section from five. A document without
    such headings is one section.
    """
    tags, body = frontmatter(text)
    before, sections = _under(body, "##")
    lead, short = 10, 5
    out = []
    if len(before) >= lead:
        name = "(preamble)" if sections else "(root)"
        out.append((f"file-sync:{path}:{name}", name, before, tags))
    for heading, nth, content in sections:
        if len(content) < short:
            continue
        whole = f"{heading}\n{content}"
        first, parts = _under(content, "###") if len(whole) > most else ("", [])
        if not parts:
            out.append((section_key(path, heading, nth), heading, whole, tags))
            continue
        if len(first) >= lead:
            out.append((section_key(path, heading, nth), heading, f"{heading}\n{first}", tags))
        out += [
            (section_key(path, heading, nth, sub, sub_nth), f"{heading} > {sub}", f"{heading}\n{sub}\n{inner}", tags)
            for sub, sub_nth, inner in parts
            if len(inner) >= short
        ]
    return out


def identity_form(text: str) -> str:
    """Compatibility form with white space collapsed, in lower case."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().lower()


def canonical_hash(value: str) -> str | None:
    """Digest of a JSON value whose keys are put in order first."""
    try:
        return hashlib.sha256(json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    except (ValueError, TypeError):
        return None


def stem(word: str) -> str:
    """A light English stem: plural, past and gerund endings (steps 1a to 1c of Porter's algorithm)."""
    vowel = lambda x: re.search(r"[aeiouy]", x) is not None
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss") and len(word) > 2:
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if vowel(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    return word


def cover_density(text: str, query: str) -> float:
    """Sum over the shortest extents that hold all query stems of 1 / extent length (Clarke, Cormack and Tudhope, 1999)."""
    terms = {stem(w) for w in re.findall(r"[a-z0-9]+", query.lower())}
    if not terms:
        return 0.0
    places = [(i, s) for i, s in enumerate(map(stem, re.findall(r"[a-z0-9]+", text.lower()))) if s in terms]
    last: dict[str, int] = {}
    score, before = 0.0, -1
    for i, s in places:
        last[s] = i
        if len(last) == len(terms) and (start := min(last.values())) > before:
            score += len(terms) / (i - start + 1)
            before = start
    return score


_MONTHS = {name.lower(): i for i in range(1, 13) for name in (calendar.month_name[i], calendar.month_abbr[i])} | {"sept": 9}
_AGO = re.compile(r"\s*(\d+)\s+(minute|hour|day|week|month|year)s?\s+ago\s*")
_NAMED = {"just now": (0, "day"), "today": (0, "day"), "yesterday": (1, "day")} | {
    label: (n, unit) for unit in ("week", "month", "year") for label, n in ((f"this {unit}", 0), (f"last {unit}", 1), (f"a {unit} ago", 1)) if label != "this year"
}


def _bucket(unit: str, at: dt.datetime) -> tuple[dt.datetime, dt.datetime, dt.datetime]:
    """The unit of the calendar that holds an instant: what stands for it, its start and its end."""
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "minute":
        start = at.replace(second=0, microsecond=0)
        return start, start, start + dt.timedelta(minutes=1)
    if unit == "hour":
        start = at.replace(minute=0, second=0, microsecond=0)
        return start, start, start + dt.timedelta(hours=1)
    if unit == "day":
        return day + dt.timedelta(hours=12), day, day + dt.timedelta(days=1)
    if unit == "week":
        start = day - dt.timedelta(days=day.weekday())
        return start + dt.timedelta(days=2, hours=12), start, start + dt.timedelta(days=7)
    if unit == "month":
        start = day.replace(day=1)
        return start.replace(day=15, hour=12), start, (start + dt.timedelta(days=32)).replace(day=1)
    start = day.replace(month=1, day=1)
    return start.replace(month=7, day=2, hour=12), start, start.replace(year=start.year + 1)


def fuzzy_time(label: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime, dt.datetime, str] | None:
    """(instant, start, end, precision) of a label such as "5 hours ago", "Today", "last week" or "March"; None if it isn't understood.

    All is UTC. A written instant with a zone is itself; any other label means a unit of the calendar, for which its
    middle stands (the start of a minute or an hour).
    """
    text = label.strip().lower()
    try:
        written = dt.datetime.fromisoformat(label.strip().replace("z", "Z"))
        if written.tzinfo:
            instant = written.astimezone(dt.timezone.utc).replace(tzinfo=None)
            return instant, instant, instant, "instant"
    except ValueError:
        pass
    unit, at = "", now
    try:
        if text in _MONTHS:
            unit, at = "month", now.replace(year=now.year - (_MONTHS[text] > now.month), month=_MONTHS[text], day=1)
        elif re.fullmatch(r"\d{4}", text):
            unit, at = "year", now.replace(year=int(text), month=1, day=1)
        elif text in _NAMED or (found := _AGO.fullmatch(text)):
            n, unit = _NAMED[text] if text in _NAMED else (int(found[1]), found[2])
            if unit in ("month", "year"):
                months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
                at = now.replace(year=months // 12, month=months % 12 + 1, day=1)
            else:
                at = now - n * dt.timedelta(**{f"{unit}s": 1})
        return (*_bucket(unit, at), unit) if unit else None
    except (ValueError, OverflowError):  # before year 1 or after 9999
        return None


def without_controls(text: str, most: int | None = None) -> str:
    """Compatibility form without control characters, white space collapsed, cut by code point."""
    flat = re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]+", " ", unicodedata.normalize("NFKC", text))).strip()
    return flat[:most]


def is_storable(text: str, most_bytes: int = 1 << 20) -> bool:
    """Whether a text can be stored and hashed without loss: no NUL, no half of a surrogate pair, within the bytes."""
    try:
        return "\0" not in text and len(text.encode("utf-8")) <= most_bytes
    except UnicodeEncodeError:
        return False


def keyed_digest(key: bytes, text: str) -> str:
    """Digest of a text that only the holder of the key can make (HMAC-SHA-256)."""
    return hmac.new(key, text.encode(), "sha256").hexdigest()


def projected(vector: list[float], native: int, kept: int) -> list[float] | None:
    """The first dimensions of a native vector, of unit length again; None for another length, a value that isn't finite or no length."""
    if vector is None or len(vector) != native or any(x is None or not math.isfinite(x) for x in vector):
        return None
    norm = math.hypot(*vector[:kept])
    return [x / norm for x in vector[:kept]] if 0 < norm < math.inf else None
