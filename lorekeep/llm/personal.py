"""Problem 1: personal items in free text, found and replaced by placeholders of their kind.

Detection preserves offsets. A first transducer maps every character to one character
(widths, kinds of space and hyphen, letters that the public table of confusables gives); a second one rewrites what is
spelt out (at, dot, digits as words, invisible characters) and keeps, for each character it
writes, the place in the source that it came from. Detectors run over the rewritten text,
and their spans are mapped back, so positions and replacements are those of the source.

Names are recognised by what the table of known people teaches: its given names, its family
names, and the beginnings and endings that several family names share, so that family names
made of known parts are found though the table doesn't hold them. A family name counts only
together with a given name or an initial. A table of people that is too large for a task's memory is joined
with the words of the contents instead, with the same result.

Defined results: null, empty and blank contents have no items and are returned as they are;
contents of any length are read whole; overlapping items go by kind (email, id_number,
phone, address, name), then by place; rows that share ``id`` are one record; without a
table of people only names are missed; further columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.lookalike import look_alikes
from lorekeep.operators.texts import each
from lorekeep.session import checkpointed

KINDS = ("email", "id_number", "phone", "address", "name")
#: Up to so many known names travel with the tasks; beyond that the words of the contents are joined with them.
MOST_NAMES = 200_000

# Words for digits, forms of address, street and box words, labels of numbers.
DIGIT_WORDS = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789"))
TITLES = "mr mrs ms miss mx dr prof professor sir madam frau herr señor señora sr sra mme monsieur madame doña don"
NOT_GIVEN = (
    "with says for by to from and or via the a an booking contact deliver because met sent thanks user said asked of in on at cc re dear hi hello "
    "send ask call write ring tell since when whenever while after before name phone if is was are were that this these those about"
)
STREETS = "St|Street|Rd|Road|Ave|Avenue|Blvd|Boulevard|Ln|Lane|Terrace|Ter|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Way|Close|Crescent|Row|Walk|Hill|Parkway|Pkwy|Highway|Hwy"
FLATS = "Flat|Apt|Apartment|Unit|Suite|Ste|Room"
STREETS, FLATS = f"{STREETS}|{STREETS.upper()}", f"{FLATS}|{FLATS.upper()}"
ID_LABELS = (
    r"passport|ssn|social security|nino|ni|national insurance|id card|identity card|id|identity|tax id|tin|itin|steuer-?id|steueridentifikationsnummer|"
    r"driver'?s licen[cs]e|driving licen[cs]e|licen[cs]e|reisepass(?:nummer)?|personalausweis(?:nummer)?|national id|nif|dni|nie|cpf|aadhaar|insee|pesel|registration|tax(?:payer)? (?:number|no\.?)"
)


@cache
def _one_to_one() -> dict[int, int]:
    table = {}
    for code in (*range(0xA0, 0x3100), *range(0xFF00, 0xFFF0), *range(0x1D7CE, 0x1D800)):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Zs":
            table[code] = ord(" ")
        elif kind == "Nd":
            table[code] = ord("0") + unicodedata.digit(char)
        elif unicodedata.decomposition(char).startswith(("<wide>", "<narrow>")) and len(form := unicodedata.normalize("NFKC", char)) == 1:
            table[code] = ord(form)
    table |= dict.fromkeys(map(ord, "‐‑‒–−"), ord("-"))
    return table | {ord("’"): ord("'"), ord("‘"): ord("'")}


_INVISIBLE = "­​‌‍⁠﻿"
_WORDY = "|".join(DIGIT_WORDS)
_SPELT = re.compile(
    rf"(?P<gone>[{_INVISIBLE}]+)"
    r"|(?P<at>\s*[\[({<]\s*(?:at|AT|At|ät|AÄT)\s*[\])}>]\s*|%40|&#0*64;|&commat;)"
    r"|(?P<dot>\s*[\[({<]\s*(?:dot|DOT|Dot|punkt|PUNKT|point)\s*[\])}>]\s*)"
    r"|(?P<word_at>\s(?:at|AT)\s(?=[\w-]+(?:\s(?:dot|DOT)\s|\s*[\[({]\s*(?:dot|DOT)|\.)[\w.-]))"
    r"|(?P<word_dot>(?<=[\w])\s(?:dot|DOT)\s(?=\w))"
    rf"|(?P<digit>\b(?:{_WORDY})\b(?=[\s,-]+(?:{_WORDY}|\d)\b)|(?<=[a-z\d][\s,-])\b(?:{_WORDY})\b)",
    re.I,
)
_MARKS = ("(at", "[at", "{at", "<at", "( at", "[ at", " dot ", "[dot", "(dot", "%40", "&#", "&commat")
_SPELT_NUMBER = re.compile(rf"\b(?:{_WORDY})[\s,-]+(?:{_WORDY})\b")


def _needs_rewriting(plain: str) -> bool:
    low = plain.lower()
    return any(m in low for m in _MARKS) or bool(_SPELT_NUMBER.search(low)) or not plain.isascii() and any(c in plain for c in _INVISIBLE)


def rewrite(text: str, table: dict[int, int] | None = None) -> tuple[str, list[int] | None]:
    """The text that detectors read, and for each of its characters the place in the source (None: the same place)."""
    plain = text if text.isascii() else text.translate(table or _one_to_one())
    if not _needs_rewriting(plain):
        return plain, None
    out, places, last = [], [], 0
    words = list(_SPELT.finditer(plain))
    spelt = {i for i, m in enumerate(words) if m.lastgroup == "digit" and any(0 <= j < len(words) and words[j].lastgroup == "digit" and abs(words[j].start() - m.start()) < 9 for j in (i - 1, i + 1))}
    dotted = {m.start() for m in words if m.lastgroup in ("dot", "word_dot")}
    for i, m in enumerate(words):
        kind = m.lastgroup
        if kind == "word_at" and not re.match(r"[\w-]+(?:\.[\w-]+)*\.(?:test|example|invalid|com|org|net|[a-z]{2,3})\b", plain[m.end() : m.end() + 80], re.I) and not any(m.end() < d < m.end() + 60 for d in dotted):
            continue
        if kind == "word_dot" and not any(w.lastgroup in ("at", "word_at") and 0 < m.start() - w.start() < 80 for w in words) and "@" not in plain[max(0, m.start() - 60) : m.start()]:
            continue
        if kind == "digit" and i not in spelt:
            continue
        out.append(plain[last : m.start()])
        places.extend(range(last, m.start()))
        new = {"gone": "", "at": "@", "word_at": "@", "dot": ".", "word_dot": "."}.get(kind) if kind != "digit" else DIGIT_WORDS[m[0].lower()]
        out.append(new)
        places.extend([m.start()] * len(new))
        last = m.end()
    out.append(plain[last:])
    places.extend(range(last, len(plain) + 1))
    return "".join(out), places


_EMAIL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.%+'-]*[\w])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@])")
_LABELLED = re.compile(
    rf"(?<![\w-])(?:{ID_LABELS})(?:[ -](?:card|number|no\.?|nr\.?|num\.?|nummer))*\s*(?:[:#=]|is)?\s*#?(?P<v>(?=[A-Z\d -]*\d)[A-Z]{{0,5}}[ -]?\d[\dA-Z]*(?:[ -]\d[\dA-Z]*)*(?:[ -][A-Z](?![\w]))?)", re.I
)
_SOCIAL = re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")
_INSURANCE = re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)")
_PHONE = re.compile(
    r"(?<![\w.+/#@-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,12}){1,7}"
    r"|\(\+\d{1,3}\)(?:[ .-]?\d{1,12}){2,7}"
    r"|00 ?\d{2}(?: \d{1,5}){3,6}"
    r"|(?:1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|(?:\(0\d{2,4}\) ?|0\d{2,4}[ /])\d{3,8}(?:[ -]\d{2,8})*"
    r"|0\d(?:[. -]\d{2}){4}"
    r"|(?:\(0\d\)|0\d) \d{4} \d{4}"
    r")(?:\s?(?:ext\.?|x|extension)\s?\d{1,6})?(?![\w/]|[.,:-]\d)",
    re.I,
)
_NOT_PHONE = re.compile(r"(?:version|build|ticket|trace|order|checksum|invoice|commit|epoch|release|track|isbn|ip|v)[ :#]*$", re.I)
_TOWN = r"(?:[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?)"
_END = rf"(?:\.?,? ?\r?\n?(?: ?(?:{FLATS})\.? \w{{1,5}},?)? ?(?:\d{{5}} )?{_TOWN}(?:,? [A-Z]{{2}})?(?: \d{{5}}(?:-\d{{4}})?)?)"
# the kinds of address: street after the number (English), before it (German), French, Spanish and Italian, post boxes
_ADDRESSES = (
    re.compile(rf"(?<![\w.,/-])(?:(?:{FLATS})\.? \w{{1,5}}, )?\d{{1,5}}[A-Za-z]? (?:[A-ZÀ-Þ][\w'-]+ ){{1,3}}(?:{STREETS})\b{_END}?"),
    re.compile(rf"(?<![\w-])[A-ZÀ-Þ][\w-]*(?:straße|strasse|STRASSE|STRAßE|str\.|weg|WEG|platz|PLATZ|gasse|GASSE|allee|ALLEE)\.? \d{{1,4}}[A-Za-z]?\b(?!\.\d)(?:,? \d{{5}} {_TOWN})?"),
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|RUE|AVENUE|BOULEVARD|PLACE|CHEMIN|QUAI)(?: (?:de|du|des|la|le|les|DE|DU|DES|LA|LE|LES))* [A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?(?:,? \d{{5}} {_TOWN})?"),
    re.compile(rf"(?<![\w-])(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Piazza|Rua|CALLE|AVENIDA|PLAZA|PASEO|VIA|RUA)(?: (?:de|del|la|las|los|da|do|di|DE|DEL|LA))* [A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?,? \d{{1,4}}[A-Za-z]?\b(?:,? \d{{5}} {_TOWN})?"),
    re.compile(rf"(?<![\w-])(?:(?:[Pp]\.? ?[Oo]\.?|POST|[Pp]ost(?: [Oo]ffice)?) ?(?:Box|BOX|box)|Postfach|POSTFACH|Apartado(?: de [Cc]orreos)?|Casella [Pp]ostale|Bo[îi]te [Pp]ostale|BP) (?:\d[\d ]*\d|\d)(?:,? {_TOWN}(?: \d{{5}})?|,? \d{{5}} {_TOWN})?"),
)


def _loose(pattern: re.Pattern) -> str:
    """A pattern without what it asks of its surroundings, in the form of Arrow's matcher: it matches wherever the pattern does."""
    bare = re.sub(r"\(\?<?[!=](?:[^()\[\]]|\[[^\]]*\])*\)", "", pattern.pattern)
    return ("(?i:" if pattern.flags & re.I else "(?:") + bare + ")"


#: Whole columns are looked through with these first; most texts have nothing of the kind, and only the others are searched.
_ANY_ADDRESS = "|".join(map(_loose, _ADDRESSES))
_ANY_LABEL = _loose(_LABELLED)
_ANY_NUMBER = "|".join(map(_loose, (_SOCIAL, _INSURANCE, _PHONE))).replace("\\1", "[- ]")
_ANY_SPELT = "(?i:" + "|".join(map(re.escape, _MARKS)) + ")|" + _loose(_SPELT_NUMBER)


def worth_searching(contents: pd.Series) -> Iterator[list[bool]]:
    """Whether each content is worth a rewriting, a search for addresses, for labelled and for other numbers; a text that isn't plain ASCII always is."""
    column = pa.array(contents, pa.string())
    plain = pc.string_is_ascii(column)
    for pattern in (_ANY_SPELT, _ANY_ADDRESS, _ANY_LABEL, _ANY_NUMBER):
        yield pc.fill_null(pc.or_(pc.invert(plain), pc.match_substring_regex(column, pattern)), False).to_pylist()


_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*(?:['-][^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*)*")


@lru_cache(200_000)
def fold(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c)).replace("ł", "l").replace("ø", "o").replace("đ", "d")


def _bare(word: str) -> str:
    """Without a possessive ending."""
    return word[:-2] if word[-2:] in ("'s", "'S") else word


@dataclass(frozen=True, eq=False)
class Names:
    """What the table of known people teaches, and the letters of other alphabets that look like Latin ones."""

    given: frozenset[str]
    family: frozenset[str]
    heads: frozenset[str] = frozenset()
    tails: frozenset[str] = frozenset()
    looks: tuple[tuple[str, str], ...] = ()
    _families: dict[str, bool] = field(default_factory=dict, repr=False)

    @cached_property
    def table(self) -> dict[int, int]:
        """The first transducer: every character and the one that it stands for."""
        return _one_to_one() | {ord(a): ord(b) for a, b in self.looks}

    @staticmethod
    def learn(people: list[str], least: int = 2, looks: tuple[tuple[str, str], ...] = ()) -> Names:
        given, family = set(), set()
        for person in people:
            words = fold(person).split()
            if len(words) >= 2:
                given.add(words[0])
                family.update(words[-1].split("-"))
        heads = Counter(w[:i] for w in family for i in range(4, len(w) - 2))
        tails = Counter(w[i:] for w in family for i in range(4, len(w) - 2))
        return Names(frozenset(given), frozenset(family), frozenset(h for h, n in heads.items() if n >= least), frozenset(t for t, n in tails.items() if n >= least), looks)

    def is_family(self, word: str) -> bool:
        """Whether every part of a (double) name, without a possessive ending, is a known family name or is made of known parts."""
        known = self._families.get(word)
        if known is None:
            if len(self._families) > 200_000:
                self._families.clear()
            known = self._families[word] = self._is_family(_bare(word))
        return known

    def any_family(self, words: set[str]) -> bool:
        """Whether any of the words is one; most contents end here."""
        known = self._families
        return any([known[w] if w in known else self.is_family(w) for w in words])

    def _is_family(self, word: str) -> bool:
        return len(word) >= 5 and all(p in self.family or any(p[:i] in self.heads and p[i:] in self.tails for i in range(4, len(p) - 2)) for p in fold(word).split("-"))


_TITLES, _NOT_GIVEN = frozenset(fold(TITLES).split()), frozenset(NOT_GIVEN.split())


def _name_spans(text: str, names: Names) -> Iterator[tuple[int, int]]:
    if not names.any_family(set(_WORD.findall(text))):
        return
    words = list(_WORD.finditer(text))
    is_family = [names.is_family(w[0]) for w in words]

    def gap(i: int, j: int) -> str:
        return text[words[i].end() : words[j].start()]

    def is_given(i: int, loose: bool) -> bool:
        f = fold(_bare(words[i][0]))
        if is_family[i] or f in _TITLES or f in _NOT_GIVEN:
            return False
        if all(p in names.given for p in f.split("-")):
            return True
        return loose and len(f) >= 2 and words[i][0][0].isupper() and text[words[i].start() - 1 : words[i].start()] not in ("@", "_")

    def is_initial(i: int) -> bool:
        return len(words[i][0]) == 1 and words[i][0].isupper() and text[words[i].end() : words[i].end() + 1] == "."

    used = -1
    for i, yes in enumerate(is_family):
        if not yes or i <= used:
            continue
        end = words[i].start() + len(_bare(words[i][0]))
        # a given name or initials in front
        k = i
        while k > 0 and k - 1 > used and is_initial(k - 1) and re.fullmatch(r"\.[ ]?", gap(k - 1, k)):
            k -= 1
        if k > 0 and k - 1 > used and re.fullmatch(r"[ ]+", gap(k - 1, k)) and is_given(k - 1, True):
            yield words[k - 1].start(), end
            used = i
            continue
        if k < i:
            yield words[k].start(), end
            used = i
            continue
        # the given name behind, after a comma or a space
        if i + 1 < len(words) and re.fullmatch(r",? ", gap(i, i + 1)):
            j = i + 1
            comma = "," in gap(i, i + 1)
            after = j + 1
            while after < len(words) and is_initial(after) and re.fullmatch(r"[ .]*", gap(after - 1, after)):
                after += 1
            leads = after < len(words) and is_family[after] and re.fullmatch(r"[ .]*", gap(after - 1, after))
            if not leads and (is_given(j, comma) or (comma and is_initial(j))):
                yield words[i].start(), words[j].start() + len(_bare(words[j][0])) + (1 if is_initial(j) else 0)
                used = j


def items(content: str, names: Names, spelt: bool = True, addresses: bool = True, labels: bool = True, numbers: bool = True) -> list[tuple[int, int, str]]:
    """Start and end (from 0, in code points of the source) and kind of each item, by place.

    The flags tell what the content as it is may hold; where it has to be rewritten they don't count.
    """
    text, places = rewrite(content, names.table) if spelt else (content, None)
    if places is not None:
        addresses = labels = numbers = True
    spans: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        while end > start and text[end - 1] in " ,\r\n":
            end -= 1
        if all(end <= s or start >= e for s, e, _ in spans):
            spans.append((start, end, kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    for m in _LABELLED.finditer(text) if labels else ():
        if sum(c.isdigit() for c in m["v"]) >= 5:
            add(m.start("v"), m.end("v"), "id_number")
    if numbers:
        for pattern in (_SOCIAL, _INSURANCE):
            for m in pattern.finditer(text):
                add(m.start(), m.end(), "id_number")
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in re.split("(?i)ext|x", m[0])[0]) <= 15 and not _NOT_PHONE.search(text[max(0, m.start() - 12) : m.start()]):
                add(m.start(), m.end(), "phone")
    if addresses:
        for pattern in _ADDRESSES:
            for m in pattern.finditer(text):
                add(m.start(), m.end(), "address")
    for start, end in _name_spans(text, names):
        add(start, end, "name")
    if places is not None:
        spans = [(places[s], places[e - 1] + 1 if places[e] - places[e - 1] <= 1 or e == len(places) - 1 else places[e], k) for s, e, k in spans]
    return sorted(spans)


def _people(entities: DataFrame) -> DataFrame:
    return entities.where((F.col("entity_type") == "person") & F.col("display_name").isNotNull()).select("display_name").distinct()


def learn_names(entities: DataFrame) -> Names:
    """Names of the known people, for a table that the tasks can hold."""
    return Names.learn(sorted(p[0] for p in _people(entities).collect()), looks=_looks())


def _looks() -> tuple[tuple[str, str], ...]:
    return tuple(sorted(look_alikes().items()))


def _words_of(batches: Iterator[pd.DataFrame], table: dict[int, int]) -> Iterator[pd.DataFrame]:
    """The folded parts of the words of each content, each once."""
    for batch in batches:
        rows = [(i, part) for i, content in zip(batch["id"], batch["content"]) for part in {p for w in _WORD.findall(rewrite(content, table)[0]) for x in (w, _bare(w)) for p in (fold(x), *fold(x).split("-"))}]
        yield pd.DataFrame(rows, columns=["id", "part"])


def known_by_row(contents: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """``id, given, family``: the words of each content (``id, content``) that are given names or made of family names.

    Does by joins what ``Names.learn`` does in a task's memory: names become words, words heads and tails, and every
    distinct word of the contents is looked up once.
    """
    table = _one_to_one() | {ord(a): ord(b) for a, b in _looks()}
    folded = each(fold, "string")
    named = _people(entities).select(F.split(F.trim(folded("display_name")), r"\s+").alias("w")).where(F.size("w") >= 2)
    given = named.select(F.element_at("w", 1).alias("part")).distinct()
    family = named.select(F.explode(F.split(F.element_at("w", -1), "-")).alias("part")).distinct()
    cuts = lambda frame: frame.where(F.length("part") >= 7).select("part", F.explode(F.sequence(F.lit(4), F.length("part") - 3)).alias("i"))
    head, tail = F.substring("part", F.lit(1), F.col("i")), F.substring("part", F.col("i") + 1, F.length("part"))
    often = lambda piece: cuts(family).select(piece.alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("piece")
    words = checkpointed(contents.mapInPandas(lambda batches: _words_of(batches, table), "id string, part string"))
    distinct = words.select("part").distinct()
    made = cuts(distinct).select("part", head.alias("head"), tail.alias("tail")).join(often(head).withColumnRenamed("piece", "head"), "head").join(often(tail).withColumnRenamed("piece", "tail"), "tail").select("part")
    families = distinct.join(family, "part", "left_semi").unionByName(made).distinct().withColumn("kind", F.lit("family"))
    kinds = families.unionByName(distinct.join(given, "part", "left_semi").withColumn("kind", F.lit("given")))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("part"))).alias(kind)
    return words.join(kinds, "part").groupBy("id").agg(of("given"), of("family"))  # at most the words of one content


def _each_content(rows: DataFrame, entities: DataFrame, give: Callable, schema: str, most_names: int) -> DataFrame:
    """Apply ``give(id, content, items)`` to every row of ``id, content``, with the names that a task can hold, or those of the row where there are more."""
    if _people(entities).limit(most_names + 1).count() <= most_names:
        names = learn_names(entities)

        def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                worth = worth_searching(batch["content"])
                yield from give((i, c, items(c, names, *flags) if c is not None else []) for i, c, *flags in zip(batch["id"], batch["content"], *worth))

        return rows.mapInPandas(small, schema)
    looks = _looks()

    def large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = (Names(frozenset(g if g is not None else ()), frozenset(f if f is not None else ()), looks=looks) for g, f in zip(batch["given"], batch["family"]))
            yield from give((i, c, items(c, n) if c is not None else []) for i, c, n in zip(batch["id"], batch["content"], own))

    known = known_by_row(rows.where(F.col("content").isNotNull()), entities)
    return rows.join(known, "id", "left").select("id", "content", "given", "family").mapInPandas(large, schema)


def found_items(memories: DataFrame, entities: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """``memory_id, kind, start_pos`` (code points, from 1) of every personal item."""

    def give(found):
        rows = [(i, kind, start + 1) for i, _, spans in found for start, _, kind in spans]
        yield pd.DataFrame(rows, columns=["memory_id", "kind", "start_pos"]).astype({"start_pos": "int32"})

    rows = memories.select("id", "content").where(F.col("content").isNotNull())
    return _each_content(rows, entities, give, "memory_id string, kind string, start_pos int", most_names).distinct()


def redacted(memories: DataFrame, entities: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """``memory_id, content, n_items``: every content with its items replaced by ``[EMAIL]``, ``[PHONE]``, ..."""

    def give(found):
        out = []
        for i, content, spans in found:
            parts, last = [], 0
            for start, end, kind in spans:
                parts += [content[last:start], f"[{kind.upper()}]"]
                last = end
            out.append((i, None if content is None else "".join(parts) + content[last:], len(spans)))
        yield pd.DataFrame(out, columns=["memory_id", "content", "n_items"]).astype({"n_items": "int32"})

    rows = memories.select("id", "content").dropDuplicates(["id"])
    return _each_content(rows, entities, give, "memory_id string, content string, n_items int", most_names)
