"""Problem 8: one consistent form for texts that look alike.

A text is first mapped by the JVM: widths, kinds of space and hyphen, look-alike letters
of other alphabets, joined letters and invisible characters get one form each. Which letters
look alike is taken from the public Unicode table of confusable characters, which comes with
the collations. A text of ASCII characters is its own mapped value. Values so
mapped are grouped in SQL under the accent- and case-sensitive root collation, which
takes care of the ways in which accents are composed; each class gets a deterministic
canonical member, its least text by code points, which is joined back.

What the collation would wrongly equate is made distinct first: digits of other scripts
(their style shows) and the joiner inside emoji sequences (without it the emoji changes).

Texts don't shuffle to be compared. Values that the collation could equate have the same
base letters, so a hash of those is the first key: it is made by one look-up a character, travels alone, is aggregated in each
task, and only texts whose base letters occur in more than one spelling are grouped under
the collation itself. A group of exact copies is one text before anything is compared.

Defined results: null stays null, empty and blank texts are their own canonical form and
are no case of ``found_pairs``; exact copies under other ids share their class; repeated
rows count once; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import string
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import checkpointed

#: Blocks of the alphabets whose letters may have the shape of a Latin letter: Greek, Cyrillic, Armenian, Coptic, Cherokee.
ALPHABETS = ((0x370, 0x590), (0x13A0, 0x1400), (0x1C80, 0x1C90), (0x1F00, 0x2000), (0x2C80, 0x2D00), (0xA640, 0xA6A0), (0xAB70, 0xABC0))
# Hyphens with the look of the ASCII one, spaces, and characters without any look.
HYPHENS = "‐‑﹣－"
INVISIBLE = "­͏؜᠎​‌‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
#: Stands for the joiner of an emoji sequence.
_JOINED = "\ue001"
#: Plane for the digits of other scripts.
_DIGITS_AT = 0xF0000


#: Combining marks above and below a letter.
_ABOVE = "\u0300-\u0314\u033d-\u0344\u0346\u034a-\u034c"
_BELOW = "\u031b\u0316-\u0319\u031c-\u0333\u0339-\u033c\u0347-\u0349"


@cache
def look_alikes() -> dict[str, str]:
    """Letters of other alphabets and the Latin letter of the same case that has their shape, by the public table of confusables."""
    checker = SparkSession.active()._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [chr(c) for block in ALPHABETS for c in range(*block) if unicodedata.category(chr(c)).startswith("L")]
    latin = string.ascii_letters
    # one call for all; a line break is nobody's confusable
    shapes = checker.getSkeleton(0, "\n".join([*latin, *letters])).split("\n")
    known = {(shape, letter.isupper()): letter for letter, shape in zip(latin, shapes)}
    return {letter: known[key] for letter, shape in zip(letters, shapes[len(latin) :]) if (key := (shape, letter.isupper())) in known}


@cache
def single_map() -> tuple[str, str]:
    """Characters that map to one character (or to none), by rules over the Unicode tables."""
    to: dict[str, str] = look_alikes() | {"µ": "μ"}
    to |= {h: "-" for h in HYPHENS}
    for code in range(0x110000):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Zs" and char != " ":
            to[char] = " "
        elif unicodedata.decomposition(char).startswith(("<wide>", "<narrow>")):
            form = unicodedata.normalize("NFKC", char)
            if len(form) == 1:
                to.setdefault(char, to.get(form, form))
        elif kind == "Nd" and char not in "0123456789":
            to[char] = chr(_DIGITS_AT + code)
    drop = "".join(c for c in INVISIBLE if c not in to)
    return "".join(to) + drop, "".join(to.values())


@cache
def joined_letters() -> dict[str, str]:
    """Ligatures: letters whose compatibility form is several ASCII letters."""
    out = {}
    for code in range(0x80, 0x10000):
        char = chr(code)
        if unicodedata.category(char) in ("Ll", "Lu", "Lt") and unicodedata.decomposition(char).startswith("<compat>"):
            form = unicodedata.normalize("NFKC", char)
            if len(form) > 1 and form.isascii() and form.isalpha():
                out[char] = form
    return out


@cache
def _class_of(chars: str) -> str:
    """A character class of ranges, which are matched faster than single characters."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def _spelt(text: Column, joined: Column) -> Column:
    """``joined`` with its joined letters spelt out, if ``text`` has any."""
    spelt = joined
    for char, form in joined_letters().items():
        spelt = F.replace(spelt, F.lit(char), F.lit(form))
    return F.when(text.rlike(_class_of("".join(joined_letters()))), spelt).otherwise(joined)


def look(text: Column) -> Column:
    """The mapped value of a text; equal under the collation for equal looks.

    Every step looks at the text first, so what a text doesn't hold costs it little.
    """
    joiner = r"([\p{So}\p{Sk}\x{FE0F}\x{1F3FB}-\x{1F3FF}])\x{200D}(?=[\p{So}])"
    out = F.when(text.contains("\u200d"), F.replace(F.regexp_replace(text, joiner, "$1" + _JOINED), F.lit("\u200d"), F.lit(""))).otherwise(text)
    out = F.translate(_spelt(text, out), *single_map())
    # marks below the letter go before marks above it, which is their canonical order
    out = F.when(text.rlike(r"[\x{300}-\x{36F}]"), F.regexp_replace(out, f"([{_ABOVE}]+)([{_BELOW}]+)", "$2$1")).otherwise(out)
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


@cache
def _base_map() -> tuple[str, str]:
    """``single_map`` followed by the loss of accents, of the joiner and of control characters, and of all but the first letter of Korean syllables."""
    mapped, drop = single_map()[1], single_map()[0][len(single_map()[1]) :]
    first = dict(zip(single_map()[0], mapped))
    kept, gone = {}, set(drop) | {"\u200d"}
    for code in range(0x110000):
        char = chr(code)
        kind = unicodedata.category(first.get(char, char))
        if kind[0] == "M" or (kind == "Cc" and char not in "\n\t\r") or 0x1160 <= code < 0x1200:
            gone.add(char)
        elif char not in gone and (base := unicodedata.normalize("NFD", first.get(char, char))[0]) != char:
            kept[char] = first.get(base, base)
    return "".join(kept) + "".join(sorted(gone - set(kept))), "".join(kept.values())


def base_letters(text: Column) -> Column:
    """The base letters of a text: equal for texts whose mapped values the collation equates."""
    return F.when(text.rlike(r"[^\x20-\x7E\n\r\t]"), F.translate(_spelt(text, text), *_base_map())).otherwise(text)


def _texts(documents: DataFrame) -> DataFrame:
    """``doc_id, text_key, base_key, shows``: hashes of every text and of its base letters, and whether it isn't blank once mapped."""
    seen = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    mapped = seen.select("doc_id", F.md5("text").alias("text_key"), base_letters(F.col("text")).alias("letters"))
    # no filter on the letters here: it would be pushed down and they would be made twice
    return mapped.select("doc_id", "text_key", F.xxhash64("letters").alias("base_key"), F.col("letters").rlike(r"(?U)\S").alias("shows"))


def look_classes(documents: DataFrame) -> DataFrame:
    """``text_key, canonical_key, class_id``: the distinct texts that share their look with another text.

    ``class_id`` is the key of the class's canonical member, its least text.
    """
    keyed = checkpointed(_texts(documents)).where("shows")
    several = keyed.groupBy("base_key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("base_key")
    # one document stands for each text; only these texts are compared under the collation
    standing = keyed.join(several, "base_key", "left_semi").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    # an id with two texts is two texts, each of which finds its own key
    texts = documents.select("doc_id", "text").join(standing, "doc_id").where(F.md5("text") == F.col("text_key")).dropDuplicates(["text_key"])
    looked = texts.select("text_key", "text", look(F.col("text")).alias("looks"))
    spark = documents.sparkSession
    return spark.sql(
        """
        WITH collated AS (SELECT text_key, text, looks COLLATE UNICODE AS looks FROM {looked}),
        classes AS (SELECT looks, min_by(text_key, text) AS class_id, count(*) AS n FROM collated GROUP BY looks)
        SELECT t.text_key, c.class_id FROM collated t JOIN classes c ON t.looks = c.looks WHERE c.n > 1
        """,
        looked=looked,
    )


def found_pairs(documents: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b``: pairs of documents that look the same in different characters.

    Texts of a class meet first, documents last, so exact copies add rows to the result only.
    """
    classes = checkpointed(look_classes(documents))
    members = checkpointed(
        documents.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("text_key")).distinct().join(classes, "text_key")
    )
    a, b = members.alias("a"), members.alias("b")
    met = a.join(b, (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.text_key") != F.col("b.text_key")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    return met.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))


def canonical_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, text, canonical``: every document with the one form of its look."""
    classes = checkpointed(look_classes(documents))
    docs = documents.groupBy("doc_id").agg(F.max("text").alias("text")).withColumn("text_key", F.md5("text"))
    # texts of the canonical members, by their key
    named = classes.select(F.col("class_id").alias("text_key")).distinct()
    canonical = docs.join(named, "text_key", "left_semi").groupBy(F.col("text_key").alias("class_id")).agg(F.max("text").alias("canonical"))
    # classes are unique by text, so neither join adds rows
    changed = classes.where("text_key <> class_id").join(canonical, "class_id").select("text_key", "canonical")
    return docs.join(changed, "text_key", "left").select("doc_id", "text", F.coalesce("canonical", "text").alias("canonical"))


def document_classes(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, texts, documents`` of every document that looks like another in other characters.

    ``class_id`` is the least ``doc_id`` of the class, ``texts`` and ``documents`` say how many it has. A class of n
    documents gives n rows here, where ``found_pairs`` gives up to n (n - 1) / 2.
    """
    classes = look_classes(documents)
    members = checkpointed(documents.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("text_key")).distinct().join(classes, "text_key"))
    sizes = members.groupBy(F.col("class_id").alias("c")).agg(F.min("doc_id").alias("least"), F.countDistinct("text_key").alias("texts"), F.countDistinct("doc_id").alias("documents"))
    return members.join(sizes, F.col("class_id") == F.col("c")).select("doc_id", F.col("least").alias("class_id"), "texts", "documents").distinct()
