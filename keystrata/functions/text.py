"""Sentences and words of a text: the parts of tokenization that need a scan, and its Catalyst parts."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, punctuation that ends a block, marks that close a sentence, and abbreviations.
SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLOSERS = "\"')]}»”’"
ABBREVIATIONS = frozenset("dr mr mrs ms prof sr sra jr st vs etc e.g i.e u.s u.k no nos".split())
TOKEN = r"\p{L}[\p{L}\p{M}\p{Nd}]*(?:(?:[.'’-]+|…+)[\p{L}\p{M}\p{Nd}]+)*|\p{Nd}+(?:[.,]\p{Nd}+)*|[^" + SPACE + "]"
SUFFIXES = ("s", "re", "ve", "ll", "d", "m")

_TOKEN = regex.compile(TOKEN)
_EVENT = regex.compile(r"\n\n|[.!?]")
_CAPITAL_LINE = regex.compile(f"[{SPACE}]*[A-Z]")
_LETTERS_BEFORE = regex.compile(r"[\p{L}\p{M}\p{Nd}]+$")
_INITIALS = regex.compile(r"(?<!\w)(?:\p{L}\.){2,}$")
_WORD_END = regex.compile(r"[\p{L}\p{M}\p{Nd}]$")
_NOT_SPACE = regex.compile(f"[^{SPACE}]")


def pre_filter(text: str) -> str:
    """Lines joined into paragraphs: one that begins with an ASCII capital stands apart, any other goes on the last."""
    return "".join(("\n\n" if _CAPITAL_LINE.match(x) else " ") + x.replace("\t", " ") for x in text.split("\n"))


def pre_filter_column(text: Column) -> Column:
    """pre_filter as a Catalyst expression."""

    def line(x: Column) -> Column:
        return F.concat(F.when(x.rlike(f"^[{SPACE}]*[A-Z]"), F.lit("\n\n")).otherwise(F.lit(" ")), F.replace(x, F.lit("\t"), F.lit(" ")))

    return F.array_join(F.transform(F.split(text, "\n"), line), "")


def split_sentences(text: str) -> list[str]:
    """Sentences of a text that went through pre_filter, trimmed, without empty ones."""
    out, begin, at, n = [], 0, 0, len(text)
    while m := _EVENT.search(text, at):
        i, c = m.start(), m[0]
        if c == "\n\n":
            out.append(text[begin:i])
            begin = at = i + 2
            continue
        end = i + 1
        while end < n and text[end] == c:
            end += 1
        while end < n and text[end] in CLOSERS:
            end += 1
        if end < n and text[end] == "." and c != ".":
            end += 1
        following = _NOT_SPACE.search(text, end)
        nxt = following.start() if following else n
        if nxt >= n or nxt > i + 1 and (c != "." or _period_ends(text, i, begin)):
            out.append(text[begin:end])
            begin = end
        at = end
    out.append(text[begin:])
    return [s for x in out if (s := x.strip(SPACE))]


def _period_ends(text: str, i: int, begin: int) -> bool:
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if before.isdecimal() and after.isdecimal():
        return False
    if _INITIALS.search(text, max(0, i - 40), i + 1) or before.isalpha() and after.isalpha() and text[i + 2 : i + 3] == ".":
        return False
    word = _LETTERS_BEFORE.search(text, max(0, i - 64), i)
    if word and word[0].lower() in ABBREVIATIONS:
        return False
    return not (after == "»" and text[begin:i].lstrip(SPACE).startswith("«"))


def tokenize(sentence: str) -> list[str]:
    """The words and marks of a sentence: dots run together, abbreviations keep theirs, contractions are split."""
    raw = _TOKEN.findall(sentence)
    if not ("'" in sentence or "’" in sentence or "…" in sentence or "؟" in sentence):
        dots = raw.count(".")
        if not dots or dots == 1 and raw[-1] == "." and not (len(raw) > 1 and _keeps_dot(raw, len(raw) - 2)):
            return raw
    out: list[str] = []
    i, n = 0, len(raw)
    while i < n:
        t = raw[i]
        if t == ".":
            j = i
            while j < n and raw[j] == ".":
                j += 1
            if j - i >= 3:
                out.append("." * (j - i))
                i = j
                continue
        nxt = raw[i + 1] if i + 1 < n else ""
        if t == "…" and nxt and nxt in CLOSERS:
            out.append(t + nxt)
            i += 2
        elif nxt == "." and t != "." and _keeps_dot(raw, i):
            out += _contractions(t + ".")
            i += 2
        elif nxt == "؟" and _WORD_END.search(t):
            out.append(t + nxt)
            i += 2
        else:
            out += _contractions(t)
            i += 1
    return out


def _keeps_dot(raw: list[str], i: int) -> bool:
    t = raw[i]
    return "." in t or t.lower() in ABBREVIATIONS or i + 3 < len(raw) and raw[i + 2] in CLOSERS


def _contractions(t: str) -> list[str]:
    k = max(t.rfind("'"), t.rfind("’"))
    if k > 0:
        tail = t[k + 1 :].lower()
        if tail in SUFFIXES:
            return [t[:k], t[k:]]
        if tail == "t" and k > 1 and t[k - 1].lower() == "n":
            return [t[: k - 1], t[k - 1 :]]
    return [t]


def sentence_tokens(text: str | None) -> list[list[str]]:
    """The tokens of each sentence that has any; what an apostrophe begins and isn't one alone is dropped."""
    if not text:
        return []
    tokens = ([t for t in tokenize(s) if not (t[0] in "'’" and len(t) > 1)] for s in split_sentences(pre_filter(text)))
    return [t for t in tokens if t]


def tag(word: Column, pos_sent: Column) -> Column:
    """d number, u unusable, a acronym, n name, p plain: the first that fits."""
    digits, letters = F.regexp_count(word, F.lit(r"\p{Nd}")), F.regexp_count(word, F.lit(r"\p{L}"))
    marks = F.regexp_count(word, F.lit("[" + "".join("\\" + c for c in PUNCTUATION) + "]"))
    capitals = F.regexp_count(word, F.lit(r"\p{Lu}"))
    bare = F.regexp_replace(word, ",", "")
    return (
        F.when(bare.rlike(r"^[0-9]+$") | F.regexp_replace(bare, r"^([^.]*)\.", "$1").rlike(r"^[0-9]+$"), "d")
        .when(((digits > 0) & (letters > 0)) | ((digits == 0) & (letters == 0)) | (marks > 1), "u")
        .when((letters > 0) & (capitals == letters), "a")
        .when((F.length(word) > 1) & word.rlike(r"^\p{Lu}") & (pos_sent > 0) & (capitals == 1), "n")
        .otherwise("p")
    )


def fold(norm: Column) -> Column:
    """A normalized word without its final s, if it has more than three letters."""
    return F.when((F.length(norm) > 3) & norm.endswith("s"), F.regexp_replace(norm, "s$", "")).otherwise(norm)


def stripped_length(term: Column) -> Column:
    """The length of a term without ASCII punctuation."""
    return F.length(F.translate(term, PUNCTUATION, ""))
