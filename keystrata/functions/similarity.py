"""Similarities of two strings, from 0 to 1: for Catalyst where it has what they need, and for Python workers."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions.text import SPACE

#: A word of a phrase, kinds of space being what parts words elsewhere.
WORD = f"[^{SPACE}]+"
_WORD = re.compile(WORD)


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def levs(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - levenshtein(a, b) / longest if longest else 1.0


ratio = levs


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [y for y, u in zip(b, used) if u]
    swapped = sum(x != y for x, y in zip(hits, other)) / 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@lru_cache(100_000)
def _parts(s: str) -> tuple[int, frozenset, tuple, frozenset, frozenset, int]:
    low = s.lower()
    words = tuple(_WORD.findall(low))
    return len(s), frozenset(low), words, frozenset(words), frozenset(low[i : i + 3] for i in range(len(low) - 2)), s.count(" ")


def seqm(a: str, b: str) -> float:
    """A quick likeness of phrases: by length, first and last letters, then shared letters, words and trigrams."""
    if a == b:
        return 1.0
    la, ca, wa, sa, ta, ka = _parts(a)
    lb, cb, wb, sb, tb, kb = _parts(b)
    longest, shortest = max(la, lb), min(la, lb)
    if abs(la - lb) > 0.6 * longest or abs(ka - kb) > 1:
        return 0.0
    if longest > 3 and shortest and (a[0] != b[0] or a[-1] != b[-1] or shortest >= 3 and a[:2].lower() != b[:2].lower()):
        return 0.0
    ratio = shortest / longest
    if ratio < 0.3:
        return 0.0
    shared = len(ca & cb) / len(ca | cb)
    if shared < 0.2:
        return 0.0
    if longest <= 4:
        return shared * ratio
    if len(wa) > 1 or len(wb) > 1:
        words = len(sa & sb) / len(sa | sb)
        if words > 0.4:
            return words
    both = len(ta | tb)
    return min(0.3 * ratio + 0.2 * shared + 0.5 * (len(ta & tb) / both if both else 0.0), 1.0)


FUNCTIONS = {"seqm": seqm, "levs": levs, "jaro": jaro}


def levs_column(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def trigrams(s: Column) -> Column:
    """The distinct runs of three characters."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) >= 3, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def _share(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def seqm_column(a: Column, b: Column) -> Column:
    """seqm as a Catalyst expression; null if either is null."""
    la, lb = F.length(a), F.length(b)
    longest, shortest = F.greatest(la, lb), F.least(la, lb)
    spaces = F.abs(F.regexp_count(a, F.lit(" ")) - F.regexp_count(b, F.lit(" ")))
    ends = (F.substring(a, 1, 1) != F.substring(b, 1, 1)) | (F.substring(a, -1, 1) != F.substring(b, -1, 1))
    heads = (shortest >= 3) & (F.lower(F.substring(a, 1, 2)) != F.lower(F.substring(b, 1, 2)))
    ratio = shortest / F.greatest(longest, F.lit(1))
    ca, cb = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("(?s)."), F.lit(0))) for x in (a, b))
    wa, wb = (F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)) for x in (a, b))
    many = (F.size(wa) > 1) | (F.size(wb) > 1)
    wa, wb = F.array_distinct(wa), F.array_distinct(wb)
    chars, words, grams = _share(ca, cb), _share(wa, wb), _share(trigrams(F.lower(a)), trigrams(F.lower(b)))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.abs(la - lb) > 0.6 * longest) | (spaces > 1), F.lit(0.0))
        .when((longest > 3) & (shortest > 0) & (ends | heads), F.lit(0.0))
        .when(ratio < 0.3, F.lit(0.0))
        .when(chars < 0.2, F.lit(0.0))
        .when(longest <= 4, chars * ratio)
        .when(many & (words > 0.4), words)
        .otherwise(F.least(0.3 * ratio + 0.2 * chars + 0.5 * grams, F.lit(1.0)))
    )
