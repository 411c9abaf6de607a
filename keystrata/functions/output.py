"""Results as stable JSON, texts with phrases marked, and the text of HTML pages."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities that become the character they name; any other becomes a blank.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“", "&mdash;": "—", "&ndash;": "–"}


def number(x: float) -> str:
    """A number in plain notation where it isn't extremely large or small, without a trailing .0."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    if "e" in text:
        digits, _, power = text.partition("e")
        p = int(power)
        if -7 <= p < 0:
            sign = "-" if digits[0] == "-" else ""
            return f"{sign}0.{'0' * (-p - 1)}{digits.lstrip('-').replace('.', '')}"
        return f"{digits}e{'+' if p > 0 else '-'}{abs(p)}"
    return text


def stable_json(value: object) -> str:
    """Compact JSON with the keys of every object in order; arrays keep theirs, absent (None) fields are left out."""
    if isinstance(value, dict):
        parts = (f"{json.dumps(str(k), ensure_ascii=False)}:{stable_json(v)}" for k, v in sorted(value.items(), key=lambda x: (str(x[0]).lower(), str(x[0]))) if v is not None)
        return "{" + ",".join(parts) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(stable_json, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return number(value) if isinstance(value, float) else str(value)


def _plain(value: object) -> object:
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and not isinstance(value, (int, float)) and getattr(value, "ndim", 0) else value


@F.pandas_udf(StringType())
def stable_json_udf(rows: pd.DataFrame) -> pd.Series:
    """The stable JSON of a struct column."""
    return pd.Series([stable_json(_plain(r)) for r in rows.to_dict("records")])


def _phrase(keyword: object) -> str:
    if isinstance(keyword, str):
        return keyword
    return str(keyword["keyword"] if isinstance(keyword, dict) else keyword.keyword if hasattr(keyword, "keyword") else keyword[0])


def highlight(text: str | None, keywords: Iterable, max_ngram: int = 3, before: str = "<mark>", after: str = "</mark>") -> str | None:
    """A text with phrases marked: whole words in any case, longer phrases first, no marks within marks.

    A keyword is a string, a pair of one and its score, or a record with a field keyword. Of phrases of as many words and
    letters the one given first goes first.
    """
    if text is None or keywords is None:
        return text
    phrases = dict.fromkeys(p for k in keywords if k is not None and (p := _phrase(k).strip()) and len(p.split()) <= max_ngram)
    found: list[tuple[int, int]] = []
    for p in sorted(phrases, key=lambda p: (-len(p.split()), -len(p))):
        for m in regex.finditer(rf"(?<![\p{{L}}\p{{Nd}}]){regex.escape(p)}(?![\p{{L}}\p{{Nd}}])", text, regex.IGNORECASE):
            if not any(b < m.end() and m.start() < e for b, e in found):
                found.append(m.span())
    out, at = [], 0
    for b, e in sorted(found):
        out += [text[at:b], before, text[b:e], after]
        at = e
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def highlight_udf(text: pd.Series, keywords: pd.Series) -> pd.Series:
    return pd.Series([highlight(t, k) for t, k in zip(text, keywords)])


def html_to_text(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags, entities resolved, white space run together."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, to in sorted(ENTITIES.items(), key=lambda x: x[0] == "&amp;"):
        out = F.replace(out, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"&[A-Za-z0-9#]+;", " "), r"\s+", " "))
