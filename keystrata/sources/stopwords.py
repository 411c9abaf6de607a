"""Stopword lists as tables (lang, word): reading them, and adding, removing and replacing words."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.text import SPACE


def language_key(label: Column) -> Column:
    """The first two letters of a label in lower case, by which lists are found."""
    return F.lower(F.substring(label, 1, 2))


def load(lines: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """The distinct words of lists of lines: trimmed, byte order marks among the blanks, in lower case, no empty ones."""
    clean = F.lower(F.regexp_replace(F.col(word), f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return lines.select(language_key(F.col(lang)).alias("lang"), clean.alias("word")).where("lang IS NOT NULL AND word <> ''").distinct()


def languages(words: DataFrame) -> DataFrame:
    return words.select("lang").distinct()


#: Words of all lists together that are sent to the workers at most; lists are a few hundred words for each language.
MAX_LISTED = 1_000_000


def by_language(stopwords: DataFrame | Mapping[str, Iterable[str] | str]) -> dict[str, frozenset[str]]:
    """Lists by two-letter language, as `load` has them; given as a table of lines or by language. More than MAX_LISTED words are an error."""
    if isinstance(stopwords, DataFrame):
        rows = [(r["lang"], r["word"]) for r in load(stopwords).limit(MAX_LISTED + 1).collect()]
    else:
        lines = ((k, w) for k, v in stopwords.items() for w in (v.split("\n") if isinstance(v, str) else v))
        rows = [(k[:2].lower(), x) for k, w in lines if (x := w.strip(SPACE).lower())]
    if len(rows) > MAX_LISTED:
        raise ValueError(f"more than {MAX_LISTED} stopwords: use KeywordExtractor.extraction, which joins them as a table")
    out: dict[str, set[str]] = {}
    for k, w in rows:
        out.setdefault(k, set()).add(w)
    return {k: frozenset(v) for k, v in out.items()}


def table_of(spark: SparkSession, stopwords: DataFrame | Mapping[str, Iterable[str] | str]) -> DataFrame:
    return load(stopwords) if isinstance(stopwords, DataFrame) else from_dict(spark, dict(stopwords))


def from_dict(spark: SparkSession, lists: dict[str, Iterable[str] | str]) -> DataFrame:
    """Lists by language, each a text of lines or any iterable of words."""
    rows = [(k, w) for k, v in lists.items() for w in (v.split("\n") if isinstance(v, str) else v)]
    return load(spark.createDataFrame(rows, "lang string, word string"))


def edit(words: DataFrame, lang: str, add: Iterable[str] = (), remove: Iterable[str] = (), replace: Iterable[str] | None = None) -> DataFrame:
    """The lists with that of one language changed: replaced, then with words added and others removed."""
    spark, key = words.sparkSession, lang[:2].lower()

    def rows(given: Iterable[str]) -> DataFrame:
        return load(spark.createDataFrame([(key, w) for w in given], "lang string, word string"))

    kept = words if replace is None else words.where(F.col("lang") != key).unionByName(rows(replace))
    return kept.unionByName(rows(add)).distinct().join(F.broadcast(rows(remove)), ["lang", "word"], "left_anti")
