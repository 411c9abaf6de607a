"""The front of the library: keywords of a text, of a table of documents, and of a stream of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions import similarity
from keystrata.functions.output import stable_json
from keystrata.operators import document
from keystrata.operators.document import Hooks
from keystrata.operators.keywords import Extraction, document_text, documents
from keystrata.options import Options
from keystrata.session import spread
from keystrata.sources import stopwords as lists_of

Lists = DataFrame | Mapping[str, Iterable[str] | str]


def _called(hook: Any, *names: str) -> Callable | None:
    """A hook given as a function, or as an object with a method of one of these names."""
    if hook is None or callable(hook):
        return hook
    for name in names:
        if callable(getattr(hook, name, None)):
            return getattr(hook, name)
    raise TypeError(f"a hook must be a function or have a method {' or '.join(names)}, not {hook!r}")


class KeywordExtractor:
    """Options, stopwords and hooks, kept for use on any number of texts and tables.

    stopwords is a table (lang, word) of lines of lists, or a mapping from language to words or to a text of lines.
    Hooks are functions, or objects with the method named: sentence_splitter (split), tokenizer (tokenize), and
    text_processor (split and tokenize), before which the two go; lemmatizer (lemmatize) and normalizer (normalize), of a
    word and a context; similar (compare); term_scorer, candidate_scorer and keyword_scorer (score); keep, which tells of a
    keyword whether it may be one; before_text, of a text and its context, and after, of a list of keywords and its context.
    A context has the row's document, its language and, for after, the text.
    """

    def __init__(
        self, stopwords: Lists, sentence_splitter=None, tokenizer=None, text_processor=None, lemmatizer=None, normalizer=None, similar=None,
        term_scorer=None, candidate_scorer=None, keyword_scorer=None, keep: Callable[[dict], bool] | None = None,
        before_text: Callable[[str, dict], str] | None = None, after: Callable[[list[dict], dict], list[dict]] | None = None, **options,
    ) -> None:
        if isinstance(lemmatizer, str):
            raise TypeError("lemmatizer must be a function or an object with a method lemmatize, not a name")
        self.options, self.stopwords = Options.parse(**options), stopwords
        whole = text_processor
        split = _called(sentence_splitter, "split") or (_called(getattr(whole, "split", None), "split") if whole else None)
        cut = _called(tokenizer, "tokenize") or (_called(getattr(whole, "tokenize", None), "tokenize") if whole else None)
        self.hooks = Hooks(
            split, cut, _called(lemmatizer, "lemmatize"), _called(normalizer, "normalize"), _called(term_scorer, "score"),
            _called(candidate_scorer, "score"), _called(keyword_scorer, "score"), keep, _called(similar, "compare"),
        )
        self.before_text, self.after = before_text, after
        self._lists: dict[str, frozenset[str]] | None = None
        self._sent = None

    levs, seqm, jaro = staticmethod(similarity.levs), staticmethod(similarity.seqm), staticmethod(similarity.jaro)

    def lists(self) -> dict[str, frozenset[str]]:
        """The stopwords by language, of a checked size."""
        if self._lists is None:
            self._lists = lists_of.by_language(self.stopwords)
        return self._lists

    def text_details(self, text: str | None, language: str | None = None) -> list[dict]:
        """The keywords of one text, best first, as records. The language of the options goes before the one given."""
        x = self.options.language or language or "en"
        context = {"document": {"id": None, "body": text}, "language": x}
        text = self.before_text(text, context) if self.before_text and text else text
        found = document.text_keywords(text, self.lists().get(x[:2].lower(), frozenset()), self.options, self.hooks, x)
        return self.after(found, context | {"text": text}) if self.after else found

    def text_keywords(self, text: str | None, language: str | None = None) -> list[tuple[str, float]]:
        return [(k["keyword"], k["score"]) for k in self.text_details(text, language)]

    def with_keywords(self, df: DataFrame, id: str = "id", body: str = "body", language: str | None = "language", title: str | None = None, metadata: str | None = None, out: str = "keywords") -> DataFrame:
        """df with its documents' keywords in one column more: an array of records, best first, empty for a null or empty body.

        Works on streams too. Repeated rows stay repeated. Nothing is shuffled, but for a table read in fewer partitions than
        there are cores, which is spread first. title names a column
        whose text goes before the body. A column named as `out` is replaced.
        """
        spark = df.sparkSession
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self.lists())  # at most stopwords.MAX_LISTED words
        text, lang = self._text(body, title), self._language(language)
        row = None
        if self.before_text or self.after:
            fields = {"id": id, "body": body, "language": language, "title": title, "metadata": metadata}
            row = F.struct(*(F.col(c).alias(k) for k, c in fields.items() if c))
        return spread(df).withColumn(out, document.keywords_column(text, lang, self._sent, self.options, self.hooks, row, self.before_text, self.after))

    def _text(self, body: str, title: str | None) -> Column:
        return document_text(body, title)

    def _language(self, language: str | None) -> Column:
        return F.coalesce(F.lit(self.options.language), F.col(language) if language else F.lit(None).cast("string"), F.lit("en"))

    def details(self, df: DataFrame, id: str = "id", **columns) -> DataFrame:
        """(doc, rank, keyword, normalized_keyword, score, ngram_size, occurrences, sentence_ids): a row for each keyword."""
        found = self.with_keywords(df, id, out="__keywords", **columns).select(F.col(id).alias("doc"), F.posexplode("__keywords").alias("rank", "k"))
        return found.select("doc", (F.col("rank") + 1).alias("rank"), "k.*")

    def keywords(self, df: DataFrame, **columns) -> DataFrame:
        """(doc, rank, keyword, score)."""
        return self.details(df, **columns).select("doc", "rank", "keyword", "score")

    def results(self, df: DataFrame, id: str = "id", language: str | None = "language", title: str | None = None, metadata: str | None = None, **columns) -> DataFrame:
        """One row for each row of df, in its place: id, language, title and metadata where named, and its keywords in order."""
        found = self.with_keywords(df, id, language=language, title=title, metadata=metadata, out="__keywords", **columns)
        own = [F.col(id).alias("id"), self._language(language).alias("language")]
        own += [F.col(c).alias(k) for k, c in (("title", title), ("metadata", metadata)) if c]
        return found.select(*own, F.col("__keywords").alias("keywords"))

    def extraction(self, df: DataFrame, id: str = "id", body: str = "body", language: str | None = "language", title: str | None = None) -> Extraction:
        """The stages as DataFrames, without hooks; close() gives up what it keeps."""
        return Extraction(documents(df, id, body, language, title, self.options), lists_of.table_of(df.sparkSession, self.stopwords), self.options)

    def stream(self, docs: DataFrame, **columns) -> DataFrame:
        """Keywords of a stream of documents, as a stream; documents don't depend on one another, so it keeps no state."""
        return self.details(docs, **columns)


def extract_keywords(text: str | None, stopwords: Lists, **options) -> list[tuple[str, float]]:
    """The keywords of one text with their scores, best first. Options and hooks are those of KeywordExtractor."""
    return KeywordExtractor(stopwords, **options).text_keywords(text)


def extract_details(text: str | None, stopwords: Lists, **options) -> list[dict]:
    return KeywordExtractor(stopwords, **options).text_details(text)


extract = extract_keywords


def extract_from_document(row: Mapping[str, Any], stopwords: Lists, title_in_text: bool = True, **options) -> dict:
    """The result of one document (id, body, language, title, metadata): those of its fields that it has, and its keywords."""
    extractor = KeywordExtractor(stopwords, **options)
    x = extractor.options.language or row.get("language") or "en"
    title, body = (row.get("title") or "").strip(), row.get("body") or ""
    text = f"{title}\n\n{body}" if title and title_in_text else body
    context = {"document": dict(row), "language": x}
    text = extractor.before_text(text, context) if extractor.before_text else text
    found = document.text_keywords(text, extractor.lists().get(x[:2].lower(), frozenset()), extractor.options, extractor.hooks, x)
    found = extractor.after(found, context | {"text": text}) if extractor.after else found
    return {"id": row["id"], "language": x, **{k: row[k] for k in ("title", "metadata") if row.get(k) is not None}, "keywords": found}


def serialized(results: Any) -> str:
    """The stable JSON of a result, or of a list of them in their order."""
    return stable_json(results)


def serialized_bytes(value: Any) -> int:
    """The size of a value's stable JSON in UTF-8."""
    return len(stable_json(value).encode("utf-8"))


def compact_keywords(df: DataFrame, stopwords: Lists, n: int = 5, max_ngram: int = 3, **columns) -> DataFrame:
    """(doc, rank, keyword, score): few phrases of English texts, without words that a better phrase holds."""

    def few(found: list[dict], context: dict) -> list[dict]:
        return document.without_parts(found, n)

    return KeywordExtractor(stopwords, language="en", n=max_ngram, top=max(3 * n, n), after=few).keywords(df, **columns)
