"""Keywords of one text, in the worker that reads it.

Documents don't depend on one another, so their keywords need no shuffle: a UDF over Arrow batches takes a column of texts
and gives a column of keywords, and every other column stays where it is. The stages are those of operators.keywords,
which has them as DataFrames for queries of the graph, the terms and the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cmp_to_key, lru_cache
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions import similarity, text as words
from keystrata.options import Options

KEYWORD = "struct<keyword: string, normalized_keyword: string, score: double, ngram_size: int, occurrences: long, sentence_ids: array<int>>"
#: Scores that differ by no more than this are equal.
TIE = 1e-15
_MARKS = frozenset(words.PUNCTUATION)
_DIGIT, _LETTER, _CAPITAL = regex.compile(r"\p{Nd}"), regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")
_NUMBER = regex.compile(r"[0-9]+")
_STRIP = str.maketrans("", "", words.PUNCTUATION)


@dataclass(frozen=True)
class Hooks:
    """What a caller may put in place of a part; all are plain functions, called in the workers.

    split gives the sentences of a text, tokenize the tokens of a sentence. lemmatize and normalize map a lower-case word,
    given a context (original, language); what they give is lower-cased again. score_term maps a Term and the document's
    statistics to its score, score_candidate a Candidate and the features. score_keywords maps the ranked list of keywords
    to another, before near duplicates are left out; keep tells whether a keyword may be one; similar compares two.
    """

    split: Callable[[str], list[str]] | None = None
    tokenize: Callable[[str], list[str]] | None = None
    lemmatize: Callable[[str, dict], str] | None = None
    normalize: Callable[[str, dict], str] | None = None
    score_term: Callable[[Term, dict], float] | None = None
    score_candidate: Callable[[Candidate, dict], float] | None = None
    score_keywords: Callable[[list[dict]], list[dict]] | None = None
    keep: Callable[[dict], bool] | None = None
    similar: Callable[[str, str], float] | None = None


class Term:
    """A word of a document with its counts, its neighbours and its features; places has (pos_sent, pos_text) by sentence."""

    __slots__ = ("term", "stopword", "tf", "tf_a", "tf_n", "places", "right", "left", "h", "wrel", "wfreq", "wspread", "wcase", "wpos", "pl", "pr")

    def __init__(self, term: str, stopword: bool) -> None:
        self.term, self.stopword = term, stopword
        self.tf = self.tf_a = self.tf_n = 0
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[str, int] = {}
        self.left: dict[str, int] = {}
        self.h = self.wfreq = self.wcase = self.wspread = self.pl = self.pr = 0.0
        self.wrel = self.wpos = 1.0


class Candidate:
    """A phrase with the tag sequences of its occurrences; parts are its terms, ord its place among first occurrences."""

    __slots__ = ("normalized", "keyword", "parts", "size", "tags", "tf", "ord", "h")

    def __init__(self, normalized: str, keyword: str, parts: Sequence[Term], size: int, ord: int) -> None:
        self.normalized, self.keyword, self.parts, self.size, self.ord = normalized, keyword, parts, size, ord
        self.tags: set[str] = set()
        self.tf, self.h = 0, 1.0

    @property
    def valid(self) -> bool:
        """Whether some occurrence has usable words only, and no stopword stands at either end."""
        return not (self.parts[0].stopword or self.parts[-1].stopword) and any("u" not in t and "d" not in t for t in self.tags)

    @property
    def virtual_tf(self) -> float:
        """The mean frequency of its terms."""
        return sum(t.tf for t in self.parts) / len(self.parts)

    def sentences(self) -> list[int]:
        return sorted({s for t in self.parts for s in t.places})


@lru_cache(200_000)
def tag_of(word: str, first: bool, marks: frozenset[str] = _MARKS) -> str:
    """d number, u unusable, a acronym, n name, p plain: the first that fits. marks are what counts as punctuation."""
    bare = word.replace(",", "")
    if _NUMBER.fullmatch(bare) or _NUMBER.fullmatch(bare.replace(".", "", 1)):
        return "d"
    digits, letters, capitals = (len(x.findall(word)) for x in (_DIGIT, _LETTER, _CAPITAL))
    if bool(digits) == bool(letters) or sum(c in marks for c in word) > 1:
        return "u"
    if letters and capitals == letters:
        return "a"
    return "n" if not first and capitals == 1 and len(word) > 1 and _CAPITAL.match(word) else "p"


def fold(norm: str) -> str:
    return norm[:-1] if len(norm) > 3 and norm.endswith("s") else norm


class Document:
    """The terms, edges and candidates of one text."""

    def __init__(self, text: str, listed: frozenset[str], options: Options = Options(), hooks: Hooks = Hooks(), language: str = "en") -> None:
        self.options, self.hooks, self.listed, self.language = options, hooks, listed, language
        self.terms: dict[str, Term] = {}
        self.candidates: dict[str, Candidate] = {}
        self.freq_ns = dict.fromkeys(range(1, options.n + 1), 0)
        self.words = 0
        self._norms: dict[str, str] = {}
        sentences = [s for s in map(self._tokens, self._sentences(words.pre_filter(text))) if s]
        self.sentences = len(sentences)
        for number, tokens in enumerate(sentences):
            self._read(number, tokens)

    def _sentences(self, text: str) -> Iterable[str]:
        return (self.hooks.split or words.split_sentences)(text)

    def _tokens(self, sentence: str) -> list[str]:
        return [t for t in (self.hooks.tokenize or words.tokenize)(sentence) if t and not (t[0] in "'’" and len(t) > 1)]

    def normal(self, word: str) -> str:
        """The lower-case form of a word, as the hooks have it."""
        out = self._norms.get(word)
        if out is None:
            out, context = word.lower(), {"original": word, "language": self.language}
            for hook in (self.hooks.lemmatize, self.hooks.normalize):
                out = hook(out, context).lower() if hook else out
            self._norms[word] = out
        return out

    def term(self, norm: str, make: bool = True) -> Term | None:
        """The term of a normalized word; a stopword by the form that came first."""
        key = fold(norm)
        found = self.terms.get(key)
        if found is None and make:
            found = self.terms[key] = Term(key, norm in self.listed or key in self.listed or len(key.translate(_STRIP)) < 3)
        return found

    def _read(self, number: int, tokens: list[str]) -> None:
        window, n = self.options.window, self.options.n
        block: list[tuple[str, str, str, Term]] = []
        for at, word in enumerate(tokens):
            if _MARKS.issuperset(word):
                block = []
                continue
            norm, tag = self.normal(word), tag_of(word, at == 0)
            t = self.term(norm)
            t.tf += 1
            t.tf_a += tag == "a"
            t.tf_n += tag == "n"
            t.places.setdefault(number, []).append((at, self.words))
            self.words += 1
            if tag not in "ud":
                for other, _, _, x in block[-window:]:
                    if other not in "ud":
                        x.right[t.term] = x.right.get(t.term, 0) + 1
                        t.left[x.term] = t.left.get(x.term, 0) + 1
            block.append((tag, word, norm, t))
            for size in range(1, min(n, len(block)) + 1):
                if size > 1:
                    self.freq_ns[size] += 1
                if not (t.stopword or block[-size][3].stopword):
                    self._count(block[-size:])

    def _count(self, parts: list[tuple[str, str, str, Term]]) -> None:
        key = " ".join([p[2] for p in parts])
        c = self.candidates.get(key)
        if c is None:
            c = self.candidates[key] = Candidate(key, " ".join([p[1] for p in parts]), [p[3] for p in parts], len(parts), len(self.candidates))
        c.tags.add("".join([p[0] for p in parts]))
        c.tf += 1

    def statistics(self) -> dict[str, Any] | None:
        """What term scores take from the whole document; None where all words are stopwords."""
        tfs = [t.tf for t in self.terms.values() if not t.stopword]
        if not tfs:
            return None
        mean = sum(tfs) / len(tfs)
        std = math.sqrt(sum((x - mean) ** 2 for x in tfs) / len(tfs))
        return {"max_tf": max(t.tf for t in self.terms.values()), "avg_tf": mean, "std_tf": std, "sentences": self.sentences, "features": self.options.features}

    def score(self) -> None:
        """Scores of all terms, then of all valid candidates; the lower, the better."""
        stats = self.statistics()
        if stats:
            for t in self.terms.values():
                t.h = self.hooks.score_term(t, stats) if self.hooks.score_term else term_score(t, stats, self.options)
        for c in self.candidates.values():
            if c.valid:
                c.h = self.hooks.score_candidate(c, {"features": self.options.features}) if self.hooks.score_candidate else self.candidate_score(c)

    def candidate_score(self, c: Candidate, virtual: bool = False) -> float:
        """The score of a phrase; a stopword within it counts by how firmly its neighbours go with it. virtual takes the
        mean frequency of its terms for its own."""
        product, total = 1.0, 0.0
        for i, t in enumerate(c.parts):
            if not t.stopword:
                product *= t.h
                total += t.h
                continue
            before = c.parts[i - 1] if i else None
            after = c.parts[i + 1] if i + 1 < len(c.parts) else None
            firm = (before.right.get(t.term, 0) / before.tf if before else 0.0) * (t.right.get(after.term, 0) / after.tf if after else 0.0)
            product *= 2 - firm
            total -= 1 - firm
        times = c.virtual_tf if virtual else c.tf if self.options.has("KPF") else 1
        under = (total + 1) * times
        if under:
            return product / under
        return math.nan if product == 0 else math.copysign(math.inf, product)

    def candidate_of(self, phrase: str) -> Candidate:
        """A phrase as a candidate of this document; an error if none of its words occurs here."""
        found = self.find_candidate(phrase)
        if found is None:
            raise ValueError(f"no word of {phrase!r} occurs in the document")
        return found

    def find_candidate(self, phrase: str) -> Candidate | None:
        """A phrase as a candidate of this document, of those of its words that occur here; None if none does."""
        tokens = self._tokens(phrase)
        norms = [self.normal(w) for w in tokens]
        parts = [t for x in norms if (t := self.term(x, make=False))]
        if not parts:
            return None
        out = Candidate(" ".join(norms), " ".join(tokens), parts, len(tokens), -1)
        out.tags.add("".join(tag_of(w, i == 0) for i, w in enumerate(tokens)))
        return out

    def ranked(self) -> list[Candidate]:
        """The valid candidates, best first; equal scores in the order of the text, sliding phrases the later first."""
        return in_order([c for c in self.candidates.values() if c.valid], lambda c: (c.h, c.ord, c.normalized))

    def keywords(self) -> list[dict]:
        """The best phrases without near duplicates, as records."""
        rows: Iterable[dict] = map(_record, self.ranked())
        if self.hooks.keep:
            rows = filter(self.hooks.keep, rows)
        if self.hooks.score_keywords:
            rows = self.hooks.score_keywords(list(rows))
        return deduplicated(rows, self.options, self.hooks.similar)


def term_score(t: Term, stats: dict, options: Options = Options()) -> float:
    """The score of a term, whose features are set on the way."""
    share = t.tf / stats["max_tf"]
    if options.has("wrel"):
        t.pl, t.pr = len(t.left) / stats["max_tf"], len(t.right) / stats["max_tf"]
        left, right = (len(x) / sum(x.values()) if x else 0.0 for x in (t.left, t.right))
        t.wrel = (0.5 + left * share) + (0.5 + right * share)
    if options.has("wfreq"):
        t.wfreq = t.tf / (stats["avg_tf"] + stats["std_tf"])
    if options.has("wspread"):
        t.wspread = len(t.places) / stats["sentences"]
    if options.has("wcase"):
        t.wcase = max(t.tf_a, t.tf_n) / (1 + math.log(t.tf))
    if options.has("wpos"):
        ids = sorted(t.places)
        t.wpos = math.log(math.log(3 + (ids[(len(ids) - 1) // 2] + ids[len(ids) // 2]) / 2))
    under = t.wcase + t.wfreq / t.wrel + t.wspread / t.wrel
    return t.wpos * t.wrel / under if under else math.inf


def _record(c: Candidate) -> dict:
    return {"keyword": c.keyword, "normalized_keyword": c.normalized, "score": c.h, "ngram_size": c.size, "occurrences": c.tf, "sentence_ids": c.sentences()}


def _sliding(a: str, b: str) -> bool:
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) >= 3 and (x[1:] == y[:-1] or y[1:] == x[:-1])


def in_order(rows: list, key: Callable[[Any], tuple[float, Any, str]]) -> list:
    """Rows by (score, place, phrase): by score; scores within TIE of one another by place, and of two phrases of three
    words or more that slide over one another the later first. A score that is no number comes last.

    As sliding isn't transitive, rows with such a tie are sorted by comparison, from the order of the text.
    """
    keyed = sorted(((*key(r), r) for r in rows), key=lambda x: (x[0] != x[0], x[0], x[1]))
    out, i, sliding = [], 0, False
    while i < len(keyed):
        j = i + 1
        while j < len(keyed) and (keyed[j][0] == keyed[j - 1][0] or abs(keyed[j][0] - keyed[j - 1][0]) <= TIE):
            j += 1
        run = sorted(keyed[i:j], key=lambda x: x[1]) if j > i + 1 else keyed[i:j]
        heads: dict[str, int] = {}
        for _, _, phrase, _ in run if len(run) > 1 else ():
            if phrase.count(" ") >= 2:
                heads[phrase.rsplit(" ", 1)[0]] = heads.get(phrase.rsplit(" ", 1)[0], 0) + 1
        sliding |= any(x[2].count(" ") >= 2 and x[2].split(" ", 1)[1] in heads for x in run if heads)
        out += run
        i = j
    if sliding:

        def compare(a: tuple, b: tuple) -> int:
            if a[0] != b[0] and not abs(a[0] - b[0]) <= TIE:
                return (a[0] > b[0]) - (a[0] < b[0]) or (a[0] != a[0]) - (b[0] != b[0])
            return ((a[1] > b[1]) - (a[1] < b[1])) * (-1 if _sliding(a[2], b[2]) else 1)

        out = sorted(sorted(keyed, key=lambda x: x[1]), key=cmp_to_key(compare))
    return [x[3] for x in out]


def deduplicated(rows: Iterable[dict], options: Options, similar: Callable[[str, str], float] | None = None) -> list[dict]:
    """The first `top` rows that are no more like an earlier one taken than dedup_lim; each row has a normalized_keyword."""
    compare, accepted = similar or similarity.FUNCTIONS[options.dedup_func], []
    for r in rows:
        if options.dedup_lim >= 1 or not any(compare(r["normalized_keyword"], x["normalized_keyword"]) > options.dedup_lim for x in accepted):
            accepted.append(r)
            if len(accepted) == options.top:
                break
    return accepted


def without_parts(rows: Iterable[dict], n: int) -> list[dict]:
    """Lower-case keywords without the single words that a better phrase holds, the first n."""
    held: set[str] = set()
    out = []
    for r in rows:
        phrase = r["keyword"].lower()
        parts = phrase.split(" ")
        if len(parts) == 1 and phrase in held:
            continue
        if len(parts) > 1:
            held.update(parts)
        out.append(r | {"keyword": phrase})
        if len(out) == n:
            break
    return out


def text_keywords(text: str | None, listed: frozenset[str], options: Options = Options(), hooks: Hooks = Hooks(), language: str = "en") -> list[dict]:
    """The keywords of one text; none for null or empty."""
    if not text:
        return []
    document = Document(text, listed, options, hooks, language)
    document.score()
    return document.keywords()


def once(udf):
    """A UDF that is run once for each row: the filter on empty arrays that a generator adds would run it again below a shuffle."""
    return udf.asNondeterministic()


def keywords_column(text: Column, language: Column, lists, options: Options = Options(), hooks: Hooks = Hooks(), document: Column | None = None, before: Callable | None = None, after: Callable | None = None) -> Column:
    """An array of KEYWORD for each text. lists is a broadcast of stopwords by two-letter language.

    before(text, context) and after(keywords, context) are called with the row's document, a struct column, and language.
    """

    def run(texts: pa.Array, languages: pa.Array, documents: Iterable[dict | None]) -> pa.Array:
        sizes, rows = [0], []
        for t, x, d in zip(texts.to_pylist(), languages.to_pylist(), documents):
            context = {"document": d, "language": x}
            t = before(t, context) if before else t
            found = text_keywords(t, lists.value.get((x or "")[:2].lower(), frozenset()), options, hooks, x)
            rows += after(found, context | {"text": t}) if after else found
            sizes.append(len(rows))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in FIELDS.items()]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(k, kind) for k, kind in FIELDS.items()]))

    if document is None:

        @F.arrow_udf(f"array<{KEYWORD}>")
        def plain(texts: pa.Array, languages: pa.Array) -> pa.Array:
            return run(texts, languages, iter(lambda: None, 0))

        return once(plain)(text, language)

    @F.arrow_udf(f"array<{KEYWORD}>")
    def with_document(texts: pa.Array, languages: pa.Array, documents: pa.Array) -> pa.Array:
        return run(texts, languages, iter(documents.to_pylist()))

    return once(with_document)(text, language, document)


FIELDS = {
    "keyword": pa.string(), "normalized_keyword": pa.string(), "score": pa.float64(), "ngram_size": pa.int32(), "occurrences": pa.int64(), "sentence_ids": pa.list_(pa.int32()),
}


def ranked_keywords(rows: Column, options: Options) -> Column:
    """Of an array of structs (score, ord, normalized_keyword), the normalized keywords in order, without near duplicates."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        out = []
        for found in lists.to_pylist():
            ordered = in_order(found or [], lambda r: (r["score"], r["ord"], r["normalized_keyword"]))
            out.append([r["normalized_keyword"] for r in deduplicated(ordered, options)])
        return pa.array(out, pa.list_(pa.string()))

    return once(run)(rows)


