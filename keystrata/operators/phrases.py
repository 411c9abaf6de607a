"""Candidates of many texts at once, in the worker that reads them.

They are those of operators.keywords, which has them as DataFrames: but words, pairs and phrases of a document meet
nowhere else, so nothing of them is exchanged. A worker counts a chunk of texts with arrays of numbers of words.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions import text
from keystrata.operators.document import fold, tag_of
from keystrata.operators.keywords import once
from keystrata.options import Options
from keystrata.sources.stopwords import language_key

#: Words of a chunk of texts, beyond which it is counted; words a worker remembers, beyond which it begins anew.
CHUNK, REMEMBERED = 200_000, 200_000
_MARKS = frozenset(text.PUNCTUATION)
_STRIP = str.maketrans("", "", text.PUNCTUATION)
_TAGS = {"d": 0, "u": 1, "a": 2, "n": 3, "p": 4}
_UNUSABLE, _ACRONYM, _NAME, _PLAIN = 1, 2, 3, 4


def _tag(word: str) -> int:
    """tag_of after the first place of a sentence, quickly for ASCII letters and digits."""
    if word.isascii() and word.isalnum():
        if not word.isalpha():
            return _TAGS["d" if word.isdigit() else "u"]
        return _ACRONYM if word.isupper() else _NAME if word.istitle() else _PLAIN
    return _TAGS[tag_of(word, False)]


class _Numbers(dict):
    """Numbers of strings in the order they came."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class _Words(dict):
    """Numbers of words, and by number those of their forms, their tags after the first place, and whether all is marks."""

    def __init__(self) -> None:
        self.norms, self.terms = _Numbers(), _Numbers()
        self.norm, self.term, self.tag, self.mark, self.short = array("q"), array("q"), array("b"), array("b"), array("b")
        self.forms: list[tuple[str, str]] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        norm = word.lower()
        term = fold(norm)
        self.forms.append((norm, term))
        self.norm.append(self.norms[norm]), self.term.append(self.terms[term])
        self.tag.append(_tag(word)), self.mark.append(_MARKS.issuperset(word)), self.short.append(len(term.translate(_STRIP)) < 3)
        return n


class _Stops(dict):
    """Whether a word is a stopword of a language in this form, by (language << 32) + word."""

    def __init__(self, words: _Words, lists: list[frozenset[str]]) -> None:
        self.words, self.lists = words, lists

    def __missing__(self, key: int) -> bool:
        listed, n = self.lists[key >> 32], key & 0xFFFFFFFF
        norm, term = self.words.forms[n]
        out = self[key] = norm in listed or term in listed or bool(self.words.short[n])
        return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each key, in the order they came, and the place of the first of each group."""
    codes, uniques = pd.factorize(keys)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


class Chunk:
    """Texts whose words are gathered, then counted together."""

    def __init__(self, lists: dict[str, frozenset[str]], options: Options) -> None:
        self.options = options
        self.languages = {k: i for i, k in enumerate(lists, 1)}
        self.lists = [frozenset(), *lists.values()]
        self.forget()
        self.clear()

    def forget(self) -> None:
        self.words = _Words()
        self.stops = _Stops(self.words, self.lists)

    def clear(self) -> None:
        """Begin a new chunk."""
        self.flat: list[str] = []
        self.lengths, self.sentences, self.keys = array("q"), array("q"), array("q")
        if len(self.words) > REMEMBERED:
            self.forget()

    def add(self, body: str | None, key: str) -> None:
        found = text.sentence_tokens(body)
        for words in found:
            self.flat += words
            self.lengths.append(len(words))
        self.sentences.append(len(found))
        self.keys.append(self.languages.get(key, 0))

    def count(self, scored: bool = True) -> Iterator[dict]:
        """For each size the phrases of the chunk, in arrays: row (of its text), tf, clean, words and norms (a list of
        arrays each, of its first form), and h where scored."""
        word = np.fromiter(map(self.words.__getitem__, self.flat), np.int64, len(self.flat))
        sentences, lengths = np.array(self.sentences), np.array(self.lengths)
        begins = np.cumsum(lengths) - lengths
        opens = np.zeros(len(word), bool)
        opens[begins] = True
        sent = np.repeat(np.arange(len(lengths)), lengths)
        row_of = np.repeat(np.arange(len(sentences)), sentences)
        mark = np.array(self.words.mark, bool)[word]
        keep = ~mark
        block, opens, sent, word = np.cumsum(mark | opens)[keep], opens[keep], sent[keep], word[keep]
        row, tag = row_of[sent], np.array(self.words.tag)[word]
        tag[opens & (tag == _NAME)] = _PLAIN
        usable = tag > _UNUSABLE
        term, first = _groups(row * len(self.words.terms) + np.array(self.words.term)[word])
        tf = np.bincount(term)
        stop = np.fromiter(map(self.stops.__getitem__, ((np.array(self.keys)[row[first]] << 32) + word[first]).tolist()), bool, len(first))
        if scored:
            h, weight = self._scores(term, tf, stop, tag, usable, block, sent, row[first], sentences)
        norm, _ = _groups(row * len(self.words.norms) + np.array(self.words.norm)[word])
        at, prefix, whole, stopped = np.arange(len(word)), norm, usable, stop[term]
        for size in range(1, self.options.n + 1):
            if size > 1:  # phrases that go on within the block, each numbered by the one it goes on from and its last word
                at = at[at >= size - 1]
                at = at[block[at] == block[at - size + 1]]
                longer = np.full(len(word), -1)
                longer[at] = pd.factorize(prefix[at - 1] * len(word) + norm[at])[0]
                prefix, whole = longer, np.append(False, whole[:-1]) & usable
            found = at[~(stopped[at] | stopped[at - size + 1])]
            codes, first = _groups(prefix[found])
            ends = found[first]
            out = {"size": size, "row": row[ends], "tf": np.bincount(codes, minlength=len(ends)), "clean": np.bincount(codes, whole[found], len(ends)) > 0}
            if scored:
                places = [ends - k for k in range(size - 1, -1, -1)]
                out |= {"words": [word[p] for p in places], "h": self._phrase_scores(places, term, tf, stop, h, weight, out["tf"])}
            yield out

    def _scores(self, term, tf, stop, tag, usable, block, sent, row, sentences) -> tuple[np.ndarray, np.ndarray]:
        """h of each term, and of each word the weight of the edge from the word before it."""
        o, n, rows = self.options, len(tf), len(sentences)
        src, dst = [], []
        for k in range(1, o.window + 1):
            near = (block[k:] == block[:-k]) & usable[k:] & usable[:-k]
            src.append(term[:-k][near]), dst.append(term[k:][near])
        edge, counts = np.unique(np.concatenate(src) * n + np.concatenate(dst), return_counts=True)
        pair = term[:-1] * n + term[1:]
        at = np.searchsorted(edge, pair)
        weight = np.zeros(len(term))
        if len(edge):
            at[at == len(edge)] = 0
            weight[1:] = np.where((edge[at] == pair) & (block[1:] == block[:-1]), counts[at], 0)
        most, listed = np.zeros(rows), ~stop
        np.maximum.at(most, row, tf)
        usual = np.bincount(row[listed], minlength=rows)
        mean = _ratio(np.bincount(row[listed], tf[listed], rows), usual)
        std = np.sqrt(_ratio(np.bincount(row[listed], (tf[listed] - mean[row[listed]]) ** 2, rows), usual))
        one = np.ones(n)
        wrel, wfreq, wspread, wcase, wpos = one, 0 * one, 0 * one, 0 * one, one
        with np.errstate(all="ignore"):
            if o.has("wrel"):
                share = tf / most[row]
                left, right = (_ratio(np.bincount(x, minlength=n), np.bincount(x, counts, n)) for x in (edge % n, edge // n))
                wrel = (0.5 + left * share) + (0.5 + right * share)
            if o.has("wfreq"):
                wfreq = tf / (mean + std)[row]
            if o.has("wspread") or o.has("wpos"):
                all_sentences = max(1, int(sentences.sum()))
                where = np.sort(pd.unique(term * all_sentences + sent))
                held = np.bincount(where // all_sentences, minlength=n)
                begins = np.cumsum(held) - held
                ids = where % all_sentences - (np.cumsum(sentences) - sentences)[row][where // all_sentences]
            if o.has("wspread"):
                wspread = held / sentences[row]
            if o.has("wcase"):
                cased = np.maximum(np.bincount(term, tag == _ACRONYM, n), np.bincount(term, tag == _NAME, n))
                wcase = cased / (1 + np.log(tf))
            if o.has("wpos"):
                wpos = np.log(np.log(3 + (ids[begins + (held - 1) // 2] + ids[begins + held // 2]) / 2))
            under = wcase + wfreq / wrel + wspread / wrel
            h = np.where(under == 0, np.inf, wpos * wrel / under)
        return np.where(usual[row] == 0, 0.0, h), weight

    def _phrase_scores(self, places, term, tf, stop, h, weight, times) -> np.ndarray:
        """h of phrases by the places of their words; a stopword within counts by how firmly its neighbours go with it."""
        product, total = np.ones(len(times)), np.zeros(len(times))
        with np.errstate(all="ignore"):
            for i, p in enumerate(places):
                t = term[p]
                plain = product * h[t], total + h[t]
                if 0 < i < len(places) - 1:
                    firm = (weight[p] / tf[term[places[i - 1]]]) * (weight[places[i + 1]] / tf[term[places[i + 1]]])
                    product, total = np.where(stop[t], product * (1 + (1 - firm)), plain[0]), np.where(stop[t], total - (1 - firm), plain[1])
                else:
                    product, total = plain
            under = (total + 1) * (times if self.options.has("KPF") else 1)
            edge = np.where(product == 0, np.nan, np.copysign(np.inf, product))
            return np.where(under == 0, edge, product / under)


class Phrases:
    """The candidates of a table of documents, as operators.keywords.documents has them, in one pass over the texts.

    lists is a broadcast of stopwords by two-letter language.
    """

    def __init__(self, docs: DataFrame, lists, options: Options = Options()) -> None:
        self.docs, self.lists, self.options = docs, lists, options

    def _map(self, columns, schema: str) -> DataFrame:
        lists, options = self.lists, self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = Chunk(lists.value, options)
            for batch in batches:
                begin = 0
                for i, (body, key) in enumerate(zip(batch.column("text"), batch.column("key")), 1):
                    chunk.add(body.as_py(), key.as_py())
                    if len(chunk.flat) > CHUNK or i == batch.num_rows:
                        yield from columns(chunk, batch.column("doc").slice(begin, i - begin))
                        chunk.clear()
                        begin = i

        rows = once(self.docs.withColumn("key", language_key(F.col("lang"))), "doc", "key", "text")
        return rows.mapInArrow(run, schema)

    @property
    def candidates(self) -> DataFrame:
        """(doc, norm_kw, kw, size, tf, clean, h): see operators.keywords.candidates."""

        def columns(chunk: Chunk, docs: pa.Array) -> Iterator[pa.RecordBatch]:
            found = list(chunk.count())
            forms = pa.array(list(chunk.words), pa.string()), pa.array(list(chunk.words.norms), pa.string())
            norm = np.array(chunk.words.norm)
            for x in found:
                kw = [forms[0].take(pa.array(w)) for w in x["words"]]
                norms = [forms[1].take(pa.array(norm[w])) for w in x["words"]]
                kw, norms = (y[0] if len(y) == 1 else pc.binary_join_element_wise(*y, " ") for y in (kw, norms))
                size = pa.array(np.full(len(kw), x["size"], np.int32))
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(x["row"])), norms, kw, size, *(pa.array(x[k]) for k in ("tf", "clean", "h"))], names)

        names = ["doc", "norm_kw", "kw", "size", "tf", "clean", "h"]
        kind = self.docs.schema["doc"].dataType.simpleString()
        return self._map(columns, f"doc {kind}, norm_kw string, kw string, size int, tf long, clean boolean, h double")

    def counts(self) -> DataFrame:
        """(size, clean, candidates, occurrences): how many there are in all documents."""

        def columns(chunk: Chunk, docs: pa.Array) -> Iterator[pa.RecordBatch]:
            rows = [(x["size"], c, int(m.sum()), int(x["tf"][m].sum())) for x in chunk.count(scored=False) for c in (True, False) if (m := x["clean"] == c).any()]
            types = (pa.int32(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        names = ["size", "clean", "candidates", "occurrences"]
        partial = self._map(columns, "size int, clean boolean, candidates long, occurrences long")
        return partial.groupBy("size", "clean").agg(F.sum("candidates").alias("candidates"), F.sum("occurrences").alias("occurrences"))
