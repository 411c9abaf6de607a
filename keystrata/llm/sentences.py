"""Sentence boundaries across languages and scripts, learned without labels.

A first pass counts, for each language, how often each type of word stands before a period and elsewhere, begins or
doesn't begin a sentence, and follows a closing quotation mark. Log-likelihood ratios of these counts give the
language's abbreviations, sentence starters, and the words that go on after a quotation (collocations with its mark).
A second pass classifies each stop of each text with them. Paragraphs end units; what is in quotation marks or brackets
stays in its sentence; where a script writes no stops, the space between two statements ends a unit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.encoding import training_texts
from keystrata.llm.language import LanguageModel, fit_documents
from keystrata.session import materialize

#: Brackets and quotation marks with what closes them, stops of all scripts, and marks of a pause.
CLOSERS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "“": "”“", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’", "‚": "‘’", '"': '"'}
OPENERS = {c: "".join(o for o, to in CLOSERS.items() if c in to) for to in CLOSERS.values() for c in to}
MARKS = re.compile("[" + re.escape("".join(CLOSERS) + "".join(OPENERS)) + "]")
STOPS = ".!?…。！？．｡।॥؟"
CLOSING = "\"'”’»›)]}）］」』“"
DASHES = "-–—―"
PAUSES = ",;:、，；：،؛"
#: Languages without stops, without blanks between words, and without capitals.
FULL_STOPPED = ("hi", "ja", "zh")  # a period ends nothing where full stops are other marks
SPACED, UNSPACED, CASELESS = ("th",), ("ja", "th", "zh"), ("ar", "hi", "ja", "th", "zh")
#: Log-likelihood from which a word counts as an abbreviation, a starter or a word that goes on after a quotation, and
#: the share of its places that it must take there. Entries of the model at most, as it is sent to every worker.
ABBREVIATION, COLLOCATION, STARTER, SHARE, MAX_ENTRIES = 0.3, 7.88, 30.0, 0.8, 1_000_000
#: A longer word is in no list, so that the end of it tells as much as the whole. Characters split at a time.
LONGEST_WORD, SLICE = 60, 1_000_000
PARAGRAPH = re.compile(r"\r?\n[^\S\r\n]*(?:\r?\n\s*)+")
STOP_RUN = re.compile(rf"[{re.escape(STOPS)}]+|(?<=[Ͱ-Ͽἀ-῿]);|;")
LETTERS = r"[\p{L}\p{M}\p{N}]+"
WORD = regex.compile(rf"{LETTERS}(?:[.'’\-]{LETTERS})*")
#: A word that a single period follows; a word that stands between words; the last word before a place, looked for backwards.
FOLLOWED = regex.compile(rf"(?>{LETTERS}(?:[.'’\-]{LETTERS})*)(?=\.(?!\.))")
WITHIN = regex.compile(rf"(?<=[\p{{L}}\p{{N}}][ \n]){LETTERS}(?:[.'’\-]{LETTERS})*")
NAME_WITHIN = regex.compile(rf"(?<=[\p{{L}}\p{{N}}][ \n])(?=\p{{Lu}}){LETTERS}(?:[.'’\-]{LETTERS})*")
LAST_WORD = regex.compile(rf"(?r){LETTERS}(?:[.'’\-]{LETTERS})*")
LATIN = re.compile(r"[A-Za-z]")
LATIN_END = regex.compile(r"(?r)\p{Latin}[\p{Latin}\p{M}]*(?:[.'’\-]\p{Latin}[\p{Latin}\p{M}]*)*")
THAI = re.compile("[฀-๿]")
OWN_SCRIPT = re.compile("([฀-๿])|([ऀ-ॿ])|([؀-ۿ])|([぀-鿿])")
NAME = re.compile(r"(?:[A-Z][A-Za-z’'\-]*\.?\s*)+")


def _spans(text: str) -> list[tuple[int, int]]:
    """Outermost pairs of quotation marks and brackets, as (begin, end); a mark without its fellow is passed over."""
    pairs, stack, held = [], [], Counter()
    for m in MARKS.finditer(text):
        i, c = m.start(), m[0]
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
        if c in "’‘" and before.isalnum() and after.isalpha() and not _unspaced(before):
            continue  # an apostrophe
        if c == "»" and not held["«"] and (not before.isspace() or after.isspace()):
            continue
        openers = [o for o in OPENERS.get(c, ()) if held[o] and not (o == "»" and before.isspace())]
        if openers:
            while stack:
                o, b = stack.pop()
                held[o] -= 1
                if o in openers:
                    pairs.append((b, i + 1))
                    break
        elif c in CLOSERS:
            stack.append((c, i))
            held[c] += 1
    out: list[tuple[int, int]] = []
    for b, e in sorted(pairs):
        if not out or b >= out[-1][1]:
            out.append((b, e))
    return out


def _unspaced(c: str) -> bool:
    return "฀" <= c <= "๿" or "぀" <= c <= "鿿"


class Places:
    """The places of one paragraph at which a unit may end: (kind, end, following), end being after all closing marks."""

    def __init__(self, text: str) -> None:
        self.text = text
        spans = _spans(text)
        inside = np.zeros(len(text) + 1, dtype=bool)
        for b, e in spans:
            inside[b:e] = True
        self.inside = inside
        out: dict[int, tuple[str, int]] = {}
        for b, e in spans:
            inner = text[b + 1 : e - 1].rstrip(CLOSING + "   ")
            if inner and inner[-1] in STOPS and (e >= len(text) or text[e] not in STOPS):
                out[e] = ("quoted", b)
        for m in STOP_RUN.finditer(text):
            if inside[m.start()]:
                continue
            run, end = m[0], m.end()
            while end < len(text) and text[end] in CLOSING and not inside[end]:
                end += 1
            if run == ".":
                kind = "period"
            elif set(run) <= {".", "…"}:
                kind = "pause"
            elif run[0] in "।॥。｡．":
                kind = "full"
            else:
                kind = "mark"
            out[end] = (kind, m.start())
        self.places: list[tuple[str, int, int, int]] = []
        self._blanks: list[int] | None = None
        for end in sorted(out):
            following = end
            while following < len(text) and text[following].isspace():
                following += 1
            if following < len(text):
                kind, at = out[end]
                self.places.append((kind, at, end, following))

    def in_address(self, at: int) -> bool:
        """Whether what stands before a place, back to the last white space, looks like an address of the web or of mail."""
        if self._blanks is None:
            self._blanks = [m.end() for m in re.finditer(r"\s+", self.text)]
            self._marks = [m.start() for m in re.finditer("[/@]", self.text)]
        k = bisect_right(self._blanks, at)
        begin = self._blanks[k - 1] if k else 0
        return bisect_left(self._marks, begin) < bisect_left(self._marks, at)


def _next_word(text: str, at: int, language: str) -> str:
    """The word at a place, without opening marks; in scripts without blanks, two characters."""
    while at < len(text) and not text[at].isalnum():
        at += 1
    if language in UNSPACED and at < len(text) and not LATIN.match(text, at):
        return text[at : at + 2]
    m = WORD.match(text, at)
    return m[0] if m else ""


def _word_before(text: str, at: int) -> str:
    """The word that ends at a place; of a word run together with the sentence before, what follows the stop."""
    m = LATIN_END.match(text, max(0, at - LONGEST_WORD), at) or LAST_WORD.match(text, max(0, at - LONGEST_WORD), at)
    word = m[0] if m else ""
    return word if "." not in word or all(len(x) <= 3 for x in word.split(".")) and not word[-1].isupper() else word.rsplit(".", 1)[1]


def _last(text: str, at: int, language: str) -> str:
    """What comes last before a stop: a word, in scripts without blanks two characters."""
    return text[max(0, at - 2) : at] if language in UNSPACED else _word_before(text, at)


def _after_quote(text: str, at: int, language: str) -> list[str]:
    """The words with which a sentence may go on after a quotation: the next three, a name left out in other scripts."""
    end = next((m.start() for m in STOP_RUN.finditer(text, at) if not text[at : m.start()].rstrip().endswith(tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))), len(text))
    rest = text[at:end]
    if language in UNSPACED:
        rest = rest.lstrip(" " + DASHES)
        out = [rest[:1]] if rest and not LATIN.match(rest) else []
        m = NAME.match(rest)
        if m:
            rest = rest[m.end() :]
        return out + ([rest[:2]] if rest else [])
    words = [m[0] for m in WORD.finditer(rest)]
    if language in CASELESS:
        words = [w for w in words if not LATIN.match(w)]
    return [w.lower() if language not in ("de",) else w for w in words[:3]]


def count_features(text: str, language: str, p: Places | None = None) -> Counter:
    """What a stretch of one language adds to its counts: (kind, word) and how often; p has its places if they are known."""
    out: Counter = Counter()
    p = p or Places(text)
    if language not in UNSPACED:
        other = Counter(map(str.lower, WORD.findall(text)))
        for m in FOLLOWED.finditer(text):
            word, after = m[0], m.end()
            if not any(map(str.isalpha, word)):
                continue
            other[word.lower()] -= 1
            word = _word_before(text, after) or word
            out["period", word.lower()] += 1
            k = after + 1
            while k < len(text) and text[k].isspace():
                k += 1
            if k < len(text):
                nxt = _next_word(text, k, language)
                if nxt and (nxt[:1].isupper() or language in CASELESS):
                    out["after " + word.lower(), nxt] += 1
        out.update({("other", w): n for w, n in other.items() if n and any(map(str.isalpha, w))})
        within = Counter((WITHIN if language in CASELESS else NAME_WITHIN).findall(text))
        out.update({("middle", w): n for w, n in within.items() if any(map(str.isalpha, w))})
    if language in UNSPACED:
        for m in re.finditer(r"[฀-๿぀-鿿]{2,}", text):
            run = m[0]
            out.update(("middle", run[i : i + 2]) for i in range(1, len(run) - 1))
    first = _next_word(text, 0, language)
    if first:
        out["begin", first] += 1
    for kind, at, end, following in p.places:
        if kind == "period" and following > end and 0 < len(digits := _word_before(text, at)) <= 2 and digits.isdigit() and text[following].isupper():
            out["ordinal", _next_word(text, following, language)] += 1
        if kind in ("mark", "full"):
            out["final", _last(text, at, language)] += 1
            nxt = _next_word(text, following, language)
            if nxt:
                out["begin", nxt] += 1
            out.update(("plain", w) for w in _after_quote(text, following, language))
        elif kind == "quoted":
            out.update(("quote", w) for w in _after_quote(text, following, language))
            out["quotes", ""] += 1
        elif kind == "period":
            out["periods", ""] += 1
            m = LAST_WORD.match(text, max(0, at - LONGEST_WORD), at)
            if m and len(m[0]) > 3 and m[0].isalpha():
                out.update(("plain", w) for w in _after_quote(text, following, language))
    return out


def _ll(k1: float, n1: float, k2: float, n2: float) -> float:
    """Dunning's log-likelihood ratio of two shares, k1 of n1 and k2 of n2."""

    def log(k: float, n: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    p = (k1 + k2) / max(n1 + n2, 1)
    return 2 * (log(k1, n1, k1 / max(n1, 1)) + log(k2, n2, k2 / max(n2, 1)) - log(k1, n1, p) - log(k2, n2, p))


PARTS = ("abbreviation", "ending", "starter", "going on", "inner", "ordinal", "final", "title")
KINDS = ("period", "other", "begin", "middle", "quote", "plain", "ordinal", "final")


def _judged(row: dict, total: dict) -> Iterator[str]:
    """What a word of a language is, by the counts of its places and those of all the language's words."""
    word, k, other = row["word"], row["period"], row["other"]
    n, all_words = k + other, total["period"] + total["other"]
    if k:
        # words that stand before a period far more often than sentence ends would have it, short ones before long
        letters, inner = len(word.replace(".", "")), word.count(".") + 1
        often = k / n > total["period"] / max(all_words, 1)
        ratio = _ll(k, n, total["period"] - k, max(all_words - n, 1)) if often else 0.0
        score = ratio * np.exp(-letters) * inner * (max(letters, 1) ** -min(float(other), 50.0))
        if score >= ABBREVIATION and k >= 2 or inner > 1 and all(len(x) <= 3 for x in word.split(".")) and k / n >= 0.5:
            yield "abbreviation"
    begin, middle = row["begin"], row["middle"]
    share, elsewhere = begin / max(total["begin"], 1), middle / max(total["middle"], 1)
    if begin and share > elsewhere and _ll(begin, total["begin"], middle, total["middle"]) >= STARTER and begin >= SHARE / 2 * (begin + middle):
        yield "starter"
    if middle >= 3 and middle > 4 * begin:
        yield "inner"
    if row["ordinal"] >= 5 and len(word) > 2 and row["ordinal"] / max(total["ordinal"], 1) > 5 * share:
        yield "ordinal"
    if row["final"] >= 3 and row["final"] / max(total["final"], 1) > 3 * elsewhere:
        yield "final"
    quote, plain = row["quote"], row["plain"]
    if quote >= 5 and quote / max(total["quote"], 1) > 20 * plain / max(total["plain"], 1):
        if _ll(quote, total["quote"], plain, total["plain"]) >= COLLOCATION:
            yield "going on"


class BoundaryModel:
    """Per language: abbreviations, those of them that end sentences, starters, words within sentences, and words that
    go on after a quotation."""

    def __init__(self, entries: list[tuple[str, str, str]]) -> None:
        self.parts: dict[str, dict[str, set[str]]] = {part: defaultdict(set) for part in PARTS}
        for language, part, word in entries:
            self.parts[part][language].add(word)
        self.any_abbreviation = {w for words in self.parts["abbreviation"].values() for w in words}
        self.abbreviations, self.ending, self.starters, self.going_on, self.inner, self.ordinals, self.finals, self.titles = (
            self.parts[x] for x in PARTS
        )

    def plainly_ends(self, p: Places, kind: str, at: int, end: int, following: int) -> bool | None:
        """Whether a unit ends at a place where no language would have it otherwise; None if that depends on it."""
        text = p.text
        if kind != "period" or following == end or not text[following].isupper() or not text[at - 1 : at].islower():
            return None
        before = _word_before(text, at).lower()
        return None if len(before) < 2 or "-" in before or before in self.any_abbreviation else True

    def ends(self, p: Places, kind: str, at: int, end: int, following: int, language: str) -> bool:
        """Whether a unit ends at this place."""
        text, gap = p.text, following > end
        nxt = text[following]
        if nxt in PAUSES or nxt in CLOSING and nxt not in CLOSERS and not nxt.isalnum():
            return False
        word = _next_word(text, following, language)
        letter = next((c for c in text[following:] if c.isalnum()), "")
        if letter.islower() and kind != "full" and (kind != "mark" or gap or language not in UNSPACED):
            return False
        if kind == "quoted":
            if set(_after_quote(text, following, language)) & self.going_on[language]:
                return False
            return not (nxt in DASHES and not letter.isupper())
        if kind == "full":
            return True
        if kind == "mark":
            return nxt not in DASHES or letter.isupper() or language in CASELESS
        if kind == "pause":
            if language in CASELESS and not LATIN.match(letter):
                return word in self.starters[language] or language == "th" and gap or _last(text, at, language) in self.finals[language]
            return word not in self.inner[language]
        if language == "th" or language in FULL_STOPPED:
            return False
        written = _word_before(text, at)
        before = written.lower()
        known = before in self.abbreviations[language] or "-" in before and before.rsplit("-", 1)[1] in self.abbreviations[language]
        single = len(before) == 1 and before.isalpha()
        if letter.isdigit() or before.isdigit() and len(before) <= 2 and word in self.ordinals[language]:
            return False
        if not gap:
            return not (known or single or p.in_address(at) or not letter.isupper() and language not in CASELESS or not before)
        if single:
            return written.islower() and (before not in self.abbreviations[language] or word in self.starters[language])
        if known:
            if language in CASELESS:
                return word in self.starters[language] and before in self.ending[language]
            if before in self.ending[language]:
                return word not in self.inner[language]
            return word in self.starters[language] and before not in self.titles[language]
        return True


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    begin = 0
    for m in PARAGRAPH.finditer(text):
        yield begin, m.start()
        begin = m.end()
    yield begin, len(text)


def _thai_spaces(p: Places) -> set[int]:
    """Where blanks part statements in Thai: those outside quotations that don't lie within a Latin name."""
    text, out = p.text, set()
    for m in re.finditer(r"\s+", text):
        b, e = m.span()
        if b == 0 or e == len(text) or p.inside[b]:
            continue
        left, right = text[b - 1], text[e]
        if LATIN.match(right) and (LATIN.match(left) or left == "."):
            token = re.search(r"[A-Za-z.]+$", text[:b])
            if token and (token.start() == 0 or not "฀" <= text[token.start() - 1] <= "๿" or len(token[0].rstrip(".")) == 1):
                continue
        elif not ("฀" <= left <= "๿" or "฀" <= right <= "๿" or right in CLOSERS or left in CLOSING):
            continue
        if left in PAUSES or right in DASHES + PAUSES or left in DASHES:
            continue
        out.add(b)
    return out


class Layout:
    """The paragraphs of a text, the places in them where a unit may end, and the pieces of text between such places."""

    def __init__(self, text: str) -> None:
        self.text, self.paragraphs, self.pieces = text, [], []
        for begin, stop in paragraphs(text):
            p = Places(text[begin:stop])
            spaces = _thai_spaces(p) if THAI.search(p.text) else set()
            cuts = sorted({end for _, _, end, _ in p.places} | spaces)
            self.paragraphs.append((begin, p, spaces, len(self.pieces)))
            self.pieces += [(begin + b, begin + e) for b, e in zip([0, *cuts], [*cuts, len(p.text)])]

    def strings(self) -> list[str]:
        return [self.text[b:e] for b, e in self.pieces]


def laid_out(texts: Sequence[str], languages: LanguageModel) -> Iterator[tuple[int, Layout, np.ndarray, np.ndarray, list[str]]]:
    """(number, layout, sums, letters, language of each piece) of each text; a piece too far from every language has that of its script."""
    begin, texts = 0, list(texts)
    while begin < len(texts):
        layouts, size = [], 0
        while begin + len(layouts) < len(texts) and (not layouts or size < SLICE):
            layouts.append(Layout(texts[begin + len(layouts)]))
            size += len(layouts[-1].text)
        sums, letters = languages.sums([x for layout in layouts for x in layout.strings()])
        lo = 0
        for i, layout in enumerate(layouts):
            hi = lo + len(layout.pieces)
            names = [x or _of_script(layout.text[b:e]) for (x, _), (b, e) in zip(languages.decide(sums[lo:hi], letters[lo:hi]), layout.pieces)]
            yield begin + i, layout, sums[lo:hi], letters[lo:hi], names
            lo = hi
        begin += len(layouts)


def _of_script(piece: str) -> str:
    """What rules hold for a piece of no known language: those of its script, else none but the general ones."""
    m = OWN_SCRIPT.search(piece)
    return next(x for x, v in zip(("th", "hi", "ar", "zh"), m.groups()) if v) if m else "und"


def split_units(layout: Layout, model: BoundaryModel, names: list[str]) -> list[tuple[int, int, int]]:
    """The sentence units of a text, as offsets (begin, end) and the number of the first piece; names has each piece's language."""
    out = []
    for begin, p, spaces, first in layout.paragraphs:
        # the language of a place is that of the piece it ends
        at_end = {e: names[k] for k, (_, e) in enumerate(layout.pieces[first : first + len(p.places) + len(spaces) + 1], first)}
        cuts = set()
        for kind, at, end, following in p.places:
            plain = model.plainly_ends(p, kind, at, end, following)
            if plain or plain is None and model.ends(p, kind, at, end, following, at_end[begin + end]):
                cuts.add(end)
        cuts |= {b for b in spaces if at_end[begin + b] in SPACED or THAI.match(p.text, b - 1)}
        last, piece_no = 0, first
        for cut in [*sorted(cuts), len(p.text)]:
            piece = p.text[last:cut]
            body = piece.strip()
            if body:
                at = begin + last + len(piece) - len(piece.lstrip())
                out.append((at, at + len(body), piece_no))
            while piece_no < len(layout.pieces) and layout.pieces[piece_no][1] <= begin + cut:
                piece_no += 1
            last = cut
    return out


def looked_up(layout: Layout, names: list[str]) -> set[str]:
    """The words by which the places of a text are judged."""
    out = set()
    for begin, p, spaces, first in layout.paragraphs:
        at_end = {e: names[k] for k, (_, e) in enumerate(layout.pieces[first : first + len(p.places) + len(spaces) + 1], first)}
        for _, at, end, following in p.places:
            x, before = at_end[begin + end], _word_before(p.text, at).lower()
            out |= {before, before.rsplit("-", 1)[-1], _next_word(p.text, following, x), _last(p.text, at, x), *_after_quote(p.text, following, x)}
    return out - {""}


def latest_rows(df: DataFrame, key: str, text: str, order: str | None, *more: str) -> DataFrame:
    """(key, text, more): one row for each key that isn't null, the last by `order`, then by text."""
    fields = [F.col(order).alias("o")] if order else []
    fields += [F.col(text).alias("t"), *(F.col(c).alias(f"m{i}") for i, c in enumerate(more))]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*fields).alias("r"))
    # as many partitions as the session's shuffles have: adaptive execution would join them by size, but the work on
    # texts is heavy for their size
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    rows = rows.groupBy("key").agg(F.max("r").alias("r"))
    return rows.select("key", "r.t", *(F.col(f"r.m{i}").alias(c) for i, c in enumerate(more)))


def boundaries(texts: DataFrame, shared, text: str = "t") -> DataFrame:
    """(language, part, word): what the boundary model of a table of texts knows, from the counts of all of them.

    shared is a broadcast pair, of which the second is the language model. Counts stay distributed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for _, layout, _, _, names in laid_out(batch[text], shared.value[1]):
                for begin, p, spaces, first in layout.paragraphs:
                    last = first + len(p.places) + len(spaces) + 1
                    for b, e, language in runs_of(layout.pieces[first:last], names[first:last]):
                        whole = e - b == len(p.text)
                        for (kind, word), n in count_features(layout.text[b:e], language, p if whole else None).items():
                            counts[language, kind, word] += n
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["language", "kind", "word", "n"])

    rows = texts.where(F.col(text).rlike(r"\S")).select(text).mapInPandas(run, "language string, kind string, word string, n long")
    totals = materialize(rows.groupBy("language", "kind", "word").agg(F.sum("n").alias("n")), "boundary-counts")
    places = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in KINDS]
    wide = totals.where(F.col("kind").isin(*KINDS)).groupBy("language", "word").agg(*places)
    sums = {r["language"]: r.asDict() for r in wide.groupBy("language").agg(*(F.sum(k).alias(k) for k in KINDS)).collect()}  # a row a language

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r["language"], part, r["word"]) for r in batch.to_dict("records") for part in _judged(r, sums[r["language"]])]
            yield pd.DataFrame(out, columns=["language", "part", "word"])

    judged = materialize(wide.mapInPandas(judge, "language string, part string, word string"), "boundary-words")
    # an abbreviation ends sentences if starters often come after it; else, as titles do, it goes with what follows
    after = totals.where(F.col("kind").startswith("after ")).withColumn("before", F.expr("substring(kind, 7)"))
    known = judged.where("part = 'abbreviation'").select("language", F.col("word").alias("before"))
    starts = judged.where("part = 'starter'").select("language", "word", F.lit(1).alias("starts"))
    after = after.join(known, ["language", "before"], "left_semi").join(starts, ["language", "word"], "left")
    ending = after.groupBy("language", "before").agg(F.sum("n").alias("n"), F.sum(F.coalesce(F.col("starts") * F.col("n"), F.lit(0))).alias("k"))
    ending = ending.where("n >= 3").select("language", F.expr("IF(k >= 0.3 * n, 'ending', 'title')").alias("part"), F.col("before").alias("word"))
    return judged.unionByName(ending)


def runs_of(pieces: Sequence[tuple[int, int]], names: Sequence[str]) -> list[tuple[int, int, str]]:
    """(begin, end, language): neighbouring pieces of one language together."""
    out: list[tuple[int, int, str]] = []
    for (b, e), x in zip(pieces, names):
        out.append((out.pop()[0] if out and out[-1][2] == x else b, e, x))
    return out


def with_entries(texts: DataFrame, entries: DataFrame, shared) -> tuple[DataFrame, Callable[[pd.DataFrame, int], BoundaryModel]]:
    """texts (key, t, ...), and what gives the boundary model for a row of a batch of it.

    A model of up to MAX_ENTRIES words is sent to every worker. A larger one stays a table: each text gets the entries
    of the words that its own places are judged by, so that results are the same.
    """
    few = [tuple(r) for r in entries.limit(MAX_ENTRIES + 1).collect()]
    if len(few) <= MAX_ENTRIES:
        sent = texts.sparkSession.sparkContext.broadcast(BoundaryModel(sorted(few)))
        return texts, lambda batch, i: sent.value

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(batch["key"].iloc[i], w) for i, layout, _, _, names in laid_out(batch["t"], shared.value[1]) for w in looked_up(layout, names)]
            yield pd.DataFrame(out, columns=["key", "word"])

    asked = texts.select("key", "t").mapInPandas(ask, "key string, word string")
    own = asked.join(entries, "word").groupBy("key").agg(F.collect_list(F.struct("language", "part", "word")).alias("entries"))  # of one text
    return texts.join(own, "key", "left"), lambda batch, i: BoundaryModel([(x["language"], x["part"], x["word"]) for x in (batch["entries"].iloc[i] if batch["entries"].iloc[i] is not None else ())])


def sentence_units(df: DataFrame, corpus: DataFrame, key: str = "id", text: str = "body", order: str | None = "arrived_at", label: str | None = "language") -> DataFrame:
    """(key STRING, unit INT, begin_at BIGINT, end_at BIGINT): the units of each text, numbered from 0.

    Offsets count code points of the text as stored, the end exclusive. Units carry no white space at either end and
    cover everything else. A key with several rows gives the units of the last one by `order`; null keys and null, empty
    or blank texts give none. The boundary model is learned from all texts given. Texts are split whole. label names a
    column of languages, some perhaps wrong, or is None.
    """
    rows = latest_rows(df, key, text, order)
    model = fit_documents(df, training_texts(corpus), key, text, label)
    shared = df.sparkSession.sparkContext.broadcast((None, model))  # bounded by FIT_ROWS and SIZE
    units = rows.select(F.col("key").cast("string").alias("key"), "t").where(F.col("t").rlike(r"\S"))
    units, model_of = with_entries(units, boundaries(rows, shared), shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, layout, _, _, names in laid_out(batch["t"], shared.value[1]):
                k = batch["key"].iloc[i]
                out += [(k, n, b, e) for n, (b, e, _) in enumerate(split_units(layout, model_of(batch, i), names))]
            yield pd.DataFrame(out, columns=["key", "unit", "begin_at", "end_at"])

    return units.mapInPandas(run, "key string, unit int, begin_at long, end_at long").withColumnRenamed("key", key)
