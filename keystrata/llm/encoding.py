"""Text that was decoded with the wrong character encoding.

Each stretch is read again along candidate chains: the characters go back to bytes by the codec of the wrong reading,
and the bytes are read as the writer may have meant them. Every reading is compressed with zstandard under dictionaries
of the languages it could be in; letters that a language's texts never use cost extra. The chain of least description
length, its own cost included, wins; if no chain beats the text as it stands, the text is left unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.lookalikes import LOOKALIKES

#: Codecs of wrong readings and of what the bytes were meant as, each with what it adds to the cost of a
#: chain in bits: the rarer, the more. Chains are all pairs of the two, and UTF-8 read wrongly twice.
WRONG = {
    "cp1252": 0, "latin-1": 0, "mac_roman": 2, "cp1251": 2, "cp1250": 2, "iso8859_2": 3, "koi8_r": 3, "cp437": 3, "cp850": 3, "cp866": 3,
}
MEANT = {
    "utf-8": 0, "cp1252": 2, "cp1250": 2, "cp1251": 2, "cp1253": 2, "cp1256": 2, "cp1257": 2, "iso8859_2": 3, "koi8_r": 3, "cp874": 3, "gb18030": 3,
    "cp932": 3, "euc_jp": 3, "big5": 4, "iso8859_5": 4, "iso8859_13": 4, "cp866": 4, "mac_roman": 4, "cp850": 4, "cp437": 5, "mac_cyrillic": 5,
}
TWICE, WIDE = ("cp1252", "latin-1"), ("gb18030", "cp932", "euc_jp", "big5")
#: A code page is one a language is written in if it has this share of the letters beyond ASCII of the language's texts.
WRITTEN_SHARE = 0.9
#: Of the letters that a chain brings in, the share the language must use, and their least number: in a Latin script one
#: code page differs from another by a few letters, in any other by all of them.
KNOWN_SHARE, LEAST_LETTERS = 0.8, 3
#: The share for scripts of thousands of characters, of which training texts hold but some, and for UTF-8, which hardly arises by chance.
LOOSE_SHARE, LARGE_SCRIPTS = 0.5, ("ja", "zh", "th")
#: In another script than Latin, the share of a sentence's letters that a chain brings in at least, beside names.
OWN_SHARE, LARGE_SHARE = 0.3, 0.1
#: Description length in bits: of one step of a chain, and of a letter foreign to a language.
STEP_BITS, FOREIGN_BITS = 8, 12
LOOKALIKE = frozenset("".join(of for of, _ in LOOKALIKES.values()))
REPLACED = "�"
#: Labelled texts taken at most, for each language, and the characters of one; the corpus table is fixed and far below.
MAX_TRAINING_ROWS = 2_000
#: Characters of a labelled text, longer ones aren't taken.
FIT_CHARS = 20_000
#: Of all documents labelled with a language, the share in which two characters stand together, the same where one of them
#: is a mark, and the share that have a phrase in a clean line: such pairs and phrases are known.
PAIR_SHARE, MARK_SHARE, PHRASE_SHARE = 0.03, 0.15, 1 / 300
#: Words of a phrase, its characters in a script without blanks; counts a task holds before it hands them on.
PHRASE, PHRASE_CHARS, KEPT_COUNTS = 3, 6, 200_000
#: Marks of typography that belong to no language.
PUNCTUATION = frozenset("–—‘’‚“”„‹›«»…·§°№©®™¿¡、。，！？：；（）「」『』《》")
#: The letters a language is written with beyond ASCII, of which training texts may lack some. Chinese and
#: the Chinese characters of Japanese can't be listed; LOOSE_SHARE holds for them. French ÿ, in a few names only, is what
#: Russian "Её" would be read again as.
LETTERS = {
    "de": "äöüß", "fr": "àâæçèéêëîïôœùûü", "es": "áéíñóúü", "pt": "àáâãçéêíóôõú", "it": "àèéìíîòóù", "lt": "ąčęėįšųūž",
    "pl": "ąćęłńóśźż", "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ",
    "ar": "".join(map(chr, [*range(0x621, 0x63B), *range(0x641, 0x653)])),
    "hi": "".join(map(chr, [*range(0x901, 0x904), *range(0x905, 0x93A), *range(0x93C, 0x94E)])),
    "th": "".join(map(chr, [*range(0xE01, 0xE3B), *range(0xE40, 0xE4F)])),
    "ja": "".join(map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB), 0x30FC])),
}
LINE = re.compile(r"[^\n]*\n*")
UNIT = re.compile(r"[^\n.!?。！？।]*(?:[.!?。！？।]+[^\s\w]*|\n+|$)\s*")
UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u9fff]+")
MIXED = re.compile("[A-Za-z][Ͱ-ӿ؀-ۿ]|[Ͱ-ӿ؀-ۿ][A-Za-z]")


@lru_cache(None)
def _byte_of(codec: str) -> dict[int, int]:
    """Code point to byte; bytes a codec leaves undefined stand for the control characters of the same number."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    if codec == "cp1252":  # many readers pass control characters through
        for b in range(0x80, 0xA0):
            out.setdefault(b, b)
    return out


@lru_cache(None)
def _runs(codec: str) -> re.Pattern:
    letters = "".join(re.escape(chr(c)) for c in _byte_of(codec))
    return re.compile(f"[{letters}]+")


@lru_cache(None)
def _sequences(codec: str) -> re.Pattern:
    """What UTF-8 of two bytes or more looks like in a wrong reading."""
    lead, then = ("".join(re.escape(chr(c)) for c, b in _byte_of(codec).items() if lo <= b < hi) for lo, hi in ((0xC2, 0xF5), (0x80, 0xC0)))
    return re.compile(f"[{lead}][{then}]")


SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _step(text: str, wrong: str, meant: str) -> str | None:
    """One step of a chain over the stretches it can apply to; None if it changes nothing."""
    if meant == "utf-8" and not _sequences(wrong).search(text):
        return None
    back = _byte_of(wrong)

    def again(m: re.Match) -> str:
        run = m[0]
        if run.isascii():
            return run
        raw = bytes(back[ord(c)] for c in run)
        if meant != "utf-8":
            return raw.decode(meant, "replace")
        out, at = [], 0
        for s in SEQUENCE.finditer(raw):
            try:
                letters = s[0].decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[at : s.start()], letters]
            at = s.end()
        return "".join(out) + run[at:] if out else run

    changed = _runs(wrong).sub(again, text)
    return changed if changed != text else None


def read_again(text: str, chain: tuple) -> str:
    """A text read again by a chain; steps that don't apply to it are passed over."""
    for wrong, meant in chain:
        text = _step(text, wrong, meant) or text
    return text


@lru_cache(None)
def _repertoire(codec: str) -> frozenset[str]:
    return frozenset(map(chr, _byte_of(codec)))


@lru_cache(None)
def _table(wrong: str, meant: str) -> dict[int, str] | None:
    """What each character of a wrong reading was meant as, where a byte is a character; REPLACED for none."""
    if meant in WIDE:
        return None
    return {c: to for c, b in _byte_of(wrong).items() if (to := bytes([b]).decode(meant, "replace")) != chr(c)}


def _within(text: str, c: str) -> bool:
    """Whether a sign stands within a word."""
    return bool(re.search(rf"[^\W\d_]{re.escape(c)}[^\W\d_]", text)) and not c.isspace() and c != "\xad"


def _is_letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


@lru_cache(None)
def chain_bits(chain: tuple) -> int:
    return sum(STEP_BITS + WRONG[wrong] + MEANT[meant] for wrong, meant in chain)


@lru_cache(None)
def chains(legacy: bool) -> tuple[tuple[int, tuple], ...]:
    """(cost, chain), the cheapest first."""
    if legacy:
        made = [((wrong, meant),) for wrong in WRONG for meant in MEANT if meant not in ("utf-8", wrong)]
    else:
        made = [((wrong, "utf-8"),) for wrong in WRONG] + [((wrong, "utf-8"),) * 2 for wrong in TWICE]
    return tuple(sorted(((chain_bits(c), c) for c in made), key=lambda x: x[0]))


def _share_written(letters: list[str], codec: str) -> float:
    n = 0
    for c, k in Counter(letters).items():
        try:
            c.encode(codec)
            n += k
        except UnicodeEncodeError:
            pass
    return n / len(letters)


MISREAD = frozenset().union(*(_repertoire(x) for x in WRONG)) - frozenset(map(chr, range(0x80)))


def strange(text: str, seen: frozenset[tuple[str, str]]) -> bool:
    """Whether characters stand together here, one of which a wrong reading may give, that aren't seen to."""
    for a, b in zip(text, text[1:]):
        if (a > "\x7f" or b > "\x7f") and (a, b) not in seen and not a.isspace() | b.isspace() or "\x80" <= b < "\xa1":
            x, y = (a in PUNCTUATION or a < "\x80"), (b in PUNCTUATION or b < "\x80")
            if not (x and y) and (a in MISREAD or b in MISREAD):
                return True
    return False


class Repairer:
    """Compressors and alphabets of the languages of a training table of clean texts; LETTERS complete the alphabets.

    phrases has more for the dictionaries, the commonest last, and pairs characters that are known to stand together,
    beside those of texts.
    """

    def __init__(self, texts: dict[str, list[str]], phrases: dict[str, list[str]] | None = None, pairs: frozenset[tuple[str, str]] = frozenset()) -> None:
        self.alphabet, self.letters, self.coder, self.latin, self.written, self.pairs = {}, {}, {}, {}, {}, {}
        misread = _repertoire("cp1252")
        for language, own in sorted(texts.items()):
            joined = "\n".join(own)
            self.alphabet[language] = frozenset(joined) | frozenset(joined.lower()) | frozenset(joined.upper()) | frozenset("\n\r\t\xa0 ")
            full = LETTERS.get(language, "")
            self.letters[language] = self.alphabet[language] | frozenset(full) | frozenset(full.upper())
            # letters that garbled text is made of: if no training text has them, they stay foreign
            self.alphabet[language] |= {c for c in self.letters[language] if c not in misread}
            letters = [c for c in joined if c.isalpha()]
            high = list(full) or [c for c in letters if c > "\x7f"]
            self.latin[language] = 2 * sum(unicodedata.name(c, "").startswith("LATIN") for c in letters) > len(letters)
            fit = [x for x in MEANT if x != "utf-8" and high and _share_written(high, x) >= WRITTEN_SHARE]
            single = [x for x in fit if x not in WIDE]
            self.written[language] = frozenset(single or ([] if self.latin[language] else fit))
            self.pairs[language] = frozenset(zip(joined, joined[1:]))
            raw = " ".join([*(phrases or {}).get(language, ()), joined]).encode("utf-8") + b" " * 8
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=3)
            self.coder[language] = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.all_pairs = pairs.union(*self.pairs.values())
        self.compressed = lru_cache(200_000)(lambda text, language: 8 * len(self.coder[language].compress(text.encode("utf-8", "replace"))))
        self.best_chain = lru_cache(50_000)(self._best_chain)
        self.writers = lru_cache(None)(lambda languages: {m: w for m in MEANT if (w := tuple(x for x in languages if m in self.written[x]))})

    def foreign(self, text: str, language: str) -> int:
        """What the letters foreign to a language add to a text's description length, which is no less than that."""
        known = self.alphabet[language]
        return FOREIGN_BITS * sum(c not in known for c in text if c > "\x7f" and c not in PUNCTUATION)

    def length(self, text: str, languages: tuple[str, ...], below: float = float("inf")) -> float:
        """Description length of a text: the least over the languages whose letters it mostly uses; `below`, or more, if it isn't less."""
        high = [c for c in text if c > "\x7f" and c not in PUNCTUATION]
        fits = [(sum(c in self.alphabet[x] for c in high), x) for x in languages]
        most = max(n for n, _ in fits)
        for x in sorted((x for n, x in fits if n >= 0.7 * most), key=lambda x: (self.foreign(text, x), x)):
            extra = self.foreign(text, x)
            if extra >= below:
                break
            below = min(below, extra + self.compressed(text, x))
        return below

    def odd(self, text: str, languages: tuple[str, ...]) -> bool:
        """Whether characters stand together here, one of which a wrong reading may give, that never do in the languages' texts.

        Text without such a pair is taken as it stands.
        """
        return strange(text, self.pairs[languages[0]] if len(languages) == 1 else self.all_pairs)

    def _known(self, letters: Counter, languages: tuple[str, ...], legacy: bool, of: int) -> tuple[str, ...]:
        """The languages that use the letters a chain brings in; of is the number of letters in the whole text."""
        total, out = letters.total(), []
        for x in languages:
            known = sum(n for c, n in letters.items() if c in self.letters[x])
            if not legacy and known >= LOOSE_SHARE * total:
                out.append(x)
            elif self.latin[x]:
                if known == total:
                    out.append(x)
            elif total >= max(LEAST_LETTERS, (LARGE_SHARE if x in LARGE_SCRIPTS[:-1] else OWN_SHARE) * of) and known >= (LOOSE_SHARE if x in LARGE_SCRIPTS else KNOWN_SHARE) * total:
                out.append(x)
        return tuple(out)

    def _again(self, text: str, languages: tuple[str, ...], legacy: bool) -> Iterator[tuple[int, str, tuple, tuple[str, ...]]]:
        """(cost, text read again, chain, languages it may be in) for the chains that could have made this text, the cheapest first."""
        high = Counter(c for c in text if c > "\x7f")
        letters = Counter({c: n for c, n in high.items() if c not in PUNCTUATION})
        strange = {c for c in letters if c not in MISREAD}  # no wrong reading gives these: they stand beside the stretch
        all_letters = sum(c.isalpha() and c not in strange for c in text)
        mixed, seen = len(MIXED.findall(text)), {text}
        may_be = {wrong for wrong in WRONG if letters.keys() - strange <= _repertoire(wrong)}
        writers = self.writers(languages) if legacy else {}
        for cost, chain in chains(legacy):
            wrong, meant = chain[0]
            if legacy:
                if wrong not in may_be or meant not in writers:
                    continue
                allowed = writers[meant]
                table = _table(wrong, meant)
                if table is not None:
                    # a code page of single bytes: its letters tell before anything is written
                    new, moved = Counter(), []
                    for c, n in high.items():
                        to = table.get(ord(c), c)
                        if to != c:
                            new[to] += n
                            moved.append(c)
                    # look-alikes within Latin words are a disguise; blanks and marks alone are no letters read wrongly
                    if mixed and LOOKALIKE.issuperset(c for c in moved if c.isalpha()):
                        continue
                    if not any(map(str.isalpha, moved)) and not any(_within(text, c) for c in moved if c not in PUNCTUATION):
                        continue
                    if not new or REPLACED in new or any("\x80" <= c < "\xa0" for c in new):
                        continue
                    allowed = self._known(Counter({c: n for c, n in new.items() if _is_letter(c)}), allowed, True, all_letters) if any(map(_is_letter, new)) else ()
                    if not allowed:
                        continue
                    now = text.translate(table)
                else:
                    if letters.total() - sum(letters[c] for c in strange) < 0.3 * all_letters:
                        continue
                    now = _step(text, wrong, meant)
            else:
                allowed, now = languages, text
                for step in chain:
                    now = _step(now, *step) if now is not None else None
            if now is None or (now, allowed) in seen:
                continue
            seen.add((now, allowed))
            new = Counter(c for c in now if c > "\x7f") - high
            if not new or legacy and any("\x80" <= c < "\xa0" or c == REPLACED for c in new):
                continue
            own = Counter({c: n for c, n in new.items() if _is_letter(c)})
            if own:
                allowed = self._known(own, allowed, legacy, sum(c.isalpha() and c not in strange for c in now))
            elif legacy or not all(c in PUNCTUATION or c.isspace() for c in new):
                continue
            if allowed and len(MIXED.findall(now)) <= (0 if legacy else mixed):
                yield cost, now, chain, allowed

    def _best_chain(self, text: str, languages: tuple[str, ...], legacy: bool) -> tuple[str, tuple]:
        best, result, chain = None, text, ()
        for cost, now, candidate, allowed in self._again(text, languages, legacy):
            best = self.length(text, languages) if best is None else best
            # a chain must shorten the text in the language it is meant in, not only change what language is the shortest
            bits = min((n for x in allowed if (n := self.length(now, (x,), best - cost)) + cost < self.length(text, (x,))), default=best) + cost
            if bits < best:
                best, result, chain = bits, now, candidate
        return result, chain

    def repair(self, text: str, language: str | None = None) -> tuple[str, list[tuple[int, int, tuple]]]:
        """The text with garbled stretches read again, and the stretches: (begin, end, chain); offsets in the given text.

        UTF-8 that was read as something else is looked for in whole lines, other code pages in single sentences. A line
        that both would change takes the shorter description.
        """
        if text.isascii():
            return text, []
        languages = (language,) if language in self.coder else tuple(self.coder)
        if not languages or not self.odd(text, languages):
            return text, []
        out, found = [], []
        for line in LINE.finditer(text):
            if not line[0] or line[0].isascii() or not self.odd(line[0], languages):
                out.append(line[0])
                continue
            fixed, chain = self.best_chain(line[0], languages, False)
            units = [(m, m[0].isascii() or not self.odd(m[0], languages)) for m in UNIT.finditer(line[0])]
            parts = [(m, *((m[0], ()) if clean else self.best_chain(m[0], languages, True))) for m, clean in units]
            steps = sum(chain_bits(c) for _, _, c in parts)
            by_units = "".join(unit for _, unit, _ in parts)
            if chain and (not steps or self.length(fixed, languages) + chain_bits(chain) <= self.length(by_units, languages) + steps):
                found.append((line.start(), line.end(), chain))
                out.append(fixed)
                continue
            found += [(line.start() + m.start(), line.start() + m.end(), c) for m, _, c in parts if c]
            out.append(by_units)
        return "".join(out), found


def _name(chain: tuple) -> str:
    return " > ".join(f"{wrong} as {meant}" for wrong, meant in chain)


def training_texts(corpus: DataFrame, language: str = "language", text: str = "text") -> dict[str, list[str]]:
    """The clean texts of a labelled table by language, at most MAX_TRAINING_ROWS of each, chosen by hash."""
    rows = corpus.select(F.lower(F.substring(F.trim(language), 1, 2)).alias("l"), F.col(text).alias("t")).where((F.col("l") != "") & (F.length("t") <= FIT_CHARS)).distinct()
    ranked = rows.selectExpr("l", "t", "row_number() OVER (PARTITION BY l ORDER BY xxhash64(t), t) AS k").where(F.col("k") <= MAX_TRAINING_ROWS)
    out = defaultdict(list)
    for r in ranked.orderBy("l", "k").collect():  # bounded by the parameter
        out[r["l"]].append(r["t"])
    return dict(out)


def labelled_texts(df: DataFrame, languages: Sequence[str], text: str, label: str) -> DataFrame:
    """(l STRING, t STRING): the distinct texts labelled with one of the languages, whole and all of them."""
    said = F.lower(F.substring(F.trim(label), 1, 2))
    rows = df.select(said.alias("l"), F.col(text).alias("t")).where(F.col("l").isin(list(languages)) & F.col("t").rlike(r"\S"))
    # adaptive execution would join partitions by size, but the work on texts is heavy for their size
    return rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t").distinct()


def document_counts(rows: DataFrame, things: Callable[[str, str], Iterable[str]]) -> DataFrame:
    """(l, w, n): how many of the rows (l, t) have w among their things, which gives each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def counted() -> pd.DataFrame:
            out = pd.DataFrame([(x, w, n) for (x, w), n in counts.items()], columns=["l", "w", "n"])
            counts.clear()
            return out

        for batch in batches:
            for x, t in zip(batch["l"], batch["t"]):
                counts.update((x, w) for w in things(x, t))
                if len(counts) > KEPT_COUNTS:
                    yield counted()
        yield counted()

    return rows.mapInPandas(run, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))


def phrases_of(line: str) -> set[str]:
    """Every PHRASE words that follow on one another; of a script without blanks every PHRASE_CHARS characters."""
    words, out = line.split(), set()
    if not line.isascii() and UNSPACED.search(line):
        out.update(r[i : i + PHRASE_CHARS] for r in UNSPACED.findall(line) for i in range(max(1, len(r) - PHRASE_CHARS + 1)))
        words = UNSPACED.sub(" ", line).split()
    out.update(" ".join(words[i : i + PHRASE]) for i in range(max(1, len(words) - PHRASE + 1)) if words)
    return out


def clean_phrases(text: str, seen: frozenset[tuple[str, str]]) -> set[str]:
    """The phrases of a text's clean lines: those in which no characters stand together oddly and none is lost."""
    clean = REPLACED not in text and not strange(text, seen)
    return set().union(*(phrases_of(line) for line in text.split("\n") if clean or REPLACED not in line and not strange(line, seen)))


Clean = tuple[dict[str, list[str]], dict[str, list[str]], frozenset[tuple[str, str]]]


def clean_documents(df: DataFrame, texts: dict[str, list[str]], text: str, label: str | None) -> Clean:
    """What a Repairer is made of: the labelled texts, phrases of the clean lines of documents, and pairs of characters.

    Both are counted over all documents that label gives one of the languages. A pair of characters of a language's own
    alphabet that PAIR_SHARE of its documents have is known, as garbled texts are few and of many kinds; so is a phrase that
    PHRASE_SHARE of them have in clean lines. The known phrases of a language hold no more characters than
    PHRASE_CHARS / PHRASE_SHARE mean documents.
    """
    if not label or not texts:
        return texts, {}, frozenset()
    fixer, context = Repairer(texts), df.sparkSession.sparkContext
    rows = labelled_texts(df, sorted(texts), text, label)
    own = context.broadcast({x: fixer.letters[x] | PUNCTUATION for x in texts})

    def side_by_side(x: str, t: str) -> Iterator[str]:
        yield ""  # counts the documents
        if not t.isascii():
            letters = own.value[x]
            for a, b in set(zip(t, t[1:])):
                if (a > "\x7f" or b > "\x7f") and (a <= "\x7f" or a in letters) and (b <= "\x7f" or b in letters):
                    yield a + b

    found = document_counts(rows, side_by_side).where("w = '' OR n >= 3").collect()  # at most the pairs of a language's letters
    docs = {r["l"]: r["n"] for r in found if not r["w"]}
    if not docs:
        return texts, {}, frozenset()
    share = {True: MARK_SHARE, False: PAIR_SHARE}
    pairs = frozenset(tuple(r["w"]) for r in found if r["w"] and r["n"] >= share[bool(PUNCTUATION.intersection(r["w"]))] * docs[r["l"]])
    seen = context.broadcast(fixer.all_pairs | pairs)
    least = F.create_map(*(F.lit(x) for l, n in sorted(docs.items()) for x in (l, PHRASE_SHARE * n)))
    phrases = defaultdict(list)
    known = document_counts(rows, lambda _, t: clean_phrases(t, seen.value)).where(F.col("n") >= least[F.col("l")])
    for r in sorted(known.collect(), key=lambda r: (r["l"], r["n"], r["w"])):  # bounded by PHRASE_SHARE
        phrases[r["l"]].append(r["w"])
    return texts, dict(phrases), pairs


_repairers: dict[int, Repairer] = {}


def repairer(clean: Clean) -> Repairer:
    """One repairer for each training table in a worker; the table is that of a broadcast value, which a worker keeps."""
    if id(clean) not in _repairers:
        _repairers[id(clean)] = Repairer(*clean)
    return _repairers[id(clean)]


def repaired(df: DataFrame, corpus: DataFrame, key: str, text: str, language: str | None = None, label: str | None = None) -> DataFrame:
    """The rows whose text is garbled, with the original where it can be restored.

    Result: (row_key STRING, original STRING, chains ARRAY<STRING>, lost INT): the text as restored; the chains of its
    stretches, in order; how many characters are replaced for good. One row for each distinct key and text that is
    garbled. language names a trusted column with the language of each text; without it every language is tried. label
    names a column of languages some of which are wrong: all texts with a label add to what is known of its language.
    Null keys and null, empty or plain ASCII texts give no rows; a byte order mark alone is no garbling. Texts are
    looked at whole. Other columns are ignored.
    """
    clean = clean_documents(df, training_texts(corpus), text, label)
    shared = df.sparkSession.sparkContext.broadcast(clean)  # bounded by MAX_TRAINING_ROWS and PHRASE_SHARE
    said = F.col(language) if language else F.lit(None)
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"), said.cast("string").alias("language"))
    rows = rows.where(F.col("row_key").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    # adaptive execution would join partitions by size, but the work on texts is heavy for their size
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_key").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixer = repairer(shared.value)
        for batch in batches:
            out = []
            for k, t, label in zip(batch["row_key"], batch["text"], batch["language"]):
                original, found = fixer.repair(t, label)
                lost = t.count(REPLACED)
                if found or lost:
                    out.append((k, original, [_name(c) for _, _, c in found], lost))
            yield pd.DataFrame(out, columns=["row_key", "original", "chains", "lost"])

    return rows.mapInPandas(run, "row_key string, original string, chains array<string>, lost int")
