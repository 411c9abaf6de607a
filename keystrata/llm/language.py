"""The language of a document and of each of its single-language segments.

A text becomes a normalised TF-IDF vector of its n-grams: those of 1 to 4 characters within words, and whole words. Each
language of a labelled table has several centroids, found by clustering texts; the nearest centroid by cosine names the
language, and a text too far from all of them is rejected. The confidence is the lead over the nearest centroid of any
other language. The sentences of a document are decided together: a change of language costs, so that a sentence of
names, or of words that two languages share, goes with its neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.encoding import FIT_CHARS, clean_documents, read_again, repairer, training_texts
from keystrata.llm.lookalikes import skeleton_letters

#: n-grams of 1 to GRAMS characters, hashed into SIZE places; centroids for each language; cosine below which a text is rejected.
#: Share of a language's texts that a cluster has at least.
GRAMS, SIZE, CENTROIDS, REJECT, LEAST_SHARE = 4, 1 << 17, 3, 0.05, 0.15
#: What a change of language costs, in letters whose language is beyond doubt, and letters of a sentence that count at most.
SWITCH, LONG = 5.0, 60
#: Labelled documents of a language that centroids are fitted on, chosen by hash of their key; none over FIT_CHARS characters.
FIT_ROWS = 300
#: Rounds of fitting on a sample of labelled documents; the lead that a text's label must have over the whole text, and
#: that from which a sentence of it counts as another language.
FIT_ROUNDS, OWN_LEAD, OTHER_LEAD = 2, 0.12, 0.5
#: Tokens whose sums a worker keeps, which bounds memory.
KEPT_TOKENS = 100_000
WORD = re.compile(r"[^\W\d_]+")
LATIN_WORD = re.compile(r"[A-Za-z’'\-]+\.?")
ROUGH_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？।])|\n+")
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> dict[int, str | None]:
    return skeleton_letters()


def folded_words(token: str) -> list[str]:
    """Lower-case words of plain letters, so that disguised letters count as what they look like."""
    if not token.isascii():
        token = unicodedata.normalize("NFC", token.translate(_letters()))
    return WORD.findall(token.lower())


def _unspaced(points: np.ndarray) -> np.ndarray:
    return (points >= 0x0E00) & (points <= 0x0E7F) | (points >= 0x3040) & (points <= 0x9FFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) for the n-grams of each length, and for whole words; word is the place in the list, ascending.

    Words begin and end with a blank. A word of a script without blanks counts by its n-grams alone.
    """
    if not words:
        return []
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    n, blank = len(text), text == 0x20
    owner = np.cumsum(blank) - 1  # of a blank, the word after it
    codes = _mixed(text.astype(np.uint64) + np.uint64(1))
    out, h = [], np.zeros(n, dtype=np.uint64)
    for size in range(1, GRAMS + 1):
        h = (h[: n - size + 1] if size > 1 else h) * np.uint64(0x100000001B3) + codes[size - 1 :]
        inner = np.concatenate([[0], np.cumsum(blank)])
        ok = ~blank if size == 1 else inner[size - 1 : n] - inner[1 : n - size + 2] == 0
        at = np.flatnonzero(ok)
        own = owner[at] if size == 1 else owner[at + blank[at].astype(np.int64)]
        out.append(((_mixed(h[at] + np.uint64(size)) % np.uint64(SIZE)).astype(np.int64), np.minimum(own, len(words) - 1)))
    begins = np.flatnonzero(blank)[:-1] + 1
    place = np.arange(n) - np.concatenate([[0], begins])[np.minimum(owner + 1, len(words))]
    whole = np.add.reduceat(np.where(blank, np.uint64(0), _mixed(codes + place.astype(np.uint64) * np.uint64(0xC2B2AE35))), begins)
    apart = ~_unspaced(text[begins])
    out.append(((_mixed(whole + np.uint64(77)) % np.uint64(SIZE)).astype(np.int64)[apart], np.flatnonzero(apart)))
    return out


@lru_cache(100_000)
def _token(token: str) -> tuple[tuple[str, ...], tuple[str, ...], int, int]:
    """The words of a token; those of it without Latin ones; its letters, and how many are in words of other scripts."""
    words = WORD.findall(token)
    own, n = tuple(folded_words(token)), sum(map(len, words))
    if token.isascii():
        return own, (), n, 0
    other = sum(len(w) for w in words if 2 * sum(c > "\u036f" for c in w) > len(w))
    return own, tuple(folded_words(LATIN_WORD.sub(" ", token))), n, other


def _vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each text's n-grams, ordered. In a text of another script, Latin words are names."""
    words, of = [], []
    for i, t in enumerate(texts):
        tokens = [_token(x) for x in t.split()]
        foreign = 5 * sum(x[3] for x in tokens) >= sum(x[2] for x in tokens) and any(x[3] for x in tokens)
        own = [w for x in tokens for w in x[1 if foreign else 0]]
        words += own
        of += [i] * len(own)
    found = features(words)
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    of = np.array(of)
    keys = np.concatenate([of[w] * SIZE + b for b, w in found])
    keys, counts = np.unique(keys, return_counts=True)
    return keys // SIZE, keys % SIZE, counts


class LanguageModel:
    """Centroids of the languages of labelled texts; the same texts always give the same centroids."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(x for x in texts if texts[x])
        rows = {x: sorted(texts[x]) for x in self.languages}
        found = {x: _vectors(rows[x]) for x in self.languages}
        total = sum(map(len, rows.values()))
        df = np.zeros(SIZE)
        for _, bucket, _ in found.values():
            df += np.bincount(bucket, minlength=SIZE)
        idf = np.log((1 + total) / (1 + df)).astype(np.float32)
        table, starts = [], []
        for x in self.languages:
            starts.append(len(table))
            text, bucket, count = found[x]
            table += list(_clusters(text, bucket, count * idf[bucket], len(rows[x])))
        self.starts = np.array(starts)
        # an n-gram's share of the dot product with each centroid, and its share of a text's squared length
        self.weights = np.ascontiguousarray((np.stack(table) * idf).T, dtype=np.float16) if table else np.zeros((SIZE, 0), np.float16)
        self.squares = idf**2
        self.forget()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("languages", "starts", "weights", "squares")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Sums by token are kept, as tokens recur; the sums of a text are those of its tokens."""
        self.known: dict[str, int] = {}
        width = self.weights.shape[1] + 1
        self.whole, self.rest = np.zeros((1024, width), np.float32), np.zeros((1024, width), np.float32)
        self.sizes = np.zeros((1024, 2), np.int64)

    def _learn(self, tokens: list[str]) -> None:
        words, of, sizes = [], [], []
        for i, t in enumerate(tokens):
            own, rest, *size = _token(t)
            words += own + rest
            of += [2 * i] * len(own) + [2 * i + 1] * len(rest)
            sizes.append(size)
        sums = np.zeros((2 * len(tokens), self.weights.shape[1] + 1), np.float32)
        of = np.array(of, dtype=np.int64)
        for lo in range(0, len(words), 5_000):
            for bucket, word in features(words[lo : lo + 5_000]):
                if len(bucket):
                    row = of[lo + word]
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    values = np.concatenate([self.weights[bucket].astype(np.float32), self.squares[bucket, None]], axis=1)
                    sums[row[first]] += np.add.reduceat(values, first)
        base = len(self.known)
        while base + len(tokens) > len(self.sizes):
            self.whole, self.rest, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.whole, self.rest, self.sizes))
        at = slice(base, base + len(tokens))
        self.whole[at], self.rest[at], self.sizes[at] = sums[::2], sums[1::2], sizes
        self.known.update(zip(tokens, range(base, base + len(tokens))))

    def sums(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece of text, the dot products with all centroids and, last, its squared length; and its letters.

        In its length, each occurrence of an n-gram counts for itself.
        """
        split = [p.split() for p in pieces]
        tokens = [t for s in split for t in s]
        if len(self.known) > KEPT_TOKENS:
            self.forget()
        new = [t for t in dict.fromkeys(tokens) if t not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        out, letters = np.zeros((len(split), self.whole.shape[1]), np.float32), np.zeros(len(split), np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            begins = (np.cumsum(sizes) - sizes)[some]
            n = np.add.reduceat(self.sizes[at], begins)
            # in a text of another script, Latin words are names
            other = 5 * n[:, 1] >= n[:, 0]
            other &= n[:, 1] > 0
            piece = np.repeat(np.arange(len(some)), sizes[some])
            values = np.where(other[piece, None], self.rest[at], self.whole[at])
            out[some], letters[some] = np.add.reduceat(values, begins), n[:, 0]
        return out, letters

    def by_language(self, sums: np.ndarray) -> np.ndarray:
        """The dot product with the nearest centroid of each language."""
        return np.maximum.reduceat(sums[:, :-1], self.starts, axis=1) if len(self.languages) else np.zeros((len(sums), 0), np.float32)

    def decide(self, sums: np.ndarray, letters: np.ndarray) -> list[tuple[str | None, float]]:
        """The language and the confidence of each piece of one document, by its sums."""
        if not len(sums) or not self.languages:
            return [(None, 0.0)] * len(sums)
        scores = self.by_language(sums)
        best = scores.max(1)
        near = best >= REJECT * np.sqrt(np.maximum(sums[:, -1], 1e-9))
        near &= best > 0
        if not near.any():
            return [(None, 0.0)] * len(sums)
        share = scores / np.maximum(best, 1e-9)[:, None]
        cost = np.where(near, np.minimum(letters, LONG), 0)[:, None] * (1 - share)
        among = np.unique(np.append(scores[near].argmax(1), cost.sum(0).argmin()))
        path = np.full(len(sums), among[0])
        if len(among) > 1:
            cost, back = cost[:, among], np.zeros((len(sums), len(among)), np.int64)
            so_far, here = cost[0].copy(), np.arange(len(among))
            for i in range(1, len(cost)):
                other = int(so_far.argmin())
                stay = so_far <= so_far[other] + SWITCH
                back[i] = np.where(stay, here, other)
                so_far = np.where(stay, so_far, so_far[other] + SWITCH) + cost[i]
            k = int(so_far.argmin())
            for i in range(len(cost) - 1, -1, -1):
                path[i] = among[k]
                k = back[i][k]
        rows = np.arange(len(sums))
        own = share[rows, path]
        share[rows, path] = -np.inf
        lead = np.where(near & (own > 0), 1 - np.maximum(share.max(1), 0) / np.maximum(own, 1e-9), 0) if len(self.languages) > 1 else near.astype(float)
        return [(self.languages[k], float(min(max(x, 0), 1))) for k, x in zip(path, lead)]

    def classify(self, text: str) -> tuple[str | None, float]:
        """The language of one text and the confidence, from 0 to 1; None if it is too far from every centroid."""
        return self.decide(*self.sums([text]))[0]


def _clusters(text: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors: spherical k-means from the vectors farthest apart."""
    length = np.sqrt(np.bincount(text, weight**2, n))
    weight = (weight / np.maximum(length[text], 1e-9)).astype(np.float32)

    def means(owner: np.ndarray, k: int) -> np.ndarray:
        m = np.bincount(owner[text] * SIZE + bucket, weight, k * SIZE).reshape(k, SIZE)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    def near(centres: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(text, weight * c[bucket], n) for c in centres], axis=1)

    def one(i: int) -> np.ndarray:
        mine = text == i
        return np.bincount(bucket[mine], weight[mine], SIZE)

    grams = np.bincount(text, minlength=n)
    long = grams >= np.median(grams)  # a short text lies far from all others whatever its words
    centres = one(int(np.where(long, near(means(np.zeros(n, np.int64), 1))[:, 0], -1).argmax()))[None]
    while len(centres) < min(CENTROIDS, n):
        centres = np.concatenate([centres, one(int(np.where(long, near(centres).max(1), 2).argmin()))[None]])
    owner = None
    for _ in range(rounds):
        last, owner = owner, near(centres).argmax(1)
        if last is not None and (last == owner).all():
            break
        held = np.bincount(owner, minlength=len(centres))
        centres = means(owner, len(centres))[held >= LEAST_SHARE * n]  # a centroid of few texts would draw in their words
        owner = owner if len(held) == len(centres) else None
    return centres


def fit_languages(training: dict[str, list[str]], sample: list[tuple[str, str]] = ()) -> LanguageModel:
    """Centroids of a labelled table and of a sample of documents whose labels may be wrong.

    Centroids of the table alone judge the sample first. A text counts for its label if most of it is in that language;
    sentences that surely are in another are left out.
    """
    model = LanguageModel(training)
    for _ in range(FIT_ROUNDS if sample else 0):
        pieces, of = [], []
        for i, (_, t) in enumerate(sample):
            parts = [p for p in ROUGH_END.split(t) if p.strip()]
            pieces += parts
            of += [i] * len(parts)
        sums, _ = model.sums(pieces)
        scores, of = model.by_language(sums), np.array(of, dtype=np.int64)
        whole = np.zeros((len(sample), len(model.languages)), np.float32)
        np.add.at(whole, of, scores)
        said = np.array([model.languages.index(x) for x, _ in sample])
        own = whole[np.arange(len(sample)), said]
        whole[np.arange(len(sample)), said] = 0
        sure = whole.max(1) <= (1 - OWN_LEAD) * own
        fits = scores[np.arange(len(of)), said[of]] >= (1 - OTHER_LEAD) * scores.max(1)
        kept: list[list[str]] = [[] for _ in sample]
        for i in np.flatnonzero(fits & sure[of]):
            kept[of[i]].append(pieces[i])
        texts = {x: list(v) for x, v in training.items()}
        for (x, _), parts in zip(sample, kept):
            if parts:
                texts[x].append(" ".join(parts))
        model = LanguageModel(texts)
    return model


def labelled_sample(df: DataFrame, languages: Sequence[str], key: str, text: str, label: str) -> list[tuple[str, str]]:
    """(language, text) of at most FIT_ROWS labelled rows of each language, those of least hash of the key."""
    said = F.lower(F.substring(F.trim(label), 1, 2))
    rows = df.select(said.alias("l"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("t")).where(F.col("l").isin(list(languages)))
    # the hashes alone are ranked, a partition's least before they are sent; texts are read for those below the bound
    bounds = rows.select("l", "h").distinct().selectExpr("l", "h", "row_number() OVER (PARTITION BY l ORDER BY h) AS k").where(F.col("k") <= FIT_ROWS)
    bound = {r["l"]: r["h"] for r in bounds.groupBy("l").agg(F.max("h").alias("h")).collect()}  # a row a language
    if not bound:
        return []
    within = F.lit(False)
    for x, h in sorted(bound.items()):
        within = within | ((F.col("l") == x) & (F.col("h") <= F.lit(h)))
    rows = rows.where(within & (F.length("t") <= FIT_CHARS)).select("l", "t").distinct()
    return sorted((r["l"], r["t"]) for r in rows.collect())  # FIT_ROWS a language


def fit_documents(df: DataFrame, training: dict[str, list[str]], key: str, text: str, label: str | None) -> LanguageModel:
    """The language model for a table of documents: from the labelled table's texts and a bounded sample of the documents'
    own labelled rows."""
    return fit_languages(training, labelled_sample(df, sorted(training), key, text, label) if label else [])


def language_segments(df: DataFrame, corpus: DataFrame, key: str = "id", text: str = "body", label: str = "language", order: str | None = "arrived_at") -> DataFrame:
    """(key STRING, begin_at BIGINT, end_at BIGINT, lang STRING, confidence DOUBLE, segments INT, label STRING).

    One row for each maximal run of whole sentences in one language, with the language and a confidence from 0 to 1: the
    mean of its sentences', by their lengths. Offsets count code points of the text as stored. Garbled sentences are
    judged as their repaired form. A key with several rows gives those of the last one by `order`; null keys and null,
    empty or blank texts give none; a text of signs alone has a null language. Sentences come from a boundary model of
    all texts given; centroids from the labelled table and FIT_ROWS labelled rows a language.
    """
    from keystrata.llm.sentences import boundaries, latest_rows, laid_out, split_units, with_entries

    rows = latest_rows(df, key, text, order, label)
    training = training_texts(corpus)
    fitted = clean_documents(df, training, text, label), fit_documents(df, training, key, text, label)
    shared = df.sparkSession.sparkContext.broadcast(fitted)  # bounded by PHRASE_SHARE, FIT_ROWS and SIZE
    told = rows.select(F.col("key").cast("string").alias("key"), "t", F.col(label).cast("string").alias("label")).where(F.col("t").rlike(r"\S"))
    told, model_of = with_entries(told, boundaries(rows, shared), shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, fixer = shared.value[1], repairer(shared.value[0])
        for batch in batches:
            out = []
            for i, layout, sums, letters, names in laid_out(batch["t"], languages):
                k, t, said = batch["key"].iloc[i], layout.text, batch["label"].iloc[i]
                units = split_units(layout, model_of(batch, i), names)
                if not units:
                    continue
                garbled = fixer.repair(t)[1]
                if garbled:
                    sums, letters = languages.sums([read_again(t[b:e], next((c for x, y, c in garbled if x < e and y > b), ())) for b, e, _ in units])
                else:
                    firsts = [f for _, _, f in units]
                    sums, letters = np.add.reduceat(sums, firsts), np.add.reduceat(letters, firsts)
                runs: list[list] = []
                for (b, e, _), (x, sure) in zip(units, languages.decide(sums, letters)):
                    if runs and runs[-1][2] == x:
                        runs[-1][1] = e
                        runs[-1][3] += sure * (e - b)
                        runs[-1][4] += e - b
                    else:
                        runs.append([b, e, x, sure * (e - b), e - b])
                out += [(k, b, e, x, s / n, len(runs), said) for b, e, x, s, n in runs]
            yield pd.DataFrame(out, columns=["key", "begin_at", "end_at", "lang", "confidence", "segments", "label"])

    found = told.mapInPandas(run, "key string, begin_at long, end_at long, lang string, confidence double, segments int, label string")
    return found.withColumnRenamed("key", key)


def mislabelled(segments: DataFrame) -> DataFrame:
    """Of language_segments' rows, those of texts whose label is missing or names another language, or that are mixed."""
    said = F.lower(F.substring(F.trim("label"), 1, 2))
    return segments.where(F.col("label").isNull() | (F.col("segments") > 1) | ~said.eqNullSafe(F.col("lang")))
