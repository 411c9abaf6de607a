"""Encoding a corpus with the byte-level BPE vocabulary of a public tokenizer.

Texts are cut into words by array operations on their code points. The distinct words a worker hasn't met yet go to
DuckDB: token-position rows join the merge table, each word's leftmost pair of least rank is contracted in a recursive
query until no pair is left, and an ordered aggregation gives each word's ids. The ids of a document are those of its
words in their order. Nothing is shuffled: a document is encoded where it is read.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points encoded at a time, and distinct words kept by a worker: they bound memory, not what is encoded.
SLICE, KEPT_WORDS = 1_500_000, 400_000
#: Bytes of a word from which many places are contracted in a round, as rounds of one place would be too many.
LONG_WORD = 400
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The white space of the splitting pattern, and the suffixes that it cuts after an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[[c for c in WHITE if not 0x1C <= c <= 0x1F]] = SPACE
    return kinds


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words begin in the texts whose code points lie end to end; begins has the first position of each text."""
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[begins[begins < n]] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # a run of white space gives its last character away: a blank to the next word, any other to a word of its own
    last = np.flatnonzero((kind == SPACE) & ~first[1:] & np.append(kind[1:] != SPACE, True))
    start[last] = True
    blank = last[points[last] == 0x20]
    start[blank + 1] = False
    # an apostrophe that begins a word cuts one of the suffixes off
    for i in np.flatnonzero(points == 0x27):
        if not start[i] or points[i] != 0x27:
            continue
        for suffix in SUFFIXES:
            j = i + 1 + len(suffix)
            if j <= n and not first[i + 1 : j].any() and all(points[i + 1 + k] == ord(x) for k, x in enumerate(suffix)):
                start[i + 1 : j] = False
                start[j] = True
                # what follows is cut as if the text began there
                break
    return np.flatnonzero(start[:n])


class WordEncoder:
    """The ids of words by the merges of a vocabulary file, found in DuckDB and kept while there is room."""

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        table = pa.table(
            {
                "a": pa.array([vocabulary[x] for x, _ in merges], pa.int32()),
                "b": pa.array([vocabulary[y] for _, y in merges], pa.int32()),
                "rank": pa.array(range(len(merges)), pa.int32()),
                "ab": pa.array([vocabulary[x + y] for x, y in merges], pa.int32()),
            }
        )
        self.con.register("merges_in", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        at = {c: b for b, c in enumerate(byte_letters())}
        self.spelling = [(sum({1 << at[c] for c in x if c in at}), len(x)) for x in vocabulary]  # the bytes of each token, and how many
        self.byte_ids = np.array([vocabulary[c] for c in byte_letters()], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 20, dtype=np.int32), [0], 0

    def learn(self, words: list[bytes]) -> None:
        """Encode words not met before."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        w = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tok = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        following = np.append(tok[1:], -1)
        following[np.cumsum(sizes) - 1] = -1
        letters = {"w": w.astype(np.int32), "pos": pos.astype(np.int32), "tok": tok, "following": following.astype(np.int32)}
        parts = []
        for wanted in (sizes <= LONG_WORD, sizes > LONG_WORD):
            if wanted.any():
                self.con.register("letters", pa.table({k: v[wanted[w]] for k, v in letters.items()}))
                long = [x for x, is_long in zip(words, sizes > LONG_WORD) if is_long] if sizes[wanted].min() > LONG_WORD else []
                parts.append(self._merge_long(long) if long else self._merge_short())
        self.con.unregister("letters")
        rows = pa.concat_tables(parts).sort_by("w")
        lists = rows.column("ids").combine_chunks()
        flat = lists.flatten().to_numpy()
        lengths = np.diff(lists.offsets.to_numpy())
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        base = len(self.ends) - 1
        self.ends.extend((self.used + np.cumsum(lengths)).tolist())
        self.used += len(flat)
        for k, word in enumerate(words):
            self.known[word] = base + k

    def _merge_short(self) -> pa.Table:
        """(w, ids) of the words in letters, which are of LONG_WORD bytes at most."""
        # a round: the least rank among a word's pairs, its leftmost place, and the contraction there. A word leaves
        # with the round in which no pair of it can be merged; its rows then carry done.
        return self.con.sql(
            """
            WITH RECURSIVE step(w, pos, tok, following, done) AS (
                SELECT w, pos, tok, following, false FROM letters
                UNION ALL
                SELECT w, pos,
                       CASE WHEN pos = best % 65536 THEN ab ELSE tok END,
                       CASE WHEN pos = best % 65536 THEN next_following
                            WHEN next_pos = best % 65536 THEN next_ab ELSE following END,
                       best IS NULL
                FROM (
                    SELECT p.w, p.pos, p.tok, p.following, m.ab,
                           min(m.rank::BIGINT * 65536 + p.pos) OVER (word ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best,
                           lag(p.pos) OVER word AS prior, lead(p.pos) OVER word AS next_pos,
                           lead(p.following) OVER word AS next_following, lead(m.ab) OVER word AS next_ab
                    FROM step p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.following
                    WHERE NOT p.done
                    WINDOW word AS (PARTITION BY p.w ORDER BY p.pos)
                )
                WHERE best IS NULL OR prior IS NULL OR prior <> best % 65536
            )
            SELECT w, list(tok ORDER BY pos) AS ids FROM step WHERE done GROUP BY w ORDER BY w
            """
        ).to_arrow_table()

    def _merge_long(self, words: list[bytes]) -> pa.Table:
        """(w, ids) of words of any length."""
        own = sum({1 << b for b in set().union(*words)})
        reach = max((n for spelt, n in self.spelling if not spelt & ~own), default=1)
        # A round contracts every pair of a rank that none within reach undercuts: merges of lower rank grow from pairs of
        # lower rank, and no token of these bytes is longer than `reach`, so what lies farther off can't take a part of this pair
        # before its turn. Of overlapping places, as in "aaaa", the first, third and so on are taken, once all of them may be.
        return self.con.sql(
            f"""
            WITH RECURSIVE step(w, pos, tok, following, done) AS (
                SELECT w, pos, tok, following, false FROM letters
                UNION ALL
                SELECT w, pos, new_tok, CASE WHEN best IS NULL THEN NULL ELSE lead(new_tok, 1, -1) OVER (PARTITION BY w ORDER BY pos) END, best IS NULL
                FROM (
                    SELECT w, pos, best, CASE WHEN taken THEN ab ELSE tok END AS new_tok,
                           coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS gone
                    FROM (
                        SELECT *, coalesce(bool_and(hit) OVER (PARTITION BY w, rank, island) AND (place - min(place) OVER (PARTITION BY w, rank, island)) % 2 = 0, false) AS taken
                        FROM (
                            SELECT *, place - row_number() OVER (PARTITION BY w, rank ORDER BY pos) AS island
                            FROM (
                                SELECT p.w, p.pos, p.tok, m.ab, min(m.rank) OVER (PARTITION BY p.w) AS best, m.rank,
                                       coalesce(m.rank = min(m.rank) OVER (PARTITION BY p.w ORDER BY p.pos RANGE BETWEEN {reach} PRECEDING AND {2 * reach} FOLLOWING), false) AS hit,
                                       row_number() OVER (PARTITION BY p.w ORDER BY p.pos) AS place
                                FROM step p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.following
                                WHERE NOT p.done
                            )
                        )
                    )
                )
                WHERE NOT gone
            )
            SELECT w, list(tok ORDER BY pos) AS ids FROM step WHERE done GROUP BY w ORDER BY w
            """
        ).to_arrow_table()

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; an empty list for a null or empty one."""
        lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(lengths) - lengths
        joined = "".join(t for t in texts if t)
        if not joined:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, dtype=np.int32)), pa.array([], pa.int32()))
        raw = joined.encode("utf-8", "replace")
        if len(raw) == len(joined):
            points = np.frombuffer(raw, dtype=np.uint8)
        else:
            points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        starts = word_starts(points, begins)
        word_of_text = np.searchsorted(starts, np.append(begins, len(points)))
        at = starts
        if len(raw) != len(joined):
            wide = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))
            at = np.concatenate([[0], wide])[starts]
        offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self.forget()
        if new := [x for x in distinct if x not in self.known]:
            self.learn(new)
        place = np.fromiter((self.known[x] for x in distinct), dtype=np.int64, count=len(distinct))
        ends = np.array(self.ends)
        code = place[words.indices.to_numpy()]
        lo, size = ends[code], ends[code + 1] - ends[code]
        out = np.cumsum(size)
        total = int(out[-1])
        flat = self.ids[np.arange(total) + np.repeat(lo - (out - size), size)]
        offsets_out = np.concatenate([[0], out])[word_of_text]
        return pa.ListArray.from_arrays(pa.array(offsets_out.astype(np.int32)), pa.array(flat))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, the rest moved up in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_encoders: dict[str, WordEncoder] = {}


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > SLICE:
            yield begin, i
            begin, size = i, 0
        size += n
    yield begin, len(texts)


def encode_corpus(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The token ids of each row's text by a vocabulary file: (key, ids ARRAY<INT>), one row for each input row.

    path is that of a byte-level BPE file of the `tokenizers` library, readable on every executor. No special tokens
    are added, and their strings in a text are ordinary text. A null or empty text gives an empty list; a blank text
    gives the ids of its blanks. Texts are encoded whole, whatever their length. Repeated rows stay repeated, a null
    key stays null, and other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts):
                ids = _encoders[path].encode(texts[begin:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), ids], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
