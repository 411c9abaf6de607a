"""Long spans that occur verbatim in more than one text.

Windows are compared level by level, each about twice as long as the last: only windows that more than one text holds
are extended. Where windows begin is chosen by their content (the least hash among neighbours), so that any two texts
with a common span of `least` characters have a common first window inside it. A window of half that length which
still recurs is extended to every window of full length about it; those that recur are the shared spans. Exact copies
of a text are one class throughout: only classes are compared, and members are added to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.session import discard, materialize

#: Characters hashed at a time: as many as a core's cache holds the arrays of. A longer text is hashed whole.
SLICE = 50_000
#: Places of one text whose surroundings are sent on at a time.
AT_A_TIME = 5_000
GRAM = 32
#: Rows of a few numbers up to which a table is broadcast: about 16 MB. Beyond it, joins shuffle.
BROADCAST_ROWS = 250_000
M1, M2, BASE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93


_digest = xxhash.xxh3_128_digest


def _mix(h: np.ndarray, by: int = M2) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(by)
    h ^= h >> np.uint64(29)
    return h


def _doubled(points: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of the windows of 1, 2, 4 ... upto characters that begin at each place; the last ones run out short."""
    h = _mix(points.astype(np.uint64) * np.uint64(M1) + np.uint64(1))
    out, n, base = {1: h}, 1, BASE
    while n < upto:
        longer = h * np.uint64(base)
        longer[:-n or None] += h[n:]
        h, n, base = longer, 2 * n, base * base % 2**64
        out[n] = h
    return out


def _sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over the w values from each place on, fewer near the end."""
    n = 1
    while 2 * n <= w:
        b = a.copy()
        b[:-n] = op(a[:-n], a[n:])
        a, n = b, 2 * n
    if n < w:
        b = a.copy()
        b[: n - w] = op(a[: n - w], a[w - n :])
        a = b
    return a


def window_places(points: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of windows chosen by content in texts that lie end to end, with the hashes of a quarter and half of `least`."""
    half, quarter = least // 2, least // 4
    gram = min(GRAM, quarter)
    top = 1 << (half.bit_length() - 1)
    low = 1 << (quarter.bit_length() - 1)
    hashes = _doubled(points, top)
    g = hashes[1 << (gram.bit_length() - 1)]
    order = _mix(g.copy(), M1)
    w = half + 1
    least_of = _sliding(order, w, np.minimum)
    # a window of places counts if the span of `least` characters from its first place on lies in one text
    whole = np.zeros(len(points) + 1, dtype=np.int32)
    long = ends - begins >= least
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, ends[long] - least + 1, -1)
    least_of[np.cumsum(whole[:-1]) == 0] = 0
    # a place is chosen if its hash is the least of some such window, that is, of one window that holds it
    best = _sliding(least_of[::-1], w, np.maximum)[::-1]
    at = np.flatnonzero((order == best) & (best > 0))
    owner = np.searchsorted(ends, at, side="right")
    at = at[at + half <= ends[owner]]
    short = _mix(hashes[low][at] * np.uint64(BASE) + hashes[low][at + quarter - low])
    double = _mix(hashes[top][at] * np.uint64(BASE) + hashes[top][at + half - top])
    return at, short.view(np.int64), double.view(np.int64)


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= SLICE):
                    size += len(texts[end])
                    end += 1
                lengths = np.array([len(t) for t in texts[begin:end]])
                points = np.frombuffer("".join(texts[begin:end]).encode("utf-32-le", "replace"), dtype=np.uint32)
                ends = np.cumsum(lengths)
                at, short, double = window_places(points, ends - lengths, ends, least)
                owner = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[begin:end][owner]), pa.array((at - (ends - lengths)[owner]).astype(np.int32)), pa.array(short), pa.array(double)],
                    ["c", "pos", "short", "double"],
                )
                begin = end

    return run


def _small(df: DataFrame, items: str | None = None) -> DataFrame:
    """df, broadcast if a count shows that it is small; items names an array whose elements count."""
    size = df.agg(F.sum(F.size(items))).first()[0] or 0 if items else df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def _recurring(df: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose value of `by` occurs in more than one class, and the table of those values; counted with a partial
    aggregate before the shuffle."""
    more = df.groupBy(by).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(by)
    more = materialize(more, "recurring")
    return df.join(_small(more), by, "left_semi"), more


class SharedSpans:
    """The spans of `least` characters (code points) or more that several texts of a table have in common.

    Texts shorter than `least`, null texts and null keys take part in nothing. Rows repeated with the same key and text
    count once; rows with the same key but other texts are looked at each for itself, and a key isn't paired with itself.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400) -> None:
        if least < 32:
            raise ValueError("least must be 32 characters or more")
        self.least = least
        rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())
        rows = rows.where(F.length("text") >= least)
        self.rows = rows.select("doc", F.xxhash64("text").alias("c"), F.length("text").alias("n"), "text")

    def members(self) -> DataFrame:
        """(c, doc, n): the class of each text, the same for exact copies."""
        return self.rows.select("c", "doc", "n").distinct()

    def windows(self) -> DataFrame:
        """(k, c, start): the windows of `least` characters that more than one class holds, k standing for their text."""
        return _recurring(self._candidates(), "k")[0]

    def _candidates(self) -> DataFrame:
        """(k, c, start): windows of `least` characters, all that more than one class holds among them, some of them repeated."""
        least, half = self.least, self.least // 2
        chosen = self.rows.select("c", "text").mapInArrow(_windows(least), "c long, pos int, short long, double long")
        # each level is dropped as soon as the next is written
        first = materialize(chosen, "windows")
        second, shorts = _recurring(first, "short")
        second = materialize(second.select("c", "pos", "double").distinct(), "second")
        discard(first, shorts)
        third, doubles = _recurring(second, "double")
        one = self.rows.groupBy("c").agg(F.min("doc").alias("doc"))
        places = third.groupBy("c").agg(F.sort_array(F.collect_set("pos")).alias("places"))  # of one text
        wanted = materialize(places.join(one, "c"), "wanted")
        discard(second, doubles)
        about = self.rows.join(_small(wanted, "places"), ["c", "doc"]).select("c", "text", "places")
        step = max(1, half // 4)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, text, places in zip(*(x.to_pylist() for x in batch.columns)):
                    for i in range(0, len(places), AT_A_TIME):
                        some = places[i : i + AT_A_TIME]
                        columns = [[c] * len(some), some, [text[max(0, p - half) : p] for p in some], [text[p : p + least] for p in some]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, cut_schema)], schema=cut_schema)

        cut_schema = pa.schema([("c", pa.int64()), ("pos", pa.int32()), ("before", pa.string()), ("after", pa.string())])
        around = materialize(about.mapInArrow(cut, "c long, pos int, before string, after string"), "around")
        discard(wanted)

        def nearly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What all full windows of a stretch of shifts have in common; it lies in the text if any of them does."""
            stretches = [(shift, min(half, shift + step - 1)) for shift in range(0, half + 1, step)]
            for batch in batches:
                keys, cs, at, shifts = [], [], [], []
                for c, p, before, after in zip(*(x.to_pylist() for x in batch.columns)):
                    left, data = len(before), memoryview((before + after).encode("utf-32-le", "replace"))
                    n = len(data) // 4
                    for shift, last in stretches:
                        lo, hi = left - shift, left - last + least
                        if lo >= 0 and hi <= n:
                            keys.append(_digest(data[4 * lo : 4 * hi]))
                            cs.append(c)
                            at.append(p)
                            shifts.append(shift)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, cs, at, shifts), near_schema)], schema=near_schema)

        def fully(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, cs, starts = [], [], []
                seen: set[tuple[int, int]] = set()  # neighbouring places share most of their windows
                for c, p, before, after, shifts in zip(*(x.to_pylist() for x in batch.columns)):
                    left, data = len(before), memoryview((before + after).encode("utf-32-le", "replace"))
                    n = len(data) // 4
                    for shift in shifts:
                        for s in range(max(shift, left + least - n), min(left, half, shift + step - 1) + 1):
                            at = c, p - s
                            if at not in seen:
                                seen.add(at)
                                keys.append(_digest(data[4 * (left - s) : 4 * (left - s + least)]))
                                cs.append(c)
                                starts.append(p - s)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, cs, starts), full_schema)], schema=full_schema)

        near_schema = pa.schema([("k", pa.binary()), ("c", pa.int64()), ("pos", pa.int32()), ("shift", pa.int32())])
        full_schema = pa.schema([("k", pa.binary()), ("c", pa.int64()), ("start", pa.int32())])
        close = materialize(around.mapInArrow(nearly, "k binary, c long, pos int, shift int"), "nearly")
        kept, keys = _recurring(close, "k")
        kept = materialize(kept.groupBy("c", "pos").agg(F.collect_set("shift").alias("shifts")), "close")  # a few for each place
        discard(close, keys)
        full = around.join(_small(kept, "shifts"), ["c", "pos"]).select("c", "pos", "before", "after", "shifts")
        full = materialize(full.mapInArrow(fully, "k binary, c long, start int"), "full")
        discard(around, kept)
        return full

    def held(self, windows: DataFrame) -> DataFrame:
        """(k, c): the classes that hold each of some windows, such that any two classes that share one share one of these.

        Of windows held by the same classes, as the many of one long span are, there is one.
        """
        seeds = [F.sum(F.xxhash64("c", F.lit(s)).bitwiseAND(F.lit((1 << 40) - 1))).alias(f"s{s}") for s in (1, 2)]
        held = windows.select("k", "c").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("m"), *seeds)
        one = materialize(held.where("m > 1").groupBy("m", "s1", "s2").agg(F.min("k").alias("k")).select("k"), "held")
        return windows.select("k", "c").join(_small(one), "k", "left_semi").distinct()

    def groups(self) -> DataFrame:
        """(k, doc): the texts that hold each such window, a row for each text and not for each pair of them."""
        return self.held(self._candidates()).join(self.members().select("c", "doc"), "c").select("k", "doc").distinct()

    def levels(self, windows: DataFrame) -> DataFrame:
        """(c, start, length): of each window of `least` characters that recurs, the longest of `least` times a power of two
        that begins there and recurs, found by doubling until none is left: two windows of one length that follow upon one
        another make one of twice the length."""
        now, length, found = materialize(windows.select("k", "c", "start").distinct(), "level"), self.least, None
        while True:
            rows = now.select("c", "start", F.lit(length).alias("length"))
            found = rows if found is None else found.unionByName(rows)
            after = now.select("c", (F.col("start") - length).alias("start"), F.col("k").alias("next"))
            longer = now.join(after, ["c", "start"]).select(F.unhex(F.sha2(F.concat("k", "next"), 256)).alias("k"), "c", "start")
            longer = materialize(longer, "doubled")
            kept = materialize(_recurring(longer, "k")[0], "level")
            discard(longer)
            if kept.isEmpty():
                return found.groupBy("c", "start").agg(F.max("length").alias("length"))
            now, length = kept, 2 * length

    def stretches(self) -> DataFrame:
        """(doc, begin, end, longest): the maximal stretches of each text in which every `least` characters recur in other
        texts, and the longest window in each, of `least` times a power of two, that recurs as a whole.

        A text with exact copies is one stretch, as long as itself.
        """
        spans = self.levels(self.windows())
        order = Window.partitionBy("c").orderBy("start")
        fresh = (F.col("start") > F.coalesce(F.lag("start").over(order), F.lit(-self.least - 1)) + self.least).cast("int")
        islands = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
        made = islands.groupBy("c", "island").agg(F.min("start").alias("begin"), (F.max("start") + self.least).alias("end"), F.max("length").alias("longest"))
        members = self.members()
        copies = members.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("c")
        own = members.join(copies, "c", "left_semi").select("doc", F.lit(0).alias("begin"), F.col("n").alias("end"), F.col("n").alias("longest"))
        others = members.join(copies, "c", "left_anti").join(made, "c").select("doc", "begin", "end", "longest")
        return own.unionByName(others)

    def class_pairs(self, windows: DataFrame) -> DataFrame:
        """(c_a, c_b), c_a < c_b: the classes that have a span in common, each pair once."""
        kept = self.held(windows)
        a, b = kept.withColumnRenamed("c", "c_a"), kept.withColumnRenamed("c", "c_b")
        return a.join(b, "k").where("c_a < c_b").select("c_a", "c_b").distinct()

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every two keys whose texts have a span in common, exact copies of one text among them."""
        members = self.members().select("c", "doc")
        classes = self.class_pairs(self._candidates())
        left, right = (members.select(F.col("c").alias(f"c_{x}"), F.col("doc").alias(x)) for x in "ab")
        across = classes.join(left, "c_a").join(right, "c_b")
        several = members.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("c").alias("c_a"))
        copies = left.join(several, "c_a", "left_semi").join(right.withColumnRenamed("c_b", "c_a"), "c_a").where("a < b")
        both = across.select("a", "b").unionByName(copies.select("a", "b")).where("a <> b")
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def shared(self) -> DataFrame:
        """(doc, n, shared, copies): how many of each text's n characters lie in spans that other texts hold too.

        One row for each text of `least` characters or more; copies is the number of other rows with the very same text.
        """
        spans = self.windows().select("c", "start").distinct()
        following = F.lead("start").over(Window.partitionBy("c").orderBy("start"))
        covered = spans.withColumn("new", F.least(F.lit(self.least), F.coalesce(following - F.col("start"), F.lit(self.least))))
        covered = covered.groupBy("c").agg(F.sum("new").alias("shared"))
        members = self.members()
        sizes = members.groupBy("c").agg((F.count(F.lit(1)) - 1).alias("copies"))
        rows = members.join(sizes, "c").join(covered, "c", "left")
        shared = F.when(F.col("copies") > 0, F.col("n")).otherwise(F.coalesce("shared", F.lit(0)))
        return rows.select("doc", "n", shared.cast("long").alias("shared"), "copies")


def shared_span_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts have a verbatim span of `least` characters or more in common.

    Null keys and texts, and texts shorter than that, give no rows, nor does an empty table. Repeated rows count once.
    Other columns are ignored.
    """
    return SharedSpans(df, key, text, least).pairs().select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
