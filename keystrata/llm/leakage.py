"""Held-out evaluation texts that occur in a corpus, found in a positional inverted index of its words.

A word is a maximal run of letters or digits in lower case; what lies between words doesn't matter. The index holds a
posting (text, position) for each corpus word that some item has. Every window of an item's words is looked up by its
rarest word; the postings of the item's other words, moved by their offsets, must then fall on the same places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.session import materialize

WORD = r"[\p{L}\p{N}]+"
#: Rows of a few numbers, and bytes of words beside them, up to which a table is broadcast: about 16 MB. Beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 8_000_000
#: Of an item's looked-up places, those that a proximity match is sure to have: more make for fewer bands to count out.
SURE = 4


def words(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos INT, word STRING) for each word of each text; a null or wordless text gives no rows."""
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("pos", "word"))
    return rows.withColumn("word", F.lower("word"))


def _small(df: DataFrame, words: str | None = None) -> DataFrame:
    """df, broadcast if a count shows that it is small; words names a column of strings, whose bytes count too."""
    if words:
        rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(words)), F.lit(0))).first()
    else:
        rows, size = df.limit(BROADCAST_ROWS + 1).count(), 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


class LeakIndex:
    """The positional index of a corpus for a set of evaluation items.

    Rows with a null key, and null or wordless texts, take part in nothing. Repeated rows count once. Two rows with
    the same key but other texts are looked at each for itself.
    """

    def __init__(self, corpus: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run: int = 15) -> None:
        self.run = run
        asked = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull())
        asked = asked.dropDuplicates().withColumn("v", F.xxhash64("item", "text"))
        of_items = words(asked, ["item", "v"], "text")
        of_items = of_items.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("v")))
        self.item_words = materialize(of_items.withColumn("w", F.xxhash64("word")), "item-words")
        vocabulary = _small(self.item_words.select("word", "w").distinct(), "word")
        texts = corpus.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())
        of_texts = words(texts.withColumn("t", F.xxhash64("text")), ["doc", "t"], "text")
        self.postings = materialize(of_texts.join(vocabulary, "word").select("w", "doc", "t", "pos"), "postings")

    def anchors(self) -> DataFrame:
        """(v, off, w): the rarest word of each window of `run` words, by its number of postings; ties go to the first."""
        counts = self.postings.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
        counted = self.item_words.join(_small(counts), "w", "left")
        window = Window.partitionBy("v").orderBy("pos").rowsBetween(0, self.run - 1)
        rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("pos").alias("off"), F.col("w"))).over(window)
        windows = counted.withColumn("a", rarest).where(F.col("pos") + self.run <= F.col("n"))
        return windows.select("v", "a.off", "a.w").distinct()

    def matches(self) -> DataFrame:
        """(item, v, n, doc, t, diag, off): item words whose postings lie in the order and distance they have in the item."""
        hits = self.postings.join(_small(self.anchors()), "w")
        diagonals = materialize(hits.select("v", "doc", "t", (F.col("pos") - F.col("off")).alias("diag")).distinct(), "diagonals")
        near = self.postings.join(_small(diagonals.select("doc", "t").distinct()), ["doc", "t"], "left_semi")
        wanted = diagonals.join(_small(self.item_words.select("item", "v", "n", F.col("pos").alias("off"), "w")), "v")
        wanted = wanted.withColumn("pos", F.col("diag") + F.col("off"))
        return wanted.join(near, ["doc", "t", "pos", "w"]).select("item", "v", "n", "doc", "t", "diag", "off").distinct()

    def phrases(self) -> DataFrame:
        """(doc, item, words): the longest run of an item's words that a document holds, of `run` words at least."""
        line = Window.partitionBy("doc", "t", "v", "diag").orderBy("off")
        runs = self.matches().withColumn("island", F.col("off") - F.row_number().over(line))
        runs = runs.groupBy("item", "v", "doc", "t", "diag", "island").agg(F.count(F.lit(1)).alias("words"))
        return runs.where(F.col("words") >= self.run).groupBy("doc", "item").agg(F.max("words").alias("words"))

    def rarest(self, share: float) -> DataFrame:
        """(v, off, w, least): an item's rarest places, and how many of them a match of this share must have at least.

        A match lacks at most m of an item's places, so it has all but m of any: of the m + SURE rarest, SURE.
        """
        counts = self.postings.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
        places = self.item_words.select("v", "n", F.col("pos").alias("off"), "w").distinct().join(_small(counts), "w", "left")
        lacking = F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9)
        order = Window.partitionBy("v").orderBy(F.coalesce("df", F.lit(0)), "off")
        places = places.withColumn("k", F.row_number().over(order)).where(F.col("k") <= lacking + SURE)
        return places.select("v", "off", "w", (F.least(lacking + SURE, F.col("n")) - lacking).alias("least"))

    def near(self, share: float = 0.8, slack: int = 3) -> DataFrame:
        """(doc, item, share): documents that hold this share of an item's words in its order, about their distances.

        Words may be missing or put in: places that differ by up to `slack` from one another still count. Items of any
        length are looked for.
        """
        band = F.explode(F.sequence(F.col("pos") - F.col("off") - slack, F.col("pos") - F.col("off"))).alias("band")
        hits = self.postings.join(_small(self.rarest(share)), "w").select("v", "doc", "t", "off", "least", band)
        bands = hits.groupBy("v", "doc", "t", "band").agg(F.count_distinct("off").alias("k"), F.first("least").alias("least"))
        bands = materialize(bands.where("k >= least").select("v", "doc", "t", "band"), "bands")
        near = self.postings.join(_small(bands.select("doc", "t").distinct()), ["doc", "t"], "left_semi")
        wanted = bands.join(_small(self.item_words.select("item", "v", "n", F.col("pos").alias("off"), "w")), "v")
        wanted = wanted.withColumn("pos", F.explode(F.sequence(F.col("band") + F.col("off"), F.col("band") + F.col("off") + slack)))
        found = wanted.join(near, ["doc", "t", "pos", "w"]).groupBy("item", "v", "doc", "t", "band").agg((F.count_distinct("off") / F.first("n")).alias("share"))
        return found.where(F.col("share") >= share - 1e-9).groupBy("doc", "item").agg(F.max("share").alias("share"))


def leaked_items(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run: int = 15) -> DataFrame:
    """(doc, item, words) as doc and item are named: each document with each item of which it holds `run` words or more in a row.

    Empty tables, items shorter than `run` words, and null keys or texts give no rows; other columns are ignored.
    """
    found = LeakIndex(corpus, items, doc, text, item, item_text, run).phrases()
    return found.select(F.col("doc").alias(doc), F.col("item").alias(item), F.col("words").cast("int").alias("words"))

