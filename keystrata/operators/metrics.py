"""Corpus weights and evaluation measures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import text


def tfidf(terms: DataFrame, docs_total: int, doc: str = "doc", term: str = "term", tf: str = "tf") -> DataFrame:
    """(doc, term, tf, df, score): tf times ln((1 + N) / (1 + df)) + 1, df being the documents that hold the term.

    One document frequency for each term is joined back to its rows; a term in many documents is split by adaptive
    skew joins, and the count is combined before it is sent.
    """
    rows = terms.select(F.col(doc).alias("doc"), F.col(term).alias("term"), F.col(tf).alias("tf"))
    df = rows.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    idf = F.log((1.0 + docs_total) / (1 + F.col("df"))) + 1
    return rows.join(df, "term").select("doc", "term", "tf", "df", (F.col("tf") * idf).alias("score"))


def overlap_at_k(a: DataFrame, b: DataFrame, k: int, doc: str = "doc", item: str = "item", rank: str = "rank") -> DataFrame:
    """(doc, overlap): how many of the first k items two rankings of a document share; 0 where none is shared."""
    x, y = (df.where(F.col(rank) <= k).select(F.col(doc).alias("doc"), F.col(item).alias("item")).distinct() for df in (a, b))
    shared = x.join(y, ["doc", "item"]).groupBy("doc").agg(F.count(F.lit(1)).alias("overlap"))
    return x.select("doc").distinct().join(shared, "doc", "left").select("doc", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def precision_at_k(predicted: DataFrame, gold: DataFrame, k: int, doc: str = "doc", item: str = "item", rank: str = "rank") -> DataFrame:
    """(doc, precision): the share of the first k items that the gold table has; fewer than k predictions count as misses."""
    hits = overlap_at_k(predicted, gold.select(doc, item).withColumn(rank, F.lit(1)), k, doc, item, rank)
    return hits.select("doc", (F.col("overlap") / F.lit(k)).alias("precision"))


def leading_matches(a: DataFrame, b: DataFrame, doc: str = "doc", item: str = "item", rank: str = "rank") -> DataFrame:
    """(doc, matches): how many items two rankings, numbered from 1, have in common before they first differ."""
    x = a.select(F.col(doc).alias("doc"), F.col(rank).alias("rank"), F.col(item).alias("x"))
    y = b.select(F.col(doc).alias("doc"), F.col(rank).alias("rank"), F.col(item).alias("y"))
    both = x.join(y, ["doc", "rank"], "left")
    wrong = F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("rank")))
    return both.groupBy("doc").agg((F.coalesce(wrong, F.max("rank") + 1) - 1).cast("long").alias("matches"))


def bio_phrases(rows: DataFrame, doc: str = "doc", pos: str = "pos", word: str = "word", tag: str = "tag") -> DataFrame:
    """(doc, begin, phrase): the phrases that tags B, I and O mark out; an I that follows no phrase begins one."""
    order = Window.partitionBy("doc").orderBy("pos")
    r = rows.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.col(word).alias("word"), F.upper(F.substring(tag, 1, 1)).alias("tag"))
    before = F.coalesce(F.lag("tag").over(order), F.lit("O"))
    starts = (F.col("tag") == "B") | ((F.col("tag") == "I") & ~before.isin("B", "I"))
    r = r.withColumn("starts", starts.cast("int")).withColumn("phrase_no", F.sum("starts").over(order)).where(F.col("tag").isin("B", "I"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word)
    return r.groupBy("doc", "phrase_no").agg(F.min("pos").alias("begin"), F.array_join(words, " ").alias("phrase")).drop("phrase_no")


def latency_summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, total, mean, p50, p95): percentiles are values that occur, the mean of nothing is 0."""
    v = F.col(value)
    return rows.groupBy(by).agg(
        F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"),
    )


def candidate_counts(texts: DataFrame, stopwords: DataFrame, doc: str = "doc", text: str = "text", lang: str = "lang", n: int = 3) -> DataFrame:
    """(doc, phrase, n): how often each run of up to n words occurs within the sentences of a text, marks being words too.

    Phrases neither begin nor end with a stopword, and single words have three letters or more. Null texts give no rows.
    """
    rows = texts.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.monotonically_increasing_id().alias("row"))
    toks = word_rows(rows)
    listed = stopwords.select(F.col("lang").alias("key"), "word", F.lit(True).alias("stop")).distinct()
    toks = toks.withColumn("key", F.lower(F.substring("lang", 1, 2))).join(listed, ["key", "word"], "left")
    within = Window.partitionBy("row", "sent").orderBy("pos")
    for k in range(1, n):
        toks = toks.withColumn(f"w{k}", F.lag("word", k).over(within)).withColumn(f"s{k}", F.lag("stop", k).over(within))
    made = []
    for size in range(1, n + 1):
        first = F.col("stop" if size == 1 else f"s{size - 1}")
        words = [F.col(f"w{k}") for k in range(size - 1, 0, -1)] + [F.col("word")]
        usable = words[0].isNotNull() & first.isNull() & F.col("stop").isNull()
        made.append(F.when(usable & (F.length("word") >= 3) if size == 1 else usable, F.concat_ws(" ", *words)))
    return toks.select("doc", F.explode(F.array_compact(F.array(*made))).alias("phrase")).groupBy("doc", "phrase").agg(F.count(F.lit(1)).alias("n"))


def word_rows(rows: DataFrame) -> DataFrame:
    """(row, doc, lang, sent, pos, word): the lower-case tokens of texts that aren't filtered into paragraphs first."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sent, pos, word = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for s, sentence in enumerate(text.split_sentences(t or "")):
                    kept = [w.lower() for w in text.tokenize(sentence) if not (w[0] in "'’" and len(w) > 1)]
                    at += [i] * len(kept)
                    sent += [s] * len(kept)
                    pos += range(len(kept))
                    word += kept
            take = pa.array(at, pa.int32())
            own = [batch.column(c).take(take) for c in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sent, pa.int32()), pa.array(pos, pa.int32()), pa.array(word, pa.string())], ["row", "doc", "lang", "sent", "pos", "word"])

    return rows.select("row", "doc", "text", "lang").mapInArrow(run, f"row long, doc {kind}, lang string, sent int, pos int, word string")


def date_sections(texts: DataFrame, key: str, text: str, least: int = 800) -> DataFrame:
    """(key, raw_date, iso_date, section): a text cut at its dates written m/d/yy, each section from one date to the next.

    Sections are trimmed; those of fewer than `least` characters are left out, as is what comes before the first date.
    """
    marked = F.regexp_replace(F.col(text), r"\b(\d{1,2}/\d{1,2}/\d{2})\b", "\x01$1\x02")
    parts = texts.select(key, F.explode(F.slice(F.split(marked, "\x01"), 2, F.size(F.split(marked, "\x01")))).alias("part"))
    raw = F.substring_index("part", "\x02", 1)
    section = F.regexp_replace(F.expr("substring(part, locate('\x02', part) + 1)"), r"^\s+|\s+$", "")
    day = F.split(raw, "/")
    iso = F.concat_ws("-", F.concat(F.lit("20"), day[2]), F.lpad(day[0], 2, "0"), F.lpad(day[1], 2, "0"))
    return parts.select(key, raw.alias("raw_date"), iso.alias("iso_date"), section.alias("section")).where(F.length("section") >= least)
