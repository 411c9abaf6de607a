"""Registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from keystrata.api import KeywordExtractor, compact_keywords
from keystrata.functions import similarity, text
from keystrata.functions.output import highlight_udf, html_to_text, stable_json_udf
from keystrata.operators import metrics
from keystrata.operators.keywords import Extraction, document_stats, documents, edges, ranked
from keystrata.operators.phrases import Phrases
from keystrata.options import Options
from keystrata.sources import stopwords
from keystrata.sources.tables import table


Stages = Callable[..., Extraction | Phrases]


def lists(spark: SparkSession, folder: str) -> DataFrame:
    return stopwords.load(table(spark, folder, "stopwords"))


_kept: list[Extraction] = []


def _only(*e: Extraction) -> Extraction | None:
    """Of the registered queries, the last one alone keeps its tokens, if it has any."""
    while _kept:
        _kept.pop().close()
    _kept.extend(e)
    return e[0] if e else None


def items(spark: SparkSession, folder: str, **options) -> Extraction:
    """The stages over the evaluation texts."""
    o = Options(language="en", **options)
    return _only(Extraction(documents(table(spark, folder, "eval_item"), "item_id", "text", None, options=o), lists(spark, folder), o))


def corpus(spark: SparkSession, folder: str, **options) -> Extraction:
    """The stages over all documents, each in its own language."""
    o = Options(**options)
    return _only(Extraction(documents(table(spark, folder, "documents"), "doc_id", "text", "lang", options=o), lists(spark, folder), o))


def phrases(spark: SparkSession, folder: str, **options) -> Extraction | Phrases:
    """The candidates of all documents in one pass; by stages where there are more stopwords than are sent to the workers."""
    words = lists(spark, folder)
    if words.limit(stopwords.MAX_LISTED + 1).count() > stopwords.MAX_LISTED:
        return corpus(spark, folder, **options)
    _only()
    o = Options(**options)
    docs = documents(table(spark, folder, "documents"), "doc_id", "text", "lang", options=o)
    return Phrases(docs, spark.sparkContext.broadcast(stopwords.by_language(words)), o)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def pre_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "input_document").select("id", text.pre_filter_column(F.col("body")).alias("filtered")).distinct()


def tokenize(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    t = over(spark, folder).tags
    return t.select(F.col("doc").alias("item_id"), "sent", "pos_sent", "block", "pos_text", "word", "norm", "term")


def token_tags(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return over(spark, folder).tags.select(F.col("doc").alias("item_id"), "pos_text", "word", "tag", "stop_form")


def term_frequency(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return over(spark, folder).terms.select(
        F.col("doc").alias("item_id"), "term", "tf", "tf_a", "tf_n", "stopword", "first_pos",
        F.size("sentence_ids").alias("in_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
    )


def doc_term_stats(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    rows = document_stats(over(spark, folder).terms).drop("rid").withColumnRenamed("doc", "item_id")
    return _round(rows, "avg_tf", "std_tf")


def cooccurrence_edges(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return over(spark, folder).edges.select(F.col("doc").alias("item_id"), "src", "dst", "weight")


def cooccurrence_window2(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return edges(over(spark, folder).tags, 2).select(F.col("doc").alias("item_id"), "src", "dst", "weight")


def graph_metrics(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    e = over(spark, folder)
    return e.terms.join(e.metrics, ["rid", "term"]).select(F.col("doc").alias("item_id"), "term", "wdr", "wir", "wdl", "wil")


def term_scores(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    rows = over(spark, folder).scores.select(F.col("doc").alias("item_id"), "term", "wrel", "wfreq", "wspread", "wcase", "wpos", "h")
    return _round(rows, "wrel", "wfreq", "wspread", "wcase", "wpos", "h")


def candidate_scores(spark: SparkSession, folder: str, over: Stages = items, **options) -> DataFrame:
    rows = over(spark, folder, **options).candidates.where("clean")
    return _round(rows.select(F.col("doc").alias("item_id"), "norm_kw", "kw", "size", "tf", "h"), "h")


def candidate_scores_no_kpf(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return candidate_scores(spark, folder, over, features=("wrel", "wfreq", "wspread", "wcase", "wpos"))


def candidate_scores_wfreq_only(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return candidate_scores(spark, folder, over, features=("wfreq",))


def candidate_validity(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return over(spark, folder).counts()


def ngram_freq_by_size(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    return over(spark, folder, n=4).counts().where("size > 1").groupBy("size").agg(F.sum("occurrences").alias("occurrences"))


def stopword_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return lists(spark, folder).select("lang", "word")


def supported_languages(spark: SparkSession, folder: str) -> DataFrame:
    return stopwords.languages(lists(spark, folder))


def stopword_set_algebra(spark: SparkSession, folder: str) -> DataFrame:
    words = stopwords.edit(lists(spark, folder), "en-GB", add=["whilst", " Amongst "], remove=["quite", "often"])
    return stopwords.edit(words, "de", replace=["und", "oder"]).select("lang", "word")


def resolve_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(table(spark, folder, "input_document"))
    return docs.select(F.col("doc").alias("id"), "lang", stopwords.language_key(F.col("lang")).alias("list")).distinct()


def title_body(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(table(spark, folder, "input_document"), title="title")
    return docs.select(F.col("doc").alias("id"), "text").distinct()


def sim_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of keywords of one document that share the first of their places."""
    k = table(spark, folder, "kaggle_excerpt").where("normalizedKeyword IS NOT NULL AND sentenceIds[0] IS NOT NULL")
    k = k.select("id", F.col("sentenceIds")[0].alias("s"), F.col("normalizedKeyword").alias("a")).distinct()
    return k.join(k.withColumnRenamed("a", "b"), ["id", "s"]).where("a < b").select("a", "b").distinct()


def sim_levenshtein(spark: SparkSession, folder: str) -> DataFrame:
    d = similarity.levs_column(F.col("a"), F.col("b"))
    return sim_pairs(spark, folder).select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(d, 9).alias("likeness"))


def sim_seqm(spark: SparkSession, folder: str) -> DataFrame:
    return sim_pairs(spark, folder).select("a", "b", F.round(similarity.seqm_column(F.col("a"), F.col("b")), 9).alias("likeness"))


def sim_jaro(spark: SparkSession, folder: str) -> DataFrame:
    @F.pandas_udf(DoubleType())
    def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity.jaro(x, y) for x, y in zip(a, b)], dtype="float64")

    return sim_pairs(spark, folder).select("a", "b", F.round(jaro("a", "b"), 9).alias("likeness"))


def trigrams(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "kaggle_excerpt").select(F.col("normalizedKeyword").alias("term")).distinct()
    return k.select("term", F.explode(similarity.trigrams(F.col("term"))).alias("trigram"))


def _deduplicated(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The keyword results of each document, best first, without near duplicates."""
    k = table(spark, folder, "kaggle_excerpt").where("id IS NOT NULL AND score IS NOT NULL AND normalizedKeyword IS NOT NULL")
    k = k.groupBy("id", F.col("normalizedKeyword").alias("item")).agg(F.min("score").alias("score"))
    return ranked(k, "id", "item", "score", F.col("item"), Options(**options))


def dedup_seqm(spark: SparkSession, folder: str) -> DataFrame:
    return _deduplicated(spark, folder, dedup_lim=0.5)


def dedup_levs(spark: SparkSession, folder: str) -> DataFrame:
    return _deduplicated(spark, folder, dedup_func="levs", dedup_lim=0.4, top=5)


def dedup_jaro(spark: SparkSession, folder: str) -> DataFrame:
    return _deduplicated(spark, folder, dedup_func="jaro", dedup_lim=0.65)


def candidate_order(spark: SparkSession, folder: str) -> DataFrame:
    """Results with equal scores in the order of their names: all of them, as no likeness is above 1."""
    k = table(spark, folder, "kaggle_excerpt").where("id IS NOT NULL AND score IS NOT NULL AND normalizedKeyword IS NOT NULL")
    k = k.groupBy("id", F.col("normalizedKeyword").alias("item")).agg((F.floor(F.min("score") * 10) / 10).alias("score")).where("NOT item LIKE '% % %'")
    near = F.col("score") + F.when(F.length("item") % 2 == 0, F.lit(4e-16)).otherwise(0.0)
    return ranked(k.withColumn("score", near), "id", "item", "score", F.col("item"), Options(dedup_lim=1.0, top=1000))


def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "kaggle_excerpt").where("normalizedKeyword IS NOT NULL AND id IS NOT NULL").dropDuplicates(["result_id"])
    tf = k.groupBy(F.col("id").alias("doc"), F.col("normalizedKeyword").alias("term")).agg(F.sum(F.coalesce("occurrences", F.lit(0))).cast("long").alias("tf"))
    return _round(metrics.tfidf(tf, frequency_of(tf, "doc")), "score")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "kaggle_excerpt").where("score IS NOT NULL AND normalizedKeyword IS NOT NULL")
    k = k.groupBy(F.col("id").alias("doc"), F.col("normalizedKeyword").alias("item")).agg(F.min("score").alias("score"))
    return k.selectExpr("doc", "item", "row_number() OVER (PARTITION BY doc ORDER BY score, item) AS rank", "row_number() OVER (PARTITION BY doc ORDER BY length(item) DESC, item) AS long_rank")


def topk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    k = _ranked(spark, folder)
    return metrics.overlap_at_k(k.select("doc", "item", "rank"), k.select("doc", "item", F.col("long_rank").alias("rank")), 3)


def precision_at_k(spark: SparkSession, folder: str) -> DataFrame:
    gold = table(spark, folder, "kaggle_excerpt").where("occurrences > 1").select(F.col("id").alias("doc"), F.col("normalizedKeyword").alias("item"))
    return metrics.precision_at_k(_ranked(spark, folder).select("doc", "item", "rank"), gold, 3)


def leading_prefix(spark: SparkSession, folder: str) -> DataFrame:
    k = _ranked(spark, folder)
    return metrics.leading_matches(k.select("doc", "item", "rank"), k.select("doc", "item", F.col("long_rank").alias("rank")))


def bio_decode(spark: SparkSession, folder: str, over: Stages = items) -> DataFrame:
    """Runs of capitalized words as tagged phrases."""
    t = over(spark, folder).tags.select("doc", F.col("pos_text").alias("pos"), "word", "block", "sent")
    up = F.col("word").rlike("^[A-Z]")
    t = t.withColumn("tag", F.when(up & (F.col("pos") % 2 == 0), "B").when(up, "I").otherwise("O"))
    return metrics.bio_phrases(t).withColumnRenamed("doc", "item_id")


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _round(metrics.latency_summary(table(spark, folder, "events"), "value", "event_type"), "total", "mean", "p50", "p95").withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 6))


def _extractor(spark: SparkSession, folder: str, **options) -> KeywordExtractor:
    return KeywordExtractor(table(spark, folder, "stopwords"), **options)


def _document_keywords(spark: SparkSession, folder: str, **options) -> DataFrame:
    found = _extractor(spark, folder, **options).details(table(spark, folder, "documents"), id="doc_id", body="text", language="lang")
    return found.withColumnRenamed("doc", "doc_id")


def keywords_seqm(spark: SparkSession, folder: str) -> DataFrame:
    return _document_keywords(spark, folder)


def keywords_levs(spark: SparkSession, folder: str) -> DataFrame:
    return _document_keywords(spark, folder, dedup_func="levs", dedup_lim=0.8, top=10)


def keywords_jaro(spark: SparkSession, folder: str) -> DataFrame:
    return _document_keywords(spark, folder, dedup_func="jaro", top=10)


def topk_no_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first keywords of up to two words of every document, near duplicates among them."""
    found = _document_keywords(spark, folder, dedup_lim=1.0, n=2)
    return _round(found.withColumn("sentence_ids", F.array_join("sentence_ids", ",")), "score")


def _item_keywords(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Keywords of the evaluation texts, up to two words long: of these SQL can tell the order."""
    found = _extractor(spark, folder, language="en", n=2, **options).details(table(spark, folder, "eval_item"), id="item_id", body="text", language=None)
    rows = found.select(F.col("doc").alias("item_id"), "rank", "keyword", "normalized_keyword", "score", "ngram_size", "occurrences", F.array_join("sentence_ids", ",").alias("sentence_ids"))
    return _round(rows, "score")


def keywords_items_seqm(spark: SparkSession, folder: str) -> DataFrame:
    return _item_keywords(spark, folder, dedup_lim=0.7)


def keywords_items_levs(spark: SparkSession, folder: str) -> DataFrame:
    return _item_keywords(spark, folder, dedup_func="levs", dedup_lim=0.6, top=10)


def keywords_items_top(spark: SparkSession, folder: str) -> DataFrame:
    return _item_keywords(spark, folder, dedup_lim=1.0)


def document_results(spark: SparkSession, folder: str) -> DataFrame:
    """Each delivered document once, with title, metadata and keywords."""
    docs = table(spark, folder, "input_document").groupBy("id").agg(F.max_by(F.struct("body", "language", "title", "metadata"), "arrived_at").alias("d"))
    return _extractor(spark, folder, top=5).results(docs.select("id", "d.*"), title="title", metadata="metadata")


def result_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What results have beside keywords, which are none only for a document without any word."""
    rows = document_results(spark, folder)
    return rows.select("id", "language", "title", F.map_keys("metadata")[0].isNotNull().alias("has_metadata"), (F.size("keywords") <= 5).alias("few"))


def stable_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_results(spark, folder)
    return rows.select("id", stable_json_udf(F.struct("id", "language", "title", "metadata", "keywords")).alias("json"))


def payload_size(spark: SparkSession, folder: str) -> DataFrame:
    """The size of each result's stable JSON in UTF-8."""
    return stable_json(spark, folder).select("id", F.octet_length("json").cast("long").alias("bytes"))


def highlight(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "kaggle_excerpt").groupBy("id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    docs = table(spark, folder, "input_document").select("id", "body").distinct()
    return docs.join(words, "id", "left").select("id", highlight_udf("body", "keywords").alias("marked"))


def compact(spark: SparkSession, folder: str) -> DataFrame:
    return compact_keywords(table(spark, folder, "documents"), table(spark, folder, "stopwords"), id="doc_id", body="text", language=None)


def candidate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each phrase of one to three words occurs in each evaluation text, blocks disregarded."""
    items = table(spark, folder, "eval_item").select("item_id", "text", F.lit("en").alias("lang"))
    return metrics.candidate_counts(items, lists(spark, folder), "item_id").withColumnRenamed("doc", "item_id")


def text_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """The weights of these phrases, by the texts that hold them."""
    counts = candidate_counts(spark, folder)
    return _round(metrics.tfidf(counts, frequency_of(counts, "item_id"), "item_id", "phrase", "n"), "score")


def frequency_of(rows: DataFrame, key: str) -> int:
    """How many distinct keys there are."""
    return rows.select(key).distinct().count()


def date_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their time written out before each paragraph, cut again at these dates."""
    day = F.date_format("committed_at", "M/d/yy")
    texts = table(spark, folder, "documents").select("doc_id", F.concat(day, F.lit("\n"), F.replace("text", F.lit("\n\n"), F.concat(F.lit("\n"), day, F.lit("\n")))).alias("text"))
    return metrics.date_sections(texts, "doc_id", "text", least=200)


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies as simple pages, and their text again."""
    page = F.concat(F.lit("<html><style>p {}</style><script>var a = '<b>';</script><p>"), F.replace("body", F.lit("\n"), F.lit("</p>\n<p class='x'>")), F.lit("</p>&mdash;&nbsp;&#39;&bogus;&amp;lt;</html>"))
    return table(spark, folder, "input_document").select("id", html_to_text(page).alias("text")).distinct()


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return keywords_seqm(spark, folder).select("doc_id", "rank", "keyword", "score")


def of_documents(query: Callable[..., DataFrame], over: Stages = corpus) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the stages over all documents."""
    return lambda spark, folder: query(spark, folder, over).withColumnRenamed("item_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        pre_filter, tokenize, token_tags, term_frequency, doc_term_stats, cooccurrence_edges,
        cooccurrence_window2, graph_metrics, term_scores, candidate_scores, candidate_scores_no_kpf,
        candidate_scores_wfreq_only, candidate_validity, ngram_freq_by_size, stopword_lookup, supported_languages,
        stopword_set_algebra, resolve_language, title_body, sim_levenshtein, sim_seqm, sim_jaro, trigrams, tfidf,
        topk_overlap, precision_at_k, leading_prefix, bio_decode, latency_percentiles, keywords_seqm, keywords_levs,
        keywords_jaro, topk_no_dedup, keywords_items_seqm, keywords_items_levs, keywords_items_top, dedup_seqm, dedup_levs,
        dedup_jaro, candidate_order, document_results, result_documents, stable_json, payload_size, highlight,
        candidate_counts, text_tfidf, date_sections, html_text,
    ]
    stages = [
        tokenize, token_tags, term_frequency, doc_term_stats, cooccurrence_edges, cooccurrence_window2, graph_metrics,
        term_scores, bio_decode,
    ]
    of_phrases = [candidate_scores, candidate_scores_no_kpf, candidate_scores_wfreq_only, candidate_validity, ngram_freq_by_size]
    whole = {f"{f.__name__}_documents": of_documents(f) for f in stages} | {f"{f.__name__}_documents": of_documents(f, phrases) for f in of_phrases}
    return {f.__name__: f for f in own} | {"compact_keywords": compact} | whole
