"""Queries of the text problems, and their SQL where there is any."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import frequency
from keystrata.llm.encoding import repaired
from keystrata.llm.language import language_segments, mislabelled
from keystrata.llm.leakage import LeakIndex, leaked_items
from keystrata.llm.lookalikes import lookalike_classes, lookalike_pairs, normalized
from keystrata.llm.sentences import sentence_units
from keystrata.llm.spans import SharedSpans, shared_span_pairs
from keystrata.llm.tokenizer import encode_corpus
from keystrata.sources.tables import table


def vocabulary_path(name: str) -> str:
    """A public vocabulary file: in the folder KEYSTRATA_TOKENIZERS names, else where the package public_tokenizers lies."""
    folder = os.environ.get("KEYSTRATA_TOKENIZERS")
    if not folder:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    bodies = lookalike_pairs(table(spark, folder, "input_document"), "id", "body")
    terms = lookalike_pairs(table(spark, folder, "kaggle_excerpt"), "result_id", "normalizedKeyword", within="id")
    found = [x.select(F.lit(name).alias("tbl"), "key_a", "key_b") for name, x in (("input_document", bodies), ("kaggle_excerpt", terms))]
    return found[0].unionByName(found[1])


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """How many spellings each keyword has that look alike."""
    rows = normalized(table(spark, folder, "kaggle_excerpt"), "normalizedKeyword")
    rows = rows.where("normal IS NOT NULL AND normal <> ''")
    return rows.groupBy("normal").agg(F.count_distinct("normalizedKeyword").alias("spellings"), F.count_distinct("result_id").alias("results"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The records whose text looks like another's and differs from it, by class."""
    bodies = lookalike_classes(table(spark, folder, "input_document"), "id", "body")
    terms = lookalike_classes(table(spark, folder, "kaggle_excerpt"), "result_id", "normalizedKeyword", within="id")
    found = [x.select(F.lit(name).alias("tbl"), "key", "look", "variants", "links") for name, x in (("input_document", bodies), ("kaggle_excerpt", terms))]
    return found[0].unionByName(found[1])


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, folder, "kaggle_excerpt"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "kaggle_excerpt")
    return frequency.mark_terms(frequency.term_frequencies(rows), frequency.count_records(rows))


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled records with the original text wherever it can be recovered."""
    corpus = table(spark, folder, "multilingual_corpus")
    words = repaired(table(spark, folder, "stopwords"), corpus, "entry_id", "word", "lang")
    bodies = repaired(table(spark, folder, "input_document"), corpus, "id", "body", label="language")
    both = words.withColumn("tbl", F.lit("stopwords")).unionByName(bodies.withColumn("tbl", F.lit("input_document")))
    return both.select("tbl", "row_key", "original", F.array_join("chains", "; ").alias("chains"), "lost")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_repaired(spark, folder).select("tbl", "row_key").distinct()


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = language_segments(table(spark, folder, "input_document"), table(spark, folder, "multilingual_corpus"))
    return found.withColumn("confidence", F.round("confidence", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = language_segments(table(spark, folder, "input_document"), table(spark, folder, "multilingual_corpus"))
    return mislabelled(found).select("id", "begin_at", "lang")


def p5_units(spark: SparkSession, folder: str) -> DataFrame:
    """The units of every body, numbered as sentence ids number them."""
    return sentence_units(table(spark, folder, "input_document"), table(spark, folder, "multilingual_corpus"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    garbled = p3_found(spark, folder).where("tbl = 'input_document'").select(F.col("row_key").alias("id"))
    return p5_units(spark, folder).join(garbled, "id", "left_anti").select("id", "begin_at", "end_at")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), vocabulary_path("byte_bpe_50k.json"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    found = LeakIndex(table(spark, folder, "documents"), table(spark, folder, "eval_item")).near()
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("share", 6).alias("share"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_span_pairs(table(spark, folder, "documents"))


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    found = SharedSpans(table(spark, folder, "documents")).shared()
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_text"), F.col("shared").alias("n_shared"), "copies")


def p8_stretches(spark: SparkSession, folder: str) -> DataFrame:
    found = SharedSpans(table(spark, folder, "documents")).stretches()
    return found.select(F.col("doc").alias("doc_id"), F.col("begin").cast("long").alias("begin_at"), F.col("end").cast("long").alias("end_at"), F.col("longest").cast("long").alias("longest"))


def p8_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of p8_found without its pairs: those that hold one window, group by group."""
    return SharedSpans(table(spark, folder, "documents")).groups().select(F.hex("k").alias("span"), F.col("doc").alias("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_classes": p1_classes,
        "p1_terms": p1_terms,
        "p2_found": p2_found,
        "p2_frequencies": p2_frequencies,
        "p3_found": p3_found,
        "p3_repaired": p3_repaired,
        "p4_found": p4_found,
        "p4_segments": p4_segments,
        "p5_found": p5_found,
        "p5_units": p5_units,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_near": p7_near,
        "p8_found": p8_found,
        "p8_groups": p8_groups,
        "p8_shared": p8_shared,
        "p8_stretches": p8_stretches,
    }


P2_FREQUENCIES = r"""
    SELECT "normalizedKeyword" AS term, CAST(sum(coalesce(occurrences, 0)) AS BIGINT) AS occurrences,
           count(DISTINCT id) AS records
    FROM (SELECT DISTINCT result_id, id, "normalizedKeyword", occurrences FROM kaggle_excerpt)
    WHERE "normalizedKeyword" IS NOT NULL AND NOT regexp_matches("normalizedKeyword", '^[\s\p{Z}]*$')
    GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_frequencies": P2_FREQUENCIES,
        "p2_found": f"""
            WITH f AS ({P2_FREQUENCIES}), total AS (SELECT count(DISTINCT id) AS n FROM kaggle_excerpt)
            SELECT term, 'rare' AS mark FROM f WHERE occurrences < 3
            UNION ALL SELECT term, 'common' FROM f, total WHERE records > 0.02 * n
        """,
    }
