"""A folder of documents as a stream, its keywords written as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.api import KeywordExtractor


def document_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def write_keywords(extractor: KeywordExtractor, docs: DataFrame, out: str, checkpoint: str, **columns):
    """Start writing the keywords of a stream of documents as Parquet; without a trigger of its own it ends with what is there."""
    found = extractor.stream(docs, **columns)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
