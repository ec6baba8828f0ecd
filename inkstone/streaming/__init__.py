"""Documents as a stream: parsing and per-document measures as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import heuristics, parse


def document_stream(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """A stream of (doc_id, fmt, text) from parquet files of documents."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.select("doc_id", F.lit("md").alias("fmt"), "text")


def generic_paragraph_stream(docs: DataFrame) -> DataFrame:
    """Generic paragraphs of streamed documents; without state, as a document is a row."""
    return heuristics.generic_paragraphs(parse.line_paragraphs(docs))


def write_measures(docs: DataFrame, out: str, checkpoint: str):
    """Writes each batch's sentence-length variation to ``out``; a batch that is run again replaces its own part."""

    def one(batch: DataFrame, number: int) -> None:
        heuristics.sentence_cv(parse.sentences(parse.line_paragraphs(batch))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
