"""Uniformity and genericity of documents, measured on paragraphs and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import ANCHOR, word_count
from inkstone.operators.findings import finding

SENTENCE_CV, LEAST_SENTENCES = 0.40, 15
PARAGRAPH_CV, LEAST_PARAGRAPHS, PARAGRAPH_WORDS = 0.35, 8, 10
GENERIC_WORDS = 50
CAPITALISED = r"[A-Z](?<=\b[A-Z])(?<![.!?]\s[A-Z])(?<!^[A-Z])[a-z]{2,}"


def counts(paras: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, words, sentences): words are those of paragraphs, sentences those kept."""
    p = paras.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(word_count(F.col("text"))).alias("words"))
    s = sents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    return p.join(s, "doc_id", "left").select("doc_id", "paragraphs", "words", F.coalesce("sentences", F.lit(0)).alias("sentences"))


def _cv(n: Column) -> Column:
    return F.stddev_samp(n) / F.avg(n)


def sentence_cv(sents: DataFrame) -> DataFrame:
    """(doc_id, sentences, cv) of documents with enough sentences: how much their lengths vary."""
    out = sents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), _cv(F.col("n_words")).alias("cv"))
    return out.where(F.col("sentences") >= LEAST_SENTENCES)


def paragraph_cv(paras: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, cv) over the paragraphs that are long enough."""
    sized = paras.withColumn("_n", word_count(F.col("text"))).where(F.col("_n") >= PARAGRAPH_WORDS)
    out = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), _cv(F.col("_n")).alias("cv"))
    return out.where(F.col("paragraphs") >= LEAST_PARAGRAPHS)


def anchored(text: Column) -> Column:
    """Whether it has something concrete: markup taken out, a digit, a capitalised word within a sentence."""
    return text.rlike(f"[0-9{ANCHOR}]") | text.rlike(CAPITALISED)


def generic_paragraphs(paras: DataFrame) -> DataFrame:
    """(doc_id, para_id, line, words, match): long paragraphs without an anchor; match is their first words."""
    out = paras.withColumn("words", word_count(F.col("text"))).where(F.col("words") >= GENERIC_WORDS).where(~anchored(F.col("text")))
    head = F.concat(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 8), " "), F.lit("…"))
    return out.select("doc_id", "para_id", F.col("start_line").alias("line"), "words", head.alias("match"))


def heuristics(paras: DataFrame, sents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, metrics) of the layer."""
    scv, pcv = sentence_cv(sents), paragraph_cv(paras)
    low = finding(scv.where(F.col("cv") < SENTENCE_CV), "heuristic", "uniform_sentences", 0.6, "Sentence lengths vary little.")
    flat = finding(pcv.where(F.col("cv") < PARAGRAPH_CV), "heuristic", "uniform_paragraphs", 0.6, "Paragraph lengths vary little.")
    generic = finding(generic_paragraphs(paras), "heuristic", "generic_paragraph", 0.5, "A long paragraph names nothing concrete.", line="line", match="match")
    metrics = (
        counts(paras, sents)
        .join(scv.select("doc_id", F.round("cv", 3).alias("sentence_cv")), "doc_id", "left")
        .join(pcv.select("doc_id", F.round("cv", 3).alias("paragraph_cv")), "doc_id", "left")
    )
    return low.unionByName(flat).unionByName(generic), metrics
