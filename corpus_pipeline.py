"""A training corpus from raw documents: language ID, line deduplication, near-duplicate join, benchmark
decontamination, packing. Every stage but the last takes and returns the columns of documents, whatever these are besides
doc_id, text, lang; extra columns stay, under any name. Null, empty and very long texts, repeated rows and empty tables are
defined at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, lines, packing
from tidemark.llm.common import stage, table


#: Least mean probability of a document's language: a document whose windows are spread over languages is in none.
SURE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, empty or letterless text, or a prediction under SURE) go. Ties go to the first language
    by name; repeated rows go or stay alike; without labelled rows no language is known and all go."""
    model = language.train(docs.select("doc_id", "text", "lang"))
    got = language.identify(docs, model, names=("__lang", "__score"))
    return got.where(f"__lang <> 'und' and __score >= {SURE}").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an equal or close line before them go; documents stay, with an empty text if all lines went. Null texts stay
    null; repeated rows lose the same lines; n_chars, where there is one, follows the text."""
    got = lines.dedup_lines(docs, unit="character", names=("__removed", "__n_lines", "__n_removed"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the least doc_id, with all its rows. Documents without words are in no
    group, and rows with a null id stay."""
    verdict = stage(jaccard.join(docs.select("doc_id", "text")).where("class_id <> doc_id").select("doc_id").distinct(), "near")
    return docs.join(verdict.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, all rows of an id; rows with a null id stay."""
    hits = stage(decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").where("doc_id is not null").distinct(), "hits")
    return docs.join(hits.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. Null and empty texts are their end token; repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("ngram_jaccard", drop_near_duplicates),
          ("decontamination", decontaminate_benchmark), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
