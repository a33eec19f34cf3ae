"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and is written as Parquet for the next one.

1. language ID: documents that the classifier rejects go (no letters, or unlike every learned language);
2. line de-duplication: lines that five documents or more share stay in one of them only;
3. near duplicates: of documents linked by their 5-word shingles (Jaccard 0.8 or more) the smallest doc_id stays;
4. benchmark decontamination: documents that hold a window of a benchmark item go;
5. SentencePiece ids of what is left, with the proof that decoding gives the text again.

All stages but the last return the columns of ``documents``; n_chars follows the text. The rows have no SQL twin (stages 1 and
5); tests compare them with a plain version.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import decontaminate, language_id, line_dedup, ngram_join, viterbi
from tickloom.llm.common import ready, stored, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.identify(docs, model).filter("not _llm_rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    kept = {"text": F.col("_llm_kept"), "n_chars": F.length("_llm_kept").cast("long")}
    return line_dedup.drop_lines(docs).select(*(kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return ngram_join.keep_one(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter("not _llm_contaminated").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    coded = viterbi.round_trip(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")))
    return coded.select("doc_id", "lang", "source", F.size("_llm_ids").cast("long").alias("n_ids"), F.col("_llm_ids").alias("ids"),
                        (F.col("_llm_decoded") == F.col("text")).alias("lossless"))


STAGES = [("language_id", languages), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", benchmark),
          ("sentencepiece", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
