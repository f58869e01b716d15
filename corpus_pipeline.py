"""A training corpus from documents: language, near duplicates, benchmark passages, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekloom.llm import decontaminate, langid, mixing, neardup, tokenfile
from weekloom.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the same documents; those without letters go."""
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as before on average, sources weighted by the square root of their rows, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's rows: doc_id, start, n_tokens, ids_crc32. The file is in shuffled order, a document's copies apart."""
    return tokenfile.report(docs, shuffled=1)


STAGES = [("language_id", known_language), ("near_dedup", one_of_each), ("decontaminate", without_benchmark), ("mix", mixed), ("token_file", token_file)]
#: Language model, near duplicates and tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
