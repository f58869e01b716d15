"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.llm import centroids, decontaminate, langid, licenses, linededup, mixing, neardup, negatives, quality, secrets, suffixes, tokenfile, warc
from weekloom.llm.common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark, sf_dir):
    return linededup.report(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark, sf_dir):
    return neardup.report(table(spark, sf_dir, "documents"), width=2)


def op5_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op10_token_file(spark, sf_dir):
    return tokenfile.report(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_ball_kmeans(spark, sf_dir):
    return centroids.report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_warc, op4_near_dedup, op5_language_id, op6_quality_rules, op7_secret_scan, op8_license_scan, op9_mix_sources, op10_token_file, op11_suffix_dedup, op12_hard_negatives, op13_ball_kmeans)}
