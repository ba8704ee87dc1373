"""The queries of this package: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, language, lattice, linedup, media, neardup, packing, sql, tokencount, toxicity, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, root, "documents"))


def op2_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return tokencount.section_counts(_table(spark, root, "documents"))


def op3_lattice_score(spark: SparkSession, root: str) -> DataFrame:
    return lattice.score_texts(_table(spark, root, "documents"))


def op4_language(spark: SparkSession, root: str) -> DataFrame:
    return language.identify(_table(spark, root, "documents"))


def op5_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.judge(_table(spark, root, "documents"), _table(spark, root, "labels"))


def op6_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(_table(spark, root, "documents"))


def op7_media(spark: SparkSession, root: str) -> DataFrame:
    return media.media_digest(_table(spark, root, "documents"))


def media_clips(spark: SparkSession, root: str) -> DataFrame:
    """The shots of the files that op7_media stores."""
    return media.clips(media.store(_table(spark, root, "documents")))


def op8_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    return decontam.overlaps(_table(spark, root, "documents"), _table(spark, root, "benchmark")).drop("text")


def op9_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return urlfilter.judge(_table(spark, root, "pages"), urlfilter.labelled_table(spark))


def op10_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    return linedup.dedup_lines(_table(spark, root, "documents"))


def pipeline(spark: SparkSession, root: str) -> DataFrame:
    return corpus_pipeline.run(spark, root)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (pipeline, op1_near_duplicates, op2_token_counts, op3_lattice_score, op4_language, op5_toxicity, op6_packing, op7_media, op8_decontaminate, op9_url_filter, op10_line_dedup, media_clips)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": sql.NEAR_DUPLICATES,
        "op9_url_filter": urlfilter.oracle(),
        "op10_line_dedup": sql.line_dedup(linedup.MIN_WORDS),
    }
