"""A corpus from raw documents: the stages in order, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and reads it back for the
next one. All stages but the last return the columns of documents; the last returns packed pieces.

Null and empty texts have no language and go in the first stage. A null lang, source or n_chars stays null where a stage
does not set it. Rows with a null doc_id, and rows that repeat one, go through all stages; what becomes of copies among
them says the near-duplicate stage. Very long texts are worked on whole. Further columns are dropped, whatever their names.
Where ties matter (which copy of a run, which document of a group stays), the smallest doc_id stays. Without documents
every stage gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, language, linedup, neardup, packing
from millrace.llm.frames import bloom, cut, discard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any language: null texts and texts without a letter. `lang` becomes the prediction."""
    rows = docs.select(*COLUMNS)
    langs, model = language.learn(rows, "text", "lang")
    if not langs:
        return rows.filter(F.col("text").rlike(r"\p{L}"))
    found = language.detect(rows, langs, model, ["doc_id", "text", "source", "n_chars"])
    return found.filter("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of repeated line runs; documents of which nothing is left go."""
    edited = linedup.dedup_lines(docs.select(*COLUMNS), keep=["lang", "source", "n_chars"])
    left = edited.filter((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Of rows that repeat a doc_id and have equal shingle sets, the one with the smallest text, lang, source and n_chars
    stays; with different sets they all stay with their document. Rows without words stay. Rows with a null doc_id link
    with nothing and all stay, copies too.
    """
    found = neardup.near_duplicates(docs)
    drop = cut(found.filter("not kept").select("doc_id").distinct(), "dropped")
    repeated = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    key = F.xxhash64("doc_id")
    maybe = bloom(drop.select(key)).column(key)  # all others pass by the join
    own = docs.select(*COLUMNS)
    left = own.filter(~maybe).unionByName(own.filter(maybe).join(drop, "doc_id", "left_anti").select(*COLUMNS))
    if repeated.isEmpty():
        return left
    rows = cut(left.join(repeated, "doc_id", "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated-rows")
    sets = neardup.signatures(rows, "row").select(F.col("doc_id").alias("row"), "n_shingles", "h1", "h2")
    first = F.min(F.struct("text", "lang", "source", "n_chars", "row"))["row"]
    copies = rows.join(sets, "row").groupBy("doc_id", "h1", "h2", F.when(F.col("n_shingles") == 0, F.col("row")).alias("own"))
    one = rows.join(copies.agg(first.alias("row")).select("row"), "row", "left_semi").select(*COLUMNS)
    return left.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover at least half of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.overlaps(docs.select(*COLUMNS), benchmark, keep=["lang", "source", "n_chars"])
    return found.filter("not contaminated").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into token sequences."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Mixture inference, prefix doubling and genetic packing are not SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage over all documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
