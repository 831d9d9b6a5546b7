"""From raw documents to packed training sequences.

Every stage takes (spark, docs, folder) and returns a DataFrame; a stage's rows are written and read
again before the next one. All but the last keep the columns of `documents`.

Defined cases, by stage: a null or empty text has no words, so the quality rules remove it; equal rows are
judged alike there. Lines that repeat go from all rows of a repeated id and text, and a row that loses its last word
goes. Near copies and repeated ids leave the rows of the smallest id, rows without id stay. Rows are
contaminated by their own text, with or without id. Empty tables give no rows; further columns are kept,
except those named `_quality`, `_n_lines` and `_n_removed`, which the operators add.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm import decontaminate, line_dedup, native, near_dedup, packing, quality_rules
from playtally.llm.queries import tokenizer_path
from playtally.llm.store import stored


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and resemble the trusted ones."""
    trusted = quality_rules.trusted_documents(spark.read.parquet(f"{folder}/labels.parquet"))
    return quality_rules.judge(docs, trusted).where("_quality.kept").select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without lines that occur earlier; a document that loses its last word goes."""
    left = line_dedup.dedup_lines(docs)
    words_left = F.btrim(F.coalesce("text", F.lit("")), F.lit(native.BLANKS)) != ""
    left = left.where((F.col("_n_removed") == 0) | words_left)
    if "n_chars" in docs.columns:
        length = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", length)
    return left.select(docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near copies, the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.SHINGLE, near_dedup.PERCENT)


def remove_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without benchmark passages in a twentieth of their words or more."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

#: Token ids and components are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, folder)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
