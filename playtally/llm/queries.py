"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.llm import (
    decontaminate,
    language_id,
    line_dedup,
    native,
    near_dedup,
    packing,
    period_runs,
    pseudonyms,
    quality_classifier,
    quality_rules,
    ranked_search,
    suffix_dedup,
    token_files,
    window_dedup,
)
from playtally.llm.oracle import ORACLE_SQL
from playtally.llm.store import shared_folder


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = quality_rules.trusted_documents(_table(spark, folder, "labels"))
    return quality_rules.judge(_table(spark, folder, "documents"), trusted).select("doc_id", "_quality.*")


def op3_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = window_dedup.remove_repeats(_table(spark, folder, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def _held_out(folds: int, remainder: int) -> Column:
    """Whether a document belongs to the fold that is not learnt from; null ids never do."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), folds) == remainder, F.lit(False))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language_id.learn(docs.where(~_held_out(5, 0)))
    return language_id.predict(docs, model).select(
        "doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score"
    )


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and removed lines of every document, and the digest of the text that is left.

    Lines of any length go if they equal an earlier one, those of five words or more also if they are near to one.
    """
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


#: Score from which a document counts as good.
GOOD = 0.7


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs.where(~_held_out(4, 2)), _table(spark, folder, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


#: The key of these queries; who uses the operator brings one.
QUERY_KEY = b"registered query"


def op10_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with pseudonyms, and the number of values of each kind."""
    found = pseudonyms.pseudonymise(_table(spark, folder, "documents").select("doc_id", "text"), QUERY_KEY)
    return found.select(
        "doc_id",
        "text",
        *(F.col("_n_values")[kind].alias(f"n_{kind}") for kind in pseudonyms.KINDS),
    )


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def _with_periods(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with its words from some word on repeated by a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        start = (g % F.size(words)).cast("int")
        period = (1 + F.floor((F.size(words) - start) / (3 + g % 8))).cast("int")

        def by(at: Column) -> Column:
            return F.array_join(
                F.transform(
                    words, lambda x, i: F.when(i < at["a"], x).otherwise(F.get(words, at["a"] + (i - at["a"]) % at["p"]))
                ),
                " ",
            )

        return F.when(F.size(words) > 0, native.let(F.struct(start.alias("a"), period.alias("p")), by)).otherwise("")

    return F.when(h % 10 == 0, native.let(native.words(text), repeat)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = period_runs.find_runs(docs.select("doc_id", _with_periods(F.col("doc_id"), F.col("text")).alias("text")))
    line = F.transform("_runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        period_runs.strongest(F.col("_runs")).alias("best"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.*",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(_table(spark, folder, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.read(spark, path)


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_window_dedup": op3_window_dedup,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
