"""Quality rules: base counts of a text, and a likelihood ratio of hashed n-grams between two corpora.

Words and word pairs are hashed to `buckets` (a power of two). Their frequencies over all trusted documents and over the
whole corpus give two multinomials; a document's score is the mean over its n-grams of the log ratio of
the two, so length does not count. A document is kept if it passes the base rules and its score reaches
a fixed threshold; equal texts are judged alike.

Counting shuffles texts once, to meet the list of trusted documents, and sums of at most `buckets` rows
a task; the table of ratios has a fixed size whatever the corpus, and scoring shuffles nothing. Built-in
functions only.

Defined cases: a null or empty text has no words and fails the base rules; without a trusted document, or
without any n-gram, all ratios are 0; a document listed as trusted more than once counts once; repeated
documents count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.llm import native

BUCKETS = 1 << 14
#: Mean log ratio a kept document reaches.
THRESHOLD = -0.12
#: Added to every bucket of both multinomials.
SMOOTHING = 1.0
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def joined(hashes: Column, gap: int) -> Column:
    """Hash of every value and the one `gap` places later."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(
        F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b)
    )


def repeated_words(pairs: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    `pairs` are the hashes of neighbouring words; a window's hash is made of those of its halves.
    """
    window = REPEAT_WINDOW
    windows = joined(joined(pairs, 2), 4)

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            native.let(ordered, covered)
        )

    def covered(ordered: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(ordered, k - 1)["h"] == x["h"])
            after = F.get(ordered, k + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        places = F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["i"]))
        return native.let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    return native.let(windows, count)


def log_ratios(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int,
    smoothing: float,
    id_column: str,
    text_column: str,
) -> DataFrame:
    """One row with one array: the log ratio of every bucket."""
    listed = trusted.select(F.col(id_column).alias("_id")).where("_id is not null").distinct()
    texts = docs.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("_text"))
    counted = (
        texts.join(listed.hint("merge"), F.col("_doc") == F.col("_id"), "left")
        .select(F.col("_id").isNotNull().alias("good"), native.words(F.col("_text")).alias("words"))
        .select("good", F.transform("words", lambda x: F.xxhash64(x)).alias("alone"))
        .select("good", F.explode(F.concat("alone", joined(F.col("alone"), 1))).alias("gram"))
        .groupBy("good", F.col("gram").bitwiseAND(buckets - 1).alias("bucket"))
        .count()
        .groupBy("bucket")
        .agg(F.sum("count").alias("raw"), F.sum(F.when(F.col("good"), F.col("count")).otherwise(0)).alias("target"))
    )
    found = counted.agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("raw", "target")))).alias("counts"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raws"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("targets"),
    )
    shift = F.log((F.col("raws") + smoothing * buckets) / (F.col("targets") + smoothing * buckets))
    ordered = F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda b: F.log(
            (F.coalesce(F.col("counts")[b]["target"], F.lit(0)) + smoothing)
            / (F.coalesce(F.col("counts")[b]["raw"], F.lit(0)) + smoothing)
        )
        + F.col("shift"),
    )
    return found.withColumn("shift", shift).select(
        F.when(F.col("targets") > 0, ordered)
        .otherwise(F.array_repeat(F.lit(0.0), buckets))
        .alias("ratios")
    )


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    smoothing: float = SMOOTHING,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All columns of `docs` and `quality`: a struct of the counts, score, base_failed and kept.

    `trusted` lists the ids of the target documents.
    """
    # A fixed number of values, whatever the corpus; as one literal they are at hand inside lambdas.
    values = log_ratios(docs, trusted, buckets, smoothing, id_column, text_column).first()["ratios"]
    ratios = F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = (
        docs.select(F.struct("*").alias("doc"), text.alias("text"), native.words(F.col(text_column)).alias("words"))
        .withColumn("alone", F.transform("words", lambda x: F.xxhash64(x)))
        .withColumn("pairs", joined(F.col("alone"), 1))
    )
    with_word = F.filter(native.lines(F.col("text")), lambda x: F.btrim(x, F.lit(native.BLANKS)) != "")
    score = F.aggregate(
        F.concat("alone", "pairs"),
        F.lit(0.0),
        lambda a, x: a + F.get(ratios, x.bitwiseAND(buckets - 1).cast("int")),
    )
    counts = own.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
        native.let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("pairs")).cast("long").alias("n_repeat_words"),
        (score / F.greatest(F.size("alone") + F.size("pairs"), F.lit(1))).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    verdict = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "score",
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
    # A filter on the verdict stays above the explode; below, every use of the words would be split anew.
    return counts.select("doc", F.explode(F.array(verdict)).alias("_quality")).select("doc.*", "_quality")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Labelled documents of good quality that are not toxic."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")
