"""Removal of lines that equal, or nearly equal, an earlier line of any document.

Two lines of at least `min_words` words are near if their word sequences are at most one edit (a word
changed, added or left out) apart. Every line that has an earlier near line goes, the earliest stays;
lines are judged on the input. Shorter lines of at least `shortest` words go if they equal an earlier one, and
lines without a word are left alone. Order is by document id, then by the
digest of the text where an id occurs twice, then by line number.

The deletion neighbourhood of a line is the line, the line without its i-th word, and the line with a hole
in place of its i-th word. Hashed, two lines meet in such a variant exactly if they are near:

- equal holes: same length, the words at one place differ;
- one line equal to the other without one word: lengths differ by one.

So a bucket needs no pairs. Its earliest member is near to all others (among holes), or to all members of
the other kind, and the edit distance to it is verified on the words. Hashes of variants are sums (exclusive
or) of hashes of words with their places, so a line of n words gives its 2 n + 1 variants in one pass.

Equal lines are brought together first. Of near lines, one half is the same; only lines that share the
hash of a half with another line of fitting length emit variants, and only for the words outside of that half,
which loses no pair.

Built-in functions only. Defined cases: null and empty texts have no lines and stay as they are; rows that
repeat an id and its text tie and keep their lines alike; null ids come first; an empty table gives no rows;
other columns are kept, names that begin with an underscore are reserved.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.llm import native
from playtally.llm.store import release, stored

MIN_WORDS = 5
#: Words of a block of the running hash.
BLOCK = 64


#: Two blanks that no text has any more once its blanks are spaces.
MARK = "\x0b\f"


def _words(line: Column) -> Column:
    """Words of a line whose blanks are spaces; a split by one character needs no pattern."""
    return F.array_remove(F.split(line, " "), "")


def _lines(text: Column) -> Column:
    """Lines of a text, one space for every run of blanks of a line; the ends of a line may keep one."""
    blanks = native.BLANKS.replace("\n", "").replace(" ", "")
    plain = text
    for blank in blanks:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    # A run of spaces becomes a run of marks, and all of it but its outer halves goes.
    for old, new in ((" ", MARK), (MARK[::-1], ""), (MARK, " ")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    # Most texts have none of these and are only looked through.
    odd = reduce(or_, (F.contains(text, F.lit(x)) for x in (*blanks, "  ")))
    return native.lines(F.when(odd, plain).otherwise(text))


def _hashes(line: Column, number: Column, min_words: int) -> Column:
    """Number, hashes and words of a line; equal words are equal strings, one space between two, so that none is split."""
    length = lambda x: F.octet_length(x)

    def build(words: Column) -> Column:
        n = F.when(words == "", 0).otherwise(length(words) - length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
        return native.let(n, lambda n: F.struct(*fields(words, n)))

    def fields(words: Column, n: Column) -> list[Column]:
        return [
            number.alias("_line"),
            F.xxhash64(words).alias("k1"),
            F.xxhash64(F.lit(1), n, words).alias("k2"),
            n.alias("size"),
            # Short lines have none, so they meet equal lines only.
            *[F.when(n >= min_words, x).alias(f"half{i}") for i, x in enumerate(_halves(words, n))],
        ]

    return native.let(F.trim(line), build)


def _halves(words: Column, n: Column) -> list[Column]:
    """Hashes of the first and last halves for the two lengths that the longer line of a pair may have."""

    def half(longer: Column, last: bool) -> Column:
        m = _half_size(longer)
        return F.xxhash64(F.call_function("substring_index", words, F.lit(" "), -m if last else m), F.lit(last))

    # Of an even number of words, both lengths have the same halves.
    other = lambda x: F.when(n % 2 == 1, x)
    return [half(n, False), half(n, True), other(half(n + 1, False)), other(half(n + 1, True))]


def _half_size(longer: Column) -> Column:
    return F.floor(longer / 2).cast("int")


def _edges(n: Column) -> list[Column]:
    """Of lines that share a half, the places where they may differ: from m on for a first half, and before
    n - m, noted as m - n, for a last one."""
    sizes = [_half_size(n), _half_size(n + 1)]
    return [edge for m in sizes for edge in (m, m - n)]


def _running(hashes: Column) -> Column:
    """Exclusive or of all values before each place, in blocks so that long lines stay cheap."""
    scan = lambda values: F.slice(
        F.aggregate(
            values,
            F.array(F.lit(0).cast("long")),
            lambda a, x: F.array_append(a, F.element_at(a, -1).bitwiseXOR(x)),
        ),
        F.lit(1),
        F.size(values),
    )
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(BLOCK)),
        lambda i: F.slice(hashes, i, F.lit(BLOCK)),
    )
    return native.let(
        blocks,
        lambda b: F.flatten(
            F.zip_with(
                b,
                scan(F.transform(b, total)),
                lambda values, before: F.transform(scan(values), lambda x: x.bitwiseXOR(before)),
            )
        ),
    )


def _variants(words: Column, low: Column, high: Column) -> Column:
    """(key, kind) of every variant: 0 the line, 1 a word left out, 2 a hole; edits from `low` on or before `high`."""
    n = F.size(words)
    places = F.filter(native.numbers(0, n - 1), lambda i: (i >= low) | (i < high))
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    left = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    def build(x: Column) -> Column:
        whole, moved, here, left, before = (x[k] for k in ("whole", "moved", "here", "left", "before"))
        key = lambda kind, length, value: F.struct(
            F.xxhash64(F.lit(kind == 2), length, value).alias("key"), F.lit(kind).alias("kind")
        )
        without = F.transform(
            places, lambda i: key(1, n - 1, moved.bitwiseXOR(F.get(before, i)).bitwiseXOR(F.get(left, i)))
        )
        holes = F.transform(places, lambda i: key(2, n, F.xxhash64(whole.bitwiseXOR(F.get(here, i)), i)))
        return F.concat(F.array(key(0, n, whole)), F.array_distinct(without), holes)

    parts = native.let(
        F.struct(here.alias("here"), left.alias("left")),
        lambda x: F.struct(
            x["here"].alias("here"),
            x["left"].alias("left"),
            total(x["here"]).alias("whole"),
            total(x["left"]).alias("moved"),
            _running(F.zip_with(x["here"], x["left"], lambda a, b: a.bitwiseXOR(b))).alias("before"),
        ),
    )
    return native.let(parts, build)


def _near(a: Column, b: Column) -> Column:
    """At most one word is changed, added or left out."""

    def same(x: Column, y: Column) -> Column:
        place = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(place == 0, F.least(F.size(x), F.size(y))).otherwise(place - 1)

    return same(a, b) + same(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def removed_lines(docs: DataFrame, min_words: int, id_column: str, text_column: str, shortest: int) -> DataFrame:
    """_doc, _digest and the numbers (from 0) of the lines to remove."""
    texts = docs.where(F.length(text_column) > 0).select(
        F.col(id_column).alias("_doc"), F.xxhash64(text_column).alias("_digest"), F.col(text_column).alias("_text")
    )
    # Hashed and written once, since lines are read to be grouped and again for their verdicts.
    hashed = F.transform(_lines(F.col("_text")), lambda line, number: _hashes(line, number, min_words))
    hashed = stored(texts.select("_doc", "_digest", F.filter(hashed, lambda x: x["size"] >= shortest).alias("lines")))
    place = F.struct("_doc", "_digest", "_line")
    # Plain columns: in a shuffled row, a struct or an array takes 16 or 24 bytes more than its values.
    every = hashed.select("_doc", "_digest", F.inline("lines"))
    halves = [f"half{i}" for i in range(4)]
    alike = stored(
        every.groupBy("k1", "k2").agg(
            F.min(place).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.min("size").alias("size"),
            *[F.min(x).alias(x) for x in halves],
        )
    )

    # A line goes by its first hash here; another line with the same hash is one candidate more.
    split = F.array(*(F.struct(F.col(x).alias("half"), e.alias("edge")) for x, e in zip(halves, _edges(F.col("size")), strict=True)))
    half = alike.where("half0 IS NOT NULL").select("k1", F.inline(split)).where("half IS NOT NULL")
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    able = half.join(shared, "half", "left_semi").groupBy("k1").agg(
        F.min(F.when(F.col("edge") > 0, F.col("edge"))).alias("low"), F.max(F.when(F.col("edge") < 0, -F.col("edge"))).alias("high")
    )
    candidates = alike.join(able, "k1").select("first.*", F.coalesce("low", "size").alias("low"), F.coalesce("high", F.lit(0)).alias("high"))
    lists = candidates.groupBy("_doc", "_digest").agg(F.collect_list(F.struct("_line", "low", "high")).alias("numbers"))
    same_document = lambda a, b: a["_doc"].eqNullSafe(b["_doc"]) & (a["_digest"] == b["_digest"])
    # Rows that repeat an id and its text are one document here.
    chosen = native.let(
        _lines(F.col("_text")),
        lambda x: F.transform(
            "numbers", lambda i: F.struct(i["_line"].alias("_line"), i["low"].alias("low"), i["high"].alias("high"), _words(F.get(x, i["_line"])).alias("words"))
        ),
    )
    lines = (
        texts.join(lists.hint("merge"), same_document(texts, lists))
        .select(texts["_doc"], texts["_digest"], F.inline(chosen))
        .select(place.alias("first"), "low", "high", "words")
    )

    # Few, as a shared half is rare; read once from the texts.
    lines = stored(lines)
    variants = stored(
        lines.select("first", F.explode(_variants(F.col("words"), F.col("low"), F.col("high"))).alias("v")).select("first", "v.*")
    )
    # Most are alone, and a count of numbers tells them at less cost than the earliest members do.
    met = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    variants = stored(variants.join(met, "key", "left_semi"))
    buckets = (
        variants.groupBy("key")
        .agg(
            F.min(F.when(F.col("kind") == 0, F.col("first"))).alias("whole"),
            F.min(F.when(F.col("kind") == 1, F.col("first"))).alias("without"),
            F.min(F.when(F.col("kind") == 2, F.col("first"))).alias("hole"),
        )
    )
    partner = F.when(F.col("kind") == 0, F.col("without")).when(F.col("kind") == 1, F.col("whole")).otherwise(
        F.col("hole")
    )
    pairs = (
        variants.join(buckets, "key")
        .select("first", partner.alias("earlier"))
        .where(F.col("earlier") < F.col("first"))
        .distinct()
    )
    late = lines.select("first", F.col("words").alias("own"))
    early = lines.select(F.col("first").alias("earlier"), F.col("words").alias("other"))
    key = lambda c: F.xxhash64(c)
    near = (
        pairs.join(late.withColumn("a", key("first")), [F.xxhash64(pairs["first"]) == F.col("a"), pairs["first"].eqNullSafe(late["first"])])
        .select(pairs["first"], "earlier", "own")
    )
    # Cut, so that the variants are gone before the texts are shuffled for their removed lines.
    near = stored(
        near.join(early.withColumn("b", key("earlier")), [F.xxhash64(near["earlier"]) == F.col("b"), near["earlier"].eqNullSafe(early["earlier"])])
        .where(_near(F.col("own"), F.col("other")))
        .select(near["first"].alias("gone"))
        .distinct()
    )
    release(docs.sparkSession)
    verdict = (
        alike.join(near, F.col("first").eqNullSafe(F.col("gone")), "left")
        .where("n > 1 OR gone IS NOT NULL")
        .select("k1", "k2", "first", F.col("gone").isNotNull().alias("near"))
    )
    return (
        every.drop("size", *halves).join(verdict, ["k1", "k2"])
        .where(F.col("near") | (place > F.col("first")))
        .select("_doc", "_digest", "_line")
        .groupBy("_doc", "_digest")
        .agg(F.collect_set("_line").alias("_gone"))
    )


def dedup_lines(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    shortest: int = 1,
) -> DataFrame:
    """All columns of `docs`, the text without removed lines, and the counts _n_lines and _n_removed."""
    gone = removed_lines(docs, min_words, id_column, text_column, shortest)
    joined = docs.join(
        gone.hint("merge"),
        docs[id_column].eqNullSafe(gone["_doc"]) & (F.xxhash64(docs[text_column]) == gone["_digest"]),
        "left",
    )
    lines = native.lines(docs[text_column])
    kept = native.let(
        lines,
        lambda x: F.concat_ws(
            "\n",
            F.transform(
                F.array_except(native.numbers(0, F.size(x) - 1), gone["_gone"]), lambda i: F.get(x, i)
            ),
        ),
    )
    text = F.when(gone["_gone"].isNull(), docs[text_column]).otherwise(kept)
    return joined.select(
        *(text.alias(c) if c == text_column else docs[c] for c in docs.columns),
        F.when(F.length(docs[text_column]) > 0, F.size(lines)).otherwise(0).cast("long").alias("_n_lines"),
        F.coalesce(F.size(gone["_gone"]), F.lit(0)).cast("long").alias("_n_removed"),
    )
