"""Periodic runs of words, found in tiles of one scale each and stitched together in Spark.

A run is a stretch of consecutive words with smallest period q and at least max(`shortest`, `least` * q) words
that no neighbouring word extends with that period.

Periods are taken by octaves [P, 2P). For every octave, a document is exploded into overlapping tiles: an
anchor stands every S = max(P, 8) words, and its tile reaches S words to the left and S + 8 + 2P words to the
right, so a tile's size is proportional to its periods and all tiles of all octaves have n log n words.
A tile is solved by itself: the Z-function of the words from the anchor on gives, for each period p of the
octave, how far the words go on to equal those p later, and the Z-function of the reversed words before the
anchor how far they did so up to there. The stretch of words that equal those p later, cut at the
tile's boundary, is a fragment. Fragments are shuffled by (document, period) and stitched where they
overlap; with equal ends only the smallest period stays.

Words that equal those p later in a run make a stretch of S + 7 at least, so one anchor of its octave has
eight words in it. Only tiles whose anchor's eight words begin again P to 2P - 1 words later can have a run, and
only those are exploded, as rows of word numbers; the rest of the corpus costs a look at its 8-word grams. The
hash of a gram only ever adds a tile that has no run: words are numbered exactly.

Tiles of one document are dealt over all tasks, whatever its size. Texts without a tile are not
shuffled at all.

Defined cases: a null or empty text has no words and no run, and an empty collapsed text; repeated rows, null ids
included, are each judged for itself; an empty table gives no rows; other columns are kept, whatever
their names, except that `_n_words`, `_runs` and `_collapsed` are added; a text of any length is cut into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from playtally.llm.store import stored

#: Least words of a run, and least number of its periods.
SHORTEST, LEAST = 24, 3
#: Words of a gram; anchors of small periods stand this far apart.
GRAM = 8

#: Words of tiles that a task holds before it passes them on.
TILE_WORDS = 1 << 20

_SCANNED = "row long, n_words long, tiled boolean, octave int, start long, anchor int, wide boolean, words binary"
_FRAGMENTS = "row long, period long, low long, high long"
RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered_words(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int32, len(words))


def _grams(numbers: np.ndarray) -> np.ndarray:
    """A hash of every GRAM consecutive numbers."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    width = 1
    while width < GRAM:
        x = (x[:-width] * np.uint64(0xBF58476D1CE4E5B9)) ^ (x[width:] >> np.uint64(3)) ^ x[width:]
        x ^= x >> np.uint64(31)
        width *= 2
    return x


def tiles(numbers: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(octave, first word, anchor in the tile, words) of the tiles that can have a run."""
    n = len(numbers)
    if n < 3 * GRAM:
        return
    grams = _grams(numbers)
    m = len(grams)
    order = np.argsort(grams, kind="stable")
    equal = grams[order[1:]] == grams[order[:-1]]
    if not equal.any():
        return
    # Places of equal grams get one group number, so (group, place) is a sorted key.
    group = np.empty(m, np.int64)
    group[order] = np.concatenate(([0], np.cumsum(~equal)))
    keys = group[order] * m + order
    octave = 1
    while octave <= n // least:
        step = max(octave, GRAM)
        anchors = np.arange(0, max(0, m - octave), step)
        own = group[anchors] * m
        # The first equal gram P words or more behind the anchor, inside the text.
        at = np.searchsorted(keys, own + anchors + octave)
        beyond = np.minimum(own + anchors + 2 * octave, own + m)
        hit = (at < m) & (keys[np.minimum(at, m - 1)] < beyond)
        for c in anchors[hit].tolist():
            first = max(0, c - step)
            yield octave, first, c - first, numbers[first : c + step + GRAM + 2 * octave]
        octave *= 2


def z_function(x: list[int]) -> list[int]:
    """For every place, how many values from there on equal those from the beginning on."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def fragments(octave: int, start: int, anchor: int, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(period, low, high): the words low ... high - 1 of the document equal those a period later."""
    step = max(octave, GRAM)
    reach = step + GRAM
    ahead = words[anchor : anchor + reach + 2 * octave].tolist()
    forward = z_function(ahead)
    found = [p for p in range(octave, min(2 * octave, len(ahead))) if forward[p] >= GRAM]
    if not found:
        return
    # Reversed: the words before the anchor, a value that no word has, and the words before anchor + 2P.
    before = words[:anchor][::-1].tolist()
    until = words[: anchor + 2 * octave]
    back = z_function([*before, -1, *until[::-1].tolist()])
    for p in found:
        yield p, start + anchor - back[len(until) + 1 - p], start + anchor + min(forward[p], reach)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run covers behind its first period, joined by one space."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def _scan(least: int):
    """A row per document, and behind it rows of its tiles, a bounded number of words in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are numbered by task; the result is stored, so a document is numbered once.
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, counts, tiled, found, size = batch.column(0), [], [], [], 0
            for text in texts.to_pylist():
                words, any_tile = text.encode().split() if text else [], False
                for octave, start, anchor, own in tiles(numbered_words(words), least):
                    wide = len(own) > 0 and int(own.max()) > 0xFFFF
                    data = own.astype("<i4" if wide else "<u2").tobytes()
                    found.append((row + len(counts), octave, start, anchor, wide, data))
                    size, any_tile = size + len(own), True
                    if size > TILE_WORDS:
                        yield _rows(batch, _TILE, found)
                        found, size = [], 0
                counts.append(len(words))
                tiled.append(any_tile)
            yield _rows(batch, _TILE, found)
            rows = zip(range(row, row + len(counts)), counts, tiled, strict=True)
            yield _rows(batch, _DOCUMENT, list(rows), batch.columns)
            row += len(counts)

    return run


_TILE = ["row", "octave", "start", "anchor", "wide", "words"]
_DOCUMENT = ["row", "n_words", "tiled"]


def _rows(like: pa.RecordBatch, names: list[str], rows: list[tuple], own: list[pa.Array] | None = None) -> pa.RecordBatch:
    """Rows of some columns of the scan; the other columns are null."""
    given = dict(zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True))
    kinds = {"row": pa.int64(), "n_words": pa.int64(), "tiled": pa.bool_(), "octave": pa.int32()}
    kinds |= {"start": pa.int64(), "anchor": pa.int32(), "wide": pa.bool_(), "words": pa.binary()}
    columns = [pa.array(given[x], t) if x in given else pa.nulls(len(rows), t) for x, t in kinds.items()]
    columns += own or [pa.nulls(len(rows), x.type) for x in like.columns]
    return pa.RecordBatch.from_arrays(columns, [*kinds, "text", "kept"])


def _parse(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for row, octave, start, anchor, wide, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            own = fragments(octave, start, anchor, np.frombuffer(words, "<i4" if wide else "<u2").astype(np.int32))
            out += [(row, *x) for x in own]
            if len(out) >= 1 << 16:
                yield _fragment_batch(out)
                out = []
        yield _fragment_batch(out)


def _fragment_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "period", "low", "high"])


def stitched(found: DataFrame, shortest: int, least: int) -> DataFrame:
    """Runs (row, start, length, period) of the fragments (row, period, low, high)."""
    here = Window.partitionBy("row", "period").orderBy("low", "high")
    so_far = F.max("high").over(here.rowsBetween(Window.unboundedPreceding, -1))
    whole = (
        found.withColumn("fresh", F.coalesce(F.col("low") > so_far, F.lit(True)).cast("int"))
        .withColumn("stretch", F.sum("fresh").over(here.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "period", "stretch")
        .agg(F.min("low").alias("start"), F.max("high").alias("high"))
        .withColumn("length", F.col("high") - F.col("start") + F.col("period"))
    )
    return (
        whole.where((F.col("length") >= shortest) & (F.col("length") >= least * F.col("period")))
        .groupBy("row", "start", "length")
        .agg(F.min("period").alias("period"))
    )


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("text")).to_pylist()
        runs = batch.column(names.index("runs")).to_pylist()
        out = []
        for text, own in zip(texts, runs, strict=True):
            own = [(x["start"], x["length"], x["period"]) for x in own or []]
            words = text.encode().split() if text else []
            out.append((collapse(words, own) if own else b" ".join(words)).decode())
        columns = [*batch.columns, pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "collapsed"])


def find_runs(
    docs: DataFrame,
    text_column: str = "text",
    shortest: int = SHORTEST,
    least: int = LEAST,
) -> DataFrame:
    """All columns of `docs`, `_n_words`, `_runs` (by start, then period) and `_collapsed`.

    `shortest` is 24 or more and `least` 3 or more: smaller runs may lie between the anchors.
    """
    if shortest < 3 * GRAM or least < 3:
        raise ValueError("runs of under 24 words or three periods are not found by these tiles")
    others = [F.col(f"`{x}`") for x in docs.columns if x != text_column]
    texts = docs.select(
        F.col(f"`{text_column}`").cast("string").alias("text"), F.struct(F.lit(0).alias("-"), *others).alias("kept")
    )
    kept = StructField("kept", texts.schema["kept"].dataType)
    text = StructField("text", StringType())
    schema = StructType([*_parse(_SCANNED), text, kept])
    scanned = stored(texts.mapInArrow(_scan(least), schema), "zstd")
    dealt = scanned.where("octave is not null").select(*_TILE).repartition("row", "octave", "start")
    found = stitched(dealt.mapInArrow(_solve, _FRAGMENTS), shortest, least)
    place = F.struct("start", "period", "length")
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("runs"))
    in_order = F.transform("runs", lambda x: F.struct(x["start"], x["length"], x["period"])).cast(RUNS)
    lists = lists.select(F.col("row").alias("of"), in_order.alias("runs"))
    # Only documents with a tile meet their runs; the others stay where they are.
    tiled = scanned.where("tiled").join(lists.hint("merge"), F.col("row") == F.col("of"), "left")
    plain = scanned.where("not tiled").withColumn("runs", F.lit(None).cast(RUNS))
    columns = ["text", "kept", "n_words", "runs"]
    schema = StructType([text, kept, *_parse(f"n_words long, runs {RUNS}, collapsed string")])
    out = tiled.select(*columns).unionByName(plain.select(*columns)).mapInArrow(_collapsed, schema)
    return out.select(
        *[
            (F.col("text") if x == text_column else F.col("kept").getField(x)).alias(x)
            for x in docs.columns
        ],
        F.col("n_words").alias("_n_words"),
        F.coalesce("runs", F.array().cast(RUNS)).alias("_runs"),
        F.col("collapsed").alias("_collapsed"),
    )


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first, then the shortest period; null without runs."""

    def better(a: Column, b: Column) -> Column:
        # Cross-multiplied: no quotient is rounded. Runs come by start, then period, so the first of equals stays.
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
