"""Removal of words inside windows that occur earlier in the corpus, by Rabin-Karp hashes.

Every window of `size` consecutive words of a document is hashed by a rolling polynomial, and hashes are
counted over the corpus. So that not every window has to be shuffled, neighbouring windows that share
their smallest gram of `gram` words form a run; equal windows always carry the same gram.

1. Grams of all runs are counted in Spark. Windows whose gram is unique are unique themselves.
2. Of the rest, runs are compared whole: a run whose words also form an earlier run is repeated in all
   its windows.
3. Of different runs with one gram, the earliest of each form is taken apart into windows, and those are
   compared one by one.

Repeated windows merge into maximal intervals of words. Order is by (document id, first word). All groups
are aggregated before they are joined, so a passage of a third of all documents sends a row a task; the
join that brings grams back to documents is one that Spark splits where a key is hot.

Defined cases: null and empty texts have no words; shorter documents have no window; rows that repeat an
id are judged each by its own text, and windows at the same place of one id tie, so neither is earlier;
null ids come first; an empty table gives no rows; other columns are ignored; a text of any length is one
document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm import hashing
from playtally.llm.store import stored

SIZE = 20
GRAM = 6

RUNS = "h long, s1 long, s2 int, doc_id long, digest long, start int, n int"


def _word_hashes(buffer: np.ndarray, at: np.ndarray):
    starts, ends, row = hashing.words(buffer, at)
    return hashing.word_hashes(buffer, starts, ends), row


def _digests(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    return hashing.stretch_hashes(buffer, at[:-1], at[1:] - 1, hashing.BYTE_BASE)


def _grams(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buffer, at in hashing.pieces(batch.column(1)):
                values, row = _word_hashes(buffer, at)
                h, start, _ = hashing.window_runs(values, row, size, gram)
                ids = batch.column(0).take(pa.array(first + row[start]))
                yield pa.RecordBatch.from_arrays([hashing.signed(h), ids], ["h", "doc_id"])

    return run


def listed_grams(column: pa.Array, first: int, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (row, h) are in the list of the row."""
    lists = column.slice(first, int(row[-1]) + 1 if len(row) else 0)
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0), np.int64))
    # One number for both: lists and runs of a row meet in it.
    mark = lambda r, x: hashing.mix(x ^ hashing.mix(r.astype(np.uint64)))
    listed = mark(owner, np.asarray(lists.flatten(), np.int64).view(np.uint64))
    return np.isin(mark(row, h), listed)


def _runs(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buffer, at in hashing.pieces(batch.column("text")):
                values, row = _word_hashes(buffer, at)
                h, start, n = hashing.window_runs(values, row, size, gram)
                keep = listed_grams(batch.column("grams"), first, row[start], h)
                h, start, n = h[keep], start[keep], n[keep]
                one = hashing.stretch_hashes(values, start, start + n + size - 1, hashing.WORD_BASE)
                two = hashing.stretch_hashes(values, start, start + n + size - 1, hashing.BYTE_BASE)
                begin = np.searchsorted(row, np.arange(len(at)))
                yield pa.RecordBatch.from_arrays(
                    [
                        hashing.signed(h),
                        hashing.signed(one),
                        pa.array(two.astype(np.uint32).view(np.int32)),
                        batch.column("doc_id").take(pa.array(first + row[start])),
                        hashing.signed(_digests(buffer, at)[row[start]]),
                        pa.array((start - begin[row[start]]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["h", "s1", "s2", "doc_id", "digest", "start", "n"],
                )

    return run


def _windows(size: int):
    """The single windows of listed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buffer, at in hashing.pieces(batch.column("text")):
                values, row = _word_hashes(buffer, at)
                begin, digests = np.searchsorted(row, np.arange(len(at))), _digests(buffer, at)
                places, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for r in range(len(at) - 1):
                    for x in batch.column("runs")[first + r].as_py():
                        if x["digest"] == int(digests[r : r + 1].view(np.int64)[0]):
                            places.append(begin[r] + x["start"] + np.arange(x["n"]))
                            rows.append(np.full(x["n"], r))
                place, own = np.concatenate(places), np.concatenate(rows)
                one = hashing.stretch_hashes(values, place, place + size, hashing.WORD_BASE)
                two = hashing.stretch_hashes(values, place, place + size, hashing.BYTE_BASE)
                yield pa.RecordBatch.from_arrays(
                    [
                        hashing.signed(one),
                        pa.array(two.astype(np.uint32).view(np.int32)),
                        batch.column("doc_id").take(pa.array(first + own)),
                        hashing.signed(digests[own]),
                        pa.array((place - begin[own]).astype(np.int32)),
                    ],
                    ["s1", "s2", "doc_id", "digest", "start"],
                )

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals of overlapping or touching ones."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept, spans = [], [], [], []
        for first, buffer, at in hashing.pieces(batch.column("text")):
            digests = _digests(buffer, at).view(np.int64).tolist()
            data = buffer.tobytes()
            for r, digest in enumerate(digests):
                # Without arguments, bytes split at the same white space as the hashes see.
                words = data[at[r] : at[r + 1] - 1].split()
                own = merge(
                    [(x["start"], x["end"]) for x in batch.column("spans")[first + r].as_py() or () if x["digest"] == digest]
                )
                n_words.append(len(words))
                n_removed.append(sum(e - s for s, e in own))
                left, last = [], 0
                for s, e in own:
                    left += words[last:s]
                    last = e
                kept.append((b" ".join(left + words[last:])).decode())
                spans.append([{"start": s, "end": e} for s, e in own])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "spans", "text"],
        )


def first_and_rest(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The earliest place of each key with the number of its rows, and the rows that come later than it."""
    place = F.struct("doc_id", "start")
    own = F.struct("doc_id", "start", "digest", *(["n"] if "n" in rows.columns else []))
    first = stored(rows.groupBy(*keys).agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("rows")))
    again = first.where("rows > 1").select(*keys, F.struct("first.doc_id", "first.start").alias("place"))
    return first, rows.join(again, keys).where(place > F.col("place"))


def remove_repeats(
    docs: DataFrame,
    size: int = SIZE,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (word intervals), text (kept words)."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    grams = stored(texts.mapInArrow(_grams(size, gram), "h long, doc_id long"))
    repeated = grams.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    hits = stored(grams.join(repeated, "h").groupBy("doc_id").agg(F.collect_set("h").alias("grams")))

    def with_texts(lists: DataFrame, how: str = "inner") -> DataFrame:
        lists = lists.withColumnRenamed("doc_id", "_id")
        # No broadcast: the lists grow with the corpus.
        return texts.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id")

    runs = stored(with_texts(hits).mapInArrow(_runs(size, gram), RUNS))
    first, later = first_and_rest(runs, ["h", "s1", "s2"])
    span = lambda n: F.struct("digest", "start", (F.col("start") + n + (size - 1)).alias("end"))
    whole = stored(later.select("doc_id", span(F.col("n")).alias("span")))

    differing = first.groupBy("h").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("h")
    apart = (
        first.join(differing, "h", "left_semi")
        .select("first.*")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("digest", "start", "n")).alias("runs"))
    )
    # Read twice, so cut: neither the texts nor the windows are made again.
    windows = stored(with_texts(apart).mapInArrow(_windows(size), "s1 long, s2 int, doc_id long, digest long, start int"))
    single = first_and_rest(windows, ["s1", "s2"])[1].select("doc_id", span(F.lit(1)).alias("span"))

    spans = stored(whole.unionByName(single).groupBy("doc_id").agg(F.collect_list("span").alias("spans")))
    return with_texts(spans, "left").mapInArrow(
        _remove,
        "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string",
    )
