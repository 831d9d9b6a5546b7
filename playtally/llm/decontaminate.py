"""Benchmark decontamination: an FM-index per shard of documents, searched for the phrases of a test set.

A phrase is `window` consecutive words of an item; a shorter item is one phrase. Benchmark items are
taken in blocks of bounded size, and a block travels to the executors as numbers. Of a shard - some
megabytes of neighbouring documents - only stretches are indexed whose words and word pairs all occur
in the block, since a phrase lies in no other place. All phrases are searched backwards at once through
the wavelet tree; the rows found are located by sampled suffix positions and merged to word spans. A
document is handled in one task from its text to its spans, so nothing is shuffled.

Words are maximal runs of digits, letters and non-ASCII characters after lower-casing A-Z.

Defined cases: null and empty texts have no words and no hits; an item without words has no phrase; an
item without id takes part in the hits but is not listed; an id that occurs on several rows is listed
once; repeated documents are judged each for itself; empty tables give no rows or no hits; other
columns are ignored; a text of any length is one document of one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm import hashing, native
from playtally.llm.fm_index import FMIndex

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Words of the benchmark that are searched together; more are searched one block after the other.
BLOCK_WORDS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = hashing.byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_FOUND = "array<struct<start:long,end:long>>"
SPANS = f"doc_id long, text string, n_words long, spans {_FOUND}, items array<long>"


def _words(buffer: np.ndarray, at: np.ndarray):
    buffer = _LOWER[buffer]
    starts, ends, row = hashing.words(buffer, at, _WORD)
    return hashing.word_hashes(buffer, starts, ends), row


class Block:
    """Phrases of some benchmark items as rows of word numbers; word 1 stands for all that is no word here."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        phrases: dict[tuple, set] = {}
        hashes, pairs = [], set()
        ids, texts = [x for x, _ in items], pa.array([x for _, x in items], pa.string())
        each: list[np.ndarray] = []
        for _, buffer, at in hashing.pieces(texts):
            found, row = _words(buffer, at)
            each += np.split(found, np.searchsorted(row, np.arange(1, len(at) - 1)))
        hashes = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        for item, own in zip(ids, each, strict=True):
            numbers = (np.searchsorted(hashes, own) + 2).tolist()
            pairs.update(zip(numbers, numbers[1:], strict=False))
            for i in range(max(1, len(numbers) - window + 1) if numbers else 0):
                phrases.setdefault(tuple(numbers[i : i + window]), set()).add(item)
        self.hashes = hashes
        self.symbols = len(hashes) + 2
        self.pairs = np.array(sorted(a * self.symbols + b for a, b in pairs), np.int64)
        self.lengths = np.array([len(x) for x in phrases], np.int64)
        self.phrases = np.zeros((len(phrases), window), np.int64)
        for i, x in enumerate(phrases):
            self.phrases[i, : len(x)] = x
        self.items = [sorted(y for y in x if y is not None) for x in phrases.values()]

    def stretches(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and places of the words of a shard that may belong to a phrase, stretches parted by 1."""
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        number = np.where(self.hashes[place] == hashes, place + 2, 1)
        pair = number[:-1] * self.symbols + number[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        joined = (self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)) & (row[1:] == row[:-1])
        known = number > 1
        begin = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        end = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long_enough = end - begin >= self.lengths.min()
        begin, end = begin[long_enough], end[long_enough]
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = end - begin + 1
        shift = np.concatenate(([0], np.cumsum(size)[:-1]))
        places = np.arange(size.sum()) - np.repeat(shift - begin, size)
        last = np.cumsum(size) - 1
        places[last] = 0
        text = number[places]
        text[last] = 1
        return text, places

    def occurrences(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence of every phrase in a shard."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(hashes):
            return nothing
        text, places = self.stretches(hashes, row)
        if not len(text):
            return nothing
        index = FMIndex(text, self.symbols)
        low, high = index.search(self.phrases, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
        return phrase, places[index.locate(rows)]


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Block.__new__(Block)
        vars(phrases).update(block.value)
        for batch in batches:
            before_spans, before_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words, spans, items = [], [], []
            for first, buffer, at in hashing.pieces(batch.column("text")):
                hashes, row = _words(buffer, at)
                begin = np.searchsorted(row, np.arange(len(at)))
                phrase, place = phrases.occurrences(hashes, row)
                deep = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(deep, place, 1)
                np.add.at(deep, place + phrases.lengths[phrase], -1)
                hit = np.cumsum(deep[:-1]) > 0
                # Spans of neighbouring documents must not merge.
                fresh = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
                starts = np.flatnonzero(hit & (fresh | ~np.concatenate(([False], hit[:-1]))))
                ends = np.flatnonzero(hit & np.concatenate((fresh[1:] | ~hit[1:], [True]))) + 1
                own: dict[int, tuple[list, set]] = {}
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    r = int(row[s])
                    own.setdefault(r, ([], set()))[0].append((s - int(begin[r]), e - int(begin[r])))
                for pair in np.unique(row[place] * len(phrases.lengths) + phrase).tolist():
                    r, p = divmod(pair, len(phrases.lengths))
                    own[r][1].update(phrases.items[p])
                for r in range(len(at) - 1):
                    n_words.append(int(begin[r + 1] - begin[r]))
                    found = own.get(r, ((), ()))
                    spans.append(_merged(before_spans[first + r] or [], found[0]))
                    items.append(sorted({*(before_items[first + r] or []), *found[1]}))
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(pair)),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                ["doc_id", "text", "n_words", "spans", "items"],
            )

    return run


def _merged(known: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted([(x["start"], x["end"]) for x in known] + list(new)):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(e, out[-1]["end"])
        else:
            out.append({"start": s, "end": e})
    return out


def blocks(benchmark: DataFrame, id_column: str, text_column: str, window: int) -> Iterator[Block]:
    """The benchmark, read item by item, in blocks of about BLOCK_WORDS words; one empty block at least."""
    items, size, made = [], 0, 0
    for item, text in benchmark.select(id_column, text_column).toLocalIterator():
        items.append((item, text))
        size += len(text or "") // 4 + 1
        if size >= BLOCK_WORDS:
            yield Block(items, window)
            items, size, made = [], 0, made + 1
    if items or not made:
        yield Block(items, window)



def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    one_in: int = ONE_IN,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_hit, spans (word intervals), items, contaminated."""
    spark = docs.sparkSession
    found = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("string").alias("text"),
        F.lit(None).cast(_FOUND).alias("spans"),
        F.lit(None).cast("array<long>").alias("items"),
    )
    for block in blocks(benchmark, item_column, text_column, window):
        found = found.mapInArrow(_search(spark.sparkContext.broadcast(vars(block))), SPANS)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Rows with the same id are judged by their own text: the text is part of the key of the join, as a
    digest. So is a missing id; a document without text is kept.
    """
    id_name, text_name = (native.free_name(docs.columns, x) for x in ("_judged_id", "_judged_text"))
    judged = contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias(id_name), F.xxhash64("text").alias(text_name)
    ).distinct()
    return docs.join(
        judged.hint("merge"),
        F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.xxhash64("text") == F.col(text_name)),
        "left_anti",
    )
