"""Packing of tokenised documents into fixed-length sequences by Karmarkar-Karp differencing.

A document becomes its token ids and one end id. It is cut into pieces of at most `max_piece` ids,
where full pieces of `capacity` ids fill a sequence alone; the other pieces are dealt at random over
groups of bounded size, and each group is divided by multiway differencing: the two partial partitions
with the largest imbalance are merged so that the large sums of one meet the small sums of the other.
Differencing makes the sums of all sequences of a group nearly equal. A group starts with the fewest
sequences that could hold its ids and gets more of them whenever one would exceed the capacity.

Only numbers are shuffled: ids are made, cut and check-summed in one pass over the texts, and that
pass is stored, so that the group of a piece is the same whenever a task is repeated.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for itself,
null keys included; an empty table gives no rows; other columns are ignored; a text of any length
becomes as many pieces as it needs.
"""

from __future__ import annotations

import array
import heapq
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm.store import stored

CAPACITY = 2048
MAX_PIECE = 512
END_ID = 1
#: Sequences of a group: more make fuller sequences, fewer make smaller groups.
GROUP_SEQUENCES = 128
#: Chunks whose ids a task remembers.
MEMO_ENTRIES = 1_000_000
#: Chunks longer than this are not remembered.
MEMO_CHARS = 64

# Before a single blank that follows a character which is no white space, a pre-token of the
# vocabulary ends, so such stretches can be encoded apart. Other texts are encoded whole.
_BLANK_AFTER_SPACE = tuple(x + " " for x in " \t\n\r\x0b\x0c")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _apart(text: str) -> bool:
    return not (
        text[:1] == " "
        or text[-1:] == " "
        or any(x in text for x in _BLANK_AFTER_SPACE)
        or (not text.isascii() and _OTHER_SPACE.search(text))
        or any(x in text for x in "\x1c\x1d\x1e\x1f")
    )


def _worker_memo() -> dict[str, dict[str, bytes]]:
    """A dictionary that stays with the Python process, so later tasks find what earlier ones encoded."""
    return sys.modules.setdefault("_encoder_memo", types.ModuleType("_encoder_memo")).__dict__.setdefault(
        "chunks", {}
    )


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, in_row long"
)


class Encoder:
    """Ids of texts as little-endian 32-bit values; repeated chunks are encoded once."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._tokenizer.encode_special_tokens = True
        self._memo = _worker_memo().setdefault(tokenizer_path, {})
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        # Tokens that begin with a blank, as byte-level vocabularies write it.
        self._blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._blank[[i for x, i in vocabulary.items() if x[:1] == "\u0120"]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", x.ids).tobytes() for x in found]

    def _encode_chunks(self, first: str, chunks: list[str]) -> list[bytes]:
        """Ids of `first` and of each chunk behind a blank: of one text, cut where a token begins with a blank."""
        ids = self._encode([" ".join([first, *chunks])])[0]
        cuts = (4 * np.flatnonzero(self._blank[np.frombuffer(ids, "<u4")])).tolist()
        if len(cuts) != len(chunks):
            return self._encode([first, *(" " + x for x in chunks)])
        return [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]

    def ids(self, text: str) -> bytes:
        if not _apart(text):
            return self._encode([text])[0]
        first, *chunks = text.split(" ")
        memo = self._memo
        found = list(map(memo.get, chunks))
        new = list({x for x, y in zip(chunks, found, strict=True) if y is None})
        head, *ids = self._encode_chunks(first, new)
        if new:
            encoded = dict(zip(new, ids, strict=True))
            found = [encoded[x] if y is None else y for x, y in zip(chunks, found, strict=True)]
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
            if len(new) <= MEMO_ENTRIES:
                memo.update((x, y) for x, y in encoded.items() if len(x) <= MEMO_CHARS)
        return head + b"".join(found)


def _pieces(tokenizer_path: str, capacity: int, max_piece: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end, row = Encoder(tokenizer_path), np.uint32(end_id).tobytes(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encoder.ids(text) if text else b"") + end
                tokens, start = len(ids) // 4, 0
                while start < tokens:
                    left = tokens - start
                    length = capacity if left >= capacity else min(left, max_piece)
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    out.append((doc, start, length, crc, tokens, row))
                    start += length
                row += 1
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "in_row"],
            )

    return run


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: indexes of `sizes` in `ways` sets of nearly equal sums."""
    # A partial partition: sums, largest first, zeros left out, and the members of each.
    heap = [(-size, i, [size], [(i,)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, a, a_sets = heapq.heappop(heap)
        _, _, b, b_sets = heapq.heappop(heap)
        # The largest of one meets the smallest of the other; absent sums are zeros.
        apart = max(0, ways - len(b))
        sums, sets = a[:apart], a_sets[:apart]
        for i in range(apart, len(a)):
            sums.append(a[i] + b[ways - 1 - i])
            sets.append((a_sets[i], b_sets[ways - 1 - i]))
        alone = len(b) - max(0, len(a) - apart)
        sums += b[:alone]
        sets += b_sets[:alone]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, sets = [sums[i] for i in order], [sets[i] for i in order]
        low = sums[-1] if len(sums) == ways else 0
        heapq.heappush(heap, (low - sums[0], fresh, sums, sets))
        fresh += 1
    return [_flat(x) for x in heap[0][3]] if heap else []


def _flat(sets: tuple) -> list[int]:
    out, stack = [], [sets]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def divide(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of at most `capacity`: as few as their sum allows, and more whenever one exceeds it."""
    ways = -(-sum(sizes) // capacity)
    while ways:
        sets = differencing(sizes, ways)
        excess = max(sum(sizes[i] for i in x) for x in sets) - capacity
        if excess <= 0:
            return sets
        ways += max(1, excess * ways // (capacity * 4))
    return []


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    max_piece: int = MAX_PIECE,
    end_id: int = END_ID,
    group_sequences: int = GROUP_SEQUENCES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens."""
    pieces = stored(
        docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(
            _pieces(tokenizer_path, capacity, max_piece, end_id), PIECES
        )
    )
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // (capacity * group_sequences)))
    # Stored rows lie still, so their number is a fair and repeatable die, also for equal rows.
    dealt = pieces.withColumn(
        "group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes = table.column("length").to_pylist()
        whole = sum(x >= capacity for x in sizes)
        sets = [[i] for i in range(whole)] + [
            sorted(whole + i for i in x) for x in divide(sizes[whole:], capacity)
        ]
        sequence, offset, filled = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for number, members in enumerate(sets):
            at = 0
            for i in members:
                sequence[i], offset[i] = key[0].as_py() + groups * number, at
                at += sizes[i]
            filled[members] = at
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        for name, column in (("sequence_id", sequence), ("offset", offset), ("sequence_tokens", filled)):
            out = out.append_column(name, pa.array(column))
        return out

    return dealt.groupBy("group").applyInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long, sequence_tokens long",
    )
