"""Removal of bytes inside stretches that occur earlier in the corpus, by a merge sort of suffixes.

Every start of a stretch of `size` bytes is a suffix, cut off after `size` bytes. Suffixes with the same
smallest gram of `gram` bytes at the same place form a run of neighbours that is kept as one string; equal
stretches always carry the same gram. Grams are counted over the corpus first, and suffixes whose gram is
unique, being unique, are not sorted.

The rest is sorted as strings: a task sorts the strings of its documents, front-codes them (the length of
the prefix common with the one before, and the rest) and sends one such run to every partition of grams.
There the runs meet in a loser tree whose players carry the length of the prefix they share with the last
winner: the longer one wins without a look at the texts, and if both are equal, comparing starts behind
the known prefix. Neighbours that share their whole length are equal; all but the earliest are repeated.
Different strings with one gram are then cut into their suffixes, sorted, and compared in the same way.

Repeated stretches merge to maximal byte intervals. Order is by (document id, first byte). Equal strings
of one batch travel once, so a passage of a third of all documents sends one string a batch; a partition
holds the different strings around some grams.

Defined cases: a null text is empty; documents under `size` bytes have no stretch; rows that repeat an id
are judged each by its own text, and stretches at the same place of one id tie, so neither is earlier; null
ids come first; an empty table gives no rows; other columns are ignored; a text of any length is one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm import hashing
from playtally.llm.store import release, stored
from playtally.llm.window_dedup import listed_grams, merge

SIZE = 100
GRAM = 24
#: Grams of the corpus for one partition of the merge.
PARTITION_GRAMS = 100_000
#: Bytes whose hashes are made in one go, so that they stay in a processor's cache.
PIECE_BYTES = 1 << 16


def digest(text: bytes) -> int:
    """64 bits that tell the texts of a repeated id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _byte_rows(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of every byte; -1 for the bytes between rows."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    row[at[1:] - 1] = -1
    return row


def _runs_of(buffer: np.ndarray, at: np.ndarray, size: int, gram: int):
    row = _byte_rows(buffer, at)
    # Bytes between rows differ from all rows, and a window that holds one is not valid.
    h, start, n = hashing.window_runs(buffer, np.where(row < 0, -2 - np.arange(len(row)), row), size, gram)
    return h, start, n, row[start]


def _grams(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buffer, at in hashing.pieces(batch.column(1), PIECE_BYTES):
                h, _, _, row = _runs_of(buffer, at, size, gram)
                ids = batch.column(0).take(pa.array(first + row))
                yield pa.RecordBatch.from_arrays([hashing.signed(h), ids], ["h", "doc_id"])

    return run


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    end = min(len(a), len(b))
    # As numbers, strings differ from their highest different bit on.
    x = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix with the one before, and the rest, of sorted strings."""
    width = max(map(len, strings), default=0)
    prefixes, tails, before, length = [], [], 0, 0
    for s in strings:
        # Of one width, each string is made a number once; the shorter one's length bounds what is shared.
        number = int.from_bytes(s.ljust(width, b"\0"), "big")
        p = min(width - ((before ^ number).bit_length() + 7) // 8, length, len(s))
        prefixes.append(p)
        tails.append(s[p:])
        before, length = number, len(s)
    return prefixes, tails


class LoserTree:
    """Merges front-coded sorted runs; yields (shared prefix with the one before, string, run, place in the run)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self._runs = runs
        self._place = [0] * len(runs)
        self._head: list[bytes | None] = []
        for prefixes, tails in runs:
            self._head.append(tails[0] if prefixes else None)
        self._known = [0] * len(runs)
        self._width = 1
        while self._width < max(1, len(runs)):
            self._width *= 2
        self._losers = [-1] * self._width

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a wins; what the loser shares with the winner is noted."""
        x = self._head[a] if a < len(self._head) else None
        y = self._head[b] if b < len(self._head) else None
        if x is None or y is None:
            return y is None
        p, q = self._known[a], self._known[b]
        if p != q:
            return p > q
        shared = common_prefix(x, y, p)
        wins = x <= y
        self._known[b if wins else a] = shared
        return wins

    def _advance(self, run: int) -> None:
        prefixes, tails = self._runs[run]
        place = self._place[run] = self._place[run] + 1
        if place < len(prefixes):
            self._known[run] = prefixes[place]
            self._head[run] = self._head[run][: prefixes[place]] + tails[place]
        else:
            self._head[run] = None

    def _first(self, node: int) -> int:
        if node >= self._width:
            return node - self._width
        a, b = self._first(2 * node), self._first(2 * node + 1)
        winner, loser = (a, b) if self._beats(a, b) else (b, a)
        self._losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        winner = self._first(1)
        while winner < len(self._runs) and self._head[winner] is not None:
            yield self._known[winner], self._head[winner], winner, self._place[winner]
            self._advance(winner)
            node = (winner + self._width) // 2
            while node:
                if not self._beats(winner, self._losers[node]):
                    winner, self._losers[node] = self._losers[node], winner
                node //= 2


#: Numbers travel as packed columns: as arrays of structs they take 56 bytes a member.
BLOCK = "part long, prefixes binary, tails binary, lengths binary, members binary"


def _packed(pack, rows: list[tuple]) -> bytes:
    """Rows of numbers, column by column; a null, as an id may be, is marked in a column of its own."""
    columns = []
    for x in zip(*rows, strict=True):
        columns.append(np.array([v is None for v in x], np.int64))
        columns.append(np.array([v or 0 for v in x], np.int64))
    return pack.compress(b"".join(x.tobytes() for x in columns))


def _unpacked(unpack, data: bytes, width: int) -> list[tuple]:
    values = np.frombuffer(unpack.decompress(data), np.int64).reshape(width, 2, -1)
    columns = [x.tolist() for x in values[:, 1]]
    for column, none in zip(columns, values[:, 0], strict=True):
        for i in np.flatnonzero(none).tolist():
            column[i] = None
    return list(zip(*columns, strict=True))


def _order(doc_id: int | None, start: int) -> tuple:
    return (doc_id is not None, doc_id or 0, start)


def _sorted_runs(size: int, gram: int, parts: int):
    """Front-coded runs of the strings of a batch, one for every partition; repeated strings go to part -1, -2, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            dealt: dict[int, dict[bytes, list[tuple]]] = {}
            again: list[tuple] = []
            for first, buffer, at in hashing.pieces(batch.column("text"), PIECE_BYTES):
                h, start, n, row = _runs_of(buffer, at, size, gram)
                keep = listed_grams(batch.column("grams"), first, row, h)
                h, start, n, row = h[keep], start[keep], n[keep], row[keep]
                data = buffer.tobytes()
                digests = [digest(data[a:b]) for a, b in zip(at[:-1].tolist(), (at[1:] - 1).tolist(), strict=True)]
                part = (hashing.mix(h) % np.uint64(parts)).astype(np.int64)
                for x in zip(
                    part.tolist(), h.view(np.int64).tolist(), start.tolist(), n.tolist(), row.tolist(), strict=True
                ):
                    p, own, s, k, r = x
                    member = (own, ids[first + r], digests[r], s - int(at[r]), k)
                    held = dealt.setdefault(p, {})
                    string = data[s : s + k + size - 1]
                    group = held.setdefault(string, [member])
                    if group[0] is member:
                        continue
                    # The earliest stays; those at the same place of the same id tie with it.
                    mine, best = _order(member[1], member[3]), _order(group[0][1], group[0][3])
                    if mine < best:
                        again += group
                        held[string] = [member]
                    elif mine > best:
                        again.append(member)
                    elif member not in group:
                        group.append(member)
            rows = []
            for p, held in dealt.items():
                strings = sorted(s for s, group in held.items() for _ in group)
                prefixes, tails = front_code(strings)
                own = [m for s in dict.fromkeys(strings) for m in held[s]]
                lengths = [(len(t),) for t in tails]
                prefixes = [(x,) for x in prefixes]
                rows.append((p, _packed(pack, prefixes), pack.compress(b"".join(tails)), _packed(pack, lengths), _packed(pack, own)))
            if again:
                rows.append((-1 - abs(hash(again[0])) % parts, None, None, None, _packed(pack, again)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in rows], pa.int64()),
                    *(pa.array([x[i] for x in rows], pa.binary()) for i in range(1, 5)),
                ],
                ["part", "prefixes", "tails", "lengths", "members"],
            )

    return run


def _later(group: list[tuple]) -> Iterator[tuple]:
    """Members of a group of equal strings that start later than its earliest."""
    low = min(_order(m[1], m[3]) for m in group)
    return (m for m in group if _order(m[1], m[3]) > low)


def merge_partition(blocks: list[dict], size: int) -> Iterator[tuple]:
    """(doc_id, digest, start, end) of the repeated stretches of a partition."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    runs, members = [], []
    for block in blocks:
        own = _unpacked(unpack, block["members"], 5)
        if block["prefixes"] is None:
            for m in own:
                yield m[1], m[2], m[3], m[3] + m[4] + size - 1
            continue
        data, at, tails = unpack.decompress(block["tails"]), 0, []
        for (length,) in _unpacked(unpack, block["lengths"], 1):
            tails.append(data[at : at + length])
            at += length
        runs.append(([x for (x,) in _unpacked(unpack, block["prefixes"], 1)], tails))
        members.append(own)

    forms: dict[int, list[tuple[bytes, tuple]]] = {}

    def close(string: bytes, group: list[tuple]) -> Iterator[tuple]:
        if len(group) == 1:
            forms.setdefault(group[0][0], []).append((string, group[0]))
            return
        for m in _later(group):
            yield m[1], m[2], m[3], m[3] + m[4] + size - 1
        low = min(_order(m[1], m[3]) for m in group)
        for m in group:
            if _order(m[1], m[3]) == low:
                forms.setdefault(m[0], []).append((string, m))

    last, group = b"", []
    for shared, string, run, place in LoserTree(runs):
        if group and not (shared == len(string) == len(last)):
            yield from close(last, group)
            group = []
        group.append(members[run][place])
        last = string
    if group:
        yield from close(last, group)

    for own in forms.values():
        if len(own) > 1:
            suffixes = sorted(((s[j : j + size], j, m) for s, m in own for j in range(m[4])), key=itemgetter(0))
            for _, same in groupby(suffixes, key=itemgetter(0)):
                _, *more = equal = list(same)
                if more:
                    at = [_order(m[1], m[3] + j) for _, j, m in equal]
                    low = min(at)
                    for (_, j, m), place in zip(equal, at, strict=True):
                        if place > low:
                            yield m[1], m[2], m[3] + j, m[3] + j + size


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        # Touching stretches of one document go on as one.
        spans: dict[tuple, list] = {}
        for doc, digest, start, end in merge_partition(table.drop_columns(["part"]).to_pylist(), size):
            spans.setdefault((doc, digest), []).append((start, end))
        rows = [(d, g, s, e) for (d, g), own in spans.items() for s, e in merge(own)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table(
            [pa.array(x, pa.int64()) for x in columns], names=["doc_id", "digest", "start", "end"]
        )

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, kept, spans = [], [], [], []
        for first, buffer, at in hashing.pieces(batch.column("text"), PIECE_BYTES):
            for r in range(len(at) - 1):
                data = buffer[at[r] : at[r + 1] - 1].tobytes()
                # Texts without a repeated stretch need no digest.
                found = batch.column("spans")[first + r].as_py() or ()
                here = digest(data) if found else None
                own = merge([(x["start"], x["end"]) for x in found if x["digest"] == here])
                left, last = [], 0
                for s, e in own:
                    left.append(data[last:s])
                    last = e
                n_bytes.append(len(data))
                n_removed.append(sum(e - s for s, e in own))
                kept.append(b"".join(left) + data[last:])
                spans.append([{"start": s, "end": e} for s, e in own])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_bytes, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )


def remove_repeats(
    docs: DataFrame,
    size: int = SIZE,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (byte intervals), kept (remaining bytes)."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    grams = stored(texts.mapInArrow(_grams(size, gram), "h long, doc_id long"))
    parts = grams.count() // PARTITION_GRAMS + 1
    repeated = grams.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    hits = stored(grams.join(repeated, "h").groupBy("doc_id").agg(F.collect_set("h").alias("grams")))

    def with_texts(lists: DataFrame, how: str = "inner") -> DataFrame:
        lists = lists.withColumnRenamed("doc_id", "_id")
        # No broadcast: the lists grow with the corpus.
        return texts.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id")

    blocks = with_texts(hits).mapInArrow(_sorted_runs(size, gram, parts), BLOCK)
    spans = stored(
        blocks.groupBy("part").applyInArrow(_merge(size), "doc_id long, digest long, start long, end long")
    )
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "start", "end")).alias("spans"))
    release(docs.sparkSession)
    return with_texts(lists, "left").mapInArrow(
        _remove,
        "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary",
    )
