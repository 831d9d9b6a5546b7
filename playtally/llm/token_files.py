"""Token ids as flat files of unsigned integers with 64-bit document offsets, to be memory-mapped.

A data set is a folder. Every shard has three flat little-endian files of one stem:

    STEM.ids      unsigned ids, 16 bits each if the vocabulary allows it, else 32
    STEM.offsets  unsigned 64-bit, one more than documents: where a document begins in the shard, and the end
    STEM.docs     signed 64-bit document ids, ascending; documents without id come first and have 0

and the Parquet table `shards` has one row per shard in the order of the documents: shard, stem, width
(bytes an id), documents, nulls (documents without id), tokens, first_document and first_token. The last
two are prefix sums of the documents and tokens of the shards before, so document k of a shard begins at
first_token + offsets[k] of the whole data set, and no id has to be rewritten when its place is known.

Documents are dealt to shards by ranges of their id, so the shards one after the other are in ascending
order; a task sorts, encodes and appends its range in one pass with bounded memory. Every attempt of a task
writes files of its own name, and only those that its row names belong to the data set: lost executors and
repeated attempts leave at most files that no reader opens.

The folder is on a file system that pyarrow reaches from all executors; local files are memory-mapped,
others read by ranges.

Defined cases: a null or empty text is the end id alone; documents without id come first; equal ids are
ordered by text, repeated rows are written each; an empty table gives no shard; other columns are
ignored; a text of any length is one document of one shard.
"""

from __future__ import annotations

import array
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.operators.numbering import running_totals

END_ID = 2
#: Words whose ids a Python process remembers, and the longest of them.
MEMO_ENTRIES = 1_000_000
MEMO_BYTES = 64
#: Ids that a task holds while it reads a shard back.
READ_TOKENS = 1 << 22

#: What a token that ends a word ends with.
WORD_END = "</w>"
# Visible ASCII and the letters of Latin-1: normal forms of themselves, each with one lower-case form.
_COMMON = re.compile("[\\x21-\\x7eÀ-ÖØ-öø-ÿ]+")
# How the vocabulary parts a word of these characters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

_WRITTEN = "shard int, stem string, width int, documents long, nulls long, tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WordEncoder:
    """Ids of texts as little-endian 32-bit values, for a vocabulary with word ends that drops white space.

    Such a tokenizer treats each word by itself, and of a word each run of letters, each digit and each
    run of other characters, in lower case. Words are looked up; the parts of new words made of common
    characters are looked up as well, and parts that are new are encoded many at a time: behind each,
    and nowhere else, stands a token that ends a word. All other words are encoded one by one.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._tokenizer.encode_special_tokens = True
        # Parts are in lower case and apart already: what is left to do is the vocabulary's own work.
        self._for_parts = Tokenizer(self._tokenizer.model)
        self._for_parts.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.CharDelimiterSplit(" "),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for x, i in vocabulary.items() if x.endswith(WORD_END)]] = True
        held = sys.modules.setdefault("_word_memo", types.ModuleType("_word_memo"))
        self._words, self._parts = held.__dict__.setdefault(tokenizer_path, ({}, {}))

    @property
    def vocabulary(self) -> int:
        return self._tokenizer.get_vocab_size(with_added_tokens=True)

    def ids(self, text: str) -> bytes:
        words = text.encode().split()
        known = self._words
        found = [known.get(x) for x in words]
        if None in found:
            new = self._encode({x for x, y in zip(words, found, strict=True) if y is None})
            found = [new[x] if y is None else y for x, y in zip(words, found, strict=True)]
            _remember(known, new)
        return b"".join(found)

    def _encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        plain: dict[bytes, list[str]] = {}
        others: list[bytes] = []
        for word in words:
            text = word.decode()
            if _COMMON.fullmatch(text):
                plain[word] = _PARTS.findall(text.lower())
            else:
                others.append(word)
        parts = self._parts
        new = self._encode_parts(list({x for own in plain.values() for x in own if x not in parts}))
        out = {}
        for word, own in plain.items():
            out[word] = b"".join([parts.get(x) or new[x] for x in own])
        _remember(parts, new)
        out.update(zip(others, self._one_by_one([x.decode() for x in others]), strict=True))
        return out

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        if not parts:
            return {}
        [made] = self._for_parts.encode_batch_fast([" ".join(parts)], add_special_tokens=False)
        ids = np.array(made.ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            return dict(zip(parts, self._one_by_one(parts), strict=True))
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return {x: data[at[i] : at[i + 1]] for i, x in enumerate(parts)}

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        made = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", x.ids).tobytes() for x in made]


def _remember(memo: dict, new: dict) -> None:
    if len(memo) + len(new) > MEMO_ENTRIES:
        # The older half goes; what is still in use comes back with its next text.
        kept = dict(islice(memo.items(), len(memo) // 2, None))
        memo.clear()
        memo.update(kept)
    memo.update((x, y) for x, y in islice(new.items(), MEMO_ENTRIES // 2) if len(x) <= MEMO_BYTES)


def _place(folder: str):
    """File system of the folder, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _shard(folder: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = WordEncoder(tokenizer_path), np.uint32(end_id).tobytes()
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        shard, (system, root) = TaskContext.get().partitionId(), _place(folder)
        stem = f"{shard:08d}-{uuid.uuid4().hex}"
        files, documents, nulls, tokens = [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                files = [system.open_output_stream(f"{root}/{stem}.{x}") for x in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, "<u8").tobytes())
            ends = []
            for text in batch.column(1):
                own = (encoder.ids(text.as_py()) if text.is_valid else b"") + end
                files[0].write(np.frombuffer(own, "<u4").astype(f"<u{width}").tobytes())
                tokens += len(own) // 4
                ends.append(tokens)
            files[1].write(np.array(ends, "<u8").tobytes())
            files[2].write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            documents += batch.num_rows
            nulls += batch.column(0).null_count
        for file in files:
            file.close()
        rows = [(shard, stem, width, documents, nulls, tokens)] if files else []
        schema = pa.schema(
            [("shard", pa.int32()), ("stem", pa.string()), ("width", pa.int32())]
            + [(x, pa.int64()) for x in ("documents", "nulls", "tokens")]
        )
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    return run


def write(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode the documents and write them to a new folder in ascending order of their ids."""
    spark = docs.sparkSession
    system, root = _place(folder)
    system.create_dir(root, recursive=True)
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    # Rows of one id, or of none, spread by their text; within a task they are sorted by it.
    dealt = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    in_order = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    in_order.mapInArrow(_shard(folder, tokenizer_path, end_id), _WRITTEN).write.parquet(f"{folder}/written")
    written = spark.read.schema(_WRITTEN).parquet(f"{folder}/written")
    bases = running_totals(written, "shard", {"documents": "first_document", "tokens": "first_token"})
    bases.write.parquet(f"{folder}/shards")


def _flat(system, path: str, kind: str, count: int):
    """A function (first, last) -> values of a flat file; a local file is mapped, others are read by ranges."""
    if not count:
        return lambda first, last: np.zeros(0, kind)
    if system.type_name == "local":
        mapped = np.memmap(path, np.dtype(kind), "r", shape=(count,))
        return lambda first, last: mapped[first:last]
    width = np.dtype(kind).itemsize

    def read(first: int, last: int) -> np.ndarray:
        with system.open_input_file(path) as file:
            return np.frombuffer(file.read_at((last - first) * width, first * width), kind)

    return read


class Shard:
    """The three files of one shard."""

    def __init__(self, folder: str, row: dict):
        system, root = _place(folder)
        self.row, stem = row, f"{root}/{row['stem']}"
        self.ids = _flat(system, f"{stem}.ids", f"<u{row['width']}", row["tokens"])
        self.offsets = _flat(system, f"{stem}.offsets", "<u8", row["documents"] + 1)
        self.docs = _flat(system, f"{stem}.docs", "<i8", row["documents"])


class TokenFiles:
    """Random access to a data set, as a training loader reads it.

    The shard table is one row per shard; ids stay in the mapped files until they are asked for.
    """

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        system, root = _place(folder)
        rows = pq.read_table(f"{root}/shards", filesystem=system).sort_by("shard").to_pylist()
        self._shards = [Shard(folder, x) for x in rows]
        self._documents = np.cumsum([0, *(x["documents"] for x in rows)])
        self._tokens = np.cumsum([0, *(x["tokens"] for x in rows)])

    def __len__(self) -> int:
        return int(self._documents[-1])

    @property
    def tokens(self) -> int:
        return int(self._tokens[-1])

    def document(self, number: int) -> np.ndarray:
        """Ids of a document by its number in ascending order of ids, with the end id."""
        if not 0 <= number < len(self):
            raise IndexError(number)
        at = int(np.searchsorted(self._documents, number, "right")) - 1
        shard, k = self._shards[at], number - int(self._documents[at])
        first, last = (int(x) for x in shard.offsets(k, k + 2))
        return shard.ids(first, last)

    def window(self, start: int, length: int) -> np.ndarray:
        """`length` consecutive ids of the whole data set from `start`, across documents and shards."""
        if start < 0 or length < 0 or start + length > self.tokens:
            raise IndexError((start, length))
        found, at = [np.zeros(0, "<u4")], int(np.searchsorted(self._tokens, start, "right")) - 1
        while length:
            base, end = int(self._tokens[at]), int(self._tokens[at + 1])
            own = min(length, end - start)
            found.append(self._shards[at].ids(start - base, start - base + own).astype("<u4"))
            start, length, at = start + own, length - own, at + 1
        return np.concatenate(found)


def _digests(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, first = Shard(folder, row), 0
                while first < row["documents"]:
                    # As many documents as READ_TOKENS hold, one at least.
                    offsets = shard.offsets(first, min(first + (1 << 16), row["documents"]) + 1).astype(np.int64)
                    n = max(1, int(np.searchsorted(offsets, offsets[0] + READ_TOKENS, "right")) - 1)
                    offsets = offsets[: n + 1]
                    ids = shard.ids(int(offsets[0]), int(offsets[-1]))
                    at = offsets - offsets[0]
                    crc = [
                        zlib.crc32(ids[a:b].astype("<u4").tobytes())
                        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
                    ]
                    unnamed = np.arange(first, first + n) < row["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(shard.docs(first, first + n)), pa.int64(), mask=unnamed),
                            pa.array(offsets[:-1] + row["first_token"], pa.int64()),
                            pa.array(np.diff(offsets), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    first += n

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document as the files have it: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids)."""
    shards = spark.read.parquet(f"{folder}/shards")
    # One task a shard; the table itself has a few bytes each and would be one task.
    spread = shards.repartitionByRange(max(1, shards.count()), "shard")
    return spread.mapInArrow(_digests(folder), DOCUMENTS)
