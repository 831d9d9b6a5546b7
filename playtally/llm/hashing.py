"""Vectorised words and rolling hashes of the texts of an Arrow batch.

All texts of a piece of a batch lie in one byte buffer, one separator byte apart, and every step is
one numpy operation over the whole buffer. Polynomial hashes are taken modulo 2**64, where the odd
base has an inverse, so the hash of any stretch is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
PIECE_BYTES = 4 << 20


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, the same wherever the stretch lies."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, n), out=sums[1:])
    back = powers(inverse(base), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every word: eight bytes at a time are mixed in, each step a bijection.

    Unlike a polynomial modulo 2**64, no pair of texts has equal hashes whatever the base. Words of up to eight bytes
    and one length never share a hash.
    """
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    # The eight bytes from every place on, as overlapping numbers.
    eight = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    hashes = mix(left.astype(np.uint64) + np.uint64(BYTE_BASE))
    at, word = starts.astype(np.int64), np.arange(len(starts))
    while len(word):
        block = eight[at]
        last = left <= 8
        cut = np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
        block = (block << cut) >> cut
        hashes[word] = mix(mix(hashes[word]) ^ block)
        more = ~last
        word, at, left = word[more], at[more] + 8, left[more] - 8
    return hashes


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, about `size` bytes a piece; null is empty.

    Row r of the piece has the bytes offsets[r] : offsets[r + 1] - 1; one zero byte follows each row.
    """
    binary = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    if len(binary) == 0:
        return
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2], np.uint8) if binary.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(binary):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(binary))
        own = offsets[first : last + 1] - offsets[first]
        # A separator byte follows every row.
        at = own + np.arange(len(own))
        buffer = np.zeros(int(at[-1]), np.uint8)
        place = np.ones(len(buffer), bool)
        place[at[1:] - 1] = False
        buffer[place] = data[offsets[first] : offsets[last]]
        yield first, buffer, at
        first = last


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def byte_class(separators: bytes) -> np.ndarray:
    """Lookup table: True for the bytes that are not separators."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


NOT_BLANK = byte_class(b" \t\n\x0b\x0c\r")


def words(buffer: np.ndarray, at: np.ndarray, table: np.ndarray = NOT_BLANK):
    """Starts, ends and row of every word; the separator bytes between rows end words as well."""
    inside = table[buffer]
    inside[at[1:] - 1] = False
    starts, ends = spans(inside)
    row = np.searchsorted(at, starts, "right") - 1
    return starts, ends, row


def window_hashes(hashes: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of every window of `size` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # As `stretch_hashes` of all windows, by slices.
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes.astype(np.uint64) * powers(base, len(hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(inverse(base), n) + np.uint64(size))


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the first minimum of every `size` consecutive values, by doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    low, place, width = values, np.arange(len(values), dtype=np.int32), 1
    while width < size:
        step = min(width, size - width)
        later = low[step:] < low[:-step]
        low = np.where(later, low[step:], low[:-step])
        place = np.where(later, place[step:], place[:-step])
        width += step
    return place


def window_runs(values: np.ndarray, row: np.ndarray, size: int, gram: int):
    """Runs of windows of one row that share the place of their smallest gram: (gram hash, first window, windows).

    A window's smallest gram depends on its content alone, so equal windows carry the same hash
    wherever they lie. On random values a run is (size - gram + 2) / 2 windows long.
    """
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = window_hashes(values, gram)
    place = sliding_argmin(grams, size - gram + 1)
    valid = row[:n] == row[size - 1 :]
    start = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]))))
    length = np.diff(np.concatenate((start, [n])))
    keep = valid[start]
    start, length = start[keep], length[keep]
    return grams[place[start]], start, length


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
