"""Vectorised byte-level helpers shared by the operators whose tasks read whole texts.

They work on the UTF-8 buffer of an Arrow string column, so a batch is tokenised and hashed by a handful of
numpy passes instead of a Python loop over words. Nothing here knows Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; numpy temporaries are a small multiple of it. One longer document still goes whole.
SLICE_BYTES = 1 << 20

_SEED_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(chars: bytes) -> np.ndarray:
    """256 booleans, true at the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


#: The white space of the word contract, [\x20\x09-\x0D].
SPACE = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _SEED_MIX)

#: Longest power tables that are kept between texts.
_KEPT_POWERS = 2 * SLICE_BYTES

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        powers, inverses = (_power_table(step, max(n, 1 << 16)) for step in (_BASE, _BASE_INVERSE))
        if len(powers) > _KEPT_POWERS:
            return powers, inverses
        _powers, _inverses = powers, inverses
    return _powers, _inverses


def _power_table(step: np.uint64, size: int) -> np.ndarray:
    steps = np.full(size, step, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def give_back() -> None:
    """Returns memory that a task has freed to the machine; the worker may serve other jobs next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts of about `limit` bytes. Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.cast(pa.large_string()).fill_null("")
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, flat[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of each maximal run of word bytes within a text, and how many words lie before each text's start."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts - 1] & inside[cuts]]  # a word at a text's end touches the next text's first word
    begins[joined] = True
    ends[joined] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each span, from one prefix sum of byte values times powers of an odd base (mod 2**64)."""
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * powers[: len(data)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * inverses[starts] + (stops - starts).astype(np.uint64) * _SEED_MIX)


#: Lower-casing and hashing in one lookup.
LOWER_VALUE = _BYTE_VALUE[LOWER]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `width` lower-cased words.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    starts, stops, first = word_spans(data, offsets, ~SPACE)
    words = word_hashes(data, starts, stops, LOWER_VALUE)
    grams = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        grams = (grams + words[k : k + len(grams)]) * _BASE
    grams = mix64(grams + np.uint64(width))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            found = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        elif n:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                h = (h + w) * _BASE
            out.append(mix64(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def runs_as_binary(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of `flat` between cuts as a binary array."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
