"""Words of Arrow string batches, found and hashed with whole-array operations.

A block of texts is one byte array; words are the runs between break bytes. Blocks are
cut by bytes, never by rows, so memory does not follow the batch size; a text longer
than a block is cut at a break byte and its parts are put together by the caller's sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute

BLOCK_BYTES = 512 << 10

#: Lower case for A-Z only; all other bytes, those of UTF-8 sequences included, stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes between words of the form [^\x20\x09-\x0D]+
SPACE_BREAKS = np.zeros(256, dtype=bool)
SPACE_BREAKS[[9, 10, 11, 12, 13, 32]] = True

#: Bytes between words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SIGN_BREAKS = np.zeros(256, dtype=bool)
SIGN_BREAKS[:0x80] = True
SIGN_BREAKS[0x30:0x3A] = False
SIGN_BREAKS[0x61:0x7B] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE_DEPTH = 48
_TABLE = mix(np.arange(1, _TABLE_DEPTH * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Block(NamedTuple):
    """Words of some rows: ``row`` (index in the batch) and ``hash`` per word, in text order."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit tabulation hash per word: the sum of a random number for each (place, byte)."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    byte = raw[place + np.repeat(start, length)]
    index = place * 256 + byte
    if int(length.max()) <= _TABLE_DEPTH:
        value = _TABLE.take(index)
    else:
        deep = place >= _TABLE_DEPTH
        value = _TABLE.take(np.where(deep, 0, index))
        value[deep] = mix((index[deep].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))


def _pieces(offsets: np.ndarray, raw: np.ndarray, breaks: np.ndarray, block: int, lower: bool) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, from, to) of each block; blocks end at row ends or, in a long row, at a break byte.

    ``breaks`` holds for lower-case bytes if ``lower``, so A-Z are looked up as a-z.
    """
    breaks = breaks[LOWER] if lower else breaks
    row, at, rows = 0, int(offsets[0]), len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, at + block, side="right")) - 1
        if stop > row:
            yield row, stop, at, int(offsets[stop])
            row, at = stop, int(offsets[stop])
            continue
        end, cut = int(offsets[row + 1]), at + block
        while cut < end and not breaks[raw[cut]]:
            cut += 1
        yield row, row + 1, at, min(cut, end)
        at = min(cut, end)
        if at == end:
            row += 1


def word_blocks(texts: pa.Array, breaks: np.ndarray = SPACE_BREAKS, block: int = BLOCK_BYTES, hashed: bool = True, lower: bool = True) -> Iterator[Block]:
    """The words of a string array, A-Z in lower case if ``lower``, block by block; null is an empty text."""
    if pa.types.is_large_string(texts.type):
        kind, width = pa.large_string(), np.int64
    else:
        kind, width = pa.string(), np.int32
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    texts = texts.cast(kind)
    if not len(texts):
        return
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    raw = np.frombuffer(data, dtype=np.uint8)
    for first, last, begin, end in _pieces(offsets, raw, breaks, block, lower):
        part = LOWER[raw[begin:end]] if lower else raw[begin:end]
        if not len(part):
            continue
        bounds = np.clip(offsets[first : last + 1] - begin, 0, len(part))
        inside = ~breaks[part]
        cuts = bounds[1:-1]
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        before[cuts[cuts < len(part)]] = False
        after[cuts[cuts > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        stop = np.flatnonzero(inside & ~after) + 1
        row = first + np.searchsorted(bounds[1:], start, side="right")
        yield Block(row, hash_words(part, start, stop) if hashed else np.empty(0, np.uint64), start, stop, part)


def row_slices(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of whole rows with about ``size`` bytes each, so that a batch of any size takes bounded memory."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def batch_words(texts: pa.Array, breaks: np.ndarray = SPACE_BREAKS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word of an array; a text cut into blocks is whole again here."""
    blocks = list(word_blocks(texts, breaks, lower=lower))
    if not blocks:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([b.row for b in blocks]), np.concatenate([b.hash for b in blocks])
