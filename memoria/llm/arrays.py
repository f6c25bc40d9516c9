"""Arrow strings as byte arrays for the numpy operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes together; a longer row comes alone. Nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        own = offsets[row : to + 1]
        yield row, raw[own[0] : own[-1]], own - own[0]
        row = to


def words_of(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every longest run of bytes that `inside` (by byte) marks; runs end where rows do."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    own = inside[raw]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    first[borders] = own[borders]
    last[borders - 1] = own[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def slices_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the slices one behind the other, each with `after` (a byte at most) behind it."""
    lengths = ends - starts + len(after)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths)
    at += np.arange(offsets[-1])
    if not after:
        return raw[at], offsets
    out = raw[np.minimum(at, max(len(raw) - 1, 0))]
    out[offsets[1:] - 1] = after[0]
    return out, offsets


def numbered(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each slice, equal for equal ones, and the slices by number."""
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
