"""Vectorised splitting of whole texts on their UTF-8 bytes.

A batch of texts is one byte array with offsets. Words and chunks are found
with table lookups on it, made an Arrow array without copying each word, and
dictionary-encoded, so that Python code only ever sees distinct strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: 1 for bytes outside 0x20 and 0x09-0x0D.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry at the end). Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _marks(offsets: np.ndarray, n: int) -> np.ndarray:
    inner = offsets[1:-1]
    return inner[(inner > 0) & (inner < n)]


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the strings that lie between offsets, and the distinct strings by code."""
    strings = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    encoded = strings.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words ([^\\x20\\x09-\\x0D]+) in order, the distinct words, and where each text's words begin (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    solid = SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = _marks(offsets, n)
    first[edge] = solid[edge]
    compact = data[solid]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(first[solid])  # in the compact bytes
    codes, distinct = coded(compact, np.append(at, len(compact)))
    return codes, distinct, np.searchsorted(starts, offsets)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Like words(), for chunks that each are a run of white space and the text up to the next run.

    A chunk begins at ASCII white space after a character that is none. Where
    the byte before may end a non-ASCII space, there is no cut, which is
    always right and only makes a longer chunk.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    solid = SOLID[data]
    cut = np.zeros(n, dtype=bool)
    cut[1:] = ~solid[1:] & solid[:-1]
    at = np.flatnonzero(cut)
    before = data[at - 1]
    # 0x1C-0x1F, 0x85, 0xA0 and the last bytes of U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000
    doubt = ((before >= 0x80) & (before <= 0x8A)) | np.isin(before, (0x1C, 0x1D, 0x1E, 0x1F, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF))
    doubt &= (before < 0x80) | np.isin(data[np.maximum(at - 2, 0)], (0xC2, 0x9A, 0x80, 0x81))
    cut[at[doubt]] = False
    cut[0] = True
    cut[_marks(offsets, n)] = True
    starts = np.flatnonzero(cut)
    codes, distinct = coded(data, np.append(starts, n))
    return codes, distinct, np.searchsorted(starts, offsets)


def spread(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all items when the item list of every code is laid out in order."""
    n = lengths[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (ends - n), n)
