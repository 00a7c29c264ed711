"""Words of whole Arrow string batches, as arrays: one 64-bit hash, a byte range and a document per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The lowest 0 to 8 bytes of a number, an odd factor, and the length in bytes above which words are hashed one by one.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
LONG = 256
BLANKS = b" \t\n\x0b\x0c\r"


class Words(NamedTuple):
    """Words of a batch in order: hash, first byte, byte after the last, number of the text; ``raw`` holds the bytes."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    raw: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers after which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def among(chars: bytes) -> np.ndarray:
    """Which of the 256 byte values are in ``chars``."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def words_of(texts: pa.Array, blank: np.ndarray, lower: bool = False) -> Words:
    """Words of every text (null: none): runs of bytes that are not ``blank``; with ``lower``, A-Z count as a-z."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower and size:
        raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << np.uint8(5))
    inside = ~blank[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < size)]
    first[edge] |= inside[edge]  # texts lie side by side, so a text may begin or end inside a run
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    return Words(_hashes(raw, start, end), start, end, doc, raw)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every byte range: eight bytes at a time, all ranges at once; ranges of over ``LONG`` bytes one by one."""
    size = end - start
    h = size.astype(np.uint64)
    eights = np.lib.stride_tricks.as_strided(np.concatenate((raw, np.zeros(8, np.uint8))).view(np.uint8), (len(raw) + 1, 8), (1, 1))
    which, at = np.flatnonzero(size <= LONG), 0
    while len(which):
        n = size[which]
        x = (h[which] ^ (eights[start[which] + at].view("<u8").reshape(-1) & _MASK[np.minimum(n - at, 8)])) * _STEP
        h[which] = x ^ (x >> np.uint64(29))
        at += 8
        which = which[n > at]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return mix(h)


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    size = pc.binary_length(batch.column(text).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
