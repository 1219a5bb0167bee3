"""Words, word hashes and shingles of whole texts, computed on Arrow's own buffers.

Every function works on a slice of a batch whose texts together hold about
``SLICE_BYTES``; a longer text is a slice of its own, so memory follows the longest
text and never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_A, _B, _C = (np.uint64(c) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size, dtype=np.int64), 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    # Workers live on between stages: give back what this batch has used.
    pa.default_memory_pool().release_unused()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the byte offsets of each; null counts as empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    known = _powers.get(0)
    if known is None or len(known[0]) < size:
        length = max(size, SLICE_BYTES + 1)
        known = tuple(
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(length - 1, b, np.uint64)]))
            for b in (_BASE, _INVERSE)
        )
        if length <= 4 * SLICE_BYTES:
            _powers[0] = known
    return known


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every other."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of every word, and the index of the first word of each text.

    A word is a run of bytes other than ASCII white space inside one text.
    """
    inside = ~_BLANK[raw]
    fresh = np.zeros(len(raw) + 1, dtype=bool)
    fresh[offsets] = True
    before = np.empty(len(raw), dtype=bool)
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word with A-Z lowered, and the first word of each text."""
    starts, ends, first = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    power, inverse = _power_tables(len(raw))
    total = np.cumsum(_TABLE[_LOWER[raw]] * power[: len(raw)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((total[ends] - before) * inverse[starts] + np.uint64(1)), first


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the ``size``-word shingles of each text, in order.

    A text with fewer words is one shingle of all its words; one without words is empty.
    """
    words, first = word_hashes(raw, offsets)
    count = np.diff(first)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _A + (words[k : k + len(rolled)] ^ _B)
    rolled = mix(rolled)
    for text, n in enumerate(count):
        if n >= size:
            yield np.unique(rolled[first[text] : first[text] + n - size + 1])
        elif n:
            short = np.uint64(n) * _C
            for word in words[first[text] : first[text] + n]:
                short = np.uint64((int(short) * int(_A) + (int(word) ^ int(_B))) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([short], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
