"""Words and shingles of Arrow batches, as 64-bit hashes in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in slices of about so many characters, whatever the batch.
SLICE_CHARS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def cut(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about ``most`` in size; a row beyond that is a part of its own."""
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch by the bytes of a text column."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    yield from cut(batch, size.astype(np.int64), most)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in a row, and each text's bounds in it.

    Works on the UTF-8 bytes: white space is cut out, and the words are views of what is
    left.  (Arrow's own splitter also cuts at the byte 0x85, inside other characters.)
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        raw = _LOWER[raw]
    inside = ~_IS_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    start[firsts] = inside[firsts]
    starts = np.flatnonzero(start)
    rank = np.cumsum(inside)
    own = np.append(rank[starts] - 1, rank[-1] if len(rank) else 0).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(own), pa.py_buffer(raw[inside])])
    return words, np.searchsorted(starts, offsets)


def hash_words(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words, across texts; callers cut at bounds."""
    out = hashes.copy()
    for k in range(1, n):
        out = mix64(out[:-1] * _A + hashes[k:])
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, sorted; with fewer words, the sequence as one."""
    words, bounds = words_of(texts)
    hashes = hash_words(words)
    whole = windows(hashes, n) if len(hashes) >= n else np.zeros(0, dtype=np.uint64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            short = hashes[a : a + 1]
            for k in range(a + 1, b):
                short = mix64(short * _C + hashes[k : k + 1])
            yield mix64(short ^ np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
