"""Words, their hashes and shingle sets of a batch of texts, by numpy over UTF-8 bytes.

White space is \\x20 and \\x09-\\x0D and letters A-Z are lower-cased; both are single bytes that occur in no other
character, so that bytes can be scanned without decoding. Hashes are sums of random 64-bit numbers by position and
byte, mixed at the end; they depend on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once; a longer text is scanned alone.
SLICE = 1 << 21
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public SplitMix64 generator: a one-to-one mix of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers, the i-th of them the same for every n."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed) * U(1 << 40)) * U(0x9E3779B97F4A7C15))


_byte = randoms(256, 1)
_byte[65:91] = _byte[97:123]
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_place = randoms(1 << 12, 2) | U(1)


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = randoms(1 << int(n).bit_length(), 2) | U(1)
    return _place


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of runs of rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        j = min(j, len(column))
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def pieces(batch: pa.RecordBatch, most: int = 2 * SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and where each text's words begin (one more than texts)."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets, "left")
    if not len(starts):
        return np.zeros(0, U), starts, ends, first
    seg = np.diff(np.append(starts, len(raw)))
    inner = np.arange(starts[0], len(raw)) - np.repeat(starts, seg)
    tail = raw[starts[0] :]
    with np.errstate(over="ignore"):
        v = _byte[tail] * _places(int(seg.max()))[inner]
        v[~solid[starts[0] :]] = 0
        h = np.add.reduceat(v, starts - starts[0])
    return mix(h + (ends - starts).astype(U)), starts, ends, first


_gram = randoms(64, 3) | U(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring words at each place where k words follow."""
    if len(words) < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - k + 1, U)
        for j in range(k):
            h += words[j : len(words) - k + 1 + j] * _gram[j]
    return mix(h + U(k))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text: the whole sequence as one where it has fewer words; empty without words."""
    for _, raw, offsets in text_slices(column):
        h, _, _, first = word_hashes(raw, offsets)
        grams = gram_hashes(h, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = b - a
            if n >= k:
                s = np.sort(grams[a : b - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif n:
                yield gram_hashes(h[a:b], n)
            else:
                yield np.zeros(0, U)
