"""Splitting Arrow string columns into words with numpy.

Every function works on whole texts and treats null as the empty text.  The
unit of work is a slice of a record batch whose text stays below a byte bound
(a longer single text forms a slice of its own), so memory does not depend on
how many rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

_IDENTITY = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, everything else unchanged.
LOWER_ASCII = _IDENTITY.copy()
LOWER_ASCII[65:91] += 32
#: As above, and every ASCII character that is neither a letter nor a digit becomes a blank.
LOWER_ALNUM = LOWER_ASCII.copy()
LOWER_ALNUM[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cut texts into runs of at most ``limit`` bytes, each with its first row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A single string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return pc.fill_null(texts.cast(pa.string()), "")


def raw(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an array without nulls."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mapped(texts: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    """Every byte replaced through ``table``, which must keep UTF-8 sequences intact."""
    data, offsets = raw(texts)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(table[data]))


@dataclass
class Words:
    """The words of some texts: ``distinct[codes[offsets[i]:offsets[i+1]]]`` are those of text i."""

    codes: np.ndarray
    distinct: pa.StringArray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(texts: pa.Array | pa.ChunkedArray, table: np.ndarray | None = None) -> Words:
    """Words separated by blanks and the control characters 09 to 0D, after mapping bytes through ``table``."""
    texts = plain(texts)
    if table is not None:
        texts = mapped(texts, table)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    encoded = flat.filter(full).dictionary_encode()
    return Words(encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, before[offsets])


def hashed(distinct: pa.StringArray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier for rolling hashes modulo 2**64.
STEP = 0x9E3779B97F4A7C15


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive values; entry i starts at i."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(STEP) + values[k : k + n]
    return mix(out)
