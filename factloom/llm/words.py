"""Vectorised words of whole texts, and packed rows of hashed windows.

A word is ``[^\\x20\\x09-\\x0D]+``: Arrow's ASCII white space is just those six characters.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Returns freed memory to the machine: Python workers live on and others run beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in order, and each text's offsets into them. Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.values
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat, offsets = flat.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    there = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not there.all():
        offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
        flat = flat.filter(pa.array(there))
    return flat, offsets


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once a batch."""
    coded = flat.dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    own = np.fromiter((h(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.uint64)


def rolling(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Scrambled polynomial hash of every run of ``width`` words (over the whole batch)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m, out = np.uint64(factor | 1), np.zeros(n, np.uint64)
    for k in range(width):
        out = out * m + hashes[k : k + n]
    return mix64(out)


def pieces(batches, most_bytes: int, *texts: str):
    """Record batches cut so that each holds about most_bytes of text (in the columns named), or one longer row."""
    for b in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(b.column(c)), 0)).astype(np.int64) for c in texts or ("text",))
        at = np.cumsum(sizes) // max(1, most_bytes)
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def by_slices(texts: pa.Array, rows_of, most_bytes: int = 1 << 20) -> np.ndarray:
    """rows_of(slice) over slices of about most_bytes, stacked: what a slice needs is bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes)) + 1
    return np.concatenate([rows_of(texts.slice(lo, hi - lo)) for lo, hi in zip([0, *cuts], [*cuts, len(texts)])])
