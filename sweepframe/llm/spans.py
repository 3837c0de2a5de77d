"""Runs of wanted bytes in many texts at once, with 64-bit hashes, and compact bytes of integer arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

from .common import _BASE, _INVERSE, mixed

#: Bytes of one text that are worked on at once.
SECTION = 4 << 20


def byte_set(*parts: int | range) -> np.ndarray:
    """A table of 256 booleans, true for the given bytes."""
    table = np.zeros(256, bool)
    for part in parts:
        table[[part] if isinstance(part, int) else list(part)] = True
    return table


def runs(low: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, stop, hash`` of the maximal runs of bytes in ``inside`` (a table of 256) that do not cross a text's edge.

    The hash is a polynomial over the bytes, so it depends on the run's bytes alone.
    """
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    within = inside[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    edge = edge[:-1]
    begins = within.copy()
    begins[1:] &= ~within[:-1] | edge[1:]
    ends = within
    ends[:-1] &= ~within[1:] | edge[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    n = len(low)
    sums = np.zeros(n + 1, np.uint64)
    terms = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
    terms *= low.astype(np.uint64) + np.uint64(1)
    np.cumsum(terms, out=sums[1:])
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)]))
    return start, stop, mixed((sums[stop] - sums[start]) * inverse[start])


def sections(low: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a chunk of texts; a single very long text comes in sections that begin at bytes of ``cut``."""
    if len(low) <= SECTION or len(offsets) > 2:
        yield low, offsets
        return
    begin = 0
    while begin < len(low):
        end, found = begin + SECTION, False
        while end < len(low) and not found:
            near = np.flatnonzero(cut[low[end : end + SECTION]])
            found = len(near) > 0
            end += int(near[0]) if found else SECTION
        end = min(end, len(low))
        yield low[begin:end], np.array([0, end - begin])
        begin = end


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Places of non-negative keys below 2^31 in ascending order, equal keys by place."""
    n = len(keys)
    # In place, as keys may be those of a whole shard.
    both = keys.astype(np.int64)
    both <<= 32
    both |= np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    both.sort()
    both &= 0xFFFFFFFF
    return both


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes (all lowest bytes first); the type is not stored."""
    plain = np.ascontiguousarray(values)
    planes = plain.view(np.uint8).reshape(len(plain), plain.itemsize).T if len(plain) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    """What :func:`pack` was given."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
