"""Fingerprints dealt by keys: pairs that share a key meet in its block, and are compared there without being written down."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, mixed

#: Keys of a block, and keys or links that are held at once.
BLOCK, HELD = 1 << 19, 1 << 20
#: What :func:`dealt` makes.
DEALT = "block long, keys binary, fps binary"


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least member of every node's component, for links ``u - v`` among ``n`` nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        label = np.minimum(label, label[label])
        if np.array_equal(label[u], label[v]):
            return label


def dealt(keys: np.ndarray, fps: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """64-bit ``keys`` and their fingerprints by blocks, where 32 bits of a key are kept: a block may take two for one."""
    if not len(keys):
        return
    keys = mixed(keys)
    block = ((keys >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    bounds = np.searchsorted(block[order], np.arange(blocks + 1))
    filled = np.flatnonzero(np.diff(bounds))
    ends = np.append(bounds[filled], len(keys))
    columns = [pa.array(filled)]
    for values in ((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], fps[order]):
        offsets = pa.array((ends * values.itemsize).astype(np.int32))
        columns.append(pa.Array.from_buffers(pa.binary(), len(filled), [None, offsets.buffers()[1], pa.py_buffer(values)]))
    yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "fps"])


def sorted_pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a key and a fingerprint, by key and population count; where each key starts, and how many it has."""
    order = np.lexsort((fps, np.bitwise_count(fps), keys))
    keys, fps = keys[order], fps[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
    keys, fps = keys[new], fps[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys, fps, starts, np.diff(np.append(starts, len(keys)))


def close(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``radius`` bits in runs of ``sizes`` connect, at most one a fingerprint.

    A run is sorted by population counts; pairs whose counts differ by more than the radius are skipped.
    """
    several = np.repeat(sizes > 1, sizes)
    fps, sizes = fps[several], sizes[sizes > 1]
    nodes, of = np.unique(fps, return_inverse=True)
    label, ones = np.arange(len(nodes)), np.bitwise_count(fps).astype(np.int64)
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps)) - 1
    us, vs, held, step = [], [], 0, 1
    rest = np.flatnonzero(after >= step)
    while len(rest):
        rest = rest[ones[rest + step] - ones[rest] <= radius]
        near = rest[np.bitwise_count(fps[rest] ^ fps[rest + step]) <= radius]
        near = near[label[of[near]] != label[of[near + step]]]
        us.append(of[near])
        vs.append(of[near + step])
        held += len(near)
        step += 1
        rest = rest[after[rest] >= step]
        if held > HELD or held and not len(rest):
            label = forest(np.concatenate([*us, np.arange(len(nodes))]), np.concatenate([*vs, label]), len(nodes))
            us, vs, held = [], [], 0
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


class Block:
    """Gathers one block's pairs of a key and a fingerprint; those of keys with over ``crowd`` of them are given out at once."""

    def __init__(self, crowd: int) -> None:
        self.crowd, self.held, self.n, self.most = crowd, [], 0, 4 * HELD
        self.crowded: dict[int, int] = {}

    def add(self, keys: np.ndarray, fps: np.ndarray):
        """Take more pairs; those given out, or None."""
        self.held.append((keys, fps))
        self.n += len(keys)
        if self.n < self.most:
            return None
        out, _, _ = self.thinned()
        self.most = max(self.most, 2 * self.n)
        return out

    def thinned(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Crowded keys, their fingerprints and the first of each key's; the other fingerprints, and runs of one key."""
        keys, fps, starts, sizes = sorted_pairs(*(np.concatenate(x) for x in zip(*self.held)))
        firsts, many = fps[starts], sizes > self.crowd
        if self.crowded:
            known = np.isin(keys[starts], np.fromiter(self.crowded, np.uint32, len(self.crowded)))
            firsts[known] = np.array([self.crowded[key] for key in keys[starts[known]].tolist()], np.uint64)
            many |= known
        self.crowded.update(zip(keys[starts[many]].tolist(), firsts[many].tolist()))
        out = np.repeat(many, sizes)
        self.held, self.n = [(keys[~out], fps[~out])], int((~out).sum())
        return (keys[out], fps[out], np.repeat(firsts[many], sizes[many])), fps[~out], sizes[~many]


def _meet(radius: int, crowd: int, given):
    def ended(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        out, fps, sizes = block.thinned()
        yield from given(number, *out)
        u, v = close(fps, sizes, radius)
        if len(u):
            yield from given(None, None, u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            for number, keys, fps in zip(batch.column("block").to_pylist(), batch.column("keys"), batch.column("fps")):
                if number != at:
                    if block:
                        yield from ended(at, block)
                    at, block = number, Block(crowd)
                out = block.add(np.frombuffer(keys.as_buffer(), np.uint32), np.frombuffer(fps.as_buffer(), np.uint64))
                if out:
                    yield from given(number, *out)
        if block:
            yield from ended(at, block)

    return run


def meeting(rows: DataFrame, blocks: int, radius: int, crowd: int, given, schema: str) -> DataFrame:
    """Rows as :func:`dealt` makes them, to links of fingerprints that share a key and differ by ``radius`` bits or fewer.

    ``given(block, keys, fps, firsts)`` makes batches of ``schema`` of crowded keys, and of links ``u, v`` given
    in place of the last two, with no block.
    """
    sent = rows.repartition(blocks, "block").sortWithinPartitions("block")
    return map_arrow(sent, _meet(radius, crowd, given), schema)
