"""Near copies by SimHash: 64-bit fingerprints of word shingles, compared exactly tile by tile.

A tile holds the fingerprints that are equal in some parts of their bits; of any two within the radius, enough parts are
equal. Within a tile, and between the pieces of a large one, pairs are skipped by their population counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, DEALT, HELD, dealt, forest, meeting
from .common import map_arrow, mixed, stored, text_bytes
from .components import components

#: Most fingerprints of a tile that is compared whole; a larger one is cut into pieces of about so many.
TILE = 16_384
#: From so many fingerprints on, three parts of the bits are equal within a tile in place of two: more tiles, but smaller ones.
QUARTERED = 1 << 21
SEED = 42

_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: A byte's eight bits, each in a byte of its own.
_SPREAD = np.ascontiguousarray(_bits).view("<u8").ravel()


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half the XXH64 values of the text's shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    lanes = _SPREAD[hashes.view(np.uint8)].reshape(n, 8)
    # A lane counts to 255, so that many rows are added before the lanes are read.
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8)
    ones = sums.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int, more=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), width) for x in batch.column("_content")]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            names = [name for name in batch.schema.names if name != "_content"]
            found = [*(batch.column(name) for name in names), signed]
            if more:
                found.append(more[2](batch.column("_content")))
            yield pa.RecordBatch.from_arrays(found, [*names, "_fp", *(more or ())[:1]])

    return run


def fingerprints(rows: DataFrame, width: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",), more=None) -> DataFrame:
    """Columns ``keep`` and ``_fp`` of every row; A-Z count as a-z, words are split at ASCII white space.

    ``more`` is the name, type and function of a further column; the function takes a column of texts as bytes.
    """
    plain = rows.select(*keep)
    schema = plain.schema.add("_fp", "long")
    if more:
        schema = schema.add(more[0], more[1])
    return map_arrow(rows.select(*keep, text_bytes(text).alias("_content")), _fingerprints(width, more), schema)


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs of ``a`` and ``b`` within ``radius`` bits connect: at most one per member."""
    nodes = np.concatenate([a, b])
    label = np.arange(len(nodes))
    rows = max(1, (1 << 20) // max(1, len(b)))
    us, vs, held = [], [], 0
    for i in range(0, len(a), rows):
        near = np.bitwise_count(a[i : i + rows, None] ^ b[None, :]) <= radius
        x, y = np.nonzero(near)
        us.append(x + i)
        vs.append(y + len(a))
        held += len(x)
        if held > len(nodes) or i + rows >= len(a):
            label = forest(np.concatenate([*us, np.arange(len(nodes))]), np.concatenate([*vs, label]), len(nodes))
            us, vs, held = [], [], 0
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for left, right in zip(batch.column("left_fps"), batch.column("right_fps")):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
                u, v = linked(a, b, radius)
                keep = u != v
                us.append(u[keep])
                vs.append(v[keep])
            found = [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays(found, ["u", "v"])

    return run


def masks(radius: int, equal: int) -> np.ndarray:
    """Bits of which any two fingerprints within ``radius`` bits have those of at least one mask equal."""
    cuts = [64 * i // (radius + equal) for i in range(radius + equal + 1)]
    parts = [(1 << stop) - (1 << start) for start, stop in zip(cuts, cuts[1:])]
    return np.array([sum(some) for some in combinations(parts, equal)], np.uint64)


def _dealt(tiles: np.ndarray, blocks: int):
    kind = mixed(np.arange(1, len(tiles) + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, HELD // len(tiles))
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(values), rows):
                fps = values[i : i + rows]
                keys = mixed(fps[:, None] & tiles) ^ kind
                yield from dealt(keys.ravel(), np.repeat(fps, len(tiles)), blocks)

    return run


def _given(block, keys, u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links as they are; of tiles that are too large, their number and every fingerprint."""
    if len(u):
        signed = [pa.array(x.view(np.int64)) for x in (u, v)]
        tile = pa.nulls(len(u), pa.int64()) if keys is None else pa.array((np.int64(block) << 32) + keys)
        yield pa.RecordBatch.from_arrays([*signed, tile], ["u", "v", "tile"])


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits.

    The bits are cut into two parts (three, from ``QUARTERED`` on) more than the radius, of which any pair within it has
    that many equal. So it meets in the tile of those, and is compared there with exclusive-or and bit counts. A tile of
    over ``TILE`` fingerprints is cut by population counts into pieces that meet pair by pair, where these allow a link.
    """
    n = nodes.count()
    tiles = masks(radius, 2 if n < QUARTERED else 3)
    blocks = -(-n * len(tiles) // BLOCK) or 1
    rows = map_arrow(nodes.select("fp"), _dealt(tiles, blocks), DEALT)
    found = stored(meeting(rows, blocks, radius, TILE, _given, "u long, v long, tile long"), "tiles")
    small = found.where("tile is null").select("u", "v")
    large = found.where("tile is not null").select("tile", F.col("u").alias("fp"))
    if large.isEmpty():
        return small
    counted = large.withColumn("ones", F.bit_count("fp").cast("int"))
    sized = counted.groupBy("tile", "ones").agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces").cast("long")).cast("int")
    filled = counted.join(sized, ["tile", "ones"]).groupBy("tile", "ones", piece.alias("piece")).agg(F.collect_list("fp").alias("fps"))
    filled = stored(filled, "pieces")
    near = filled.select("tile", "ones", "piece", F.col("fps").alias("left_fps"), F.explode(F.lit(list(range(radius + 1)))).alias("more"))
    near = near.withColumn("other", F.col("ones") + F.col("more"))
    right = filled.select("tile", F.col("ones").alias("other"), F.col("piece").alias("with"), F.col("fps").alias("right_fps"))
    both = near.join(right, ["tile", "other"]).where("more > 0 or piece <= with")
    # Spread evenly: a pair of full pieces is as much work as any other.
    both = both.repartition("tile", "ones", "piece", "other", "with").select("left_fps", "right_fps")
    return small.union(map_arrow(both, _compare(radius), "u long, v long"))


def _classes(docs: DataFrame, radius: int, width: int, text: str) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row; ``root`` is the least fingerprint of its component."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = stored(fingerprints(narrow, width).withColumnRenamed("_fp", "fp"), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    member = member.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.join(found, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def near_copies(docs: DataFrame, radius: int = 3, width: int = 3, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Equal fingerprints are one node, so a group of copies costs no more than one document. ``component_id``
    is the least id that links reach (null ids are passed over; null if there is no other). Null and empty
    texts have fingerprint 0 and link like any other. Every repeated row is returned; further columns are
    ignored; an empty table gives no rows.
    """
    printed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _classes(docs, radius, width, text).select("doc_id", printed, "component_id")


def first_of_each(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, with the component's least id.

    Rows of one id may hold different texts; each is kept or dropped by its own. Rows without an id cannot be
    told apart and stay.
    """
    return first_of_classes(docs, _classes(docs, radius, width, "text"), width)


def first_of_classes(docs: DataFrame, classes: DataFrame, width: int = 3) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``classes(doc_id, fp, root, component_id)``, as :func:`first_of_each`."""
    found = stored(classes.where("doc_id is not null"), "components")
    heads = found.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("head"))
    head_ids = heads.select("doc_id").distinct()
    other = found.select("doc_id").join(head_ids, "doc_id", "left_anti").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(other, docs["doc_id"] == other["gone"], "left_anti")
    several = found.groupBy("doc_id").count().where("count > 1").join(head_ids, "doc_id", "left_semi")
    several = stored(several.select(F.col("doc_id").alias("gone")), "repeated")
    if several.isEmpty():
        return kept
    same = kept["doc_id"] == several["gone"]
    # Rows of a repeated id are told apart by their fingerprints.
    names = [f"c{i}" for i in range(len(docs.columns))]
    of_name = dict(zip(docs.columns, names))
    rows = kept.join(several, same, "left_semi").toDF(*names)
    printed = fingerprints(rows, width, of_name["text"], tuple(names))
    match = (printed[of_name["doc_id"]] == heads["doc_id"]) & (printed["_fp"] == heads["head"])
    chosen = printed.join(heads, match, "left_semi").dropDuplicates([of_name["doc_id"], "_fp"])
    return kept.join(several, same, "left_anti").union(chosen.select(*names))
