"""Documents as files of token ids, range coded in checksummed blocks, and back.

A file holds documents in ascending order of id. Its parts, all integers little-endian:

* 8 bytes ``SWTOKEN2``;
* groups of blocks: the number of blocks, then for each block its number of ids, its bytes and the CRC-32 of
  its ids (unsigned 32 bits each), then the bytes of the blocks (:mod:`.range_coder`; every block starts anew);
* the index: for each document its id (64 bits), a byte that is 1 where the id is null, its number of ids
  (64 bits);
* the place of the index, the numbers of documents and ids (64 bits each), the index's CRC-32 (32 bits), ``SWTOKEN2``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import file_system, qualified
from . import range_coder
from .common import chunks, map_arrow, stored, text_bytes
from .tokens import encoder

MAGIC = b"SWTOKEN2"
#: Ids that are coded side by side. With what the coder holds of them a worker needs about 25 bytes for each.
GROUP = 4 << 20
#: The same, and pieces that a writing worker knows, where memory is short; smaller groups take more time for each id.
SMALL_GROUP, FEW_KNOWN = 1 << 20, 100_000
MANIFEST = "file_no int, path string, docs long, ids long, bytes long"


def _write(spec: str, root: str, end: int, group: int, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context = encoder(spec, known), TaskContext.get()
        system, base = file_system(root)
        number = context.partitionId()
        final = f"{base}/part-{number:06d}.tok"
        part = f"{base}/.part-{number:06d}.{context.taskAttemptId()}"
        closing = np.array([end], "<u4").tobytes()
        doc_ids, nulls, sizes = [], [], []
        waiting, held = [], 0
        with system.open_output_stream(part) as out:
            place = out.write(MAGIC)

            def put(most: int) -> None:
                nonlocal waiting, held, place
                ids = np.frombuffer(b"".join(waiting), "<u4")
                waiting.clear()
                cut = min(len(ids), -(-most // range_coder.BLOCK) * range_coder.BLOCK)
                blocks = [ids[i : min(i + range_coder.BLOCK, cut)] for i in range(0, cut, range_coder.BLOCK)]
                coded = range_coder.encode(blocks)
                heads = [(len(b), len(c), zlib.crc32(b.tobytes())) for b, c in zip(blocks, coded)]
                place += out.write(struct.pack("<I", len(blocks)) + np.array(heads, "<u4").tobytes() + b"".join(coded))
                waiting, held = [ids[cut:].tobytes()], len(ids) - cut

            for batch in chunks(batches, "content"):
                texts = [x.decode("utf-8", "replace") for x in batch.column("content").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(texts)):
                    doc_ids.append(doc_id or 0)
                    nulls.append(doc_id is None)
                    sizes.append(len(ids) // 4 + 1)
                    waiting += [ids, closing]
                    held += sizes[-1]
                    # A group of few blocks takes nearly as long as a full one, so none is left for the end.
                    while held >= group + group // 2:
                        put(group)
            if held > group:
                put(held // 2)
            if held:
                put(held)
            index = np.array(doc_ids, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(sizes, "<i8").tobytes()
            total = sum(sizes)
            tail = struct.pack("<QQQI", place, len(sizes), total, zlib.crc32(index))
            place += out.write(index + tail + MAGIC)
        if sizes:
            system.move(part, final)
            row = [[number], [final], [len(sizes)], [total], [place]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], ["file_no", "path", "docs", "ids", "bytes"]
            )
        else:
            system.delete_file(part)

    return run


def write_token_files(docs: DataFrame, tokenizer: str, root: str, end: int = 0, text: str = "text", group: int = GROUP, known: int = 300_000) -> DataFrame:
    """Write every whole text's ids and ``end`` to files below ``root``; returns the stored manifest.

    Rows are dealt by ranges of ``doc_id`` (nulls first, equal ids by a hash of their text), so one file
    after the other is in ascending order and no id is a hot spot. A task writes under a name of its own and
    renames at the end, so a lost or repeated task leaves one whole file. Null texts count as empty; an empty
    table gives an empty manifest; further columns are ignored.
    """
    spark = docs.sparkSession
    root = qualified(spark, root)
    system, base = file_system(root)
    system.create_dir(base, recursive=True)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("content"))
    plain = plain.withColumn("tie", F.xxhash64("content"))
    dealt = plain.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "content")
    written = map_arrow(dealt.drop("tie"), _write(Path(tokenizer).read_text("utf-8"), root, end, group, known), MANIFEST)
    scheme = root[: len(root) - len(base)]
    return stored(written.withColumn("path", F.concat(F.lit(scheme), "path")), "manifest")


def _groups(stream, end: int) -> Iterator[np.ndarray]:
    """The ids of a file, one group of blocks after the other, each block checked."""
    while stream.tell() < end:
        (n,) = struct.unpack("<I", stream.read(4))
        heads = np.frombuffer(stream.read(12 * n), "<u4").reshape(n, 3)
        coded = [stream.read(int(size)) for size in heads[:, 1]]
        blocks = [b.astype("<u4") for b in range_coder.decode(coded, heads[:, 0])]
        for block, check in zip(blocks, heads[:, 2]):
            if zlib.crc32(block.tobytes()) != check:
                raise ValueError("a block of token ids does not match its checksum")
        yield np.concatenate(blocks)


def documents_of(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of every document of a file, in its order."""
    system, base = file_system(path)
    with system.open_input_file(base) as stream:
        size = stream.size()
        stream.seek(size - 36)
        place, docs, _, check = struct.unpack("<QQQI", stream.read(28))
        if stream.read(8) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        stream.seek(place)
        index = stream.read(docs * 17)
        if zlib.crc32(index) != check:
            raise ValueError(f"the index of {path} does not match its checksum")
        doc_ids = np.frombuffer(index, "<i8", docs)
        nulls = np.frombuffer(index, "u1", docs, docs * 8)
        sizes = np.frombuffer(index, "<i8", docs, docs * 9)
        stream.seek(8)
        groups = _groups(stream, place)
        held, at = np.zeros(0, "<u4"), 0
        for doc_id, null, n in zip(doc_ids.tolist(), nulls.tolist(), sizes.tolist()):
            parts, need = [], n
            while need:
                if at == len(held):
                    held, at = next(groups), 0
                part = held[at : at + need]
                parts.append(part)
                at += len(part)
                need -= len(part)
            yield None if null else doc_id, np.concatenate(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            start, rows = file["start"], []
            for doc_id, ids in documents_of(file["path"]):
                rows.append((doc_id, file["file_no"], start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, types)], ["doc_id", "file_no", "start", "n_tokens", "ids_crc32"]
            )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, file_no, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before it. The manifest has one row per file, so the
    sums over earlier files are made on the driver.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["file_no"]):
        files.append((row["file_no"], row["path"], start))
        start += row["ids"]
    listed = spark.createDataFrame(files, "file_no int, path string, start long")
    dealt = listed.repartitionByRange(max(1, len(files)), "file_no") if files else listed
    return map_arrow(dealt, _read, "doc_id long, file_no int, start long, n_tokens long, ids_crc32 long")
