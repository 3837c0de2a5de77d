"""Web pages as WARC records in seekable Zstandard bundles, and back.

A bundle holds, in this order (integers little-endian, 32 bits unless said otherwise):

* frames: each an independent Zstandard frame of whole WARC/1.1 records, about ``FRAME_BYTES`` before compression;
* the record index, a skippable frame (0x184D2A5D): for each record, ascending, the 128-bit XXH3 of its identifier,
  the number of its frame, and its offset and length in that frame's content;
* the seek table of the Zstandard seekable format, a skippable frame (0x184D2A5E): for each frame its compressed and
  plain size and the low half of the content's XXH64; then the number of frames, a byte 0x80, and 0x8F92EAB1. The
  record index counts as a frame without content.

Decoders pass over skippable frames, so a plain ``zstd -d`` gives an ordinary WARC file.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import file_system, qualified
from .common import map_arrow, small, stored, text_bytes

FRAME_BYTES = 1 << 20
#: Fixed values of the Zstandard frame formats.
SKIP_INDEX, SKIP_SEEK, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "record_id string, page_id long, path string, frame int, offset long, length long"
_RECORD = "record_id string, page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_NAME = re.compile(r"<urn:page:(-?\d*):([A-Z2-7]*):(\d+)>")


def record_name(page_id: int | None, digest: str, ordinal: int) -> str:
    """The identifier of a record; pages without an id have none in it."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{ordinal}>"


def record(kind: str, name: str, url: str | None, date: str, digest: str, payload: bytes, refers: str | None) -> bytes:
    """One WARC record. A revisit has the HTTP header alone, which still tells the length of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    # A line must not end early, so white space and controls in addresses are escaped.
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers}"] if refers else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a frame's content."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        begin = end + 4
        stop = begin + int(head["Content-Length"])
        body = data.index(b"\r\n\r\n", begin, stop) + 4
        size = int(re.search(rb"Content-Length: (\d+)", data[begin:body])[1])
        revisit = head["WARC-Type"] == "revisit"
        if data[stop : stop + 4] != b"\r\n\r\n" or not revisit and stop - body != size:
            raise ValueError(f"record {head['WARC-Record-ID']} has another length than it says")
        yield {
            "record_id": head["WARC-Record-ID"],
            "page_id": _page(head["WARC-Record-ID"]),
            "record_type": head["WARC-Type"],
            "target_uri": head["WARC-Target-URI"],
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": size,
            "refers_to": _page(head["WARC-Refers-To"]) if revisit else None,
            "payload": None if revisit else data[body:stop],
        }
        at = stop + 4


def _page(name: str) -> int | None:
    found = _NAME.fullmatch(name)
    return int(found[1]) if found and found[1] else None


class BundleWriter:
    """Appends records to an open stream; :meth:`close` writes the index and the seek table."""

    def __init__(self, stream):
        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=3)
        self.waiting, self.held = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.records: list[tuple[bytes, int, int, int]] = []
        self.size = 0

    def add(self, name: str, data: bytes) -> tuple[int, int]:
        """Frame and offset of the new record."""
        if self.waiting and self.held + len(data) > FRAME_BYTES:
            self._frame()
        place = len(self.frames), self.held
        self.records.append((xxhash.xxh3_128_digest(name), *place, len(data)))
        self.waiting.append(data)
        self.held += len(data)
        return place

    def _frame(self) -> None:
        plain = b"".join(self.waiting)
        packed = self.compressor.compress(plain)
        self.stream.write(packed)
        self.size += len(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.waiting:
            self._frame()
        index = b"".join(name + struct.pack("<III", *place) for name, *place in sorted(self.records))
        self.stream.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class Bundle:
    """Reads frames and records of a bundle through its footer."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the bundle")
        stream.seek(size - 9 - 12 * count)
        self.frames = np.frombuffer(stream.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.index = None

    def __len__(self) -> int:
        return len(self.frames) - 1

    def frame(self, number: int) -> bytes:
        """The checked content of one frame; no other frame is read."""
        self.stream.seek(int(self.starts[number]))
        packed, plain, check = self.frames[number].tolist()
        data = zstandard.ZstdDecompressor().decompress(self.stream.read(packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError("a frame does not match its checksum")
        return data

    def find(self, name: str) -> tuple[int, int, int] | None:
        """Frame, offset and length of a record, from the bundle's own index."""
        if self.index is None:
            self.stream.seek(int(self.starts[len(self)]) + 8)
            data = self.stream.read(int(self.frames[-1, 0]) - 8)
            self.index = np.frombuffer(data, [("name", "V16"), ("place", "<u4", 3)])
            self.names = [bytes(x) for x in self.index["name"]]
        from bisect import bisect_left

        wanted = xxhash.xxh3_128_digest(name)
        at = bisect_left(self.names, wanted)
        return tuple(self.index["place"][at].tolist()) if at < len(self.names) and self.names[at] == wanted else None


def _write(root: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = file_system(root)
        number = context.partitionId()
        final = f"{base}/part-{number:06d}.warc.zst"
        part = f"{base}/.part-{number:06d}.{context.taskAttemptId()}"
        rows: list[tuple] = []
        before, ordinal = None, 0
        with system.open_output_stream(part) as out:
            bundle = BundleWriter(out)
            for batch in batches:
                columns = (batch.column(name).to_pylist() for name in ("page_id", "digest", "url", "content", "alone", "refers_to"))
                for page_id, raw, url, content, alone, refers_to in zip(*columns):
                    ordinal = ordinal + 1 if (page_id, raw) == before else 0
                    before = page_id, raw
                    digest = base64.b32encode(raw).decode()
                    # A repeated row revisits its first copy.
                    to = refers_to if refers_to is not None else page_id if ordinal and not alone else None
                    name = record_name(page_id, digest, ordinal)
                    kind = "response" if to is None else "revisit"
                    data = record(kind, name, url, date, digest, content, None if to is None else record_name(to, digest, 0))
                    rows.append((name, page_id, final, *bundle.add(name, data), len(data)))
            bundle.close()
        if rows:
            system.move(part, final)
        else:
            system.delete_file(part)
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for i in range(0, len(rows), 10_000):
            arrays = [pa.array(v, t) for v, t in zip(zip(*rows[i : i + 10_000]), types)]
            yield pa.RecordBatch.from_arrays(arrays, ["record_id", "page_id", "path", "frame", "offset", "length"])

    return run


def write_bundles(pages: DataFrame, root: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write one WARC record per row to bundles below ``root``; returns the stored manifest (:data:`MANIFEST`).

    Of rows with equal payloads of ``least_bytes`` or more, that with the smallest id is a response, the others are
    revisits of it; smaller payloads are all responses. Null payloads are empty. A repeated row revisits its first
    copy; rows without an id are revisits where a row with an id has their payload, else responses; an empty
    table gives an empty manifest; further columns are ignored.

    Only ids and digests are grouped by payload, so the number of copies does not matter; rows with payloads are
    dealt by id and digest. A task writes under a name of its own and renames at the end.
    """
    spark = pages.sparkSession
    root = qualified(spark, root)
    system, base = file_system(root)
    system.create_dir(base, recursive=True)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_bytes(payload).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("content"))).withColumn("alone", F.length("content") < least_bytes)
    # A null id must meet itself in the join.
    rows = rows.withColumn("own", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    ids = stored(rows.where("not alone").groupBy("digest", "page_id", "own").agg(F.lit(True).alias("there")), "page-ids")
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 and refers_to is not null")
    revisits = ids.join(small(stored(shared.drop("rows"), "shared")), "digest").where("not (page_id <=> refers_to)").select("own", "digest", "refers_to")
    dealt = rows.repartition("own", "digest").join(revisits, ["own", "digest"], "left").sortWithinPartitions("own", "digest", "url")
    written = map_arrow(dealt.select("page_id", "digest", "url", "content", "alone", "refers_to"), _write(root, date), MANIFEST)
    scheme = root[: len(root) - len(base)]
    return stored(written.withColumn("path", F.concat(F.lit(scheme), "path")), "manifest")


def _batch(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"record_id": pa.string(), "page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    kinds |= {"payload": pa.binary()} if payloads else {}
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()], list(kinds))


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, base = file_system(path)
                with system.open_input_file(base) as stream:
                    bundle = Bundle(stream)
                    for number in range(len(bundle)):
                        rows = []
                        for found in parsed(bundle.frame(number)):
                            # A response is held against its digest.
                            if found["payload"] is not None and base64.b32encode(_sha1(found["payload"])).decode() != found["payload_digest"]:
                                raise ValueError(f"the payload of {found['record_id']} does not match its digest")
                            rows.append(found)
                        yield _batch(rows, payloads)

    return run


def _sha1(data: bytes) -> bytes:
    import hashlib

    return hashlib.sha1(data).digest()


def read_bundles(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the manifest's files, frame by frame, each frame and payload checked.

    ``record_id, page_id, record_type, target_uri, payload_digest, payload_bytes, refers_to`` and, if asked for,
    ``payload``, which revisits do not have. An empty manifest gives no rows.
    """
    files = stored(manifest.select("path").distinct(), "bundles")
    n = files.count()
    dealt = files.repartitionByRange(n, "path") if n else files
    return map_arrow(dealt, _read(payloads), _RECORD if payloads else _RECORD.rsplit(",", 1)[0])


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, stream, number, data = None, None, None, b""
    for batch in batches:
        rows, held = [], 0
        for want in batch.select(["path", "frame", "offset", "length"]).to_pylist():
            if want["path"] != path:
                if stream is not None:
                    stream.close()
                system, base = file_system(want["path"])
                path, number, stream = want["path"], None, system.open_input_file(base)
                bundle = Bundle(stream)
            if want["frame"] != number:
                number, data = want["frame"], bundle.frame(want["frame"])
            rows += parsed(data[want["offset"] : want["offset"] + want["length"]])
            held += want["length"]
            if held >= 8 * FRAME_BYTES:
                yield _batch(rows, True)
                rows, held = [], 0
        yield _batch(rows, True)
    if stream is not None:
        stream.close()


def fetch(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``, by seeking to their frames; other frames are not read.

    A record is returned once, however often it is asked for; unknown and null identifiers give no row.
    """
    places = manifest.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    dealt = places.repartition("path", "frame").sortWithinPartitions("path", "frame", "offset")
    return map_arrow(dealt.select("path", "frame", "offset", "length"), _seek, _RECORD)
