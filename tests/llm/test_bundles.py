from __future__ import annotations

import base64
import hashlib
import io
import zlib

import pyarrow.fs as fs
import pytest
import zstandard
from pyspark.sql import functions as F

from sweepframe.llm import warc

COLUMNS = "page_id long, url string, html string, digest string, path string, frame int"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>a very long page</p>" * 200_000
    rows = [(i, f"http://h/{i}", "<p>the same page</p>") for i in range(40, 140)]
    rows += [(7, "http://h/7", None), (3, "http://h/3", ""), (8, None, ""), (9, "http://h/\r\nX: y z", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n")]
    rows += [(1, "http://h/1", long), (2, "http://ü/2", long), (-5, "http://h/m", "é\u0000\U0001f600"), (None, "http://h/n", "é\u0000\U0001f600"), (None, "http://h/o", "no id at all"), (None, "http://h/p", "no id at all")]
    rows += [(200, "http://h/a", "repeated row")] * 3 + [(201, "http://h/b", "repeated row")]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], COLUMNS).repartition(4)


def plain(rows, least=0):
    """Types and references by the contract; a repeated row revisits its first copy."""
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out, seen = [], set()
    for page_id, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html or "") if len(data) >= least else None
        if page_id == refers and page_id not in seen:
            refers = None
        seen.add(page_id)
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


@pytest.fixture(scope="module")
def manifest(pages, tmp_path_factory):
    return warc.write_bundles(pages, f"file://{tmp_path_factory.mktemp('bundles')}")


def kinds(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(pages, manifest):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    found = warc.read_bundles(manifest, payloads=True)
    wanted = plain(rows)
    # Rows without an id are revisits only of a row that has one.
    assert kinds(found.where("page_id is not null")) == sorted((r for r in wanted if r[0] is not None), key=str)
    without = {(r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.where("page_id is null").collect()}
    by_text = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): t for t in ("é\u0000\U0001f600", "no id at all")}
    assert {(by_text[d], kind, to) for d, kind, to in without} == {("é\u0000\U0001f600", "revisit", -5), ("no id at all", "response", None)}
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in found.where("record_type = 'response' and page_id is not null").collect():
        assert bytes(r["payload"]).decode() == (texts[r["page_id"]] or "")
    assert found.where("page_id = 9").first()["target_uri"] == "http://h/%0D%0AX:%20y%20z"
    assert manifest.count() == manifest.select("record_id").distinct().count() == len(rows)


def test_small_payloads_are_all_responses(pages, tmp_path):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.where("page_id is not null").collect()]
    found = warc.read_bundles(warc.write_bundles(pages.where("page_id is not null"), f"file://{tmp_path}", least_bytes=15))
    assert kinds(found) == sorted(plain(rows, 15), key=str)


def test_files_are_plain_zstandard_and_seekable(manifest):
    local = fs.LocalFileSystem()
    for path, records in {p: n for p, n in manifest.groupBy("path").count().collect()}.items():
        base = path.removeprefix("file://")
        whole = open(base, "rb").read()
        # Any decoder of concatenated frames gives the WARC file.
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
        assert len(list(warc.parsed(text))) == records
        bundle = warc.Bundle(local.open_input_file(base))
        for r in manifest.where(F.col("path") == path).collect():
            place = bundle.find(r["record_id"])
            assert place == (r["frame"], r["offset"], r["length"])
            data = bundle.frame(place[0])
            (one,) = warc.parsed(data[place[1] : place[1] + place[2]])
            assert one["record_id"] == r["record_id"]
        assert bundle.find("<urn:page:0:NONE:0>") is None
        # Frames hold whole records and about a megabyte, or one record.
        assert all(n <= warc.FRAME_BYTES or len(list(warc.parsed(bundle.frame(i)))) == 1 for i, n in enumerate(bundle.frames[:-1, 1]))


def test_fetch_reads_wanted_records(spark, manifest):
    some = [r["record_id"] for r in manifest.where("page_id in (1, 2, 7, 9, 60)").collect()]
    wanted = spark.createDataFrame([(x, 1) for x in [*some, some[0], "<urn:page:0:NONE:0>", None]], "record_id string, frame int")
    found = warc.fetch(manifest, wanted).collect()
    assert sorted(r["record_id"] for r in found) == sorted(some)
    assert {r["page_id"]: r["record_type"] for r in found} == {1: "response", 2: "revisit", 7: "revisit", 9: "response", 60: "revisit"}
    assert warc.fetch(manifest, wanted.where("false")).count() == 0


def test_damage_is_noticed(manifest, tmp_path):
    base = manifest.first()["path"].removeprefix("file://")
    data = bytearray(open(base, "rb").read())
    bundle = warc.Bundle(fs.LocalFileSystem().open_input_file(base))
    number = int(bundle.starts[1]) - 3
    data[number] ^= 0x55
    broken = tmp_path / "broken"
    broken.write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.Bundle(fs.LocalFileSystem().open_input_file(str(broken))).frame(0)
    broken.write_bytes(zlib.compress(bytes(100)))
    with pytest.raises(ValueError, match="no seek table"):
        warc.Bundle(fs.LocalFileSystem().open_input_file(str(broken)))


def test_empty_table(pages, tmp_path):
    manifest = warc.write_bundles(pages.where("false"), f"file://{tmp_path}")
    assert manifest.count() == 0 and warc.read_bundles(manifest).count() == 0
