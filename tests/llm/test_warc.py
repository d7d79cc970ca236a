import base64
import hashlib
import io

import pytest
import zstandard

from yearloom.llm import warc
from yearloom.llm.common import open_file

PAGES = "page_id long, url string, html string, sha1 string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}\r\n ", h, "x", "x") for i, h in rows], PAGES)


LONG = "<p>é</p>" * 200
ROWS = [(1, LONG), (2, LONG), (9, LONG), (3, "short"), (4, "short"), (5, None), (6, ""), (7, "x" * 999), (8, "x" * 999), (10, "y" * 1000), (11, "y" * 1000)]


def test_round_trip_with_revisits(spark):
    rows = [*ROWS, (12, "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (13, "z" * 3_000_000), (None, LONG), (3, "short")]
    got = warc.read_archives(warc.write_archives(pages(spark, rows).repartition(4), frame_bytes=4000, bundle_bytes=20_000)).collect()
    origin = {1: 9, 2: 9, None: 9, 10: 11}
    html = {i: (h or "").encode() for i, h in rows}
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", origin[r.page_id]) if r.page_id in origin else ("response", None))


def test_repeats_of_the_largest_page_and_of_null_pages(spark):
    got = warc.read_archives(warc.write_archives(pages(spark, [(1, LONG), (2, LONG), (2, LONG), (None, "q" * 2000), (None, "q" * 2000)]))).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [
        ("1", "revisit"), ("2", "response"), ("2", "response"), ("None", "response"), ("None", "response"),
    ]


def test_index_finds_single_records_and_any_tool_reads_the_bundle(spark):
    index = warc.write_archives(pages(spark, ROWS).coalesce(1), frame_bytes=3000).collect()
    for entry in index:
        head, http, payload = warc.read_record(entry.path, entry.frame, entry.at, entry.length)
        assert head["WARC-Record-ID"] == warc.record_id(entry.page_id)
        html = (dict(ROWS)[entry.page_id] or "").encode()
        assert payload == (b"" if head["WARC-Type"] == "revisit" else html)
        assert int(http["Content-Length"]) == len(html)
        assert base64.b32decode(head["WARC-Payload-Digest"][5:]) == hashlib.sha1(html).digest()
    assert len({e.frame for e in index}) > 1
    with open_file(index[0].path) as source:
        raw = source.read()
        reader = warc.BundleReader(source)
        plain = b"".join(bytes(reader.frame(i)) for i in range(len(reader.frames)))
    end = sum(packed for _, packed, _ in reader.frames)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw[:end]), read_across_frames=True).read() == plain
    assert int.from_bytes(raw[end : end + 4], "little") == 0x184D2A5E and raw[-4:] == (0x8F92EAB1).to_bytes(4, "little")


def test_damage_is_seen(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"0" * 100)
    with open_file(str(path)) as source, pytest.raises(ValueError):
        warc.BundleReader(source)


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0
