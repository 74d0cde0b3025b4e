import hashlib
import struct

import pytest
import zstandard

from quillspark.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def test_round_trip(spark, tmp_path):
    big, small = "<p>é</p>" * 300, "tiny"
    rows = [(1, "http://a/\r\nX: 1", big), (2, None, big), (3, "http://c", small), (4, "http://d", small), (5, "http://e", None), (6, "http://f", ""), (None, "http://g", big), (7, "http://h", "\r\n\r\n" + "x" * 2000), (2, None, big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    assert warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=3000) == len(rows)
    got = warc.read_archives(spark, warc.archives(spark, f"file://{tmp_path}/w")).collect()
    assert len(got) == len(rows) and not any(r.error for r in got)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    for r in got:
        page = next(x for x in rows if warc.page_record_id(x[0]) == r.record_id)
        text = page[2] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), sha(text))
        revisit = text == big and page[0] != 2
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (warc.page_record_id(2) if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == text.encode()
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/none") == 0


def archive(raws, dictionary=b"", compressed=False):
    held = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    lead = struct.pack("<II", warc.DICTIONARY_MAGIC, len(held)) + held if dictionary else b""
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    return lead + b"".join(coder.compress(r) for r in raws)


def record(payload=b"hello", **change):
    raw = warc.build_record("<urn:page:1>", "http://a", payload, hashlib.sha1(payload).hexdigest(), None)
    for old, new in change.values():
        assert old in raw
        raw = raw.replace(old, new, 1)
    return raw


@pytest.mark.parametrize("compressed", [False, True])
def test_dictionaries(compressed):
    samples = [f"page number {i} with some common words and markup <p>{i * 7}</p>".encode() * 3 for i in range(400)]
    dictionary = zstandard.train_dictionary(2048, samples).as_bytes()
    rows = list(warc.parse_archive(archive([record(s) for s in samples[:5]], dictionary, compressed)))
    assert [r["payload"] for r in rows] == samples[:5] and not any(r["error"] for r in rows)


@pytest.mark.parametrize(
    "change",
    [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""), (b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 6\r\n\r\nhello"), (b"hello", b"jello"), (b"hello\r\n\r\n", b"hello\r\n\r\n\r\n"), (b"WARC-Type: response", b"WARC-Type response")],
)
def test_bad_records_are_told(change):
    rows = list(warc.parse_archive(archive([record(), record(c=change), record()])))
    assert [bool(r["error"]) for r in rows] == [False, True, False]


def test_broken_archives_are_told():
    whole = archive([record(), record(b"x" * 5000)])
    for data in (whole[:-3], whole + b"junk!!!", whole + struct.pack("<II", 0x184D2A50, 99) + b"x", struct.pack("<II", warc.DICTIONARY_MAGIC, 99) + b"x"):
        assert list(warc.parse_archive(data))[-1]["error"]
    assert list(warc.parse_archive(b"")) == []


def test_strict_reading_fails(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive([record(c=(b"hello", b"jello"))]))
    path = f"file://{tmp_path}/a.warc.zst"
    assert warc.read_archives(spark, path, strict=False).first().error
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, path).collect()
