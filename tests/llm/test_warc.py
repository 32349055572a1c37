import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from mixdetect.llm import warc

PAGES = "page_id long, url string, html string, kind string, id string, key string"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "k", "i", "x") for i, u, h in rows], PAGES).repartition(3)

    return make


def rows():
    page = "<html>é" + "abc " * 400
    out = [(k, f"http://h{k}/", f"<p>page {k}" + "word " * (k * 7)) for k in range(60)]
    out += [(100, "http://a/", page), (103, "http://b/", page), (101, None, page), (103, "http://b/", page), (None, "http://n/", page)]
    out += [(None, "u", "y" * 1500), (None, "u", "y" * 1500), (110, "http://x/", "z" * 999), (111, "http://x/", "z" * 999),
            (112, "bad\r\nurl", "z" * 1000), (113, "http://x/", "z" * 1000), (114, "", None), (115, "", ""),
            (116, "big", "long " * 400_000), (117, "big", "long " * 400_000)]
    return out


def expected(given):
    groups = {}
    for i, _, h in given:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in given:
        raw = (h or "").encode()
        keeper = max((x for x in groups[h or ""] if x is not None), default=None)
        again = len(raw) >= 1000 and i != keeper
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def test_round_trip(pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    given = rows()
    folder = f"file://{tmp_path}/archives"
    got = warc.round_trip(pages(given), folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(given)
    files = sorted((tmp_path / "archives").glob("*"))
    assert files and all(f.name.endswith(".warc.zst") for f in files)
    first = files[0].read_bytes()
    assert struct.unpack("<I", first[:4])[0] == warc.SKIPPABLE_DICTIONARY


def test_payloads_and_writer_is_repeatable(pages, spark, tmp_path):
    given = pages(rows())
    plan = warc.plan_records(given).persist()
    dictionary = warc.train_dictionary(given, "page_id", "html")
    for name in "ab":
        warc.write_archives(plan, f"{tmp_path}/{name}", dictionary, archive_bytes=20_000)
    one, two = ({f.name: f.read_bytes() for f in (tmp_path / n).glob("*.warc.zst")} for n in "ab")
    assert one == two and len(one) > 3
    back = warc.read_archives(spark, f"file://{tmp_path}/a").where("warc_type = 'response'")
    assert back.where(F.sha1("payload") != F.col("payload_digest")).count() == 0
    assert back.where("target_uri = 'bad%0D%0Aurl'").count() + back.where("target_uri = 'http://x/'").count() >= 2


def test_empty(pages, tmp_path):
    assert warc.round_trip(pages([]), f"file://{tmp_path}/none").count() == 0
    assert warc.round_trip(pages([(1, "u", "h")]), f"file://{tmp_path}/one").count() == 1


def record(**changes):
    raw = warc.make_record("response", "<urn:record:1>", "http://x/", "2000-01-01T00:00:00Z", b"payload " * 20, None)
    for old, new in changes.get("replace", ()):
        assert old in raw
        raw = raw.replace(old, new)
    return raw


def archive(*raws, dictionary=b"", **options):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    comp = zstandard.ZstdCompressor(**({"dict_data": data} if data else {}), **options)
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + b"".join(comp.compress(r) for r in raws)


@pytest.mark.parametrize("change, message", [
    ((b"WARC/1.1", b"WARC/9.9"), "version"), ((b"WARC-Date", b"WARC-Data"), "missing"), ((b"Content-Length: 2", b"Content-Length: 3"), "declared"),
    ((b"WARC-Type: ", b"WARC-Type "), "bad header"), ((b"payload payload", b"payload paylaod"), "digest")])
def test_bad_records(spark, tmp_path, change, message):
    (tmp_path / "x.warc.zst").write_bytes(archive(record(), record(replace=[change]), record()))
    got = warc.read_archives(spark, f"file://{tmp_path}", on_error="row").orderBy("offset").collect()
    assert len(got) == 3 and message in got[1].error and got[0].error is None and got[2].warc_type == "response"
    with pytest.raises(Exception, match=message):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_frames():
    raws = [record(), b"x" * 300_000, b""]
    for options in ({}, {"write_checksum": True}, {"write_content_size": False}, {"level": 19}):
        assert [r for _, r in warc.frames(archive(*raws, **options))] == raws
    good = archive(*raws)
    skipped = struct.pack("<II", 0x184D2A50, 5) + b"hello"
    assert [r for _, r in warc.frames(skipped + good + skipped)] == raws
    with pytest.raises(warc.WarcError):
        list(warc.frames(good[:-3]))
    with pytest.raises(warc.WarcError):
        list(warc.frames(b"junk" + good))
