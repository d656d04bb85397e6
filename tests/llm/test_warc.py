"""WARC archives: exact round trips, revisits and broken files."""

import io

import pytest
import zstandard

from strataloom.llm import warc
from strataloom.llm.common import filesystem

PAGES = [(1, "http://a/ x\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", ""), (4, "http://d", None), (5, "ü", "<p>" + "long " * 20_000), (5, "ü", "<p>" + "long " * 20_000), (None, "n", "<p>one</p>"), (7, "g", "own\r\n\r\nbreaks")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "clash", 3) for i, u, h in PAGES], "page_id long, url string, html string, digest string, refers_to int").repartition(2)


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    files = warc.archive_pages(pages, folder).collect()
    assert sum(f.records for f in files) == len(PAGES)
    found = warc.read_archives(spark, spark.createDataFrame([(f.path,) for f in files], "path string")).collect()
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        refers = None if best[h or ""] == i else best[h or ""]
        expected.append((i, len(raw), warc.payload_digest(raw), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == sorted(expected, key=repr)
    texts = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert bytes(texts[7]) == b"own\r\n\r\nbreaks" and bytes(texts[4]) == b""


def test_no_pages(spark, pages, tmp_path):
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def records(n=40):
    return [warc.page_record(i, f"http://x/{i}", f"<html>page {i} {'text ' * 40}</html>".encode(), warc.payload_digest(f"<html>page {i} {'text ' * 40}</html>".encode()), None) for i in range(n)]


def test_leading_dictionary_frame():
    raw = records(400)
    dictionary = warc.train_dictionary(raw)
    data = b"".join(warc.archive_chunks(iter(raw), dictionary))
    assert dictionary and data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.frames(io.BytesIO(data), chunk=777)) == raw
    plain = b"".join(warc.archive_chunks(iter(raw), b""))
    assert list(warc.frames(io.BytesIO(plain), chunk=64)) == raw
    stored = b"\x5d\x2a\x4d\x18" + len(dictionary).to_bytes(4, "little") + dictionary + data[8 + int.from_bytes(data[4:8], "little") :]
    assert list(warc.frames(io.BytesIO(stored))) == raw


@pytest.mark.parametrize("spoil", [lambda d: d[:-3], lambda d: d + b"xyz", lambda d: d + b"notaframe", lambda d: d[:40] + bytes([d[40] ^ 255]) + d[41:]])
def test_broken_archives_are_refused(spoil):
    data = b"".join(warc.archive_chunks(iter(records(3)), b""))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(spoil(data))))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Type", b"WARC Type "), (b"WARC-Date: ", b"X-Date: "), (b"page 1", b"pagE 1")])
def test_broken_records_are_refused(old, new):
    raw = records(2)[1]
    fields, block = warc.parse_record(raw)
    assert warc.page_of(fields, block)[0] == 1
    with pytest.raises(warc.WarcError):
        head, sep, rest = raw.partition(b"\r\n\r\n")
        spoiled = head.replace(old, new) + sep + rest if old != b"page 1" else raw.replace(old, new)
        if old == b"Content-Length: ":
            spoiled = raw.replace(b"\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n", b"\r\nContent-Length: 1\r\n\r\n")
        f, b = warc.parse_record(spoiled)
        warc.page_of(f, b)


def test_a_retried_write_replaces_the_file(tmp_path):
    from strataloom.llm.common import write_atomic

    for _ in range(2):
        write_atomic(f"file://{tmp_path}/d/f", [b"ab", b"c"])
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["f"] and filesystem(f"file://{tmp_path}/d/f")[1] == f"{tmp_path}/d/f"
    assert zstandard.ZSTD_VERSION


def foreign(kind, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in more.items()}}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_others():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    digest = warc.payload_digest(b"hello")
    page = warc.page_of(*warc.parse_record(foreign("response", body, WARC_Target_URI="http://a/")))
    assert page == (None, "http://a/", b"hello", 5, digest, "response", None)
    assert warc.page_of(*warc.parse_record(foreign("response", body, WARC_Payload_Digest="md5:1")))[4] == digest
    assert warc.page_of(*warc.parse_record(foreign("response", b"a DNS answer")))[2] == b"a DNS answer"
    revisit = foreign("revisit", body.replace(b"hello", b""), WARC_Refers_To="<urn:uuid:0>", WARC_Payload_Digest=f"sha1:{digest}")
    assert warc.page_of(*warc.parse_record(revisit))[3:] == (None, digest, "revisit", None)
    for spoiled in (foreign("response", body, WARC_Payload_Digest="sha1:AAAA"), foreign("response", b"HTTP/1.1 200 OK"), foreign("revisit", body), foreign("response", body, X_Payload_Length="x"), foreign("response", body, X_Payload_Length="4")):
        with pytest.raises(warc.WarcError):
            warc.page_of(*warc.parse_record(spoiled))
