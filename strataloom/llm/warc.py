"""WARC archives in Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Layout of a file (the ``.warc.zst`` convention): a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame, and then one frame for each record, compressed with that
dictionary. Records are WARC/1.1: one ``warcinfo``, then a ``response`` or, where the same payload
stands in another record, a ``revisit`` of it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialize, shared_path, ship, table, write_atomic

DICTIONARY_FRAME, ZSTD_FRAME, EOL = 0x184D2A5D, 0xFD2FB528, b"\r\n"

#: Payload bytes that a task looks at to train its dictionary, and the dictionary's size.
TRAINING_BYTES, DICTIONARY_BYTES = 4_000_000, 65_536

#: Payload bytes of a file before the task starts another.
FILE_BYTES = 256_000_000

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + EOL + EOL


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit of page ``refers_to`` with the HTTP head alone."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    # Line breaks can't stand in a header, and a URI has no blanks.
    target = "".join(c if c.isprintable() and c not in " <>" else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(f"page:{page_id}")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target or "urn:none"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is None:
        return record_bytes(fields, head + payload)
    return record_bytes([*fields, ("WARC-Refers-To", record_id(f"page:{refers_to}")), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", REVISIT_PROFILE)], head)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for these payloads; empty where there are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_chunks(records: Iterator[bytes], dictionary: bytes, level: int = 6) -> Iterator[bytes]:
    """The bytes of an archive."""
    import zstandard

    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    if dictionary:
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **options)
    for record in records:
        yield compressor.compress(record)


def write_archives(rows: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", digest_col: str = "digest", refers_col: str = "refers_to") -> DataFrame:
    """Write a record for each row; (path, records) of each file. A task writes its own files and
    trains their dictionary on its first payloads; file names come from the partition and the
    content is fixed by the rows, so a repeated task replaces what it wrote."""
    ship(rows.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        def pages():
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    yield from zip(*(part.column(c).to_pylist() for c in (id_col, url_col, html_col, digest_col, refers_col)), strict=True)

        source, partition, number, written = pages(), TaskContext.get().partitionId(), 0, []
        page = next(source, None)
        while page is not None:
            held, size = [], 0
            while page is not None and size < TRAINING_BYTES:
                held.append(page)
                size += len(page[2] or b"")
                page = next(source, None)
            dictionary = train_dictionary([p[2][:131_072] for p in held if p[2] and p[4] is None])
            path, count = f"{folder}/pages-{partition:06d}-{number:04d}.warc.zst", 0

            def records():
                nonlocal page, size, count
                yield record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                for p in held:
                    count += 1
                    yield page_record(p[0], p[1], p[2] or b"", p[3], p[4])
                held.clear()
                while page is not None and size < FILE_BYTES:
                    count += 1
                    size += len(page[2] or b"")
                    yield page_record(page[0], page[1], page[2] or b"", page[3], page[4])
                    page = next(source, None)

            write_atomic(path, archive_chunks(records(), dictionary))
            written.append((path, count))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in written], pa.string()), pa.array([w[1] for w in written], pa.int64())], ["path", "records"])

    columns = [F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{url_col}`").cast("string").alias(url_col), F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias(html_col), digest_col, refers_col]
    return rows.select(*columns).mapInArrow(run, "path string, records long")


class WarcError(ValueError):
    """An archive that breaks the format."""


def frames(stream, chunk: int = 4_000_000) -> Iterator[bytes]:
    """The records of an open archive, frame by frame; memory holds one record and one chunk."""
    import zstandard

    def fresh(dictionary):
        return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

    buffer, dictionary, first = b"", b"", True
    decompressor = fresh(b"")
    while True:
        if len(buffer) < 8:
            buffer += stream.read(chunk)
            if not buffer:
                return
            if len(buffer) < 8:
                raise WarcError("the archive ends inside a frame's head")
        magic, size = struct.unpack_from("<II", buffer)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            while len(buffer) < 8 + size:
                more = stream.read(chunk)
                if not more:
                    raise WarcError("the archive ends inside a skippable frame")
                buffer += more
            if magic == DICTIONARY_FRAME:
                if not first:
                    raise WarcError("a dictionary that isn't at the start")
                dictionary = buffer[8 : 8 + size]
                if dictionary[:4] == struct.pack("<I", ZSTD_FRAME):
                    dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
                decompressor = fresh(dictionary)
            buffer, first = buffer[8 + size :], False
            continue
        if magic != ZSTD_FRAME:
            raise WarcError(f"no frame starts with {magic:#x}")
        one, out, first = decompressor.decompressobj(), [], False
        try:
            while True:
                out.append(one.decompress(buffer))
                if one.eof:
                    buffer = one.unused_data
                    break
                buffer = stream.read(chunk)
                if not buffer:
                    raise WarcError("the archive ends inside a frame")
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        yield b"".join(out)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record, checked."""
    head, found, rest = raw.partition(EOL + EOL)
    if not found:
        raise WarcError("a record without an end of its head")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC version: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"no header: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"a record without {name}")
    size = fields["content-length"]
    if not (size.isascii() and size.isdigit()):
        raise WarcError(f"no length: {size[:40]!r}")
    if rest[int(size) :] != EOL + EOL:
        raise WarcError(f"a block that isn't {size} bytes, or a record without its end")
    return fields, rest[: int(size)]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to); the SHA-1
    digest and the length of a response are checked against its payload where the record has them.

    Archives of others have no extension headers: page ids are null then, lengths and digests of
    responses come from the payloads, and of a revisit only the digest that it states is known. A
    response that isn't of HTTP, such as a DNS answer, is all payload.
    """
    own, name, kind = "x-page-id" in fields, fields.get("warc-record-id", "a record without id"), fields["warc-type"]

    def number(header: str) -> int | None:
        try:
            return int(fields[header]) if fields.get(header) else None
        except ValueError:
            raise WarcError(f"{header} of {name} isn't a number") from None

    http, found, payload = block.partition(EOL + EOL)
    if not http.startswith(b"HTTP/"):
        if own:
            raise WarcError("no HTTP head in a page's record")
        payload = block
    elif not found:
        raise WarcError(f"an HTTP head that doesn't end: {name}")
    stated, size = fields.get("warc-payload-digest", ""), number("x-payload-length")
    digest = stated.removeprefix("sha1:") if stated.startswith("sha1:") else None
    if kind == "response":
        made = payload_digest(payload)
        if size not in (None, len(payload)) or digest not in (None, made):
            raise WarcError(f"a payload that doesn't match its digest or length: {name}")
        size, digest = len(payload), made
    elif own and payload or not ("warc-refers-to" in fields or "warc-refers-to-target-uri" in fields):
        raise WarcError(f"no proper revisit: {name}")
    return number("x-page-id"), fields.get("warc-target-uri"), payload, size, digest, kind, number("x-refers-to-page-id")


def read_archives(spark: SparkSession, paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages of the archives in ``paths`` (path): (page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to), one task per file. ``payload`` is null for a revisit,
    and for all if ``payloads`` is false (they are decoded and checked all the same). Records come
    as often as they stand in the files; empty payloads are no nulls; no files give no rows, and
    other columns of ``paths`` are ignored. A record that breaks the format is a WarcError."""
    ship(spark)
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    def run(batches):
        for uri in (p for b in batches for p in b.column("path").to_pylist()):
            system, path = filesystem(uri)
            rows, size = [], 0
            with system.open_input_stream(path, compression=None) as stream:
                for raw in frames(stream):
                    fields, block = parse_record(raw)
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    page = page_of(fields, block)
                    rows.append((*page[:2], page[2] if payloads and page[5] == "response" else None, *page[3:]))
                    size += len(page[2]) if payloads else 0
                    if len(rows) >= 5000 or size > 16_000_000:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return paths.select("path").mapInArrow(run, schema)


#: The alphabet of RFC 4648 base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages as WARC archives to ``folder``; (path, records) of each file.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that of the largest id is a
    response and the others revisit it; smaller ones are all responses. The largest id of each
    digest comes from an aggregate that combines before its shuffle; payloads are shuffled once, to
    meet it, in a sort-merge join whose hot digests Spark splits.

    Null html is an empty payload. Rows that repeat the largest id of their payload are responses
    too. Pages without an id are responses unless another page with an id has their payload.
    """
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.encode(F.col(f"`{html_col}`").cast("string"), "UTF-8"), F.lit(b"")).alias("html"))
    hexed = p.withColumn("__sha1", F.sha1("html"))
    best = hexed.where(F.octet_length("html") >= min_bytes).groupBy(F.col("__sha1").alias("__key")).agg(F.max("page_id").alias("__best"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # Written, so that the join deals both sides anew and Spark can split a hot digest's rows.
    best = materialize(best, "warc-best")
    joined = hexed.join(best, hexed["__sha1"] == best["__key"], "left")
    refers = F.when(F.col("__best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__best")), F.col("__best"))
    rows = joined.select("page_id", "url", "html", base32("__sha1").alias("digest"), refers.alias("refers_to"))
    return write_archives(rows, folder)


def base32(hex_column: str):
    """Base 32 of 40 hex digits: every 5 digits are 4 letters."""
    letters = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(hex_column, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_path(spark, "warc")
    listing = f"{folder}/files"
    archive_pages(pages, folder).write.parquet(listing)
    written = spark.read.parquet(listing)
    files = written.repartition(max(1, written.count()))
    return read_archives(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
