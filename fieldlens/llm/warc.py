"""WARC archives: written with segmented, chunk-framed records, read back and reassembled.

A page becomes a record whose block is an HTTP response in chunked transfer framing. Blocks beyond the
segment size continue in further records, which name the first record as their origin and carry their
number; the last one carries the total length. Reading groups continuations by origin, orders them by
number, verifies the total and takes the chunk framing off.

Spark's text writer with the records' closing blank lines as line separator writes the archives, so
they land in any store that Spark reaches, and a lost task is written again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from fieldlens.storage import shared_path, stored
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CRLF = b"\r\n"
END = "\r\n\r\n"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("6f0c1c5e-7b0e-5a5e-9f53-3a1d1c0d5b7a")


def record_id(page_id: int | str | None) -> str:
    """The same page has the same record id in every run."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, str(page_id))}>"


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a chunk-framed body; ValueError when the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(CRLF, at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk doesn't end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + CRLF


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int, chunk: int, row: int | None = None) -> list[bytes]:
    """The records of one page, without their closing blank lines. row tells rows of one page_id apart."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = str(page_id) if row is None else f"{page_id}#{row}"
    own = record_id(name)
    uri = re.sub(r"\s", "%20", url or "") or None
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-Id", page_id)]
    if refers_to is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", refers_to), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http))]
        return [header(head) + http]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for k, part in enumerate(parts):
        if k == 0:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None), ("Content-Type", "application/http;msgtype=response")]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, f'{name}/{k + 1}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", len(block) if k == len(parts) - 1 else None)]
        out.append(header([*head, ("Content-Length", len(part))]) + part)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [(h or "").encode() for h in b["html"].to_pylist()]
        yield pa.record_batch({"page_id": b["page_id"].cast(pa.int64()), "sha": [hashlib.sha1(x).hexdigest() for x in data], "bytes": pa.array([len(x) for x in data], pa.int64())})


def _writer(segment: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, url, html, refers, row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "refers_to", "row")), strict=True):
                yield pa.record_batch({"record": pa.array(page_records(page, url, (html or "").encode(), refers, segment, chunk, row), pa.binary())})

    return run


def write_archives(pages: DataFrame, path: str, least: int = 1000, segment: int = 65536, chunk: int = 8192, per_file: int = 400) -> None:
    """A record for each row of pages, in gzipped archives of at most per_file records of segment bytes.

    Among payloads that are equal (SHA-1) and have least bytes, the largest page_id's is the response
    and the others revisit it; a null page_id never is the one revisited if any other id is there, and
    rows that share the response's page_id are responses too. Rows that share a page_id are records of their own. Null html is an empty payload.
    Extra columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    sums = rows.select("page_id", "html").mapInArrow(_sums, "page_id long, sha string, bytes long").where(F.col("bytes") >= least)
    sums = stored(sums, "sums")
    first = stored(sums.groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    again = sums.join(first, "sha").where("page_id < response").select("page_id", F.struct("sha", "response").alias("to"))
    often = rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id", F.lit(None).cast("struct<sha:string,response:bigint>").alias("to"))
    marks = again.unionByName(often).groupBy("page_id").agg(F.map_from_entries(F.collect_set("to")).alias("to"), F.bool_or(F.col("to").isNull()).alias("often"))
    marks = stored(marks.withColumnRenamed("page_id", "id"), "revisits")
    marked = rows.join(marks, F.col("page_id").eqNullSafe(F.col("id")), "left")
    refers = F.try_element_at("to", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    marked = marked.select("page_id", "url", "html", refers.alias("refers_to"), F.when(F.col("often"), F.monotonically_increasing_id()).alias("row"))
    records = marked.mapInArrow(_writer(segment, chunk), "record binary")
    out = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file)
    out.text(path)


PIECE = 1 << 20


def unpacked(content: bytes) -> Iterator[bytes]:
    """The archive's bytes in pieces: gzip of one member or of a member for each record, or none."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(content):
        if not any(view[at : at + 512]) and not any(view[at:]):  # padding after the last member
            return
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            piece = view[at : at + PIECE]
            if not len(piece):
                raise ValueError("the archive ends inside a gzip member")
            out = member.decompress(piece, PIECE)
            at += len(piece) - len(member.unused_data) - len(member.unconsumed_tail)
            if out:
                yield out


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; ValueError where the archive is broken. Holds one record."""
    it, held, place = iter(pieces), bytearray(), 0

    def more(least: int) -> bool:
        while len(held) < least:
            piece = next(it, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while more(2) and held[:2] == CRLF:  # more blank lines than needed
            del held[:2]
            place += 2
        if not more(5):
            if held:
                raise ValueError(f"no record at byte {place}")
            return
        if held[:5] != b"WARC/":
            raise ValueError(f"no record at byte {place}")
        end = -1
        while (end := held.find(b"\r\n\r\n", max(0, end))) < 0:
            if not more(len(held) + 1):
                raise ValueError(f"the record at byte {place} has no end of its fields")
        fields: dict[str, str] = {}
        name = ""
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and name:  # a field goes on
                fields[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        size = int(fields["content-length"])
        if not more(end + 8 + size) or held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {place} doesn't end where its length says")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]
        place += end + 8 + size


SEGMENT = "origin string, number int, total long, page_id long, url string, record_type string, sha1 string, refers_to long, http boolean, block binary"


#: The record types that carry pages. Others (warcinfo, request, metadata, ...) are passed over.
PAGES = ("response", "resource", "revisit", "conversion")


def hex_digest(field: str | None) -> str | None:
    """A labelled SHA-1 in hexadecimal; null for other algorithms."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None else int(x)
    for b in batches:
        for content in b["content"]:
            rows: list[tuple] = []
            held = 0
            for f, block in parse_records(unpacked(content.as_py())):
                kind = f.get("warc-type", "").lower()
                if kind not in PAGES and kind != "continuation":
                    continue
                first = kind != "continuation"
                segment = number(f.get("warc-segment-number"))
                total = number(f.get("warc-segment-total-length")) if segment else len(block)
                http = f.get("content-type", "").lower().startswith("application/http") or kind == "revisit"
                rows.append((f["warc-record-id"] if first else f["warc-segment-origin-id"], segment or 1, total, number(f.get("x-page-id")), f.get("warc-target-uri"), kind if first else None, hex_digest(f.get("warc-payload-digest")) if first else None, number(f.get("x-refers-to-page-id")), http if first else None, block))
                held += len(block)
                if held > 8 << 20:
                    yield _as_batch(rows)
                    rows, held = [], 0
            yield _as_batch(rows)


_TYPES = [("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("sha1", pa.string()), ("refers_to", pa.int64()), ("http", pa.bool_()), ("block", pa.binary())]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, _TYPES, strict=True)], schema=pa.schema(_TYPES))


def http_payload(block: bytes, page: object) -> tuple[bytes, bytes]:
    """(head, body) of an HTTP message: chunks are joined, a stated length holds, else the body is all the rest."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?mi)^transfer-encoding:\s*chunked\s*$", head):
        return head, unchunked(body)
    if blank and (size := re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", head)):
        if len(body) < int(size[1]):
            raise ValueError(f"the body of page {page} has {len(body)} of {int(size[1])} bytes")
        body = body[: int(size[1])]
    return head, body


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page, url, kind, sha, refers, http, total, blocks in zip(*(b[c].to_pylist() for c in ("page_id", "url", "record_type", "sha1", "refers_to", "http", "total", "blocks")), strict=True):
            whole = b"".join(blocks)
            if total is None or len(whole) != total:
                raise ValueError(f"segments of page {page if page is not None else url} have {len(whole)} of {total} bytes")
            if kind == "revisit":
                stated = re.search(rb"(?mi)^content-length:\s*(\d+)", whole.partition(b"\r\n\r\n")[0])
                size, payload = int(stated[1]) if stated else None, None
            else:
                payload = http_payload(whole, page)[1] if http else whole
                size, own = len(payload), hashlib.sha1(payload).hexdigest()
                if sha is not None and own != sha:
                    raise ValueError(f"the payload of page {page if page is not None else url} has another digest")
                sha = own
            rows.append((page, url, size, sha, kind, refers, payload))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each whole record that carries a page.

    Archives are plain or gzipped, by record or as one. A record in one segment is whole where it is
    read; only segmented ones are shuffled, by origin. Bodies are chunked, of a stated length, or all
    the rest. page_id is null in archives of others. A missing segment, a wrong total, broken chunks and
    a wrong digest are errors. Revisits have no payload of their own; size and digest are those of the
    payload they stand for.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = files.mapInArrow(_segments, SEGMENT)
    meta = ["page_id", "url", "record_type", "sha1", "refers_to", "http"]
    alone = parts.where("number = 1 and total is not null").select(*meta, "total", F.array("block").alias("blocks"))
    split = parts.where("number > 1 or total is null")
    joined = split.groupBy("origin").agg(*[F.max(c).alias(c) for c in meta], F.max("total").alias("total"), F.expr("transform(sort_array(collect_list(struct(number, block))), x -> x.block)").alias("blocks")).drop("origin")
    whole = alone.unionByName(joined.select(*meta, "total", "blocks"))
    return whole.mapInArrow(_payloads, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, path: str | None = None, **options: int) -> DataFrame:
    """pages written as archives (in a shared folder unless a path is given), and what reading them back gives."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path)
