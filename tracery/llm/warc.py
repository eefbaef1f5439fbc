"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Archives are rows (archive, content) of a table that Spark writes to the shared folder, so that a lost executor's work is
written again and a store that only Spark reaches will do; `content` is byte for byte the file.  Reading validates every
frame, header and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

# Fixed values of the formats.
SKIPPABLE_MAGIC, ZSTD_MAGIC, DICT_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary is trained on at most so many pages of at most so many bytes, those with the smallest digests, and is at most so large.
SAMPLE_PAGES, SAMPLE_PAGE_BYTES, DICT_BYTES = 400, 64 << 10, 32 << 10
#: Copies of one row (same id, url and payload) that are written by one task.
COPIES = 10_000
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 16 << 20
#: Records that are read are handed on once their payloads have so many bytes, or there are so many of them.
READ_BYTES, READ_ROWS = 4 << 20, 4096


class WarcError(ValueError):
    pass


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary, or none where the samples are too few to train one."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstd.ZstdError:
        return b""


def record(kind: str, record_id: str | None, uri: str, payload_bytes: int, digest: str, payload: bytes | None, refers_to: str | None = None, copy: int = 1) -> bytes:
    """One WARC record; the block is HTTP headers and, for a response, the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes + (payload or b"")
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id, copy)}", f"WARC-Target-URI: {uri}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_start(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def compressor(dictionary: bytes):
    import zstandard as zstd

    return zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one from each frame.  The dictionary of the leading skippable frame may itself be compressed."""
    import zstandard as zstd

    at, extra = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if len(raw) != size:
            raise WarcError("the dictionary is cut off")
        raw = zstd.ZstdDecompressor().decompress(raw, max_output_size=1 << 27) if raw[:4] == ZSTD_MAGIC else raw
        if raw[:4] != DICT_MAGIC:
            raise WarcError("no dictionary in the leading frame")
        extra, at = zstd.ZstdCompressionDict(raw), 8 + size
    reader = zstd.ZstdDecompressor(dict_data=extra)
    while at < len(content):
        if content[at : at + 4] != ZSTD_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = reader.decompressobj()
        try:
            data = one.decompress(memoryview(content)[at:] if len(content) - at < 1 << 16 else memoryview(content)[at : at + (1 << 16)])
            end = at + (1 << 16)
            while not one.eof and end < len(content):
                data += one.decompress(memoryview(content)[end : end + (1 << 20)])
                end += 1 << 20
        except zstd.ZstdError as e:
            raise WarcError(f"bad frame at byte {at}: {e}") from None
        if not one.eof:
            raise WarcError(f"the frame at byte {at} is cut off")
        at = min(end, len(content)) - len(one.unused_data)
        yield data


def parse_record(data: bytes) -> dict[str, object]:
    """Headers (lower-case names), http headers and payload of a record; raises WarcError on any header or length that doesn't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("not a WARC record")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    size = int(headers["content-length"]) if headers["content-length"].isascii() and headers["content-length"].isdigit() else -1
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block's length is wrong")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    inner = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
    if not (inner.isascii() and inner.isdigit()):
        raise WarcError("the payload's length is no number")
    length = int(inner)
    if headers["warc-type"] == "response":
        if length != len(payload):
            raise WarcError("the payload's length is wrong")
        if headers.get("warc-payload-digest") != "sha1:" + digest_of(payload):
            raise WarcError("the payload's digest is wrong")
    elif headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise WarcError("a revisit needs a target, a length and no payload")
    else:
        raise WarcError(f"unknown type {headers['warc-type']}")
    return {"headers": headers, "payload_bytes": length, "payload": payload}


def _header(line: bytes) -> tuple[str, str]:
    name, colon, value = line.decode("utf-8", "surrogateescape").partition(":")
    if not colon or not name.strip():
        raise WarcError("a header without a name")
    return name.strip().lower(), value.strip()


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = [_header(x) for x in lines]
    if len({k for k, _ in pairs}) < len(pairs):
        raise WarcError("a header comes twice")
    return dict(pairs)


def _urn(page_id: str | None, copy: int = 1) -> str:
    """<urn:page:id>, and for further copies of a row <urn:page:id#copy>; a null id is an empty one."""
    return f"<urn:page:{quote(page_id or '', safe='')}{f'#{copy}' if copy > 1 else ''}>"


def _page_of(urn: str | None) -> str | None:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">").partition("#")[0]) or None if urn else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = compressor(dictionary)
        held, size, name, count = [archive_start(dictionary)], 0, "", 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for x in batches:
            for i in range(x.num_rows):
                r = {k: x.column(k)[i].as_py() for k in x.schema.names}
                kind = "revisit" if r["revisit"] else "response"
                payload = None if r["revisit"] else (r["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                uri = "".join(c for c in r["url"] or "" if c >= " " and c != "\x7f")
                frame = pack.compress(record(kind, r["page_id"], uri, r["payload_bytes"], digest, payload, r["refers_to"], r["copy"]))
                name = name or f"pages-{TaskContext.get().partitionId():06d}-{count:06d}.warc.zst"
                held.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, name, count = [archive_start(dictionary)], 0, "", count + 1
        if name:
            yield close()

    return run


_RECORD = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _row(data: bytes) -> dict[str, object]:
    r = parse_record(data)
    h = r["headers"]
    return {"page_id": _page_of(h["warc-record-id"]), "url": h.get("warc-target-uri", ""), "payload_bytes": r["payload_bytes"], "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "record_type": h["warc-type"], "refers_to": _page_of(h.get("warc-refers-to")), "payload": r["payload"]}


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records leave as soon as READ_BYTES of payloads or READ_ROWS records are there: what an archive unpacks to is never held whole."""
    for x in batches:
        for content in x.column(1):
            rows, size = [], 0
            for row in map(_row, read_archive(content.as_py())):
                rows.append(row)
                size += len(row["payload"])
                if size >= READ_BYTES or len(rows) == READ_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives (archive, content) with a record for each row of `pages` (page_id, url, html).

    Of records with equal payloads of at least `least_bytes` bytes, that with the largest page_id is the response and the others
    revisit it; of several rows with that page_id, one with the greatest url.  Null html is an empty payload, a null url an empty one, a null page_id the
    smallest.  Every row has its record, rows that are equal in all three too.  Very long pages are records like others.
    Other columns are ignored; an empty table makes no archive.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").alias("id"), F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit("")).alias("page"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    # digests decide, so that the pages themselves are shuffled once; equal rows are one with a count
    key = ["page", "url", "sha1"]
    known = saved(pages.groupBy(*key).agg(F.first("id").alias("id"), F.first(F.octet_length("html")).cast("long").alias("payload_bytes"), F.count("*").alias("n")), "digests")
    first = known.groupBy("sha1").agg(F.max(F.struct("id", "page", "url")).alias("first"))
    own = (F.col("page") == F.col("first.page")) & (F.col("url") == F.col("first.url"))
    known = known.join(first, "sha1").select(*key, "n", "payload_bytes", F.coalesce(~own & (F.col("payload_bytes") >= least_bytes), F.lit(False)).alias("revisit"), F.col("first.id").cast("string").alias("first"), F.col("id").cast("string").alias("page_id"))
    refers = F.when(F.col("revisit"), F.col("first")).alias("refers_to")
    # the first copy of each row, with the page for a response (a filter would become a join key, hence the aggregate)
    whole = pages.groupBy(*key).agg(F.first("html").alias("html"))
    rows = whole.join(known, key).select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "payload_bytes", "sha1", "revisit", refers, F.lit(1).alias("copy"))
    # further copies: of a payload below `least_bytes` responses with the page, else revisits
    more = known.where("n > 1").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 2) div {COPIES})"))).repartition("sha1", "page", "url", "chunk")
    more = more.withColumn("copy", F.explode(F.expr(f"sequence(cast(chunk * {COPIES} + 2 as int), cast(least(n, (chunk + 1) * {COPIES} + 1) as int))")))
    again = F.col("payload_bytes") >= least_bytes
    revisits = more.where(again).select("page_id", "url", F.lit(None).cast("string").alias("html"), "payload_bytes", "sha1", F.lit(True).alias("revisit"), F.col("first").alias("refers_to"), "copy")
    rows = rows.union(revisits)
    if least_bytes > 0:
        small = more.where(~again).join(whole, key).select("page_id", "url", "html", "payload_bytes", "sha1", F.lit(False).alias("revisit"), F.lit(None).cast("string").alias("refers_to"), "copy")
        rows = rows.union(small)
    picked = known.where(F.col("payload_bytes").between(1, SAMPLE_PAGE_BYTES)).groupBy("sha1").agg(F.min("page").alias("page")).orderBy("sha1").limit(SAMPLE_PAGES).collect()
    sample = pages.where(F.col("page").isin([r["page"] for r in picked])).where(F.col("sha1").isin([r["sha1"] for r in picked])).groupBy("sha1").agg(F.first("html").alias("html")).orderBy("sha1").collect() if picked else []
    return saved(rows.mapInArrow(_writer(train_dictionary([r["html"].encode() for r in sample])), "archive string, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of archives (archive, content)."""
    kind = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    return archives.select("archive", "content").mapInArrow(_reader, kind)
