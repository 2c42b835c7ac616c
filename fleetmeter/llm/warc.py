"""Derivatives of web archives: metadata and plain-text conversion records of response records.

A response becomes two records that refer to it by its id: ``metadata`` (application/warc-fields: status, source headers,
digests, title, language, links) and ``conversion`` (text/plain). The two are linked with each other as concurrent, carry the
response's target, date, headers and digests on, and have ids that follow from the response's id, so building them again
gives the same records.

Responses come from WARC files (``read``) or from a table of pages (``responses``). Every record is built where it lies,
without a shuffle. Transfer and content encodings are undone before text is taken, digests are those of the bytes as archived;
what can't be undone leaves the conversion with what could be read and a ``content-problem`` line in the metadata. A damaged
part of a file costs the records in it, no later ones; ``damages`` lists such parts.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import map_slices

#: Namespace of all record ids made here.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
#: Date of a response of which none is known.
UNDATED = "1970-01-01T00:00:00Z"
#: The first bytes of gzip members, of zstd frames, and of WARC records.
GZIP, ZSTD, VERSION = b"\x1f\x8b", b"\x28\xb5\x2f\xfd", b"WARC/"
#: Bytes unpacked at a time.
STEP = 1 << 16
RESPONSE = "record_id string, target_uri string, date string, http_head string, payload binary"
DERIVED = (
    "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
    "source_head string, source_payload_digest string, source_block_digest string, content_type string, "
    "block_digest string, block string, warc_header string"
)
UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAKS = re.compile(
    r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|hr|title|body|head)\b[^<>]*>",
    re.I,
)
TAGS = re.compile(r"<[a-z/!?][^<>]*>", re.I)
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
CHUNK_SIZE = re.compile(rb"[0-9A-Fa-f]{1,16}")
LENGTH = re.compile(r"[0-9]{1,18}")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """What a reader sees: no scripts, styles, comments or tags; a line per block, single spaces, no empty lines."""
    shown = html.unescape(TAGS.sub("", BREAKS.sub("\n", UNSEEN.sub("", page))))
    lines = (" ".join(line.split()) for line in shown.split("\n"))
    return "\n".join(line for line in lines if line)


def decoded(payload: bytes, head: str) -> str:
    """The payload as text, in the charset its head names, else UTF-8; what can't be read becomes U+FFFD."""
    named = CHARSET.search(head)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def header_fields(head: str) -> dict[str, str]:
    """Header lines by lower-case name; repeated ones are joined by a comma, lines without a colon are left out."""
    out: dict[str, str] = {}
    for line in head.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def _unchunked(data: bytes) -> tuple[bytes, str | None]:
    """A chunked body in one piece. A body that doesn't begin with a chunk's size was joined by the archiver."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at : end if end >= 0 else len(data)].split(b";")[0].strip()
        if not CHUNK_SIZE.fullmatch(size):
            return (b"".join(parts), "chunked: not a size") if parts else (data, None)
        n = int(size, 16)
        if n == 0:
            return b"".join(parts), None
        if end < 0 or len(data) < end + 2 + n:
            return b"".join(parts) + (data[end + 2 :] if end >= 0 else b""), "chunked: cut off"
        parts.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n
        at += 2 if data[at : at + 2] == b"\r\n" else 0


def _inflated(data: bytes, bits: int) -> tuple[bytes, str | None]:
    """What a deflate stream gives up to where it is damaged; further gzip members follow on the first."""
    out, rest = [], data
    while rest:
        packer = zlib.decompressobj(bits)
        view = memoryview(rest)
        try:
            for i in range(0, len(rest), STEP):
                out.append(packer.decompress(view[i : i + STEP]))
                if packer.eof:
                    rest = packer.unused_data + bytes(view[i + STEP :])
                    break
            else:
                return b"".join(out), "deflate: cut off"
        except zlib.error:
            return b"".join(out), "deflate: damaged"
        if bits < 16 or rest[:2] != GZIP:
            break
    return b"".join(out), None


def _unframed(data: bytes) -> tuple[bytes, str | None]:
    """What the zstd frames give up to where one is damaged."""
    out = []
    while data[:4] == ZSTD:
        frame = zstandard.ZstdDecompressor().decompressobj()
        try:
            for i in range(0, len(data), STEP):
                out.append(frame.decompress(data[i : i + STEP]))
                if frame.eof:
                    break
        except zstandard.ZstdError:
            return b"".join(out), "zstd: damaged"
        if not frame.eof:
            return b"".join(out), "zstd: cut off"
        data = frame.unused_data + data[i + STEP :]
    return b"".join(out), None


def _uncompressed(coding: str, data: bytes) -> tuple[bytes, str | None]:
    """One content coding undone. Data without the coding's signature was unpacked by the archiver."""
    if coding in ("", "identity") or not data:
        return data, None
    if coding in ("gzip", "x-gzip"):
        return _inflated(data, 31) if data[:2] == GZIP else (data, None)
    if coding == "deflate":  # with the zlib header, as it should be, or bare, as some servers send it
        tries = [_inflated(data, bits) for bits in (15, -15)]
        whole = [t for t in tries if t[1] is None]
        return whole[0] if whole else (data, None) if data.lstrip()[:1] == b"<" else max(tries, key=lambda t: len(t[0]))
    if coding == "zstd":
        return _unframed(data) if data[:4] == ZSTD else (data, None)
    return (data, None) if data.lstrip()[:1] == b"<" else (b"", f"{coding}: unknown coding")


def body(head: str, payload: bytes) -> tuple[bytes, str | None]:
    """The payload without its transfer and content encodings, and what went wrong, if anything did."""
    named, problems = header_fields(head), []
    codings = [c.strip().lower() for k in ("content-encoding", "transfer-encoding") for c in named.get(k, "").split(",")]
    for coding in reversed(codings):  # the last was applied last
        payload, problem = _unchunked(payload) if coding == "chunked" else _uncompressed(coding, payload)
        problems += [problem] if problem else []
    return payload, "; ".join(problems) or None


def header(record_type: str, fields: list[tuple[str, str | None]], length: int) -> str:
    lines = [f"WARC-Type: {record_type}", *(f"{k}: {' '.join(v.split())}" for k, v in fields if v is not None)]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {length}", "", ""])


def derive(record_id: str, target: str | None, date: str | None, head: str | None, payload: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response. Null fields count as absent, a null payload as empty."""
    head, payload, date = head or "", payload or b"", date or UNDATED
    plain, problem = body(head, payload)
    page = decoded(plain, head)
    source = {
        "refers_to": record_id, "target_uri": target, "source_head": head, "source_payload_digest": digest(payload),
        "source_block_digest": digest(head.encode("utf-8", "replace") + payload),
    }
    ids = {kind: record_urn(kind, record_id) for kind in ("metadata", "conversion")}
    title, language = TITLE.search(page), LANGUAGE.search(page)
    status, *kept = head.split("\r\n")
    about = [("http-status", status)] if status else []
    about += [("source-header", line) for line in kept if line]
    about += [("payload-digest", source["source_payload_digest"]), ("block-digest", source["source_block_digest"])]
    about += [("content-problem", problem)] if problem else []
    about += [("title", html.unescape(title[1]))] if title else []
    about += [("language", language[1])] if language else []
    about += [("outlink", html.unescape(a or b or c)) for a, b, c in LINK.findall(UNSEEN.sub("", page))]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about)),
        "conversion": ("text/plain; charset=utf-8", plain_text(page)),
    }
    out = []
    for kind, (content_type, block) in blocks.items():
        data = block.encode("utf-8", "replace")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        fields = [
            ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", other), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(data)),
            ("Content-Type", content_type),
        ]
        out.append(source | {
            "record_type": kind, "record_id": ids[kind], "concurrent_to": other, "content_type": content_type, "block": block,
            "block_digest": digest(data), "warc_header": header(kind, fields, len(data)),
        })
    return out


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = UNDATED) -> DataFrame:
    """Response records of a table of pages; equal rows are equal records, a null url stays null and a null page is empty."""
    body = F.coalesce(F.col(page), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n")
    )
    name = F.sha1(F.concat_ws("\0", F.lit("response"), F.col(page_id).cast("string"), F.col(url)).cast("binary"))
    urn = F.regexp_replace(F.substring(name, 1, 32), r"(.{8})(.{4}).(.{3}).(.{3})(.{12})", r"<urn:uuid:$1-$2-5$3-8$4-$5>")
    return pages.select(F.col(page_id).alias("page_id"), urn.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"), head.alias("http_head"), body.alias("payload"))


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows per response: the fields of DERIVED, after whatever columns ``found`` has before ``record_id``."""
    keys = found.columns[: found.columns.index("record_id")]
    names = [c.split()[0] for c in DERIVED.split(", ")]

    def work(part: pa.RecordBatch) -> dict:
        columns = (part.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "http_head", "payload"))
        made = [derive(*row) for row in zip(*columns, strict=True)]
        which = pa.array([i for i, records in enumerate(made) for _ in records], pa.int64())
        return {k: part.column(k).take(which) for k in keys} | {n: [r[n] for records in made for r in records] for n in names}

    kinds = [f"`{k}` {found.schema[k].dataType.simpleString()}" for k in keys]
    return map_slices(found, "payload", work, ", ".join([*kinds, DERIVED]))


def serialized(records: DataFrame, compress: bool = True) -> DataFrame:
    """``records`` with the bytes of each record, a gzip member of its own, in ``warc``; a file is any of them in a row."""

    def work(part: pa.RecordBatch) -> dict:
        out = {n: part.column(n) for n in names}
        both = zip(part.column("warc_header").to_pylist(), part.column("block").to_pylist(), strict=True)
        whole = [(h + b + "\r\n\r\n").encode("utf-8", "replace") for h, b in both]
        return out | {"warc": [_gzip(w) for w in whole] if compress else whole}

    names = records.columns
    return map_slices(records, "block", work, StructType([*records.schema.fields, StructField("warc", BinaryType())]))


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """Offset and content of each gzip member; None for a stretch that holds no whole member."""
    at, view, lost = 0, memoryview(data), -1
    while at < len(data):
        unpacked, found, end = zlib.decompressobj(31), [], at
        try:
            while not unpacked.eof and end < len(data):
                found.append(unpacked.decompress(view[end : end + STEP]))
                end = min(end + STEP, len(data))
        except zlib.error:
            pass
        if unpacked.eof:
            if lost >= 0:
                yield lost, None
            yield at, b"".join(found)
            at, lost = end - len(unpacked.unused_data), -1
        else:  # go on where the next member may begin
            lost = at if lost < 0 else lost
            following = data.find(GZIP + b"\x08", at + 1)
            at = following if following >= 0 else len(data)
    if lost >= 0:
        yield lost, None


def _next_record(data: bytes, at: int) -> int:
    """Where the next line that begins a record is; the end if none is."""
    found = data.find(b"\r\n" + VERSION, at)
    return found + 2 if found >= 0 else len(data)


def scan(data: bytes) -> Iterator[tuple[int, dict[str, str] | None, bytes, str | None]]:
    """Each record of a WARC file (offset, header fields, block, None), and each stretch that is none (offset, None, bytes,
    problem). The offset is that of the gzip member where the file has members.

    After a damaged member the next whole one is read, after a malformed record the next line that begins one.
    """
    packed = data[:2] == GZIP
    rest, start = b"", 0
    for at, part in _members(data) if packed else [(0, data)]:
        if part is None:
            if rest:
                yield start, None, rest, "record cut off"
            rest = b""
            yield at, None, b"", "damaged member"
            continue
        start, rest, begin = start if rest else at, rest + part, 0
        while True:
            while rest[begin : begin + 2] == b"\r\n":  # two line ends close the record before
                begin += 2
            place = start if packed else start + begin
            end = rest.find(b"\r\n\r\n", begin)
            if begin < len(rest) and not VERSION.startswith(rest[begin : begin + len(VERSION)]):
                problem = "no record"
            elif end < 0:
                break
            else:
                lines = rest[begin:end].decode("utf-8", "replace").split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                length, problem = fields.get("content-length", ""), None
                if not LENGTH.fullmatch(length):
                    problem = "no valid Content-Length"
            if problem:
                following = _next_record(rest, begin)
                yield place, None, rest[begin:following], problem
                begin = following
                continue
            if len(rest) < end + 4 + int(length):
                break
            yield place, fields, rest[end + 4 : end + 4 + int(length)], None
            begin = end + 4 + int(length)
            start = at if packed else start
        start, rest = start if packed else start + begin, rest[begin:]
    if rest:
        yield start, None, rest, "record cut off"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each whole record of a WARC file, plain or gzipped member by member."""
    return ((fields, block) for _, fields, block, _ in scan(data) if fields is not None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, with the file's ``path`` first. A task holds one file at a time, customarily of 1 GB;
    Spark reads none over 2 GB. Records that a file holds no longer whole are those of ``damages``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for fields, block in parse(content.as_py()):
                    if fields.get("warc-type") != "response":
                        continue
                    head, mark, payload = block.partition(b"\r\n\r\n")
                    row = [
                        name.as_py(), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"),
                        (head + mark).decode("latin-1"), payload,
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, KINDS, strict=True)], NAMES)

    return files.mapInArrow(run, "path string, " + RESPONSE)


def damages(spark: SparkSession, path: str) -> DataFrame:
    """A row per part of WARC files that is no whole record: ``path``, ``offset`` in the file, and the ``problem``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                found = [(at, problem) for at, fields, _, problem in scan(content.as_py()) if fields is None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * len(found), pa.string()), pa.array([at for at, _ in found], pa.int64()),
                        pa.array([problem for _, problem in found], pa.string()),
                    ],
                    ["path", "offset", "problem"],
                )

    return files.mapInArrow(run, "path string, offset long, problem string")


NAMES = ["path", *(c.split()[0] for c in RESPONSE.split(", "))]
KINDS = [pa.string()] * 5 + [pa.binary()]
